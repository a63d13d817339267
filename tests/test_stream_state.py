"""The state of a streamed group: what a call of it asks for and hands on."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Row, types as T

from chatwarden.streaming.windows import _Cutter


def test_a_group_takes_and_gives_rows_and_asks_for_its_tail_only_if_it_has_one():
    kept, asked = {}, []
    state = lambda name: SimpleNamespace(
        get=lambda: asked.append(name) or kept.get(name), update=lambda v: kept.update({name: v}), put=lambda v: kept.update({name: v})
    )
    handle = SimpleNamespace(getValueState=lambda name, _: state(name), getListState=lambda name, _: state(name))
    cutter = _Cutter("g", T.StructType([T.StructField("o0", T.LongType())]), 2, 1, None)
    cutter.init(handle)
    rows = lambda *at: iter([Row(_group=7, o0=i, message=f"{i}") for i in at])
    assert [tuple(r) for r in cutter.handleInputRows((7,), rows(3, 1, 2), None)] == [(7, 0, 1, 0, "[1,2,3]")]
    assert asked == ["counts"]
    assert [tuple(r) for r in cutter.handleInputRows((7,), rows(4, 0), None)] == [(7, 2, 2, 1, "[3,4]"), (7, None, None, 1, "[0]")]
    assert asked == ["counts", "counts", "tail"]
