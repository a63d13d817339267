"""What workers hold at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chatwarden.session import small_batches
from chatwarden.llm import words
from chatwarden.llm.common import as_bytes

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_cut_by_bytes(spark):
    before = spark.conf.getAll.get(BATCH)
    try:
        spark.conf.unset(BATCH)
        small_batches(spark)
        wide = spark.range(3000).selectExpr("repeat('x', 10000) text").coalesce(1)
        sizes = wide.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
        assert max(r.n for r in sizes) < 5 << 20
        spark.conf.set(BATCH, "1m")
        small_batches(spark)
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


def test_texts_of_a_batch_are_not_all_held():
    column = pa.array(["y" * 10_000] * 2000 + [None])
    tracemalloc.start()
    assert sum(map(len, as_bytes(column))) == 20_000_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5_000_000


def test_powers_take_no_more_than_is_asked(monkeypatch):
    monkeypatch.setattr(words, "worker_cache", dict)
    up, down = words.powers(np.uint64(3), (1 << 20) + 1)
    assert len(up) == len(down) == (1 << 20) + 1
    assert len(up.base) < 1.3 * (1 << 20)
