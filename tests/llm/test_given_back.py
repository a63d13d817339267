"""What workers keep when a task has ended, and what they hold while a shard's grammar is built."""

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from chatwarden.session import small_batches
from chatwarden.llm import decontamination, jaccard_join, token_files, toxicity
from chatwarden.llm.queries import tokenizer_path
from chatwarden.llm.words import release

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROLLUP = Path("/proc/self/smaps_rollup")


def held_mb() -> float:
    return int(re.search(r"\nAnonymous:\s+(\d+)", ROLLUP.read_text())[1]) / 1024


@pytest.fixture
def passes(spark, monkeypatch):
    """The functions that go to workers, instead of their results."""
    made = []
    frame = type(spark.range(1))
    real = frame.mapInArrow

    def keep(self, function, schema, *rest):
        made.append(function)
        return real(self, function, schema, *rest)

    monkeypatch.setattr(frame, "mapInArrow", keep)
    return made


@pytest.mark.skipif(not ROLLUP.exists(), reason="memory can't be read here")
def test_a_worker_keeps_little_when_a_task_has_ended(spark, passes):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bits = jaccard_join.signatures(docs, "doc_id", "text")
    assert bits.columns[:2] == ["doc_id", "row"]
    count = passes[0]  # of frequent_cells
    rng = np.random.default_rng(0)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 4000))) for _ in range(200)]
    release()
    for batch in count(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])])):
        del batch
    ended = held_mb()
    release()
    assert ended - held_mb() < 15


def test_every_pass_gives_memory_back(spark, passes, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i % 7} b c d e f {i % 3}") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a1 b c d e f 1")], "item_id string, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    toxicity.score(docs, toxicity.train(docs, labels)).count()
    jaccard_join.keep_one(docs).count()
    decontamination.decontaminate(docs, items).count()
    token_files.token_digests(docs, tokenizer_path("byte_bpe_50k.json")).count()
    assert len(passes) > 10
    assert {f.__qualname__ for f in passes} == {"map_batches.<locals>.released"}


def test_encoding_gives_memory_back_before_the_grammar(monkeypatch):
    done = []
    repair = token_files.repair
    monkeypatch.setattr(token_files, "release", lambda: done.append("release"))
    monkeypatch.setattr(token_files, "repair", lambda ids, end: done.append(("repair", len(held))) or repair(ids, end))
    held = [np.arange(5, dtype=np.uint32), np.array([5, 9], np.uint32)]
    row = token_files._shard(0, 0, held, [1], [7], 9).to_pylist()[0]
    assert done == ["release", ("repair", 0), "release"]
    assert token_files.decode_document(row, 0).tolist() == [0, 1, 2, 3, 4, 5, token_files.END_ID]


def test_rounds_of_a_grammar_hold_nothing_of_the_round_before():
    ids = (np.random.default_rng(0).zipf(1.3, 1 << 20) % 50_000).astype(np.uint32)
    tracemalloc.start()
    _, rules, _ = token_files.repair(ids, 50_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rules) > 1000
    assert peak < 34 * len(ids)


def test_a_batch_is_about_one_block(spark):
    before = spark.conf.getAll.get(BATCH)
    try:
        spark.conf.unset(BATCH)
        small_batches(spark)
        wide = spark.range(3000).selectExpr("repeat('x', 1000) text").coalesce(1)
        sizes = wide.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
        assert max(r.n for r in sizes) < 1_000_000
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
