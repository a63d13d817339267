"""Single steps of the operators: what they look at, how many jobs they run."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chatwarden.llm import common, jaccard_join, token_files
from chatwarden.llm.queries import tokenizer_path


def test_only_texts_that_may_be_uneven_are_looked_at_one_by_one(monkeypatch):
    words = token_files.WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["", "a b", " a", "a ", "a  b", "a\n b", "a \n", "a\n", "a  b", "　 ", "  x", "é b", "à b", "a\x1f b", "\x85 a"]
    texts += [f"x{special.decode()} y" for special in words.special] + ["plain text", "", ""]
    wanted = [bool(token_files._UNEVEN.search(t)) or any(s.decode() in t for s in words.special) for t in texts]
    for order in (slice(None), slice(None, None, -1)):
        assert words._uneven([t.encode() for t in texts[order]]) == wanted[order]
    assert words._uneven([]) == []
    looked = []
    monkeypatch.setattr(token_files, "_UNEVEN", SimpleNamespace(search=looked.append))
    words.encode([b"one plain text"] * 1000 + [b"two  spaces"])
    assert looked == ["two  spaces"]


@pytest.mark.parametrize("made", ["sized", "fixed", "cells"])
def test_bit_tables_run_no_job_for_each_partition(spark, made):
    context, conf = spark.sparkContext, spark.conf
    held = {c: conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    conf.set("spark.sql.shuffle.partitions", "40")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup(made, made)
    try:
        keys = spark.range(200).select(F.xxhash64("id").alias("k"), F.concat_ws(" ", *[F.col("id") + i for i in range(9)]).alias("t"))
        if made == "cells":
            jaccard_join.frequent_cells(keys, "t")
        else:
            bits = jaccard_join.sized_bits(keys, "k") if made == "sized" else common.bit_table(keys, "k")
            assert common.in_bit_table(bits, keys.toPandas()["k"].to_numpy()).all()
        assert len(context.statusTracker().getJobIdsForGroup(made)) < 10
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for c, value in held.items():
            conf.set(c, value)
