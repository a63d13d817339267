"""Missing values, odd shapes and repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatwarden.functions.arrays import list_median
from chatwarden.operators.cleaning import drop_malformed, parse_windows
from chatwarden.operators.concordance import concordance
from chatwarden.operators.metrics import drop_short_batch
from chatwarden.operators.vectors import nearest_rows
from chatwarden.plans.stream_queries import stream_scores
from chatwarden.sources import stores
from chatwarden.streaming.scoring import append_stream
from chatwarden.streaming.windows import stream_windows

CELLS = {
    "['a'] x": None, "['a']['b']": None, "['a', NaN]": None, "[NaN]": None, "['a', true]": None,
    "['a', 'b']": ["a", "b"], "['a', 1]": ["a", "1"], "[]": [], "['[x], y']": ["[x], y"], " ['a'] ": ["a"],
    "['a' 'b']": ["ab"], '["it\'s"]': ["it's"],
}


def test_only_whole_lists_are_read(spark):
    df = spark.createDataFrame([(c, "[1]") for c in CELLS], "cell string, n string").withColumn("raw", F.col("cell"))
    found = {r.raw: r.cell for r in parse_windows(df, ["cell"], ["n"]).collect()}
    assert found == CELLS
    numbers = spark.createDataFrame([("['a']", c) for c in ("[1][2]", "[1] 3", "[1, 2.5]", "[1")], "t string, n string")
    kept = drop_malformed(parse_windows(numbers, ["t"], ["n"]), ["t"], ["n"])
    assert [r.n for r in kept.collect()] == [[1.0, 2.5]]


def test_median_of_missing(spark):
    rows = [([None, 1.0, 2.0],), ([float("nan"), 1.0, 2.0],), ([None, 5.0],), ([3.0, 1.0],), ([],)]
    found = spark.createDataFrame(rows, "x array<double>").select(list_median(F.col("x"))).collect()
    assert [r[0] for r in found] == [None, None, None, 2.0, None]


def test_short_batch_needs_a_key(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key int")
    assert drop_short_batch(keys(1, 2, 3, 4, 5, 6, 7), "key", 3).count() == 6
    for rows in (keys(1, 2, 3, 4, 5, 5, 5), keys(1, 2, 3, None)):
        with pytest.raises(ValueError):
            drop_short_batch(rows, "key", 3)


def test_missing_labels_are_in_no_pair(spark):
    schema = "key int, y_true double, y_pred double"
    rows = [(1, 1.0, 3.0), (2, 2.0, 2.0), (3, None, 1.0), (4, 5.0, float("nan")), (5, 5.0, None)]
    both = [concordance(spark.createDataFrame(x, schema)).first() for x in (rows, rows[:2])]
    assert both[0] == both[1]


def test_ragged_vectors_are_refused(spark):
    vectors = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 2)], "sample_id long, embedding array<float>")
    centers = spark.createDataFrame([(0, [0.0] * 3)], "cluster_id int, center array<double>")
    with pytest.raises(Exception, match="3 values"):
        nearest_rows(vectors.coalesce(1), centers, 2).collect()


def test_embeddings_stored_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5], 20, "train")], "sample_id long, embedding array<float>, seq_length int, split string")
    for part in (rows, rows, rows.withColumn("split", F.lit("val"))):
        stores.write_embeddings(part, str(tmp_path / "e"))
    assert stores.read_embeddings(spark, str(tmp_path / "e"), 20).count() == 2


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "embeddings", "events", "customer", "conversations", "orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert stream_scores(spark, str(tmp_path)).count() == docs.count()


def test_streamed_whole_numbers_stay_exact_beside_missing_ones(spark, tmp_path):
    big = 9007199254740993  # no double is equal to it
    rows = [("g", 1, big), ("g", 2, None), ("g", 3, big + 2)]
    table = spark.createDataFrame(rows, "grp string, id long, n long")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    found = stream_windows(stream, "grp", ["id"], ["n"], 2, 1)
    out = str(tmp_path / "out")
    append_stream(found, out, str(tmp_path / "state")).awaitTermination()
    got = [list(r.n) for r in spark.read.parquet(out).orderBy("window_start").collect()]
    assert got == [[big, None], [None, big + 2]]
