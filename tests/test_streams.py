"""Streams: late messages, values as they were, states that end, repeated batches."""

import math
import time

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from chatwarden.streaming import scoring
from chatwarden.streaming.windows import stream_windows, write_windows

SCHEMA = "grp STRING, id INT, value DOUBLE, n BIGINT"


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / name) for name in ("windows", "late", "state")]
    assert write_windows(stream, "grp", ["id"], ["id", "value", "n"], *paths, length=2, step=1, **options).awaitTermination(90)
    found = spark.read.schema("grp STRING, window_start LONG, n_messages INT, late_messages LONG, id ARRAY<INT>, value ARRAY<DOUBLE>, n ARRAY<LONG>, batch_id INT")
    return found.parquet(paths[0]), spark.read.parquet(paths[1])


def test_late_messages_are_in_a_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [("a", i, float(i), i) for i in (10, 11, 12)])
    windows, late = run(spark, tmp_path)
    assert late.count() == 0 and windows.count() == 2
    arrive(spark, folder, [("a", 1, 0.5, None), ("a", 2, float("nan"), 2**60 + 1)])
    windows, late = run(spark, tmp_path)
    first, second = late.orderBy("id").collect()
    assert (first.grp, first.id, first.value, first.n) == ("a", 1, 0.5, None)
    assert (second.id, second.n) == (2, 2**60 + 1) and math.isnan(second.value)
    assert windows.count() == 2  # nothing new
    arrive(spark, folder, [("a", 13, None, None), ("a", 3, 3.0, 3)])
    windows, late = run(spark, tmp_path)
    assert late.count() == 3
    newest = windows.orderBy(F.desc("window_start")).first()
    assert (newest.window_start, newest.id, newest.late_messages, newest.value, newest.n) == (2, [12, 13], 3, [12.0, None], [12, None])


def test_values_stay_what_they_were(spark, tmp_path):
    table = spark.createDataFrame([("g", i, v, None) for i, v in enumerate([float("nan"), None, float("inf"), -0.0, 0.1])], SCHEMA)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    found = stream_windows(stream, "grp", ["id"], ["value"], 5, 1)
    scoring.append_stream(found, out, str(tmp_path / "state")).awaitTermination(90)
    value = spark.read.parquet(out).first().value
    assert math.isnan(value[0]) and value[1] is None and value[2:] == [float("inf"), 0.0, 0.1]
    assert math.copysign(1, value[3]) == -1


def test_the_state_of_an_idle_group_ends(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, [("a", 5, 1.0, 1), ("a", 6, 1.0, 1), ("b", 5, 1.0, 1)])
    run(spark, tmp_path, idle=1500)
    time.sleep(2)
    arrive(spark, folder, [("c", 1, 1.0, 1)])  # a batch in which the timers fire
    run(spark, tmp_path, idle=1500)
    arrive(spark, folder, [("a", 1, 1.0, 1), ("a", 2, 1.0, 1)])
    windows, late = run(spark, tmp_path, idle=600_000)
    assert late.count() == 0  # the group starts anew
    assert sorted((r.grp, r.window_start, r.id) for r in windows.collect()) == [("a", 0, [1, 2]), ("a", 0, [5, 6])]
    arrive(spark, folder, [("a", 0, 1.0, 1)])
    assert run(spark, tmp_path, idle=600_000)[1].count() == 1  # its state is kept this time


def test_a_batch_that_is_run_again_replaces_itself(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("sample_id"), F.col("id").cast("string").alias("chat"), (F.col("id") * 2.0).alias("x"))
    stages = [VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="x")]
    stored, queue = str(tmp_path / "model"), str(tmp_path / "queue")
    Pipeline(stages=stages).fit(rows).write().save(stored)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    # The first batch fails after its write: it is run again when the stream starts again.
    failing = scoring.start_batches(stream, lambda batch, i: (scoring.write_batch(batch, queue, i), 1 / 0), str(tmp_path / "state"))
    try:
        failing.awaitTermination(90)
    except Exception:
        pass
    assert spark.read.parquet(queue).count() == 6
    for _ in range(2):
        scoring.score_into_queue(stored, stream, queue, str(tmp_path / "state")).awaitTermination(90)
        found = spark.read.parquet(queue).orderBy("item_id").collect()
        assert [r.item_id for r in found] == list(range(6))
        assert all(abs(r.assessed_risk - 2 * r.item_id) < 1e-6 for r in found)
