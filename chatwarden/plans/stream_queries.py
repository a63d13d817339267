"""Streaming queries, run to the end of the given tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from chatwarden.operators.moderation import sort_by_risk
from chatwarden.plans import model_queries
from chatwarden.plans.roles import table
from chatwarden.plans.window_queries import windows_sql
from chatwarden.session import scratch_path
from chatwarden.streaming.scoring import append_stream, score_into_queue, score_stream
from chatwarden.streaming.windows import stream_windows as windows_of, write_windows

SLICES = 2
FILES_PER_SLICE = 4


def _event_files(spark, sf_dir) -> str:
    """``events`` as files that arrive one time slice after another."""
    path = scratch_path(spark, "arrivals")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    width = (high - low) / SLICES
    for i in range(SLICES):
        arrived = events.filter(F.col("ts") >= F.lit(low + i * width))
        if i < SLICES - 1:
            arrived = arrived.filter(F.col("ts") < F.lit(low + (i + 1) * width))
        arrived.repartition(FILES_PER_SLICE).write.mode("append").parquet(path)
    return path


def stream_windows(spark, sf_dir):
    path, out = _event_files(spark, sf_dir), scratch_path(spark, "stream-windows")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_SLICE)
    arriving = stream.parquet(path)
    found = windows_of(arriving, "user_id", ["ts", "event_id"], ["event_id", "value"])
    append_stream(found, out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select(
        "user_id",
        "window_start",
        "n_messages",
        F.array_join("event_id", ",").alias("event_ids"),
        F.round(F.aggregate("value", F.lit(0.0), lambda t, x: t + x), 6).alias("value_sum"),
        "late_messages",
    )


STREAM_WINDOWS = f"""
    SELECT user_id, pos AS window_start, CAST(20 AS INTEGER) AS n_messages,
           array_to_string(event_id, ',') AS event_ids, round(list_sum(value), 6) AS value_sum,
           CAST(0 AS BIGINT) AS late_messages
    FROM ({windows_sql('event_id value')}) WHERE len(event_id) = 20
"""


def stream_late(spark, sf_dir):
    """Messages that came after later ones of their user: each in a table, beside the windows.

    The messages of some hours arrive first, those of the others in a second run.
    """
    path = scratch_path(spark, "late-arrivals")
    windows, late = scratch_path(spark, "windows"), scratch_path(spark, "late")
    state = scratch_path(spark, "stream-state")
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES_PER_SLICE)
    first = F.hour("ts") % 10 >= 5
    for run, arrived in enumerate((events.filter(first), events.filter(~first))):
        arrived.repartition(FILES_PER_SLICE).write.parquet(f"{path}/arrival-{run}")
        arriving = stream.parquet(f"{path}/*")
        write_windows(arriving, "user_id", ["ts", "event_id"], ["value"], windows, late, state).awaitTermination()
    return spark.read.parquet(late).select("user_id", "ts", "event_id", "value")


STREAM_LATE = """
    WITH first AS (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE hour(ts) % 10 >= 5 GROUP BY user_id)
    SELECT user_id, ts, event_id, value FROM events JOIN first USING (user_id)
    WHERE hour(ts) % 10 < 5 AND (ts, event_id) <= last
"""


def stream_scores(spark, sf_dir):
    """Documents scored into the queue as they arrive as files; the queue by risk."""
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    # A pattern stands for the table as one file and as a folder of files.
    arriving = stream.parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", F.col("text").alias("chat"))
    out = scratch_path(spark, "stream-scores")
    scored = score_stream(model_queries.fitted(spark, sf_dir), arriving, "doc_id")
    append_stream(scored, out, scratch_path(spark, "stream-state")).awaitTermination()
    return sort_by_risk(spark.read.parquet(out)).select("item_id", "assessed_risk")


def stream_queue(spark, sf_dir):
    """A stored model scores documents into the queue as they arrive; a plain fit, so SQL has it too."""
    documents = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("length"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    plain = LinearRegression(regParam=0.0, solver="normal", labelCol="label")
    stages = [VectorAssembler(inputCols=["length"], outputCol="features"), plain]
    stored = scratch_path(spark, "queue-model")
    Pipeline(stages=stages).fit(documents.join(labels, "doc_id")).write().save(stored)
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    arriving = stream.parquet(f"{sf_dir}/documents.parque[t]").select(
        "doc_id", F.col("text").alias("chat"), (F.col("n_chars") / 1000.0).alias("length")
    )
    queue = scratch_path(spark, "queue")
    score_into_queue(stored, arriving, queue, scratch_path(spark, "stream-state"), "doc_id").awaitTermination()
    return spark.read.parquet(queue).select("item_id", "preview", F.round("assessed_risk", 6).alias("assessed_risk"))


STREAM_QUEUE = """
    WITH d AS (SELECT doc_id, text, n_chars / 1000.0::DOUBLE AS x FROM documents),
    f AS (SELECT regr_slope(CAST(quality AS DOUBLE), x) AS b, regr_intercept(CAST(quality AS DOUBLE), x) AS a
          FROM labels JOIN d USING (doc_id))
    SELECT doc_id AS item_id, text AS preview, round(a + b * x, 6) AS assessed_risk FROM d, f
"""


QUERIES = {
    "stream_windows": (stream_windows, STREAM_WINDOWS),
    "stream_late": (stream_late, STREAM_LATE),
    "stream_scores": (stream_scores, None),
    "stream_queue": (stream_queue, STREAM_QUEUE),
}
