"""Scoring of new chats into the review queue as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from chatwarden.operators.models import score_texts


def score_stream(
    model: Transformer, chats: DataFrame, key: str = "sample_id", text: str = "chat"
) -> DataFrame:
    """Queue rows of a streaming table of chats: id, preview and assessed risk.

    Every chat is scored by itself, so no state is kept.
    """
    return score_texts(model, chats, [key, text]).select(
        F.col(key).alias("item_id"),
        F.col(text).alias("preview"),
        F.col("predicted_risk").alias("assessed_risk"),
    )


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is available to a Parquet table, each row once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """The rows of one micro-batch, in a folder of its own that a repetition replaces."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def start_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hands all that is available to ``write``, a numbered micro-batch at a time."""
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def score_into_queue(
    model_path: str, chats: DataFrame, queue_path: str, checkpoint: str, key: str = "sample_id", text: str = "chat"
) -> StreamingQuery:
    """Scores arriving chats with a stored model into a queue table of micro-batches.

    A batch that is run again, after a failure between its write and its commit,
    replaces its own rows, so a chat is in the queue once. The model is read when
    the stream starts and stays the same until then.
    """
    model = PipelineModel.load(model_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(score_stream(model, batch, key, text), queue_path, batch_id)

    return start_batches(chats, write, checkpoint)
