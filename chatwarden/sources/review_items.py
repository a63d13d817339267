"""Review items, decisions and player assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatwarden import schema


def read_review_items(spark: SparkSession, path: str) -> DataFrame:
    """Nested records, one JSON object per line, with the declared schema."""
    return spark.read.schema(schema.REVIEW_ITEM).json(path)


def write_review_items(items: DataFrame, path: str) -> None:
    items.write.json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.DECISIONS).parquet(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    decisions.write.mode("append").parquet(path)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PLAYER_ASSESSMENT).parquet(path)
