"""Split tables, embeddings, centers and models on shared storage."""

from __future__ import annotations

from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from chatwarden import schema


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split; reading one split touches only its files."""
    df.write.partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """One split, or the union of all of them."""
    table = spark.read.parquet(path)
    return table if wanted is None else table.filter(F.col("split") == wanted)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """Embeddings in folders by sequence length and split; the folders written replace
    what was stored there, others stay."""
    replacing = embeddings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    replacing.partitionBy("seq_length", "split").parquet(path)


def read_embeddings(
    spark: SparkSession, path: str, seq_length: int, split: str | None = None
) -> DataFrame:
    table = spark.read.parquet(path).filter(F.col("seq_length") == seq_length)
    return table if split is None else table.filter(F.col("split") == split)


def write_centers(centers: DataFrame, path: str) -> None:
    centers.write.parquet(path)


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.CENTERS).parquet(path)


def write_assignments(assignments: DataFrame, path: str) -> None:
    assignments.write.parquet(path)


def save_kmeans(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> KMeansModel:
    return KMeansModel.load(path)
