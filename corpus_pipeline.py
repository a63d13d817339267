"""A training-data pipeline of five operators; every stage is written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. The first four return the columns of ``documents``; the last returns what
the token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatwarden.session import scratch_path
from chatwarden.llm import decontamination, jaccard_join, mixing, token_files, toxicity
from chatwarden.llm.common import table
from chatwarden.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field of operator 6 does not find toxic."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic")
    return toxicity.score(docs, field).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 7."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 does not find contaminated, unchanged."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as operator 10 takes them."""
    return mixing.emit(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, size and checksum of each document in the token files of operator 5."""
    return token_files.token_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: A trained field and a tokenizer decide on the rows, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
