"""Concordance index of a whole table, exact, in near-linear work.

Order the rows by prediction (descending, ties by key). Over all pairs, a row
scores 1 against a later one with a smaller label and 0.5 if the labels are
equal. Ties need only label counts. For the rest every row is reduced to two
ranks: r, its place by prediction, and q, its place by (label, r). Equal labels
then ascend in q, so the wins are exactly the pairs with r_i < r_j, q_i > q_j.

Both ranks are permutations of 0..n-1. Cutting r into blocks and q into cells
of the same size gives blocks and cells that cannot be skewed, and three kinds
of pairs: different block and cell (from the counts alone), same block but
different cell, and same cell. The last two are counted inside one block or
cell, of about four times the square root of n rows (16 million for 10^13).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chatwarden.operators.ranks import global_rank

MIN_BLOCK_ROWS = 1 << 14


def descents(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], one bit of the values at a time."""
    values = np.asarray(values, dtype=np.int64)
    total, bits = 0, int(values.max()).bit_length() if values.size else 0
    for bit in range(bits - 1, -1, -1):
        prefix = values >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        ones = (values[order] >> bit) & 1
        seen = np.cumsum(ones) - ones
        first = np.r_[True, np.diff(prefix[order]) != 0]
        at_start = seen[first][np.cumsum(first) - 1]
        total += int(((seen - at_start) * (1 - ones)).sum())
    return total


def _count_inside(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].to_numpy()
        return pd.DataFrame({"wins": [descents(values - values.min())]})

    return rows.groupBy(group).applyInPandas(count, "wins LONG")


def concordance(
    pairs: DataFrame,
    key: str = "key",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    block_rows: int | None = None,
) -> DataFrame:
    """One row: ``n_pairs``, ``wins``, ``ties`` and ``concordance`` (NULL if n < 2).

    Rows with a missing label or prediction (NULL or NaN) are in no pair.
    """
    labelled = pairs.select(
        F.col(key).alias("_key"), F.col(y_true).alias("_y"), F.col(y_pred).alias("_p")
    )
    for c in ("_y", "_p"):
        labelled = labelled.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    by_prediction = global_rank(labelled, [F.desc("_p"), F.col("_key")], "_r").select("_r", "_y")
    ranks = global_rank(by_prediction, [F.col("_y"), F.col("_r")], "_q")
    n = ranks.count()
    size = block_rows or max(MIN_BLOCK_ROWS, 4 * math.isqrt(n))
    parts = -(-n // size)
    cut = ranks.select(
        F.col("_r"),
        F.col("_q"),
        F.expr(f"_r div {size}").alias("_block"),
        F.expr(f"_q div {size}").alias("_cell"),
    )
    inside = _count_inside(cut, "_block", "_r", "_cell").unionByName(
        _count_inside(cut, "_cell", "_r", "_q")
    )
    wins = inside.unionByName(_wins_between(cut, parts)).agg(
        F.coalesce(F.sum(F.col("wins").cast("decimal(38,0)")), F.lit(0)).alias("wins")
    )
    equal = ranks.groupBy("_y").agg(F.count("*").cast("decimal(38,0)").alias("c"))
    ties = equal.agg(
        F.coalesce(F.sum(F.expr("c * (c - 1) / 2").cast("decimal(38,0)")), F.lit(0)).alias("ties")
    )
    # 64 bits hold the pairs of four billion rows, so the totals are decimals.
    n_pairs = F.lit(str(n * (n - 1) // 2)).cast("decimal(38,0)")
    tied = ties.scalar()
    score = F.col("wins").cast("double") + tied.cast("double") * 0.5
    return wins.select(
        n_pairs.alias("n_pairs"),
        F.col("wins").cast("decimal(38,0)").alias("wins"),
        tied.cast("decimal(38,0)").alias("ties"),
        F.try_divide(score, n_pairs.cast("double")).alias("concordance"),
    )


def _wins_between(cut: DataFrame, parts: int) -> DataFrame:
    """Wins between different blocks and different cells, from the count grid.

    The grid has one entry per pair of a block and a cell, a sixteenth of n or
    less; each window below runs over one row or column of it.
    """
    counts = cut.groupBy("_block", "_cell").agg(F.count("*").alias("_n"))
    blocks = cut.sparkSession.range(parts).withColumnRenamed("id", "_block")
    cells = F.sequence(F.lit(0).cast("long"), F.lit(max(parts - 1, 0)).cast("long"))
    grid = blocks.withColumn("_cell", F.explode(cells))
    grid = grid.join(counts, ["_block", "_cell"], "left").fillna(0, ["_n"])
    all_before = (Window.unboundedPreceding, -1)
    down_blocks = Window.partitionBy("_cell").orderBy(F.desc("_block"))
    up_cells = Window.partitionBy("_block").orderBy("_cell")
    later_blocks = down_blocks.rowsBetween(*all_before)
    smaller_cells = up_cells.rowsBetween(*all_before)
    return (
        grid.withColumn("_later", F.coalesce(F.sum("_n").over(later_blocks), F.lit(0)))
        .withColumn("_beaten", F.coalesce(F.sum("_later").over(smaller_cells), F.lit(0)))
        .filter(F.col("_n") > 0)
        .select((F.col("_n") * F.col("_beaten")).alias("wins"))
    )
