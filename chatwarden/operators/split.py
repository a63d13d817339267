"""Train / validation / test splits that are repeatable."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.functions.fixed_values import SPLIT_SEED

_HISTOGRAM_CELLS = 1 << 14
_SMALL = 10_000


def id_hash(key: str, seed: int = SPLIT_SEED) -> Column:
    """Non-negative 63-bit hash of a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 1)


def hash_split(df: DataFrame, by: str, seed: int = SPLIT_SEED, name: str = "split") -> DataFrame:
    """80/10/10 by hash, one pass and no shuffle; sizes are close, not exact.

    Splitting ``by`` the alliance keeps overlapping windows on one side.
    """
    tenth = F.pmod(id_hash(by, seed), F.lit(10))
    label = F.when(tenth < 8, "train").when(tenth == 8, "val").otherwise("test")
    return df.withColumn(name, label)


def exact_split(
    df: DataFrame, key: str, hashed: Column | None = None, name: str = "split"
) -> DataFrame:
    """80/10/10 with exact sizes, in the order of (hash, key).

    A fifth (rounded up) is taken off, then halved with the test part rounded
    up. The two limits between the parts are looked up with histograms of the
    hash, so the rows themselves are never sorted or moved: the split is a
    projection.
    """
    hashed = id_hash(key) if hashed is None else hashed
    keys = df.select(hashed.alias("_h"), F.col(key).alias("_k"))
    n, low, high = keys.agg(F.count("*"), F.min("_h"), F.max("_h")).first()
    if n == 0:
        return df.withColumn(name, F.lit("train"))
    held_out = math.ceil(0.2 * n)
    train = n - held_out
    val = held_out - math.ceil(0.5 * held_out)

    def up_to(rows: int) -> Column:
        if rows == 0:
            return F.lit(False)
        h, k = _nth(keys, rows - 1, low, high)
        return (hashed < h) | ((hashed == h) & (F.col(key) <= F.lit(k)))

    label = F.when(up_to(train), "train").when(up_to(train + val), "val").otherwise("test")
    return df.withColumn(name, label)


def _nth(keys: DataFrame, n: int, low: int, high: int):
    """The (hash, key) at 0-based rank n: narrow the hash range, then look inside."""
    while True:
        width = -(-(high - low + 1) // _HISTOGRAM_CELLS)
        inside = keys.filter(F.col("_h").between(low, high))
        cell = F.expr(f"(_h - {low}L) div {width}L")
        # At most _HISTOGRAM_CELLS rows come back.
        counts = sorted(inside.groupBy(cell.alias("c")).count().collect())
        for c, size in counts:
            if n < size:
                break
            n -= size
        low, high = low + c * width, min(high, low + (c + 1) * width - 1)
        if size <= _SMALL or width == 1:
            break
    inside = keys.filter(F.col("_h").between(low, high)).orderBy("_h", "_k").limit(n + 1)
    return inside.orderBy(F.desc("_h"), F.desc("_k")).first()
