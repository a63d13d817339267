"""Row numbers and running sums over a whole table, without one big task.

A global ``row_number`` would move the table into a single task. Here the table
is cut into sorted range partitions, written once, and numbered inside each
partition; the per-partition totals (one row per partition) give the offsets.
The written copy matters: range bounds come from a sample, and both passes have
to see the same partitions, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chatwarden.session import materialize

# monotonically_increasing_id() keeps the row number in the low 33 bits.
_ROW_BITS = 33


def range_sorted(
    df: DataFrame, order: Sequence[Column], partitions: int | None = None
) -> DataFrame:
    """Adds ``_part`` and ``_row``: the range partition and the row number in it.

    ``order`` must be unique per row; then equal sort values cannot pile up in
    one partition, however skewed the leading columns are. Without a number of
    ``partitions``, adaptive execution sizes them.
    """
    number = () if partitions is None else (partitions,)
    numbered = (
        df.repartitionByRange(*number, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumns(
            {
                "_part": F.shiftright("_id", _ROW_BITS),
                "_row": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
            }
        )
        .drop("_id")
    )
    return materialize(numbered, "range")


def _before(column: str) -> Column:
    """Running sum over all earlier partitions; its input has one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def part_offsets(sorted_df: DataFrame) -> DataFrame:
    """``_part``, ``_base``: rows in all earlier partitions."""
    sizes = sorted_df.groupBy("_part").agg(F.count("*").alias("_n"))
    return sizes.select("_part", _before("_n").alias("_base"))


def global_rank(
    df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Adds the 0-based rank of each row in a unique ``order``."""
    rows = range_sorted(df, order, partitions)
    # One row per range partition, so the broadcast is bounded by their number.
    return (
        rows.join(F.broadcast(part_offsets(rows)), "_part")
        .withColumn(name, F.col("_base") + F.col("_row"))
        .drop("_part", "_row", "_base")
    )


def rank_within(
    df: DataFrame,
    group: str,
    order: Sequence[Column],
    name: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Adds the 0-based rank inside the group; a huge group is spread over tasks."""
    rows = range_sorted(df, [F.col(group), *order], partitions)
    pieces = rows.groupBy("_part", group).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    earlier = (
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifts = pieces.select("_part", group, (before - F.col("_first")).alias("_shift"))
    return (
        rows.join(shifts, ["_part", group])
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], partitions: int | None = None
) -> DataFrame:
    """Adds ``{new column: summed column}`` as running sums that include the row."""
    rows = range_sorted(df, order, partitions)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()])
    bases = totals.select("_part", *[_before(f"_t_{new}").alias(f"_b_{new}") for new in sums])
    so_far = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(bases), "_part")
    for new, c in sums.items():
        out = out.withColumn(new, F.col(f"_b_{new}") + F.sum(c).over(so_far))
    return out.drop("_part", "_row", *[f"_b_{new}" for new in sums])


#: Equal ranges of a group's order in which its rows are numbered.
RANGES = 256


def _as_number(df: DataFrame, name: str) -> Column | None:
    """The column as a double in the same order (coarser, maybe), or None for other types."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # without a time zone, whose hours may repeat
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return (F.unix_date(F.to_date(value)) * F.lit(86_400.0) + seconds).cast("double")
    return None


def number_in_groups(
    df: DataFrame, group: str, order: Sequence[str], name: str = "position", ranges: int = RANGES
) -> DataFrame:
    """Adds the 0-based rank inside the group, by a plan that runs nothing beforehand.

    The first column of ``order`` cuts every group into equal ranges between the
    least and the largest value of the table, so a group of very many rows is
    many tasks. Rows are numbered inside their range; what stands before a range
    is a running sum over a row per group and range. Both sides see the same
    ranges, as least and largest are exact. An order that starts with a text has
    no such ranges and is numbered by :func:`rank_within`.
    """
    value = _as_number(df, order[0])
    if value is None:
        return rank_within(df, group, [F.col(c) for c in order], name)
    usable = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    # Two scalar subqueries over one column.
    low, high = (df.agg(f(usable).alias("x")).select("x").scalar() for f in (F.min, F.max))
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    inside = F.least(F.floor(share * ranges), F.lit(ranges - 1))
    place = (
        F.when(value.isNull(), -2)
        .when(value == F.lit(float("-inf")), -1)
        .when(F.isnan(value) | (value == F.lit(float("inf"))), ranges)
        .otherwise(inside)
    )
    placed = df.withColumn("_range", place.cast("int"))
    sizes = placed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside_range = Window.partitionBy(group, "_range").orderBy(*order)
    return (
        placed.withColumn("_row", F.row_number().over(inside_range) - 1)
        .join(bases, [group, "_range"])
        .withColumn(name, F.col("_base") + F.col("_row"))
        .drop("_range", "_base", "_row")
    )


def chain_from_first(links: DataFrame, key: str, follows: str) -> DataFrame:
    """The keys that are reached from key 0 by following ``follows`` again and again.

    Pointer doubling: after round r the links span 2^r steps and the first 2^r
    keys of the chain are known, so a chain of n keys takes log n rounds, each a
    join of the links with themselves. NULL ends the chain. Each round is written.
    """
    links = materialize(links.select(F.col(key).alias("k"), F.col(follows).alias("to")), "links")
    found = materialize(links.where("k = 0").select("k"), "chain")
    while True:
        more = found.join(links, "k").where("to IS NOT NULL").select(F.col("to").alias("k"))
        more = materialize(more, "chain")
        if more.isEmpty():
            return found.select(F.col("k").alias(key))
        found = materialize(found.unionByName(more), "chain")
        further = links.select(F.col("k").alias("to"), F.col("to").alias("beyond"))
        doubled = links.join(further, "to", "left").select("k", F.col("beyond").alias("to"))
        links = materialize(doubled, "links")
