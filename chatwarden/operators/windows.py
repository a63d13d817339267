"""Sliding message windows and the grouping operators around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatwarden.functions.fixed_values import GROUP_BATCH_ROWS, WINDOW_LENGTH, WINDOW_STEP
from chatwarden.operators.ranks import (
    chain_from_first,
    number_in_groups,
    part_offsets,
    range_sorted,
    running_sums,
)
from chatwarden.session import materialize

# Rows of a group that are put together to cut windows from.
PIECE_ROWS = 2_000


def sliding_windows(
    log: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Windows of up to ``length`` messages per group, ``step`` messages apart.

    With s = min(step, length), a window starts at every position k with
    k % s = 0 where k = 0 or a row exists at k - s + length; it holds the rows
    [k, k + length). A group no longer than ``length`` gives one short window.

    Returns ``group``, ``sample_id``, ``window_start``, ``n_messages`` and each
    of ``columns`` as an array in message order. Rows without a group are left
    out. ``order`` must be unique inside a group.

    Groups of any size take one way: rows are numbered in ranges of their
    group's order, then put together in pieces that overlap by ``length - 1``.
    """
    _check(length, step)
    rows = log.filter(F.col(group).isNotNull()).select(
        group, *order, *[c for c in columns if c not in order and c != group]
    )
    numbered = number_in_groups(rows, group, order, "_position")
    return _pieces(numbered, group, [group], columns, length, step, piece_rows)


def run_windows(
    log: DataFrame,
    group: str,
    order: Sequence[str],
    columns: Sequence[str],
    length: int = WINDOW_LENGTH,
    step: int = WINDOW_STEP,
    piece_rows: int = PIECE_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Like :func:`sliding_windows`, per run of consecutive rows of one group.

    The order is over the whole log. ``run_start`` is the rank of the run's
    first row in it and identifies the run.
    """
    _check(length, step)
    wanted = [c for c in columns if c not in order and c != group]
    rows = range_sorted(
        log.select(group, *order, *wanted), [F.col(c) for c in order], partitions
    )
    # Edges of the range partitions: one row each, so the windows over them and
    # the broadcasts are bounded by the number of partitions.
    by_part = Window.orderBy("_part")
    last_rows = rows.groupBy("_part").agg(F.max_by(F.struct(group), "_row").alias("_last"))
    edges = last_rows.join(part_offsets(rows), "_part").select(
        "_part", "_base", F.lag("_last").over(by_part).alias("_previous_part")
    )
    in_part = Window.partitionBy("_part").orderBy("_row")
    previous = F.coalesce(F.lag(F.struct(group)).over(in_part), F.col("_previous_part"))
    flagged = (
        rows.join(F.broadcast(edges), "_part")
        .withColumn("_rank", F.col("_base") + F.col("_row"))
        .withColumn(
            "_start",
            F.when(previous.isNull() | ~previous[group].eqNullSafe(F.col(group)), F.col("_rank")),
        )
    )
    starts = flagged.groupBy("_part").agg(F.max("_start").alias("_last_start"))
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = starts.select("_part", F.max("_last_start").over(earlier).alias("_carried"))
    runs = (
        flagged.join(F.broadcast(carried), "_part")
        .withColumn(
            "run_start",
            F.coalesce(
                F.last("_start", ignorenulls=True).over(
                    in_part.rowsBetween(Window.unboundedPreceding, 0)
                ),
                "_carried",
            ),
        )
        .withColumn("_position", F.col("_rank") - F.col("run_start"))
        .filter(F.col(group).isNotNull())
    )
    return _pieces(runs, group, [group, "run_start"], columns, length, step, piece_rows)


def _check(length: int, step: int) -> None:
    if length < 1 or step < 1:
        raise ValueError("length and step must be at least 1")


def _pieces(rows, group, keys, columns, length, step, piece_rows) -> DataFrame:
    """Windows of rows that have a ``_position``, cut from pieces of neighboring rows.

    A piece owns the starts in its range and is given the ``length - 1`` rows
    after it as well, so its last windows are complete. Its rows become one
    sorted list, and each start that it owns a slice of it: a row is sent twice
    at most, however many windows it is in, and no list is made for a row that
    starts none.
    """
    stride = min(step, length)
    starts = -(-max(piece_rows, length) // stride)
    size = stride * starts
    piece = F.floor(F.col("_position") / size).cast("long")
    shared = (F.col("_position") % size < length - 1) & (piece > 0)
    copies = F.when(shared, F.array(piece - 1, piece)).otherwise(F.array(piece))
    dealt = rows.withColumn("_piece", F.explode(copies))
    packed = dealt.groupBy(*keys, "_piece").agg(
        F.sort_array(F.collect_list(F.struct("_position", *columns))).alias("_rows")
    )
    # A start after the first needs a row at its own place - stride + length.
    reached = F.floor((F.size("_rows") - length + stride - 1) / stride)
    last = F.least(F.when(F.col("_piece") == 0, F.greatest(reached, F.lit(0))).otherwise(reached), F.lit(starts - 1))
    cut = (
        packed.withColumn("_last", last.cast("int"))
        .filter("_last >= 0")
        .withColumn("_start", F.explode(F.sequence(F.lit(0), "_last")))
        .withColumn("window_start", F.col("_piece") * size + F.col("_start") * stride)
        .withColumn("_window", F.slice("_rows", F.col("_start") * stride + 1, length))
    )
    return _finish(cut, group, keys, columns)


def _finish(framed: DataFrame, group: str, keys, columns) -> DataFrame:
    key_texts = [F.col(k).cast("string") for k in keys]
    return framed.select(
        *keys,
        F.concat_ws(":", *key_texts, "window_start").alias("sample_id"),
        "window_start",
        F.size("_window").alias("n_messages"),
        *[F.col("_window")[c].alias(c if c not in keys else f"{c}s") for c in columns],
    )


def group_summary(log: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The distinct groups with their row count and first row's order values."""
    first = F.min(F.struct(*order))
    return (
        log.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("n_rows"), first.alias("_first"))
        .select(group, "n_rows", *[F.col("_first")[c].alias(f"first_{c}") for c in order])
    )


def one_group(log: DataFrame, group: str, value) -> DataFrame:
    """Rows of one group, given as a value or a scalar; NULL matches nothing."""
    return log.filter(F.col(group) == (value if isinstance(value, Column) else F.lit(value)))


def group_batches(
    log: DataFrame, group: str, order: Sequence[str], batch_rows: int = GROUP_BATCH_ROWS
) -> DataFrame:
    """Assigns each whole group to a numbered batch of at least ``batch_rows`` rows.

    Groups are laid out in order of first appearance. A batch takes groups until
    it has the asked rows, and the next one begins with the group after; only the
    last may be short. No group is split, no number is left out. Only counts are
    moved: rows get their batch by joining on the group.

    Where a batch ends depends on where it begins. For every group, the group
    that would follow a batch beginning there is found with running sums, and
    the batches are the chain of those links from the first group.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be at least 1")
    summary = group_summary(log, group, order).withColumn("_one", F.lit(1))
    laid_out = running_sums(
        summary,
        [F.col(f"first_{c}") for c in order] + [F.col(group)],
        {"_through": "n_rows", "_rank": "_one"},
    )
    laid_out = materialize(laid_out.withColumn("_rank", F.col("_rank") - 1), "laid-out")
    # The group that fills a batch is the first with a running sum of at least what is asked:
    # as many groups are before it as have a smaller one.
    ends = laid_out.select(F.col("_through").alias("_at"), F.lit(1).alias("_end"), F.col("_rank").alias("_of"))
    wanted = laid_out.select(
        (F.col("_through") - F.col("n_rows") + batch_rows).alias("_at"), F.lit(0).alias("_end"), F.col("_rank").alias("_of")
    )
    counted = running_sums(ends.unionByName(wanted), [F.col(c) for c in ("_at", "_end", "_of")], {"_below": "_end"})
    groups = laid_out.agg(F.count("*")).scalar()
    follows = F.when(F.col("_below") + 1 < groups, F.col("_below") + 1)
    links = counted.where("_end = 0").select(F.col("_of").alias("_rank"), follows.alias("_next"))
    firsts = chain_from_first(links, "_rank", "_next").withColumn("_first", F.lit(1))
    marked = laid_out.join(firsts, "_rank", "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    batched = running_sums(marked, [F.col("_rank")], {"_batch": "_first"})
    return batched.select(group, "n_rows", (F.col("_batch") - 1).alias("batch_id"))
