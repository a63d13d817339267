"""Regression and precision-recall metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.functions.arrays import binarize
from chatwarden.functions.fixed_values import BATCH_SIZE, BINARY_CUTOFF
from chatwarden.operators.ranks import running_sums


def mean_baseline(train: DataFrame, validation: DataFrame, label: str = "y_true") -> DataFrame:
    """Mean training label, and the error of predicting it on the validation rows."""
    mean = train.agg(F.avg(label)).scalar()
    return validation.agg(
        F.avg(F.abs(F.col(label) - mean)).alias("baseline_mae"), F.count("*").alias("n_validation")
    ).select(mean.alias("mean_label"), "baseline_mae", "n_validation")


def squared_error(pairs: Sequence[tuple[str, str]]) -> Column:
    """Mean squared error per (label, prediction) column pair, summed over pairs."""
    total = F.lit(0.0)
    for y, p in pairs:
        total = total + F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))
    return total


def absolute_error(pair: tuple[str, str] | None) -> Column:
    """Mean absolute error of a (label, prediction) pair; 0 if there is no pair."""
    if pair is None:
        return F.lit(0.0)
    y, p = pair
    return F.avg(F.abs(F.col(p) - F.col(y)))


def errors(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``mse`` over all outputs, ``mae`` of the first and ``mae_second`` of the second."""
    second = pairs[1] if len(pairs) > 1 else None
    return rows.agg(
        squared_error(pairs).alias("mse"),
        absolute_error(pairs[0]).alias("mae"),
        absolute_error(second).alias("mae_second"),
    )


def drop_short_batch(rows: DataFrame, key: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Leaves out the rows after the last full batch in key order.

    They are fewer than a batch, so they are found with a top-k by key; the
    table is neither numbered nor sorted. The key has to tell rows apart: NULL
    keys, and a key at the limit that repeats, are refused.
    """
    n = rows.count()
    extra = n % batch_size
    if extra == 0:
        return rows
    first_left_out = rows.orderBy(F.desc(key)).limit(extra).agg(F.min(key)).first()[0]
    kept = rows.filter(F.col(key) < F.lit(first_left_out))
    if kept.count() != n - extra:
        raise ValueError(f"{key} is NULL or repeated, so the last batch is not defined")
    return kept


def epoch_errors(
    rows: DataFrame, key: str, pairs: Sequence[tuple[str, str]], batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Mean of the per-batch errors over the full batches in key order.

    Full batches weigh the same, so this is the error over all their rows.
    """
    return errors(drop_short_batch(rows, key, batch_size), pairs)


def regression_metrics(rows: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One row with ``mse mae pearson_r2 slope r0_squared rm_squared r2_score``.

    A metric is NULL where its denominator is zero.
    """
    y_col, p_col = F.col(y), F.col(p)
    sums = rows.agg(
        F.avg(y).alias("mean"),
        F.sum(y_col * p_col).alias("yp"),
        F.sum(p_col * p_col).alias("pp"),
    )
    facts = sums.select(F.struct("mean", F.try_divide("yp", "pp").alias("slope"))).scalar()
    mean, slope = facts.getField("mean"), facts.getField("slope")

    def square(x: Column) -> Column:
        return x * x

    found = rows.agg(
        F.avg(square(p_col - y_col)).alias("mse"),
        F.avg(F.abs(p_col - y_col)).alias("mae"),
        # corr() itself fails on a constant column in ANSI mode
        F.try_divide(square(F.covar_pop(y, p)), F.var_pop(y) * F.var_pop(p)).alias("pearson_r2"),
        F.max(slope).alias("slope"),
        F.sum(square(y_col - slope * p_col)).alias("_origin"),
        F.sum(square(y_col - p_col)).alias("_residual"),
        F.sum(square(y_col - mean)).alias("_total"),
    )
    r2, r02 = F.col("pearson_r2"), 1 - F.try_divide("_origin", "_total")
    return found.select(
        "mse",
        "mae",
        "pearson_r2",
        "slope",
        r02.alias("r0_squared"),
        (r2 * (1 - F.sqrt(F.abs(r2 * r2 - r02 * r02)))).alias("rm_squared"),
        (1 - F.try_divide("_residual", "_total")).alias("r2_score"),
    )


def binarized(rows: DataFrame, y: str, p: str, cutoff: float = BINARY_CUTOFF) -> DataFrame:
    """Label and score as 0/1 around a cutoff."""
    return rows.withColumns({y: binarize(F.col(y), cutoff), p: binarize(F.col(p), cutoff)})


def pr_curve(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score, and at the score before it.

    Counts are taken per score first; the running sums go over range
    partitions, so a score with as many values as rows is no single task.
    """
    per_score = rows.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n")
    )
    sums = running_sums(per_score, [F.desc("score")], {"_tp": "_p", "_seen": "_n"})
    positives = sums.agg(F.sum("_p")).scalar()
    hits, seen = F.col("_tp") - F.col("_p"), F.col("_seen") - F.col("_n")
    return sums.select(
        "score",
        F.try_divide(F.col("_tp"), F.col("_seen")).alias("precision"),
        F.try_divide(F.col("_tp"), positives).alias("recall"),
        F.coalesce(F.try_divide(hits, seen), F.lit(1.0)).alias("previous_precision"),
        F.try_divide(hits, positives).alias("previous_recall"),
    )


def pr_area(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids; NULL without positives."""
    width = F.col("recall") - F.col("previous_recall")
    height = (F.col("precision") + F.col("previous_precision")) / 2
    return pr_curve(rows, label, score).agg(F.sum(width * height).alias("pr_area"))


def best_model(metrics: DataFrame, model: str, mae: str) -> DataFrame:
    """The model with the lowest validation error; the first by name on a tie."""
    lowest = F.min(F.struct(F.col(mae), F.col(model)))
    return metrics.agg(lowest.alias("_b")).select(
        F.col("_b")[model].alias(model), F.col("_b")[mae].alias(mae)
    )
