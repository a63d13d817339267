"""Column functions over numeric lists and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def list_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def list_mean(values: Column) -> Column:
    """Mean of a list; NULL for an empty list."""
    return F.try_divide(list_sum(values), F.size(values))


def list_median(values: Column) -> Column:
    """Median of a list, the mean of the middle two when the size is even.

    NULL for an empty list and for a list with a missing value (NULL or NaN).
    """
    ordered = F.sort_array(values)
    size = F.size(values)
    lower = F.element_at(ordered, F.floor((size + 1) / 2).cast("int"))
    upper = F.element_at(ordered, (F.floor(size / 2) + 1).cast("int"))
    missing = F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return F.when((size > 0) & ~missing, (lower + upper) / 2)


def risk_label(scores: Column) -> Column:
    """Training label: the mean score, moved from [-1, 7] to [0, 1]."""
    return (list_mean(scores) + 1) / 8


def euclidean(left: Column, right: Column) -> Column:
    """Distance of two vectors of the same length."""
    squares = F.zip_with(
        left.cast("array<double>"), right.cast("array<double>"), lambda a, b: (a - b) * (a - b)
    )
    return F.sqrt(list_sum(squares))


def is_clean(values: Column, numeric: bool) -> Column:
    """True for a list that was read and holds no missing value."""
    bad = (lambda x: x.isNull() | F.isnan(x)) if numeric else (lambda x: x.isNull())
    return values.isNotNull() & ~F.exists(values, bad)


def binarize(score: Column, cutoff: float) -> Column:
    """0 below the cutoff, else 1."""
    return F.when(score < cutoff, 0).otherwise(1)
