"""Linear risk models of several outputs, fitted and searched from one pass of sums.

A linear model with a quadratic penalty depends on its rows only through the
products of their columns: with A = [vector, labels, 1], the matrix A'A holds all
of them. Each task sums A'A over its Arrow batches, the partial matrices are
added in two steps, and models of every penalty and for every label follow from
one decomposition on the driver. The search scores all of them in a single pass
over the validation rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Partial matrices that reach the driver.
_MERGERS = 16
_SUMS = T.StructType([T.StructField("sums", T.BinaryType())])


@dataclass
class Sums:
    """A'A of some rows: ``width`` places of the vector, the labels, and the count."""

    matrix: np.ndarray
    width: int
    labels: tuple[str, ...]

    @property
    def count(self) -> int:
        return int(self.matrix[-1, -1])


@dataclass
class LinearModel:
    """``weights[place, label]`` and an intercept per label."""

    penalty: float
    labels: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercepts


def _complete(rows: DataFrame, labels: Sequence[str], vector: str) -> DataFrame:
    """Vectors as doubles and labels; rows that miss a value take no part."""
    found = rows.select(
        F.col(vector).cast("array<double>").alias("_x"), *[F.col(y).cast("double").alias(y) for y in labels]
    )
    known = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    for y in labels:
        known = known & F.col(y).isNotNull() & ~F.isnan(y) & (F.abs(F.col(y)) != float("inf"))
    return found.where(F.coalesce(known, F.lit(False)))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and the labels of a batch; vectors of unequal length are refused."""
    sizes = np.diff(batch.column(0).offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length")
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    y = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)]
    return x, np.column_stack(y) if y else np.zeros((batch.num_rows, 0))


def gram(rows: DataFrame, labels: Sequence[str], vector: str = "embedding") -> Sums | None:
    """The sums of all rows that have a vector and every label; None without such rows."""
    extra = len(labels) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = _matrices(batch)
                a = np.hstack([x, y, np.ones((len(x), 1))])
                if total is not None and total.shape[0] != a.shape[1]:
                    raise ValueError("vectors of unequal length")
                total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                one = np.frombuffer(cell)
                if total is not None and total.shape != one.shape:
                    raise ValueError("vectors of unequal length")
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    partial = _complete(rows, labels, vector).mapInArrow(add, _SUMS)
    parts = partial.repartition(_MERGERS).mapInArrow(merge, _SUMS).collect()
    if not parts:
        return None
    sizes = {len(r.sums) for r in parts}
    if len(sizes) > 1:
        raise ValueError("vectors of unequal length")
    total = sum(np.frombuffer(r.sums) for r in parts)
    side = round(len(total) ** 0.5)
    return Sums(total.reshape(side, side), side - extra, tuple(labels))


def solve(sums: Sums, penalties: Sequence[float]) -> list[LinearModel]:
    """The model of every penalty p: least mean squared error + p * squared length of the
    weights, per label; the intercept is not penalised."""
    d, n = sums.width, sums.matrix[-1, -1]
    means = sums.matrix[-1, :-1] / n
    centered = sums.matrix[:-1, :-1] / n - np.outer(means, means)
    values, axes = np.linalg.eigh(centered[:d, :d])
    cross = axes.T @ centered[:d, d:]
    out = []
    for penalty in penalties:
        scale = values + penalty
        usable = scale > 1e-12 * max(values.max(initial=0.0), 1e-300)  # else a direction without variance
        inverse = np.where(usable, 1 / np.where(usable, scale, 1), 0.0)
        weights = axes @ (cross * inverse[:, None])
        out.append(LinearModel(float(penalty), sums.labels, weights, means[d:] - means[:d] @ weights))
    return out


def fit(rows: DataFrame, labels: Sequence[str], penalty: float = 0.0, vector: str = "embedding") -> LinearModel:
    sums = gram(rows, labels, vector)
    if sums is None:
        raise ValueError("no rows to learn from")
    return solve(sums, [penalty])[0]


def predict(model: LinearModel, rows: DataFrame, keep: Sequence[str], vector: str = "embedding") -> DataFrame:
    """``keep`` and ``predicted_<label>`` of every row; NULL where the vector is missing."""
    names = [f"predicted_{y}" for y in model.labels]
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(n, T.DoubleType()) for n in names)])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # as wide as one vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            known = column.is_valid()
            have = column.filter(known)
            out = np.zeros((batch.num_rows, len(names)))
            if len(have):
                x = have.flatten().to_numpy(zero_copy_only=False).reshape(len(have), -1)
                out[known.to_numpy(zero_copy_only=False)] = shared.value.predict(x)
            missing = ~known.to_numpy(zero_copy_only=False)
            made = [pa.array(out[:, i], mask=missing) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=schema.names)

    return rows.select(*keep, F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def errors_of(models: Sequence[LinearModel], rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``penalty, label, n, mae, mse`` of every model and label, from one pass over the rows."""
    labels = models[0].labels
    shared = rows.sparkSession.sparkContext.broadcast(
        (np.hstack([m.weights for m in models]), np.concatenate([m.intercepts for m in models]))
    )
    schema = "model INT, label INT, n LONG, abs DOUBLE, square DOUBLE"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercepts = shared.value
        n, total = 0, np.zeros((2, len(intercepts)))
        for batch in batches:
            if batch.num_rows:
                x, y = _matrices(batch)
                off = x @ weights + intercepts - np.tile(y, len(models))
                n += len(x)
                total += [np.abs(off).sum(axis=0), (off * off).sum(axis=0)]
        at = np.arange(len(intercepts), dtype=np.int32)
        columns = [at // len(labels), at % len(labels), np.full(len(at), n), *total]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "label", "n", "abs", "square"])

    sums = _complete(rows, labels, vector).mapInArrow(run, schema).groupBy("model", "label").agg(
        F.sum("n").alias("n"), F.sum("abs").alias("abs"), F.sum("square").alias("square")
    )
    penalty = F.element_at(F.array(*[F.lit(m.penalty) for m in models]), F.col("model") + 1)
    label = F.element_at(F.array(*[F.lit(y) for y in labels]), F.col("label") + 1)
    mean = lambda c: F.when(F.col("n") > 0, F.try_divide(F.col(c), F.col("n")))
    return sums.select(
        penalty.alias("penalty"), label.alias("label"), "n", mean("abs").alias("mae"), mean("square").alias("mse")
    )


def search(
    train: DataFrame, validation: DataFrame, labels: Sequence[str], penalties: Sequence[float], vector: str = "embedding"
) -> tuple[LinearModel, DataFrame]:
    """The model with the least error of the first label on the validation rows, and the
    errors of all; of equal ones the larger penalty wins."""
    sums = gram(train, labels, vector)
    if sums is None:
        raise ValueError("no rows to learn from")
    models = solve(sums, penalties)
    tried = errors_of(models, validation, vector)
    scored = tried.where(F.col("label") == labels[0]).collect()  # a row per penalty
    best = min(scored, key=lambda r: (float("inf") if r.mae is None else r.mae, -r.penalty)).penalty
    return next(m for m in models if m.penalty == best), tried
