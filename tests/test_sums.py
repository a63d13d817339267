"""Models from sums, the ball tree and summed centroids, against plain numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatwarden.operators import ridge, vectors
from chatwarden.operators.balls import BallTree


def labelled(seed=1, n=300, d=4):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, d)) + 3
    y = np.column_stack([x @ draw.normal(size=d) + 1, x[:, 0] ** 2]) + draw.normal(size=(n, 2)) / 9
    return x, y


def table_of(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b[0]), float(b[1])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id LONG, embedding ARRAY<DOUBLE>, risk DOUBLE, assist DOUBLE")


def plain_ridge(x, y, penalty):
    a, b = x - x.mean(axis=0), y - y.mean(axis=0)
    w = np.linalg.solve(a.T @ a / len(x) + penalty * np.eye(x.shape[1]), a.T @ b / len(x))
    return w, y.mean(axis=0) - x.mean(axis=0) @ w


@pytest.mark.parametrize("parts", [1, 7])
def test_models_of_all_penalties_and_labels(spark, parts):
    x, y = labelled()
    rows = table_of(spark, x, y).repartition(parts)
    penalties = [0.0, 0.1, 10.0]
    models = ridge.solve(ridge.gram(rows, ["risk", "assist"]), penalties)
    for penalty, model in zip(penalties, models):
        w, b = plain_ridge(x, y, penalty)
        assert np.allclose(model.weights, w) and np.allclose(model.intercepts, b)
    found = {r.id: r for r in ridge.predict(models[1], rows, ["id"]).collect()}
    w, b = plain_ridge(x, y, 0.1)
    assert all(np.allclose([found[i].predicted_risk, found[i].predicted_assist], x[i] @ w + b) for i in range(len(x)))


def test_search_scores_the_given_validation_rows(spark):
    x, y = labelled()
    train, val = table_of(spark, x[:200], y[:200]), table_of(spark, x[200:], y[200:])
    penalties = [0.01, 1.0, 100.0]
    best, tried = ridge.search(train, val, ["risk", "assist"], penalties)
    got = {(r.penalty, r.label): (r.n, r.mae, r.mse) for r in tried.collect()}
    maes = []
    for penalty in penalties:
        w, b = plain_ridge(x[:200], y[:200], penalty)
        off = x[200:] @ w + b - y[200:]
        for i, label in enumerate(["risk", "assist"]):
            assert np.allclose(got[penalty, label], (100, np.abs(off[:, i]).mean(), (off[:, i] ** 2).mean()))
        maes.append(np.abs(off[:, 0]).mean())
    assert best.penalty == penalties[int(np.argmin(maes))] and len(got) == 6
    again = {(r.penalty, r.label): r.mae for r in ridge.search(train.repartition(9), val.repartition(5), ["risk", "assist"], penalties)[1].collect()}
    assert all(abs(again[k] - v[1]) < 1e-9 for k, v in got.items())


def test_rows_that_miss_a_value(spark):
    rows = table_of(spark, *labelled(n=20))
    odd = spark.createDataFrame(
        [(90, None, 1.0, 1.0), (91, [1.0, None, 1.0, 1.0], 1.0, 1.0), (92, [1.0] * 4, None, 1.0), (93, [float("nan")] * 4, 1.0, 1.0),
         (94, [1.0] * 4, 1.0, float("inf"))], rows.schema)
    assert ridge.gram(rows.unionByName(odd), ["risk", "assist"]).count == 20
    model = ridge.fit(rows, ["risk"], 0.1)
    assert [r.predicted_risk for r in ridge.predict(model, odd.where("id = 90"), ["id"]).collect()] == [None]
    assert ridge.gram(odd, ["risk", "assist"]) is None
    with pytest.raises(ValueError):
        ridge.fit(odd, ["risk", "assist"])
    constant = spark.createDataFrame([(i, [1.0, 1.0], 2.0) for i in range(5)], "id LONG, embedding ARRAY<DOUBLE>, risk DOUBLE")
    flat = ridge.fit(constant, ["risk"])
    assert np.allclose(flat.weights, 0) and np.allclose(flat.intercepts, 2)


@pytest.mark.parametrize("n_centers,k", [(1, 3), (200, 1), (700, 4)])
def test_ball_tree_finds_the_nearest(n_centers, k):
    draw = np.random.default_rng(n_centers)
    middles = draw.normal(size=(40, 6)) * 20
    centers = middles[draw.integers(0, 40, n_centers)] + draw.normal(size=(n_centers, 6))
    x = middles[draw.integers(0, 40, 3000)] + draw.normal(size=(3000, 6))
    x[5] = x[9]  # a tie
    tree = BallTree(centers, k)
    for s in range(0, len(x), 500):
        tree.add(pa.array(np.arange(s, s + 500)), x[s : s + 500])
    away = np.sqrt(((x[:, None, :] - centers[None]) ** 2).sum(axis=2))
    for j in range(n_centers):
        order = sorted(zip(away[:, j].tolist(), range(len(x))))[:k]
        assert [key for _, key in tree.found[j]] == [key for _, key in order]
        assert np.allclose([d for d, _ in tree.found[j]], [d for d, _ in order])
    if n_centers > 100:
        assert tree.measured < 0.7 * tree.seen


def test_many_centers_take_one_scan_and_centroids_one_array_per_group(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = vectors.centroid(rows, by=["label"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    centers = vectors.centroid(rows, by=["label"]).withColumnRenamed("label", "cluster_id")
    plan = vectors.nearest_rows(rows, centers, 3, "vec_id", center_bytes=600)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    with_gaps = rows.limit(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array(F.lit(None).cast("float")).alias("embedding"), "label")
    found = vectors.centroid(rows.unionByName(with_gaps)).first().center
    assert np.allclose(found, np.mean([r.embedding for r in rows.collect()], axis=0))
