"""Metrics against numpy and against all pairs."""

import random

import numpy as np
import pytest

from chatwarden.operators import metrics as M
from chatwarden.operators.concordance import concordance, descents

SCHEMA = "key LONG, y_true DOUBLE, y_pred DOUBLE"


def pairs_of(spark, y, p):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], SCHEMA)


def all_pairs(y, p):
    order = sorted(range(len(y)), key=lambda i: (-p[i], i))
    wins = sum(y[a] > y[b] for i, a in enumerate(order) for b in order[i + 1 :])
    ties = sum(y[a] == y[b] for i, a in enumerate(order) for b in order[i + 1 :])
    return wins, ties


def test_descents():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 200):
        for high in (1, 2, 5, 1000):
            v = rng.integers(0, high, n)
            assert descents(v) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("block_rows", [1, 3, 7, 50, None])
@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_concordance(spark, block_rows, levels):
    rng = random.Random(levels)
    y = [rng.randrange(levels) for _ in range(60)]
    p = [rng.randrange(max(levels // 2, 2)) for _ in range(60)]
    wins, ties = all_pairs(y, p)
    got = concordance(pairs_of(spark, y, p), block_rows=block_rows).first()
    assert (got.n_pairs, got.wins, got.ties) == (60 * 59 // 2, wins, ties)
    assert got.concordance == pytest.approx((wins + ties / 2) / (60 * 59 / 2))


def test_concordance_of_one_value_and_of_few_rows(spark):
    same = concordance(pairs_of(spark, [1.0] * 30, range(30)), block_rows=4).first()
    assert same.wins == 0 and same.concordance == 0.5
    assert concordance(pairs_of(spark, [1.0], [2.0])).first().concordance is None
    assert concordance(pairs_of(spark, [], [])).first().concordance is None


def numpy_metrics(y, p):
    y, p = np.asarray(y, float), np.asarray(p, float)
    total = ((y - y.mean()) ** 2).sum()
    r2 = ((p - p.mean()) * (y - y.mean())).sum() ** 2 / (total * ((p - p.mean()) ** 2).sum())
    k = (y * p).sum() / (p * p).sum()
    r02 = 1 - ((y - k * p) ** 2).sum() / total
    return {
        "mse": ((y - p) ** 2).mean(),
        "mae": abs(y - p).mean(),
        "pearson_r2": r2,
        "slope": k,
        "r0_squared": r02,
        "rm_squared": r2 * (1 - np.sqrt(abs(r2 * r2 - r02 * r02))),
        "r2_score": 1 - ((y - p) ** 2).sum() / total,
    }


def test_regression_metrics(spark):
    rng = np.random.default_rng(2)
    for y, p in [(rng.random(1000), rng.random(1000)), (rng.random(50) + 100, rng.random(50) + 99)]:
        got = M.regression_metrics(pairs_of(spark, y, p)).first().asDict()
        assert got == pytest.approx(numpy_metrics(y, p), rel=1e-9)


def test_undefined_metrics_are_null(spark):
    flat = M.regression_metrics(pairs_of(spark, [2.0] * 3, [1.0, 2.0, 3.0])).first()
    assert flat.r2_score is None and flat.r0_squared is None and flat.rm_squared is None
    zero = M.regression_metrics(pairs_of(spark, [1.0, 2.0], [0.0, 0.0])).first()
    assert zero.slope is None and zero.r0_squared is None and zero.mae == 1.5


def test_baseline(spark):
    train, val = pairs_of(spark, [1.0, 3.0], [0, 0]), pairs_of(spark, [0.0, 5.0, 2.0], [0, 0, 0])
    row = M.mean_baseline(train, val).first()
    assert (row.mean_label, row.baseline_mae, row.n_validation) == (2.0, pytest.approx(5 / 3), 3)


@pytest.mark.parametrize("n,batch", [(10, 3), (9, 3), (2, 3), (1, 1), (20, 8)])
def test_epoch_errors(spark, n, batch):
    rng = np.random.default_rng(n)
    y, p = rng.random(n), rng.random(n)
    row = M.epoch_errors(pairs_of(spark, y, p), "key", [("y_true", "y_pred")], batch).first()
    batches = [slice(i, i + batch) for i in range(0, n - batch + 1, batch)]
    if not batches:
        assert row.mse is None
        return
    assert row.mse == pytest.approx(np.mean([((y[b] - p[b]) ** 2).mean() for b in batches]))
    assert row.mae == pytest.approx(np.mean([abs(y[b] - p[b]).mean() for b in batches]))
    assert row.mae_second == 0.0


def numpy_pr_area(y, s):
    points = [(0.0, 1.0)]
    for cut in sorted(set(s), reverse=True):
        chosen = [a for a, b in zip(y, s) if b >= cut]
        points.append((sum(chosen) / sum(y), sum(chosen) / len(chosen)))
    return sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(points, points[1:]))


@pytest.mark.parametrize("levels", [1, 2, 7, 500])
def test_pr_area(spark, levels):
    rng = random.Random(levels)
    y = [rng.randrange(2) for _ in range(100)]
    s = [rng.randrange(levels) for _ in range(100)]
    got = M.pr_area(pairs_of(spark, y, s), "y_true", "y_pred").first().pr_area
    assert got == pytest.approx(numpy_pr_area(y, s))


def test_pr_area_edges(spark):
    def area(y, s):
        return M.pr_area(pairs_of(spark, y, s), "y_true", "y_pred").first().pr_area

    assert area([0, 0], [1, 2]) is None
    assert area([1, 1], [1, 2]) == 1.0
    assert area([1, 0, 0, 0], [3, 3, 3, 3]) == pytest.approx((1 / 4 + 1) / 2)
    assert area([], []) is None


def test_binarized_and_best(spark):
    cut = M.binarized(pairs_of(spark, [6.9, 7.0], [8.0, 1.0]), "y_true", "y_pred").orderBy("key").collect()
    assert [(r.y_true, r.y_pred) for r in cut] == [(0, 1), (1, 0)]
    table = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.9)], "model STRING, mae DOUBLE")
    assert M.best_model(table, "model", "mae").first().model == "a"


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    pairs = pairs_of(spark, rng.integers(0, 9, 300), rng.integers(0, 9, 300))
    one, many = (pairs.repartition(n) for n in (1, 11))
    assert concordance(one, block_rows=40).first() == concordance(many, block_rows=17).first()
    assert M.pr_area(M.binarized(one, "y_true", "y_pred", 4), "y_true", "y_pred").first()[0] == pytest.approx(
        M.pr_area(M.binarized(many, "y_true", "y_pred", 4), "y_true", "y_pred").first()[0]
    )
