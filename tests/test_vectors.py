"""Nearest rows, profiles, clusters and splits against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatwarden.operators import split as S, vectors as V


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[50:60] = x[10:20]  # equal distances
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark, points):
    data = [(f"s{i:03}", [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "sample_id STRING, embedding ARRAY<FLOAT>").repartition(5)


@pytest.fixture(scope="module")
def centers(spark):
    c = np.random.default_rng(4).normal(size=(7, 6))
    data = [(i, [float(v) for v in row]) for i, row in enumerate(c)]
    return c, spark.createDataFrame(data, "cluster_id INT, center ARRAY<DOUBLE>")


def brute(points, center, k):
    d = np.sqrt(((points.astype(np.float64) - center) ** 2).sum(axis=1))
    return sorted((float(v), f"s{i:03}") for i, v in enumerate(d))[:k]


@pytest.mark.parametrize("k", [1, 5, 40, 400])
@pytest.mark.parametrize("center_bytes", [1 << 20, 200])
def test_nearest_rows(rows, points, centers, k, center_bytes):
    values, table = centers
    got = V.nearest_rows(rows, table, k, center_bytes=center_bytes).collect()
    for j, center in enumerate(values):
        mine = sorted((r.pick, r.sample_id, r.distance) for r in got if r.cluster_id == j)
        want = brute(points, center, k)
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert np.allclose([m[2] for m in mine], [w[0] for w in want])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))


def test_nearest_with_large_offsets_keeps_the_exact_order(spark):
    base = 1e6
    data = [(i, [base + i * 1e-3, base]) for i in range(50)]
    table = spark.createDataFrame(data, "sample_id LONG, embedding ARRAY<DOUBLE>")
    center = spark.createDataFrame([(0, [base, base])], "cluster_id INT, center ARRAY<DOUBLE>")
    got = V.nearest_rows(table, center, 5).orderBy("pick").collect()
    assert [r.sample_id for r in got] == [0, 1, 2, 3, 4]


def test_broken_vectors_are_near_nothing_and_spoil_nothing(spark):
    bad = [float("nan"), float("inf"), None]
    data = [(i, [float(i), bad[i % 3] if i % 4 == 0 else 1.0]) for i in range(40)] + [(99, None)]
    table = spark.createDataFrame(data, "sample_id INT, embedding ARRAY<DOUBLE>").coalesce(1)
    center = spark.createDataFrame(
        [(0, [0.0, 1.0]), (1, [39.0, 1.0])], "cluster_id INT, center ARRAY<DOUBLE>"
    )
    got = V.nearest_rows(table, center, 3).orderBy("cluster_id", "pick").collect()
    assert [r.sample_id for r in got] == [1, 2, 3, 39, 38, 37]


def test_closest_rows_and_no_rows(rows, points, centers):
    values, table = centers
    closest = {r.cluster_id: r.sample_id for r in V.closest_rows(V.nearest_rows(rows, table, 3)).collect()}
    assert closest == {j: brute(points, c, 1)[0][1] for j, c in enumerate(values)}
    assert V.nearest_rows(rows.limit(0), table, 3).count() == 0
    assert V.nearest_rows(rows, table.limit(0), 3).count() == 0


def test_profiles(spark, rows, centers):
    scores = rows.select(
        "sample_id",
        F.array(F.lit(1.0), F.substring("sample_id", 2, 3).cast("double")).alias("a"),
        F.lit(2.0).alias("b"),
    )
    picks = V.nearest_rows(rows, centers[1], 4)
    found = V.cluster_profile(picks, scores, ["a", "b"], "sample_id").collect()
    got = {r.cluster_id: (r.a, r.b) for r in found}
    assert all(r.n_picks == r.n_scored == 4 for r in found)
    none = V.cluster_profile(picks, scores.limit(0), ["a", "b"], "sample_id").collect()
    assert len(none) == len(found) and all((r.n_picks, r.n_scored, r.a) == (4, 0, None) for r in none)
    members = {}
    for r in picks.collect():
        members.setdefault(r.cluster_id, []).append((1.0 + int(r.sample_id[1:])) / 2)
    assert got == {c: (pytest.approx(np.mean(m)), 2.0) for c, m in members.items()}


def test_riskiest_and_similar(spark, rows, points):
    scores = rows.select(
        "sample_id",
        F.transform(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), lambda x: x + F.pmod(F.hash("sample_id"), F.lit(50))).alias("risk"),
    )
    k = 6
    got = {r.picks: r.risk for r in V.riskiest_and_similar(scores, rows, "risk", ["risk"], k).collect()}
    means = {r.sample_id: r.risk[1] for r in scores.collect()}
    seeds = sorted(means, key=lambda s: (-means[s], s))[:k]
    places = [int(s[1:]) for s in seeds]
    middle = points[places].astype(np.float64).mean(axis=0)
    rest = [(d, s) for d, s in brute(points, middle, 300) if s not in seeds][:10]
    assert got["riskiest"] == pytest.approx(np.mean([means[s] for s in seeds]))
    assert got["similar"] == pytest.approx(np.mean([means[s] for _, s in rest]))


def test_centroid_by_group(rows, points):
    grouped = V.centroid(rows.withColumn("g", F.col("sample_id") < "s100"), by=["g"]).collect()
    for r in grouped:
        part = points[:100] if r.g else points[100:]
        assert np.allclose(r.center, part.astype(np.float64).mean(axis=0), atol=1e-6)
    assert V.centroid(rows.limit(0)).isEmpty()
    none = V.similar_to_seeds(rows, rows.select("sample_id").limit(0))
    assert none.isEmpty()


def test_kmeans_finds_separate_clouds(spark):
    rng = np.random.default_rng(0)
    data = [
        (i, [float(v) for v in rng.normal(size=3) + 20 * (i % 4)]) for i in range(200)
    ]
    table = spark.createDataFrame(data, "sample_id INT, embedding ARRAY<DOUBLE>")
    assigned, centers, model = V.kmeans(table, 4)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster_id, set()).add(r.sample_id % 4)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert centers.count() == 4 and len(model.clusterCenters()) == 4


def test_kmeans_ends_at_a_fixed_point(rows, points):
    assigned, centers, _ = V.kmeans(rows, 3)
    middle = np.array([r.center for r in centers.orderBy("cluster_id").collect()])
    ids = np.array([r.cluster_id for r in assigned.orderBy("sample_id").collect()])
    distances = ((points[:, None, :] - middle[None]) ** 2).sum(axis=2)
    assert (distances.argmin(axis=1) == ids).all()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 11, 25, 1000])
def test_exact_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
    counts = dict(S.exact_split(df, "k").groupBy("split").count().collect())
    held = math.ceil(0.2 * n)
    test = math.ceil(0.5 * held)
    want = {"train": n - held, "val": held - test, "test": test}
    assert counts == {s: c for s, c in want.items() if c}


@pytest.mark.parametrize("cells,small", [(2, 1), (3, 5), (1 << 14, 10)])
def test_exact_split_is_the_order_of_the_hash(spark, monkeypatch, cells, small):
    monkeypatch.setattr(S, "_HISTOGRAM_CELLS", cells)
    monkeypatch.setattr(S, "_SMALL", small)
    for modulus in (1, 3, 97, 1 << 40):
        df = spark.range(137).withColumnRenamed("id", "k")
        hashed = F.expr(f"(k * 2654435761) % {modulus}L")
        got = {r.k: r.split for r in S.exact_split(df, "k", hashed).collect()}
        ordered = sorted(range(137), key=lambda k: ((k * 2654435761) % modulus, k))
        assert [got[k] for k in ordered] == ["train"] * 109 + ["val"] * 14 + ["test"] * 14


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    for split in (lambda d: S.exact_split(d, "k"), lambda d: S.hash_split(d, "k")):
        a, b = (split(df.repartition(p)).orderBy("k").collect() for p in (1, 7))
        assert a == b
    sizes = dict(S.hash_split(spark.range(20000).toDF("k"), "k").groupBy("split").count().collect())
    assert abs(sizes["train"] - 16000) < 300 and abs(sizes["val"] - 2000) < 300
