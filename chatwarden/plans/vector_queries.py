"""Queries on embeddings, clusters, splits and their stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatwarden.functions.arrays import euclidean
from chatwarden.operators import split as S, vectors as V
from chatwarden.plans.roles import (
    EVENT_TYPES,
    LABEL_CENTERS_SQL,
    USER_RISK_SQL,
    label_centers,
    spread_hash,
    spread_hash_sql,
    spread_split,
    spread_split_sql,
    table,
    user_risk,
)
from chatwarden.session import scratch_path
from chatwarden.sources import stores

K = 5
SEEDS = 20
KEY = "vec_id"


def _rounded(columns, digits=6):
    return [F.round(c, digits).alias(c) for c in columns]


def _rounded_sql(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def _picks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return V.nearest_rows(rows, label_centers(spark, sf_dir), K, KEY)


_PICKS_SQL = f"""
    SELECT cluster_id, row_number() OVER w AS pick, vec_id, distance FROM (
        SELECT c.cluster_id, e.vec_id, list_distance(e.embedding::DOUBLE[], c.center) AS distance
        FROM embeddings e, ({LABEL_CENTERS_SQL}) c)
    WINDOW w AS (PARTITION BY cluster_id ORDER BY distance, vec_id)
    QUALIFY row_number() OVER w <= {K}
"""


def topk_per_center(spark, sf_dir):
    return _picks(spark, sf_dir).select(
        "cluster_id", "pick", KEY, F.round("distance", 6).alias("distance")
    )


TOPK_PER_CENTER = f"""
    SELECT cluster_id, CAST(pick AS INTEGER) AS pick, vec_id, round(distance, 6) AS distance
    FROM ({_PICKS_SQL})
"""


def topk_sliced_centers(spark, sf_dir):
    """The same picks with the centers shipped a few at a time."""
    rows = table(spark, sf_dir, "embeddings")
    picks = V.nearest_rows(rows, label_centers(spark, sf_dir), K, KEY, center_bytes=3000)
    return picks.select("cluster_id", "pick", KEY, F.round("distance", 6).alias("distance"))


def closest_per_center(spark, sf_dir):
    return V.closest_rows(_picks(spark, sf_dir), KEY).select(
        "cluster_id", KEY, F.round("distance", 6).alias("distance")
    )


CLOSEST_PER_CENTER = f"""
    SELECT cluster_id, vec_id, round(distance, 6) AS distance FROM ({_PICKS_SQL}) WHERE pick = 1
"""


def label_distances(spark, sf_dir):
    """Distance of every row to the mean of its own label."""
    rows = table(spark, sf_dir, "embeddings")
    centers = label_centers(spark, sf_dir).withColumnRenamed("cluster_id", "label")
    return V.with_center(rows, centers, "label").select(
        KEY, "label", F.round(euclidean(F.col("embedding"), F.col("center")), 6).alias("distance")
    )


LABEL_DISTANCES = f"""
    SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], center), 6) AS distance
    FROM embeddings JOIN ({LABEL_CENTERS_SQL}) ON label = cluster_id
"""


def cluster_profile(spark, sf_dir):
    scores = user_risk(spark, sf_dir)
    profile = V.cluster_profile(_picks(spark, sf_dir), scores, EVENT_TYPES, KEY)
    return profile.select("cluster_id", "n_picks", "n_scored", *_rounded(EVENT_TYPES))


CLUSTER_PROFILE = f"""
    SELECT cluster_id, count(*) AS n_picks, count(risk_score) AS n_scored,
           {', '.join(f'round(avg({t}), 6) AS {t}' for t in EVENT_TYPES)}
    FROM ({_PICKS_SQL}) LEFT JOIN ({USER_RISK_SQL}) USING (vec_id) GROUP BY cluster_id
"""

_SEEDS_SQL = f"""
    SELECT vec_id FROM ({USER_RISK_SQL}) WHERE vec_id IN (SELECT vec_id FROM embeddings)
    ORDER BY risk_score DESC, vec_id LIMIT {SEEDS}
"""

_SIMILAR_SQL = f"""
    WITH seeds AS MATERIALIZED ({_SEEDS_SQL}),
    parts AS (
        SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
        FROM embeddings WHERE vec_id IN (SELECT vec_id FROM seeds)),
    middle AS (
        SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, avg(x) AS m FROM parts GROUP BY pos))
    SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT c FROM middle)) AS distance
    FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM seeds)
    ORDER BY distance, vec_id LIMIT 10
"""


def similar_rows(spark, sf_dir):
    """The ten rows nearest to the centroid of the riskiest ones."""
    rows, scores = table(spark, sf_dir, "embeddings"), user_risk(spark, sf_dir)
    embedded = scores.join(rows.select(KEY), KEY, "left_semi")
    seeds = V.materialize(V.riskiest(embedded, "risk_score", SEEDS, KEY).select(KEY), "seeds")
    near = V.similar_to_seeds(rows, seeds, key=KEY)
    return near.select(KEY, F.round("distance", 6).alias("distance"))


SIMILAR_ROWS = f"SELECT vec_id, round(distance, 6) AS distance FROM ({_SIMILAR_SQL})"


def similar_to_risky(spark, sf_dir):
    profiles = V.riskiest_and_similar(
        user_risk(spark, sf_dir),
        table(spark, sf_dir, "embeddings"),
        "risk_score",
        EVENT_TYPES,
        SEEDS,
        KEY,
    )
    return profiles.select("picks", "n_picks", "n_scored", *_rounded(EVENT_TYPES))


SIMILAR_TO_RISKY = f"""
    SELECT picks, count(*) AS n_picks, count(risk_score) AS n_scored,
           {', '.join(f'round(avg({t}), 6) AS {t}' for t in EVENT_TYPES)}
    FROM (SELECT 'riskiest' AS picks, vec_id FROM ({_SEEDS_SQL})
          UNION ALL SELECT 'similar', vec_id FROM ({_SIMILAR_SQL}))
    LEFT JOIN ({USER_RISK_SQL}) USING (vec_id) GROUP BY picks
"""


def kmeans_profile(spark, sf_dir):
    """k-means, the rows nearest to each center, and their risk profile."""
    rows = table(spark, sf_dir, "embeddings")
    _, centers, _ = V.kmeans(rows, 10, KEY)
    picks = V.nearest_rows(rows, centers, K, KEY)
    return V.cluster_profile(picks, user_risk(spark, sf_dir), EVENT_TYPES, KEY)


def kmeans_counts(spark, sf_dir):
    """k-means run, its model and assignment stored; every row is in one cluster."""
    assigned, centers, model = V.kmeans(table(spark, sf_dir, "embeddings"), 10, KEY)
    stores.save_kmeans(model, scratch_path(spark, "kmeans"))
    path = scratch_path(spark, "assignments")
    stores.write_assignments(assigned.join(centers.select("cluster_id"), "cluster_id"), path)
    found = spark.read.parquet(path)
    return found.agg(F.count("*").alias("n_rows"), F.count_distinct(KEY).alias("n_keys"))


KMEANS_COUNTS = "SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_keys FROM embeddings"


def kmeans_groups(spark, sf_dir):
    """k-means on vectors moved apart by label, model and assignment stored: a cluster per label."""
    moved = F.concat(
        F.transform("embedding", lambda x: x.cast("double")),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(F.col("label") % 10 == i, 1000.0).otherwise(0.0)),
    )
    rows = table(spark, sf_dir, "embeddings").select(KEY, "label", moved.alias("embedding"))
    groups = rows.select(F.count_distinct(F.col("label") % 10)).first()[0]
    assigned, _, model = V.kmeans(rows, groups, KEY)
    stored, path = scratch_path(spark, "kmeans"), scratch_path(spark, "assignments")
    stores.save_kmeans(model, stored)
    stores.write_assignments(assigned, path)
    centers = [(i, c.tolist()) for i, c in enumerate(stores.load_kmeans(stored).clusterCenters())]
    centers = spark.createDataFrame(centers, "cluster_id INT, center ARRAY<DOUBLE>")
    found = spark.read.parquet(path).join(rows.select(KEY, "label"), KEY).join(centers, "cluster_id")
    by_label = found.groupBy((F.col("label") % 10).alias("label"))
    return by_label.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("cluster_id").alias("n_clusters"),
        F.round(F.max(F.element_at("center", F.col("label") % 10 + 65)), 4).alias("own_axis"),
    )


KMEANS_GROUPS = """
    SELECT CAST(label % 10 AS INTEGER) AS label, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_clusters,
           1000.0::DOUBLE AS own_axis
    FROM embeddings GROUP BY label % 10
"""


def split_sets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return S.exact_split(documents, "doc_id", spread_hash("doc_id"))


SPLIT_SETS = f"""
    SELECT doc_id, CASE WHEN r <= n - h THEN 'train' WHEN r <= n - CAST(ceil(0.5 * h) AS BIGINT)
                        THEN 'val' ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY {spread_hash_sql('doc_id')}, doc_id) AS r,
                 count(*) OVER () AS n, CAST(ceil(0.2 * count(*) OVER ()) AS BIGINT) AS h
          FROM documents)
"""


def union_splits(spark, sf_dir):
    """Documents written one folder per split; the union of all folders."""
    path = scratch_path(spark, "splits")
    documents = table(spark, sf_dir, "documents").withColumn("split", spread_split("doc_id"))
    stores.write_splits(documents, path)
    return stores.read_split(spark, path).select("doc_id", "split", F.md5("text").alias("text_md5"))


UNION_SPLITS = f"""
    SELECT doc_id, {spread_split_sql('doc_id')} AS split, md5(text) AS text_md5 FROM documents
"""


def split_store(spark, sf_dir):
    """Embeddings stored by length and split; every split read by itself."""
    path = scratch_path(spark, "embeddings")
    rows = table(spark, sf_dir, "embeddings").withColumns(
        {"seq_length": F.lit(20), "split": spread_split(KEY)}
    )
    stores.write_embeddings(rows, path)
    train, val, test = (
        stores.read_embeddings(spark, path, 20, s) for s in ("train", "val", "test")
    )
    union = train.unionByName(val).unionByName(test)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return union.select(KEY, F.size("embedding").alias("dims"), "split", F.round(total, 6).alias("x_sum"))


SPLIT_STORE = f"""
    SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, {spread_split_sql('vec_id')} AS split,
           round(list_sum(embedding::DOUBLE[]), 6) AS x_sum
    FROM embeddings
"""


def centers_store(spark, sf_dir):
    """Centers written and read back, one row per value."""
    path = scratch_path(spark, "centers")
    stores.write_centers(label_centers(spark, sf_dir), path)
    values = stores.read_centers(spark, path).select("cluster_id", F.posexplode("center"))
    place = (F.col("pos") + 1).alias("pos")
    return values.select("cluster_id", place, F.round("col", 6).alias("x"))


CENTERS_STORE = f"""
    SELECT cluster_id, CAST(generate_subscripts(center, 1) AS INTEGER) AS pos,
           round(unnest(center), 6) AS x
    FROM ({LABEL_CENTERS_SQL})
"""

QUERIES = {
    "topk_per_center": (topk_per_center, TOPK_PER_CENTER),
    "topk_sliced_centers": (topk_sliced_centers, TOPK_PER_CENTER),
    "closest_per_center": (closest_per_center, CLOSEST_PER_CENTER),
    "label_distances": (label_distances, LABEL_DISTANCES),
    "cluster_profile": (cluster_profile, CLUSTER_PROFILE),
    "similar_rows": (similar_rows, SIMILAR_ROWS),
    "similar_to_risky": (similar_to_risky, SIMILAR_TO_RISKY),
    "kmeans_profile": (kmeans_profile, None),
    "kmeans_counts": (kmeans_counts, KMEANS_COUNTS),
    "kmeans_groups": (kmeans_groups, KMEANS_GROUPS),
    "split_sets": (split_sets, SPLIT_SETS),
    "union_splits": (union_splits, UNION_SPLITS),
    "split_store": (split_store, SPLIT_STORE),
    "centers_store": (centers_store, CENTERS_STORE),
}
