"""Embeddings: centroids, nearest rows, clusters and their risk profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F, types as T

from chatwarden.functions.arrays import list_mean, list_median
from chatwarden.functions.fixed_values import NEAREST_PER_CLUSTER, NEAREST_TO_SEEDS
from chatwarden.operators.balls import BallTree
from chatwarden.operators.ranks import global_rank
from chatwarden.session import materialize, scratch_path

# Centers are shipped to every task in slices of at most this size.
CENTER_BYTES = 32 << 20
# Picks are counted, and broadcast up to this number; above, Spark chooses the join.
BROADCAST_PICKS = 100_000


def centroid(vectors: DataFrame, vector: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """Mean vector, of the whole table or per group.

    Each task keeps one array per group, to which its vectors are added place by
    place, and moves only that. No rows give no center; a vector that misses a
    value takes no part; vectors of unequal length are refused.
    """
    whole = F.coalesce(F.forall(vector, lambda v: v.isNotNull()) & (F.size(vector) > 0), F.lit(False))
    places = vectors.where(whole).select(*by, array_to_vector(F.col(vector).cast("array<double>")).alias("_places"))
    # A group even for the whole table: without rows there is none.
    groups = [F.col(b) for b in by] or [F.lit(0).alias("_all")]
    means = places.groupBy(*groups).agg(Summarizer.mean(F.col("_places")).alias("_mean"))
    return means.select(*by, vector_to_array("_mean").alias("center"))


def nearest_rows(
    rows: DataFrame,
    centers: DataFrame,
    k: int = NEAREST_PER_CLUSTER,
    key: str = "sample_id",
    vector: str = "embedding",
    center_bytes: int = CENTER_BYTES,
) -> DataFrame:
    """The ``k`` rows nearest to every center, over all rows.

    ``centers`` has ``cluster_id`` and ``center``. Each task scans its rows once,
    in Arrow batches, and hands on its own k best per center, so neither the
    pairs nor the vectors are shuffled. Balls of centers that a row cannot be
    near are passed over. Every task holds all centers, sent in slices of at
    most ``center_bytes``; the answer is the same for any size of slice.

    Returns ``cluster_id``, ``pick`` (1 is the nearest), ``key``, ``distance``;
    ties go to the smaller key. Fewer than k rows give fewer picks. A vector
    with a missing or infinite value is near nothing.
    """
    spark = rows.sparkSession
    centers = materialize(centers.select("cluster_id", "center"), "centers")  # made once
    count, dims = centers.agg(F.count("*"), F.max(F.size("center"))).first()
    in_slice = max(1, center_bytes // (8 * max(dims or 0, 1)))
    if count > in_slice:  # neighbors by number stay together
        ranked = materialize(global_rank(centers, [F.col("cluster_id")], "_rank"), "centers")
        slices = [
            ranked.filter(F.col("_rank").between(start, start + in_slice - 1)) for start in range(0, count, in_slice)
        ]
    else:
        slices = [centers]
    shared = [spark.sparkContext.broadcast(_center_table(part)) for part in slices]
    vectors = rows.filter(F.col(vector).isNotNull()).select(key, F.col(vector))
    near = _nearest_in_tasks(vectors, shared, centers.schema["cluster_id"], k, key)
    nearest = Window.partitionBy("cluster_id").orderBy("distance", key)
    return (
        near.withColumn("pick", F.row_number().over(nearest))
        .filter(F.col("pick") <= k)
        .select("cluster_id", "pick", key, "distance")
    )


def _center_table(centers: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and vectors of one slice of the centers."""
    table = centers.select("cluster_id", "center").collect()
    return [row.cluster_id for row in table], np.array([row.center for row in table], dtype=np.float64)


def _nearest_in_tasks(
    vectors: DataFrame, slices: Sequence[Broadcast], cluster: T.StructField, k: int, key: str
) -> DataFrame:
    """The k nearest rows of every center in every task, from one scan."""
    distance = T.StructField("distance", T.DoubleType())
    schema = T.StructType([cluster, vectors.schema[key], distance])

    def task(batches):
        trees, types = None, None
        for batch in batches:
            types = batch.schema.field(0).type
            trees = trees or [(ids, BallTree(matrix, k)) for ids, matrix in (s.value for s in slices)]
            for _, tree in trees:
                if len(tree.centers):
                    tree.add(*_finite(batch, tree.centers.shape[1]))
        for ids, tree in trees or []:
            found = [(ids[j], row_key, d) for j, picks in enumerate(tree.found) for d, row_key in picks]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], _arrow(schema[0].dataType)),
                    pa.array([f[1] for f in found], types),
                    pa.array([f[2] for f in found], pa.float64()),
                ],
                names=schema.names,
            )

    return vectors.mapInArrow(task, schema)


def _finite(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors of the rows whose values are all finite."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    if (sizes != width).any():
        raise ValueError(f"vectors and centers need {width} values each")
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(batch.num_rows, -1).astype(np.float64)
    finite = np.flatnonzero(np.isfinite(x).all(axis=1))
    return batch.column(0).take(pa.array(finite)), x[finite]


def _arrow(data_type: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.StringType(): pa.string()}.get(data_type, pa.int32())


def with_center(rows: DataFrame, centers: DataFrame, on: str, center_bytes: int = CENTER_BYTES) -> DataFrame:
    """Adds the ``center`` of each row's group. Centers are few for the groups of most tables:
    they are written, and broadcast if their bytes are at most ``center_bytes``; else Spark joins
    them, and splits groups of very many rows."""
    centers = materialize(centers, "centers")
    count, dims = centers.agg(F.count("*"), F.max(F.size("center"))).first()
    small = count * 8 * (dims or 0) <= center_bytes
    return rows.join(F.broadcast(centers) if small else centers, on)


def closest_rows(picks: DataFrame, key: str = "sample_id") -> DataFrame:
    """The closest row of every cluster and its distance."""
    return picks.groupBy("cluster_id").agg(
        F.min("distance").alias("distance"),
        F.min_by(key, F.struct("distance", key)).alias(key),
    )


def risk_profile(
    rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), counted: str | None = None
) -> DataFrame:
    """Mean over rows of each row's mean score, for every listed column.

    A column holds a row's list of scores, or its mean score already. ``counted``
    names a column for the number of rows.
    """
    lists = {f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType)}
    means = {c: list_mean(F.col(c)) if c in lists else F.col(c) for c in columns}
    profile = [F.avg(mean).alias(c) for c, mean in means.items()]
    if counted is not None:
        profile.append(F.count("*").alias(counted))
    return rows.groupBy(*by).agg(*profile)


def _hinted(picks: DataFrame) -> DataFrame:
    """Written rows, with a broadcast hint if they are few by count."""
    few = picks.limit(BROADCAST_PICKS + 1).count() <= BROADCAST_PICKS
    return F.broadcast(picks) if few else picks


def join_picks(picks: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Scores of picked rows. ``picks`` are counted first and should be written ones."""
    return scores.join(_hinted(picks), key)


def cluster_profile(
    picks: DataFrame, scores: DataFrame, columns: Sequence[str], key: str
) -> DataFrame:
    """Risk profile of each cluster's picks: ``n_picks``, ``n_scored`` and the columns.

    Picks without scores are counted in ``n_picks`` only; a cluster of none but
    those keeps its row, with no means.
    """
    picks = materialize(picks.select("cluster_id", key), "picks")
    picked = picks.groupBy("cluster_id").agg(F.count("*").alias("n_picks"))
    scored = risk_profile(join_picks(picks, scores, key), columns, ["cluster_id"], "n_scored")
    return picked.join(scored, "cluster_id", "left").withColumn(
        "n_scored", F.coalesce("n_scored", F.lit(0).cast("long"))
    )


def riskiest(rows: DataFrame, score: str, k: int, key: str) -> DataFrame:
    """The k rows with the highest median of a score list; ties by key.

    A plain number is taken as the risk itself. A top-k per task, then one over
    those: the table is not sorted.
    """
    is_list = isinstance(rows.schema[score].dataType, T.ArrayType)
    risk = list_median(F.col(score)) if is_list else F.col(score)
    return rows.withColumn("risk", risk).orderBy(F.desc_nulls_last("risk"), key).limit(k)


def without(rows: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Rows that are no seeds."""
    return rows.join(_hinted(seeds.select(key)), key, "left_anti")


def similar_to_seeds(
    embeddings: DataFrame,
    seeds: DataFrame,
    k: int = NEAREST_TO_SEEDS,
    key: str = "sample_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k rows nearest to the seeds' centroid, the seeds themselves left out."""
    seed_vectors = join_picks(seeds.select(key), embeddings, key)
    center = centroid(seed_vectors, vector).withColumn("cluster_id", F.lit(0))
    rest = without(embeddings, seeds, key)
    return nearest_rows(rest, center, k, key, vector).drop("cluster_id")


def riskiest_and_similar(
    scores: DataFrame,
    embeddings: DataFrame,
    score: str,
    profile_columns: Sequence[str],
    k: int,
    key: str = "sample_id",
    vector: str = "embedding",
) -> DataFrame:
    """Risk profile of the k riskiest rows and of the rows most like them.

    ``n_picks`` counts all of them, ``n_scored`` those that have scores.
    """
    embedded = scores.join(embeddings.select(key), key, "left_semi")
    # k rows, needed three times: taken once.
    seeds = materialize(riskiest(embedded, score, k, key).select(key), "seeds")
    near = similar_to_seeds(embeddings, seeds, key=key, vector=vector).select(key)
    picked = seeds.withColumn("picks", F.lit("riskiest")).unionByName(
        near.withColumn("picks", F.lit("similar"))
    )
    picked = materialize(picked, "picks")
    picks = picked.groupBy("picks").agg(F.count("*").alias("n_picks"))
    scored = risk_profile(join_picks(picked, scores, key), profile_columns, ["picks"], "n_scored")
    return picks.join(scored, "picks", "left").withColumn(
        "n_scored", F.coalesce("n_scored", F.lit(0).cast("long"))
    )


def kmeans(
    rows: DataFrame, k: int, key: str = "sample_id", vector: str = "embedding", seed: int = 1
) -> tuple[DataFrame, DataFrame, KMeansModel]:
    """Euclidean k-means: (key, cluster_id), (cluster_id, center) and the model."""
    spark = rows.sparkSession
    features = array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    points = rows.select(key, features)
    clustering = KMeans(k=k, seed=seed, distanceMeasure="euclidean", predictionCol="cluster_id")
    model = clustering.fit(points)
    centers = spark.createDataFrame(
        [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster_id INT, center ARRAY<DOUBLE>",
    )
    return model.transform(points).select(key, "cluster_id"), centers, model
