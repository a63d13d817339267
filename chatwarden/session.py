"""Session settings and the shared scratch space for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_local_scratch: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "chatwarden", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks; clusters bring their own."""
    cores = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared space named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster,
    files in a machine-local folder are gone with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.conf.get("spark.app.id", "local")
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="chatwarden-")
        base = _local_scratch[app]
    return f"{base.rstrip('/')}/chatwarden/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Cuts what goes to Python workers by bytes, unless the session says how.

    A batch of wide texts is held by the JVM outside its heap, more than once,
    and by the worker. The default of 64 MB a batch is a tenth of a small executor.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, "900k")


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a scan that has fewer splits than there are cores.

    For scans in front of heavy work per row (tokens, embeddings): a single
    unsplittable file would be a single task. Scans of many files stay as they
    are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a later step reads the same rows twice and must see the same
    rows both times, also after an executor is lost (row numbers inside range
    partitions, seed sets). Parquet keeps column pruning for the second read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
