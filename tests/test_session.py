"""Scratch space, spreading of scans, and logs in file order."""

import csv
import random

import pytest

from chatwarden.operators.windows import sliding_windows
from chatwarden.session import materialize, scratch_path, spread
from chatwarden.sources import logs


class Settings:
    """Stands in for a session of which only the settings are asked for."""

    def __init__(self, **values):
        self.values = {k.replace("_", "."): v for k, v in values.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_scratch_is_in_the_shared_folder_and_fresh(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(f"{base}/chatwarden/x-")
    shared = Settings(spark_master="yarn", spark_checkpoint_dir="hdfs://shared/")
    assert scratch_path(shared, "x").startswith("hdfs://shared/chatwarden/x-")


def test_only_a_local_session_may_go_without_a_shared_folder():
    with pytest.raises(ValueError):
        scratch_path(Settings(spark_master="yarn"), "x")
    assert "chatwarden-" in scratch_path(Settings(spark_master="local[2]"), "x")


def test_materialized_rows_stay_the_same(spark):
    from pyspark.sql import functions as F

    kept = materialize(spark.range(100).withColumn("r", F.rand()), "random")
    assert kept.orderBy("id").collect() == kept.orderBy("id").collect()


def test_spread_only_where_there_are_few_splits(spark):
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == 4
    many = spark.range(100, numPartitions=9)
    assert spread(many) is many


@pytest.mark.parametrize("multi_line", [True, False])
def test_file_order_is_the_order_of_the_lines(spark, tmp_path, multi_line):
    rng = random.Random(7)
    groups = [f"g{rng.randrange(3)}" for _ in range(2000)]
    for part in range(4):  # files of different sizes, named in order
        lines = range(part * 100, 100 + part * 100) if part < 3 else range(300, 2000)
        with open(tmp_path / f"log-{part}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["grp", "n"])
            out.writerows([groups[i], i] for i in lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        log = logs.read_csv_in_file_order(spark, str(tmp_path), "grp STRING, n INT", multi_line)
        assert log.rdd.getNumPartitions() > 3
        found = sliding_windows(log, "grp", logs.FILE_ORDER, ["n"], 3000, 1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.grp: r.n for r in found} == {
        g: [i for i, x in enumerate(groups) if x == g] for g in set(groups)
    }
