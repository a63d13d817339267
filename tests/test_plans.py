"""Plans that must stay as they are: what is read, moved and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chatwarden.operators import cleaning, moderation, ranks, split, vectors, windows

SF_DIR = "/root/testdata/sf0.001"
QUERIES = [n for n in entry.queries() if not n.startswith("stream_")]


@pytest.fixture(autouse=True)
def whole_plans(spark):
    """Lists in plans are cut at 100 characters otherwise."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> list[set]:
    return [
        {field.split(":")[0] for field in re.split(r",(?![^<]*>)", schema)}
        for schema in re.findall(r"ReadSchema: struct<(.*)>", plan)
    ]


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairs_of_all_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_windows_run_nothing_beforehand_and_read_what_they_use(spark):
    """Two shuffles of rows and two of counts, whatever the step; no list at every row."""
    log = spark.read.parquet(f"{SF_DIR}/events.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("windows", "")
    for step in (1, 20):
        plan = plan_of(windows.sliding_windows(log, "user_id", ["ts", "event_id"], ["value"], 20, step))
        assert plan.count("Exchange hashpartitioning") == 4 and "rangepartitioning" not in plan
        assert re.findall(r"Window \[(\w+)\(", plan) and "collect_list" not in "".join(re.findall(r"Window \[.*", plan))
        assert {"user_id", "ts", "event_id", "value"} in read_columns(plan)
        assert all("props" not in columns for columns in read_columns(plan))
    assert not tracker.getJobIdsForGroup("windows")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filters_reach_the_scan(spark):
    log = spark.read.parquet(f"{SF_DIR}/events.parquet")
    plan = plan_of(windows.one_group(log, "user_id", 7).select("value"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    assert read_columns(plan) == [{"user_id", "value"}]
    table = spark.read.parquet(f"{SF_DIR}/orders.parquet").withColumnsRenamed(
        {"o_orderpriority": "priority", "o_orderkey": "item_id"}
    )
    plan = plan_of(moderation.filter_priority(table, "HIGH").select("item_id"))
    assert "StringContains(o_orderpriority,HIGH)" in plan


def test_one_split_reads_only_its_files(spark):
    plan = plan_of(entry.queries()["split_store"](spark, SF_DIR))
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    splits = [re.search(r"\(split#\d+ = (\w+)\)", f).group(1) for f in filters]
    assert sorted(splits) == ["test", "train", "val"]
    assert all(re.search(r"\(seq_length#\d+ = 20\)", f) for f in filters)


def test_exact_split_moves_no_rows(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert "Exchange" not in plan_of(split.exact_split(rows, "doc_id"))
    assert "Exchange" not in plan_of(split.hash_split(rows, "doc_id"))


def test_nearest_rows_shuffles_candidates_only(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    centers = vectors.centroid(rows, by=["label"]).withColumnRenamed("label", "cluster_id")
    plan = plan_of(vectors.nearest_rows(rows, centers, 3, "vec_id"))
    below = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and below.index("MapInArrow") < below.index("FileScan")
    assert "embedding" not in plan[: plan.index("MapInArrow")]


def test_a_hot_group_is_not_one_task(spark):
    """A third of all rows in one group: rows are dealt by range and by piece of the group."""
    hot = F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50)
    log = spark.range(6000).select(hot.alias("grp"), "id")
    found = windows.sliding_windows(log, "grp", ["id"], ["id"], piece_rows=100)
    plan = plan_of(found)
    assert re.search(r"hashpartitioning\(grp#\d+L, _range#\d+", plan)
    assert re.search(r"hashpartitioning\(grp#\d+L, _piece#\d+L", plan)
    plain = windows.sliding_windows(log, "grp", ["id"], ["id"])
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert found.filter("grp = -1").count() == 2000 - 19
    ranges = ranks.number_in_groups(log, "grp", ["id"]).groupBy("grp").count()
    assert ranges.filter("grp = -1").first()["count"] == 2000


def test_lists_that_json_reads_never_enter_python(spark):
    """Rows whose cells the JVM reads are one side of a union that has no Python step."""
    cells = ['''['a', "it's"]''', r"['\x41\n\a', 'd\d']", "['x\\\\']", "[]", r"['\U0001f600']", r"['\101']", "['a', nan]", None]
    rows = spark.createDataFrame(list(enumerate(cells)), "id INT, text STRING").repartition(2)
    parsed = cleaning.parse_windows(rows, ["text"], [])
    plan = plan_of(parsed)
    assert plan.count("EvalPython") == 1 and plan.index("EvalPython") > plan.index("Scan")
    read = rows.where(~cleaning.json_texts(F.col("text")).isNull()).collect()
    assert [r.id for r in sorted(read)] == [0, 1, 2, 3]
    found = {r.id: r.text for r in parsed.collect()}
    assert found == {0: ["a", "it's"], 1: ["A\n\a", "d\\d"], 2: ["x\\"], 3: [], 4: ["\U0001f600"], 5: ["A"], 6: None, 7: None}
