"""How the given tables play the parts of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chatwarden.functions.arrays import list_median
from chatwarden.operators.vectors import centroid
from chatwarden.operators.windows import sliding_windows
from chatwarden.session import materialize

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a message log: a user is a group, scores are per event type."""
    events = table(spark, sf_dir, "events")
    by_type = {
        t: F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0) for t in EVENT_TYPES
    }
    return events.withColumns(by_type)


EVENT_SCORES_SQL = ", ".join(
    f"CASE WHEN event_type = '{t}' THEN value ELSE 0.0 END AS {t}" for t in EVENT_TYPES
)


def second_number() -> Column:
    """The number ``k`` inside ``props``."""
    return F.get_json_object("props", "$.k").cast("double")


SECOND_NUMBER_SQL = """CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as prediction pairs."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("key"),
        F.col("value").alias("y_true"),
        second_number().alias("y_pred"),
    )


PREDICTIONS_SQL = (
    f"SELECT event_id AS key, value AS y_true, {SECOND_NUMBER_SQL} AS y_pred FROM events"
)


def spread_hash(key: str) -> Column:
    """Multiplicative hash below 2^32, the same arithmetic in any SQL engine."""
    return F.expr(f"({key} * 2654435761) % 4294967296")


def spread_hash_sql(key: str) -> str:
    return f"(({key} * 2654435761) % 4294967296)"


def spread_split(key: str) -> Column:
    h = spread_hash(key)
    return F.when(h < 3435973836, "train").when(h < 3865470566, "val").otherwise("test")


def spread_split_sql(key: str) -> str:
    h = spread_hash_sql(key)
    return (
        f"CASE WHEN {h} < 3435973836 THEN 'train' WHEN {h} < 3865470566 THEN 'val' ELSE 'test' END"
    )


def label_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One center per label of ``embeddings``: the mean vector of its rows."""
    rows = table(spark, sf_dir, "embeddings")
    return centroid(rows, by=["label"]).select(F.col("label").alias("cluster_id"), "center")


LABEL_CENTERS_SQL = """
    SELECT label AS cluster_id, list(m ORDER BY pos) AS center FROM (
        SELECT label, pos, avg(x) AS m FROM (
            SELECT label, unnest(embedding::DOUBLE[]) AS x,
                   generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos)
    GROUP BY label
"""


def review_items(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """``orders`` as review items; the violations come from the order's lines.

    Lines are reduced to a few distinct types per order before the join, and
    before that to the orders whose ``item_id`` is ``wanted``.
    """
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    if wanted is not None:
        orders = orders.join(wanted, F.col("o_orderkey") == wanted["item_id"], "left_semi")
        lines = lines.join(wanted, F.col("l_orderkey") == wanted["item_id"], "left_semi")
    violations = lines.groupBy(F.col("l_orderkey").alias("item_id")).agg(
        F.sort_array(F.collect_set(F.concat("l_returnflag", F.lit("-"), "l_linestatus"))).alias(
            "violation_type"
        )
    )
    return plain_items(orders).join(violations, "item_id", "left").withColumn(
        "violation_type", F.coalesce("violation_type", F.array().cast("array<string>"))
    )


def plain_items(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.col("o_custkey").cast("string").alias("player_id"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("priority"),
        F.col("o_totalprice").alias("assessed_risk"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("preview"),
        F.date_format("o_orderdate", "d.MM.yyyy").alias("date"),
        F.concat(F.lit("Player "), F.col("o_custkey")).alias("player_name"),
        F.col("o_orderstatus").alias("game_id"),
        F.when(F.col("o_orderstatus") == "F", "Ignore").otherwise("Hate").alias("suggested_action"),
    )


ITEMS_SQL = """
    SELECT o_orderkey AS item_id, CAST(o_custkey AS VARCHAR) AS player_id,
           lower(substr(o_orderpriority, 3)) AS priority, o_totalprice AS assessed_risk,
           'order ' || o_orderkey AS preview,
           day(o_orderdate) || strftime(o_orderdate, '.%m.%Y') AS date,
           'Player ' || o_custkey AS player_name, o_orderstatus AS game_id,
           CASE WHEN o_orderstatus = 'F' THEN 'Ignore' ELSE 'Hate' END AS suggested_action
    FROM orders
"""

ITEMS_WITH_VIOLATIONS_SQL = f"""
    SELECT i.*, coalesce(v.types, []) AS violation_type
    FROM ({ITEMS_SQL}) i LEFT JOIN (
        SELECT l_orderkey, list(DISTINCT l_returnflag || '-' || l_linestatus
                                ORDER BY l_returnflag || '-' || l_linestatus) AS types
        FROM lineitem GROUP BY l_orderkey) v ON v.l_orderkey = i.item_id
"""


def player_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as the assessment table; one segment has none yet."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("player_id"),
        F.when(segment == "MACHINERY", "").otherwise(segment).alias("assessment"),
    )


ASSESSMENTS_SQL = """
    SELECT CAST(c_custkey AS VARCHAR) AS player_id,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS assessment
    FROM customer
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as moderator decisions on the order with the user's number."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        "ts",
        "event_id",
        F.when(kind == "purchase", "submit")
        .when(kind == "error", "toggle_escalate")
        .otherwise("set_action")
        .alias("kind"),
        kind.alias("action"),
    )


def user_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the highest window median as risk, and the mean of each score.

    Written once: the queries look at it more than once.
    """
    log = event_log(spark, sf_dir)
    windows = sliding_windows(log, "user_id", ["ts", "event_id"], ["value"])
    risk = windows.groupBy("user_id").agg(F.max(list_median(F.col("value"))).alias("risk_score"))
    means = log.groupBy("user_id").agg(*[F.avg(t).alias(t) for t in EVENT_TYPES])
    scores = risk.join(means, "user_id").withColumnRenamed("user_id", "vec_id")
    return materialize(scores, "user-risk")


USER_RISK_SQL = f"""
    SELECT user_id AS vec_id, risk_score, {', '.join(EVENT_TYPES)} FROM (
        SELECT user_id, max(list_aggregate(vals, 'median')) AS risk_score FROM (
            SELECT user_id, row_number() OVER w - 1 AS pos,
                   count(*) OVER (PARTITION BY user_id) AS n,
                   list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                       ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS vals
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE pos = 0 OR pos - 1 + 20 < n GROUP BY user_id)
    JOIN (SELECT user_id, {', '.join(f'avg({t}) AS {t}' for t in EVENT_TYPES)}
          FROM (SELECT user_id, {EVENT_SCORES_SQL} FROM events) GROUP BY user_id)
    USING (user_id)
"""
