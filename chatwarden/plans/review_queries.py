"""Queries on the review queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from chatwarden.functions import fixed_values as fixed, review as fn
from chatwarden.operators import moderation as Q
from chatwarden.plans.roles import (
    ASSESSMENTS_SQL,
    EVENT_TYPES,
    ITEMS_SQL,
    ITEMS_WITH_VIOLATIONS_SQL,
    decisions as decision_events,
    plain_items,
    player_assessments,
    review_items,
    table,
)
from chatwarden.session import scratch_path
from chatwarden.sources import review_items as store

_PRIORITY_SQL = (
    "CASE priority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PRIORITY_LABELS.items())
    + " END"
)


def _note_sql(region: str) -> str:
    cases = " ".join(
        f"WHEN '{name}' THEN '" + note.replace("'", "''") + "'"
        for name, note in fixed.REGION_NOTES.items()
    )
    return f"CASE {region} {cases} ELSE '{fixed.NO_REGION_NOTE}' END"


def _queue_sql(condition: str = "true") -> str:
    return f"""
        SELECT item_id, {_PRIORITY_SQL} AS priority_label, assessed_risk, preview, date,
               array_to_string(violation_type, ', ') AS violations
        FROM ({ITEMS_WITH_VIOLATIONS_SQL}) WHERE {condition}
    """


def review_queue(spark, sf_dir):
    return Q.queue(review_items(spark, sf_dir))


def review_queue_high(spark, sf_dir):
    return Q.queue(review_items(spark, sf_dir), priority="high")


def review_queue_violation(spark, sf_dir):
    return Q.queue(review_items(spark, sf_dir), violation="R-F", descending=False)


def queue_views(spark, sf_dir):
    """How many items each of the five views shows, and their total risk."""
    totals = Q.view_totals(plain_items(table(spark, sf_dir, "orders")))
    return totals.withColumn("risk", F.round("risk", 2))


QUEUE_VIEWS = " UNION ALL ".join(
    f"""SELECT '{v}' AS view_name, count(*) AS n_items, round(sum(assessed_risk), 2) AS risk
        FROM ({ITEMS_SQL}) WHERE {'true' if v == 'all' else f"contains(priority, '{v}')"}
        HAVING count(*) > 0"""
    for v in fixed.QUEUE_VIEWS
)

def queue_view_rows(spark, sf_dir):
    """The rows of the five views, each read from its registered view."""
    items = review_items(spark, sf_dir)
    names = Q.register_queue_views(items, "shown_")
    views = [spark.table(name).withColumn("view_name", F.lit(name.removeprefix("shown_"))) for name in names]
    return reduce(DataFrame.unionByName, views)


QUEUE_VIEW_ROWS = " UNION ALL ".join(
    f"""SELECT *, '{v}' AS view_name FROM ({_queue_sql('true' if v == 'all' else f"contains(priority, '{v}')")})"""
    for v in fixed.QUEUE_VIEWS
)


def empty_views(spark, sf_dir):
    """Whether there is nothing to review in each view, and among items of a violation that none has."""
    items = review_items(spark, sf_dir)
    views = {v: Q.filter_priority(items, v) for v in fixed.QUEUE_VIEWS}
    views["no such violation"] = Q.filter_violation(items, "Z-Z")
    rows = [(name, Q.is_queue_empty(shown)) for name, shown in views.items()]
    return spark.createDataFrame(rows, "view_name STRING, is_empty BOOLEAN")


EMPTY_VIEWS = " UNION ALL ".join(
    f"""SELECT '{v}' AS view_name, count(*) = 0 AS is_empty FROM ({ITEMS_WITH_VIOLATIONS_SQL})
        WHERE {'true' if v == 'all' else f"contains(priority, '{v}')"}"""
    for v in fixed.QUEUE_VIEWS
) + f"""
    UNION ALL SELECT 'no such violation', count(*) = 0 FROM ({ITEMS_WITH_VIOLATIONS_SQL})
    WHERE list_contains(violation_type, 'Z-Z')
"""

# Filtered terms beside the chats; system messages come with none.
_TERMS = ("tion", "Der")


def chat_context(spark, sf_dir):
    terms = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(
        F.array(*[F.lit(t) for t in _TERMS])
    )
    chats = table(spark, sf_dir, "conversations")
    return Q.chat_context(chats, F.col("role"), F.col("text"), terms, ["conv_id", "turn"])


CHAT_CONTEXT = f"""
    SELECT conv_id, turn, substr(role, 1, 5) || ': ' || text AS line,
           role <> 'system' AND ({' OR '.join(f"contains(text, '{t}')" for t in _TERMS)})
               AS highlighted
    FROM conversations
"""


def _trait_items(spark, sf_dir):
    """Users as items with two players: mean and highest value per event type."""
    kind, value = F.col("event_type"), F.col("value")

    def six(aggregate):
        per_type = [aggregate(F.when(kind == t, value)) for t in EVENT_TYPES]
        return F.struct(F.array(*per_type, aggregate(value)).alias("data"))

    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("item_id"))
        .agg(F.array(six(F.avg), six(F.max)).alias("traits"))
    )


def trait_radar(spark, sf_dir):
    radar = Q.trait_radar(_trait_items(spark, sf_dir), "traits")
    return radar.withColumn("score", F.round("score", 6))


def _radar_sql(slot: int, aggregate: str) -> str:
    types = [f"WHERE event_type = '{t}'" for t in EVENT_TYPES] + [""]
    return " UNION ALL ".join(
        f"""SELECT user_id AS item_id, {slot} AS player_slot, '{label}' AS trait,
                   round({aggregate}(value) {f'FILTER ({w})' if w else ''}, 6) AS score
            FROM events GROUP BY user_id"""
        for label, w in zip(fixed.TRAIT_LABELS, types)
    )


TRAIT_RADAR = f"{_radar_sql(0, 'avg')} UNION ALL {_radar_sql(1, 'max')}"


def cultural_context(spark, sf_dir):
    """Customers as items, their region found over the nation."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("n_nationkey")
    )
    region = F.when(F.col("r_name") == "ASIA", "South East Asia").otherwise(F.col("r_name"))
    regions = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", region.alias("region"))
    )
    items = customers.join(regions, "n_nationkey", "left")
    return Q.cultural_context(items).select("item_id", "region", "cultural_context")


CULTURAL_CONTEXT = f"""
    SELECT item_id, region, {_note_sql('region')} AS cultural_context
    FROM (SELECT c_custkey AS item_id,
                 CASE WHEN r_name = 'ASIA' THEN 'South East Asia' ELSE r_name END AS region
          FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
          LEFT JOIN region ON n_regionkey = r_regionkey)
"""


def _detail_items(spark, sf_dir, wanted=None):
    region = F.when(F.col("priority") == "high", "South East Asia").otherwise("Europe")
    return review_items(spark, sf_dir, wanted).withColumns(
        {"amount_of_times_reported": F.size("violation_type"), "region": region}
    )


def item_detail(spark, sf_dir):
    return Q.item_details(_detail_items(spark, sf_dir), player_assessments(spark, sf_dir))


def _detail_sql(condition: str = "true") -> str:
    return f"""
        SELECT item_id, date, {_PRIORITY_SQL} AS priority_label,
               player_name || '''s Account' AS account, preview,
               array_to_string(violation_type, ', ') AS violations,
               CASE WHEN coalesce(assessment, '') = '' THEN 'pending' ELSE assessment END
                   AS assessment,
               CAST(len(violation_type) AS INTEGER) AS amount_of_times_reported, game_id,
               {_note_sql("CASE WHEN priority = 'high' THEN 'South East Asia' END")}
                   AS cultural_context,
               suggested_action,
               CASE WHEN suggested_action = 'Ignore' THEN 'The reviewed item will be ignored.'
                    ELSE 'The reviewed item will be classified as ' || suggested_action || '.' END
                   AS confirmation
        FROM ({ITEMS_WITH_VIOLATIONS_SQL}) LEFT JOIN ({ASSESSMENTS_SQL}) USING (player_id)
        WHERE {condition}
    """


def item_lookup(spark, sf_dir):
    """Details of the items that decisions speak of."""
    wanted = decision_events(spark, sf_dir).select("item_id").distinct()
    return Q.item_details(_detail_items(spark, sf_dir, wanted), player_assessments(spark, sf_dir))


def item_records(spark, sf_dir):
    """The whole record of the items that decisions speak of, its nested parts as texts."""
    wanted = decision_events(spark, sf_dir).select("item_id").distinct()

    def message(text, author):
        return F.struct(text.alias("text"), author.alias("author"))

    scores = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.floor(F.col("assessed_risk") * i).cast("double"))
    items = _detail_items(spark, sf_dir, wanted).withColumns(
        {
            "conversation": F.struct(
                F.array(
                    message(F.col("preview"), F.col("player_name")),
                    message(F.col("suggested_action"), F.lit("Moderator")),
                ).alias("texts"),
                F.array(F.lit("order 1"), F.lit("Hate")).alias("filtered_content"),
                F.array(F.struct(scores.alias("data"))).alias("messaging_traits"),
            ),
            "alliance": F.struct(
                F.col("game_id").alias("alliance_id"),
                F.col("preview").alias("alliance_description"),
                F.col("player_name").alias("moderator"),
                (F.col("priority") == "low").alias("is_family_friendly"),
            ),
        }
    )
    found = Q.item_records(items, player_assessments(spark, sf_dir))
    mark = lambda c: F.concat(c["line"], F.when(c["highlighted"], "*").otherwise(""))
    chart = lambda t: F.concat_ws("=", t["player_slot"], t["trait"], t["score"].cast("bigint"))
    return found.withColumns(
        {
            "chat": F.array_join(F.transform("chat", mark), "|"),
            "traits": F.array_join(F.transform("traits", chart), "|"),
            "alliance": F.concat_ws("|", "alliance.alliance_id", "alliance.moderator", "alliance.alliance_description"),
        }
    )


def _records_sql() -> str:
    traits = " || '|' || ".join(
        f"'0={label}=' || CAST(floor(assessed_risk * {i}) AS BIGINT)" for i, label in enumerate(fixed.TRAIT_LABELS, 1)
    )
    return f"""
        SELECT d.*, player_id, substr(player_name, 1, 5) || ': ' || i.preview
                   || CASE WHEN contains(i.preview, 'order 1') THEN '*' ELSE '' END
                   || '|Moder: ' || i.suggested_action
                   || CASE WHEN i.suggested_action = 'Hate' THEN '*' ELSE '' END AS chat,
               {traits} AS traits, i.game_id || '|' || player_name || '|' || i.preview AS alliance
        FROM ({_detail_sql("item_id IN (SELECT user_id FROM events)")}) d
        JOIN ({ITEMS_SQL}) i ON i.item_id = d.item_id
    """


def assessment_lookup(spark, sf_dir):
    items = plain_items(table(spark, sf_dir, "orders"))
    found = Q.with_assessment(items, player_assessments(spark, sf_dir))
    return found.select("item_id", "player_id", "assessment")


ASSESSMENT_LOOKUP = f"""
    SELECT item_id, player_id,
           CASE WHEN coalesce(assessment, '') = '' THEN 'pending' ELSE assessment END AS assessment
    FROM ({ITEMS_SQL}) LEFT JOIN ({ASSESSMENTS_SQL}) USING (player_id)
"""


def decisions(spark, sf_dir):
    """The queue after all moderator decisions."""
    items = plain_items(table(spark, sf_dir, "orders"))
    left = Q.open_items(items, decision_events(spark, sf_dir))
    return left.select("item_id", "suggested_action", "escalated")


DECISIONS = f"""
    SELECT item_id, coalesce(chosen, suggested_action) AS suggested_action,
           coalesce(toggles, 0) % 2 = 1 AS escalated
    FROM ({ITEMS_SQL}) LEFT JOIN (
        SELECT user_id AS item_id,
               arg_max(event_type, (ts, event_id))
                   FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS chosen,
               count(*) FILTER (WHERE event_type = 'error') AS toggles
        FROM events GROUP BY user_id) USING (item_id)
    WHERE item_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
"""


def stored_decisions(spark, sf_dir):
    """Decisions and assessments from their stores: the queue after decisions appended in two parts."""
    path, known = scratch_path(spark, "decisions"), scratch_path(spark, "assessments")
    events = decision_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    early = F.hour("ts") < 12
    for part in (events.filter(early), events.filter(~early)):
        store.append_decisions(part, path)
    player_assessments(spark, sf_dir).write.parquet(known)
    items = plain_items(table(spark, sf_dir, "orders"))
    left = Q.open_items(items, store.read_decisions(spark, path))
    assessed = Q.with_assessment(left, store.read_assessments(spark, known))
    return assessed.select("item_id", "suggested_action", "escalated", "assessment")


STORED_DECISIONS = f"""
    SELECT item_id, d.suggested_action, escalated, assessment
    FROM ({DECISIONS}) d JOIN ({ASSESSMENT_LOOKUP}) USING (item_id)
"""


def decision_state(spark, sf_dir):
    """Where every item stands after all decisions."""
    return Q.decision_state(decision_events(spark, sf_dir))


DECISION_STATE = """
    SELECT user_id AS item_id,
           arg_max(event_type, (ts, event_id))
               FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS chosen_action,
           bool_or(event_type = 'purchase') AS submitted,
           count(*) FILTER (WHERE event_type = 'error') % 2 = 1 AS escalated
    FROM events GROUP BY user_id
"""


def nested_items(spark, sf_dir):
    """Items written as nested JSON, read with the schema, flattened again."""
    path = scratch_path(spark, "items")
    items = review_items(spark, sf_dir)
    nested = items.select(
        "item_id", "player_id", "priority", "assessed_risk", "date", "violation_type",
        F.struct(
            F.array(
                F.struct(F.col("preview").alias("text"), F.col("player_name").alias("author"))
            ).alias("texts"),
            F.array().cast("array<string>").alias("filtered_content"),
        ).alias("conversation"),
        F.struct(
            F.col("game_id").alias("alliance_id"),
            F.col("player_name").alias("moderator"),
            F.col("preview").alias("alliance_description"),
            (F.col("priority") == "low").alias("is_family_friendly"),
        ).alias("alliance"),
    )
    store.write_review_items(nested, path)
    back = store.read_review_items(spark, path)
    shown = Q.item_chat(back, "alliance", "player_id", "violation_type", "date")
    info = Q.alliance_info(shown, "line", "player_id", "violation_type", "date")
    return info.withColumns(
        {
            "violations": fn.violations_text(F.col("violation_type")),
            "review_date": fn.review_date(F.col("date")).cast("string"),
        }
    ).drop("violation_type", "date")


NESTED_ITEMS = f"""
    SELECT item_id, game_id AS alliance_id, player_name AS moderator,
           preview AS alliance_description, priority = 'low' AS is_family_friendly,
           substr(player_name, 1, 5) || ': ' || preview AS line, player_id,
           array_to_string(violation_type, ', ') AS violations,
           CAST(CAST(strptime(date, '%d.%m.%Y') AS DATE) AS VARCHAR) AS review_date
    FROM ({ITEMS_WITH_VIOLATIONS_SQL})
"""

QUERIES = {
    "review_queue": (review_queue, _queue_sql()),
    "review_queue_high": (review_queue_high, _queue_sql("contains(priority, 'high')")),
    "review_queue_violation": (
        review_queue_violation, _queue_sql("list_contains(violation_type, 'R-F')")
    ),
    "queue_views": (queue_views, QUEUE_VIEWS),
    "queue_view_rows": (queue_view_rows, QUEUE_VIEW_ROWS),
    "empty_views": (empty_views, EMPTY_VIEWS),
    "chat_context": (chat_context, CHAT_CONTEXT),
    "trait_radar": (trait_radar, TRAIT_RADAR),
    "cultural_context": (cultural_context, CULTURAL_CONTEXT),
    "item_detail": (item_detail, _detail_sql()),
    "item_lookup": (item_lookup, _detail_sql("item_id IN (SELECT user_id FROM events)")),
    "item_records": (item_records, _records_sql()),
    "assessment_lookup": (assessment_lookup, ASSESSMENT_LOOKUP),
    "decisions": (decisions, DECISIONS),
    "stored_decisions": (stored_decisions, STORED_DECISIONS),
    "decision_state": (decision_state, DECISION_STATE),
    "nested_items": (nested_items, NESTED_ITEMS),
}
