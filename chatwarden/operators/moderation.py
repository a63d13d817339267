"""The review queue: views, filters, details and moderator decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.functions import review as fn
from chatwarden.functions.fixed_values import QUEUE_VIEWS, TRAIT_LABELS

# Escalation, submission and the chosen action are events in one table.
SET_ACTION, SUBMIT, TOGGLE = "set_action", "submit", "toggle_escalate"


def filter_priority(items: DataFrame, wanted: str) -> DataFrame:
    """Keeps items whose priority contains the text; ``all`` keeps everything."""
    return items if wanted == "all" else items.filter(F.contains("priority", F.lit(wanted)))


def filter_violation(items: DataFrame, wanted: str) -> DataFrame:
    """Keeps items with exactly this violation type; ``All`` keeps everything."""
    return items if wanted == "All" else items.filter(F.array_contains("violation_type", wanted))


def sort_by_risk(items: DataFrame, descending: bool = True) -> DataFrame:
    risk = F.col("assessed_risk")
    return items.orderBy(risk.desc() if descending else risk.asc(), "item_id")


def queue_rows(items: DataFrame) -> DataFrame:
    """What a row of the queue shows."""
    return items.select(
        "item_id",
        fn.priority_label(F.col("priority")).alias("priority_label"),
        "assessed_risk",
        "preview",
        "date",
        fn.violations_text(F.col("violation_type")).alias("violations"),
    )


def queue(
    items: DataFrame, priority: str = "all", violation: str = "All", descending: bool = True
) -> DataFrame:
    """Filter, then sort by assessed risk, then show."""
    kept = filter_violation(filter_priority(items, priority), violation)
    return sort_by_risk(queue_rows(kept), descending)


def is_queue_empty(items: DataFrame) -> bool:
    """Whether there is nothing to review; looks for one row, counts none."""
    return items.isEmpty()


def view_totals(items: DataFrame) -> DataFrame:
    """Items and total risk of each queue view that has any, in one pass."""
    wanted = F.array(*[F.lit(view) for view in QUEUE_VIEWS])
    shown_in = F.filter(wanted, lambda v: (v == "all") | F.contains(F.col("priority"), v))
    shown = items.select(F.explode(shown_in).alias("view_name"), "assessed_risk")
    return shown.groupBy("view_name").agg(
        F.count("*").alias("n_items"), F.sum("assessed_risk").alias("risk")
    )


def register_queue_views(items: DataFrame, prefix: str = "queue_") -> list[str]:
    """The five queue views as temp views."""
    names = []
    for wanted in QUEUE_VIEWS:
        name = f"{prefix}{wanted}"
        queue(items, wanted).createOrReplaceTempView(name)
        names.append(name)
    return names


def decision_state(decisions: DataFrame) -> DataFrame:
    """Per item: the last chosen action, whether submitted, whether escalated.

    One aggregate with partial results, so an item with very many decisions
    costs its tasks no more than any other.
    """
    kind = F.col("kind")
    chosen = kind == SET_ACTION
    when = F.when(chosen, F.struct("ts", "event_id"))
    toggles = F.count_if(kind == TOGGLE)
    return decisions.groupBy("item_id").agg(
        F.max_by("action", when).alias("chosen_action"),
        F.bool_or(kind == SUBMIT).alias("submitted"),
        (toggles % 2 == 1).alias("escalated"),
    )


def open_items(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items not yet submitted, with the decisions applied to them.

    Later choices replace earlier ones, a submitted item leaves the queue, and
    escalation is on after an odd number of toggles.
    """
    state = decision_state(decisions)
    return (
        items.join(state, "item_id", "left")
        .filter(~F.coalesce("submitted", F.lit(False)))
        .withColumn("suggested_action", F.coalesce("chosen_action", "suggested_action"))
        .withColumn("escalated", F.coalesce("escalated", F.lit(False)))
        .drop("chosen_action", "submitted")
    )


def with_assessment(items: DataFrame, assessments: DataFrame) -> DataFrame:
    """Looks up each player's assessment; ``pending`` when there is none yet."""
    found = assessments.select("player_id", F.col("assessment").alias("_found"))
    return (
        items.join(found, "player_id", "left")
        .withColumn("assessment", fn.assessment_or_pending(F.col("_found")))
        .drop("_found")
    )


def chat_context(
    chats: DataFrame, author: Column, text: Column, terms: Column, keep: list[str]
) -> DataFrame:
    """One shown line per message, marked if it holds a filtered term."""
    return chats.select(
        *keep,
        fn.chat_line(author, text).alias("line"),
        fn.is_highlighted(text, terms).alias("highlighted"),
    )


def item_chat(items: DataFrame, *keep: str) -> DataFrame:
    """The chat lines of review items, in message order, beside columns to keep."""
    lines = items.select(
        "item_id",
        *keep,
        F.col("conversation.filtered_content").alias("_terms"),
        F.posexplode("conversation.texts").alias("line_no", "_message"),
    )
    author, text = F.col("_message.author"), F.col("_message.text")
    return chat_context(lines, author, text, F.col("_terms"), ["item_id", "line_no", *keep])


def trait_radar(items: DataFrame, traits: str = "conversation.messaging_traits") -> DataFrame:
    """One row per item, player slot and labelled trait."""
    labels = F.array(*[F.lit(label) for label in TRAIT_LABELS])
    players = items.select("item_id", F.posexplode(traits).alias("player_slot", "_traits"))
    scores = players.select(
        "item_id", "player_slot", F.posexplode("_traits.data").alias("_axis", "score")
    )
    return scores.select(
        "item_id",
        "player_slot",
        F.try_element_at(labels, F.col("_axis") + 1).alias("trait"),
        "score",
    )


def cultural_context(items: DataFrame) -> DataFrame:
    return items.withColumn("cultural_context", fn.cultural_note(F.col("region")))


def alliance_info(items: DataFrame, *keep: str) -> DataFrame:
    return items.select(
        "item_id",
        *keep,
        F.col("alliance.alliance_id").alias("alliance_id"),
        F.col("alliance.moderator").alias("moderator"),
        F.col("alliance.alliance_description").alias("alliance_description"),
        F.col("alliance.is_family_friendly").alias("is_family_friendly"),
    )


def _details(items: DataFrame, assessments: DataFrame, wanted: DataFrame | None, *more: Column) -> DataFrame:
    if wanted is not None:
        items = items.join(wanted.select("item_id"), "item_id", "left_semi")
    return with_assessment(items, assessments).select(
        "item_id",
        "date",
        fn.priority_label(F.col("priority")).alias("priority_label"),
        fn.account_label(F.col("player_name")).alias("account"),
        "preview",
        fn.violations_text(F.col("violation_type")).alias("violations"),
        "assessment",
        "amount_of_times_reported",
        "game_id",
        fn.cultural_note(F.col("region")).alias("cultural_context"),
        "suggested_action",
        fn.confirmation(F.col("suggested_action")).alias("confirmation"),
        *more,
    )


def item_details(
    items: DataFrame, assessments: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """The detail record of each item, or of the ``item_id`` values in ``wanted``."""
    return _details(items, assessments, wanted)


def item_records(
    items: DataFrame, assessments: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """All that the detail panel shows of an item, as one nested record.

    Beside :func:`item_details`: ``player_id``, ``chat`` (shown lines, marked if
    they hold a filtered term), ``traits`` (slot, label and score of every
    player's chart) and ``alliance``. Everything stands in the item already, so
    nothing is exploded or joined for it.
    """
    terms = F.col("conversation.filtered_content")
    chat = F.transform(
        "conversation.texts",
        lambda m: F.struct(
            fn.chat_line(m["author"], m["text"]).alias("line"),
            fn.is_highlighted(m["text"], terms).alias("highlighted"),
        ),
    )
    labels = F.array(*[F.lit(label) for label in TRAIT_LABELS])
    charts = F.transform(
        "conversation.messaging_traits",
        lambda player, slot: F.transform(
            player["data"],
            lambda score, axis: F.struct(
                slot.alias("player_slot"),
                F.try_element_at(labels, axis + 1).alias("trait"),
                score.alias("score"),
            ),
        ),
    )
    return _details(
        items,
        assessments,
        wanted,
        F.col("player_id"),
        chat.alias("chat"),
        F.flatten(charts).alias("traits"),
        F.col("alliance"),
    )


def one_item(items: DataFrame, item_id: int) -> DataFrame:
    return items.filter(F.col("item_id") == item_id)
