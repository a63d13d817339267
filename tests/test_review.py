"""The review queue on neutral records of the declared shape."""

import datetime

import pytest
from pyspark.sql import functions as F

from chatwarden import schema
from chatwarden.functions import fixed_values as fixed, review as fn
from chatwarden.operators import moderation as Q
from chatwarden.sources import review_items as store


def item(i, priority, risk, types, date="10.02.2023", player="p1", region="Europe", traits=1, terms=()):
    return {
        "item_id": i,
        "region": region,
        "player_assessment": "",
        **({"player_id": player} if player else {}),
        "number_of_past_offences": 1,
        "conversation": {
            "texts": [{"text": "good game all", "author": "abcdefgh"}, {"text": "see You", "author": "xy"}],
            "filtered_content": list(terms),
            "messaging_traits": [{"data": [1.5, 0, 0.25, 0, 2, 3 + t]} for t in range(traits)],
        },
        "alliance": {
            "alliance_id": f"a{i}",
            "alliance_description": "friendly",
            "moderator": "m",
            "is_family_friendly": i % 2 == 0,
        },
        "priority": priority,
        "assessed_risk": risk,
        "player_name": "Kim",
        "amount_of_times_reported": 2,
        "suggested_action": "Hate",
        "game_id": "G",
        "preview": "good game",
        "date": date,
        "violation_type": types,
    }


ITEMS = [
    item(0, "standard", 0.5, ["Vulgarity"], terms=["game"]),
    item(1, "high", 0.9, ["Bullying", "Fraud"], "4.04.2021", region="South East Asia", traits=2),
    item(2, "medium", 0.5, ["Fraud"], player=None, terms=["you"]),
    item(3, "low", 0.1, [], player="p3", terms=[""]),
    item(4, "urgent", 0.7, ["Hate Speech"], player="p4"),
]


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    import json

    path = tmp_path_factory.mktemp("items") / "items.json"
    path.write_text("\n".join(json.dumps(i) for i in ITEMS))
    return store.read_review_items(spark, str(path))


def ids(df):
    return [r.item_id for r in df.collect()]


def test_nested_records_survive_a_round_trip(spark, items, tmp_path):
    path = str(tmp_path / "again")
    store.write_review_items(items, path)
    again = store.read_review_items(spark, path).orderBy("item_id").collect()
    assert again == items.orderBy("item_id").collect()
    assert again[2].player_id is None and again[0].conversation.filtered_content == ["game"]


def test_queue_filters_and_sort(items):
    assert ids(Q.queue(items)) == [1, 4, 0, 2, 3]
    assert ids(Q.queue(items, descending=False)) == [3, 0, 2, 4, 1]
    assert ids(Q.queue(items, priority="high")) == [1]
    assert ids(Q.queue(items, priority="gen")) == [4]  # a part of the text is enough
    assert ids(Q.queue(items, violation="Fraud")) == [1, 2]
    assert ids(Q.queue(items, violation="Frau")) == []
    assert ids(Q.queue(items, priority="medium", violation="Fraud")) == [2]
    assert Q.is_queue_empty(Q.queue(items, priority="none")) and not Q.is_queue_empty(items)
    first = Q.queue(items).first()
    assert first.asDict() == {
        "item_id": 1,
        "priority_label": "High",
        "assessed_risk": 0.9,
        "preview": "good game",
        "date": "4.04.2021",
        "violations": "Bullying, Fraud",
    }
    labels = {r.item_id: r.priority_label for r in Q.queue_rows(items).collect()}
    assert labels == {0: "Standard", 1: "High", 2: "Medium", 3: "Low", 4: None}


def test_queue_views(spark, items):
    names = Q.register_queue_views(items)
    counts = {n: spark.table(n).count() for n in names}
    assert counts == {"queue_all": 5, "queue_high": 1, "queue_medium": 1, "queue_standard": 1, "queue_low": 1}


def test_chat_lines_and_highlights(items):
    lines = Q.item_chat(items).orderBy("item_id", "line_no").collect()
    assert [r.line for r in lines[:2]] == ["abcde: good game all", "xy: see You"]
    marked = {i: [r.highlighted for r in lines if r.item_id == i] for i in range(4)}
    assert marked == {0: [True, False], 1: [False, False], 2: [False, False], 3: [True, True]}


def test_radar(items):
    radar = Q.trait_radar(items).collect()
    assert len(radar) == 6 * 6
    mine = [(r.player_slot, r.trait, r.score) for r in radar if r.item_id == 1]
    scores = [1.5, 0, 0.25, 0, 2]
    want = [(s, t, v) for s in (0, 1) for t, v in zip(fixed.TRAIT_LABELS, [*scores, 3 + s])]
    assert sorted(mine) == sorted(want)


def test_details(spark, items):
    known = spark.createDataFrame([("p1", "calm"), ("p3", "")], schema.PLAYER_ASSESSMENT)
    details = {r.item_id: r for r in Q.item_details(items, known).collect()}
    assert {i: r.assessment for i, r in details.items()} == {
        0: "calm", 1: "calm", 2: "pending", 3: "pending", 4: "pending"
    }
    assert details[0].account == "Kim's Account" and details[0].cultural_context == "N/A"
    assert details[1].cultural_context == fixed.REGION_NOTES["South East Asia"]
    assert details[0].confirmation == "The reviewed item will be classified as Hate."
    wanted = spark.createDataFrame([(3,), (3,)], "item_id LONG")
    assert ids(Q.item_details(items, known, wanted)) == [3]
    assert ids(Q.one_item(items, 4)) == [4]
    info = Q.alliance_info(items).filter("item_id = 1").first()
    assert (info.alliance_id, info.moderator, info.is_family_friendly) == ("a1", "m", False)


def test_small_columns(spark):
    df = spark.createDataFrame([("Ignore", "4.04.2021")], "action STRING, date STRING")
    row = df.select(fn.confirmation(F.col("action")), fn.review_date(F.col("date"))).first()
    assert row[0] == "The reviewed item will be ignored."
    assert row[1] == datetime.date(2021, 4, 4)


def test_decisions(spark, items):
    t = [datetime.datetime(2024, 1, 1, 0, i) for i in range(9)]
    events = [
        (0, t[3], 1, "set_action", "Fraud"),
        (0, t[1], 2, "set_action", "Early"),
        (0, t[3], 3, "set_action", "Last"),  # same time, later id
        (0, t[4], 4, "toggle_escalate", None),
        (1, t[0], 5, "toggle_escalate", None),
        (1, t[1], 6, "toggle_escalate", None),
        (2, t[0], 7, "submit", None),
        (2, t[5], 8, "set_action", "Too late"),
        (3, t[0], 9, "toggle_escalate", None),
    ]
    decisions = spark.createDataFrame(events, schema.DECISIONS)
    left = {r.item_id: (r.suggested_action, r.escalated) for r in Q.open_items(items, decisions).collect()}
    assert left == {0: ("Last", True), 1: ("Hate", False), 3: ("Hate", True), 4: ("Hate", False)}
    reopened = Q.open_items(items, decisions.limit(0))
    assert reopened.count() == 5
