"""Declared schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

from chatwarden.functions import fixed_values as fixed

ALLIANCE = "alliance_id"
TEXT = "text"
CHAT = "chat"


def _log_name(position: int) -> str:
    if position == fixed.ALLIANCE_POSITION:
        return ALLIANCE
    if position == fixed.TEXT_POSITION:
        return TEXT
    if position in fixed.SCORE_POSITIONS:
        return f"score_{position}"
    return f"field_{position}"


LOG_COLUMNS = tuple(_log_name(i) for i in range(fixed.LOG_COLUMN_COUNT))
SCORE_COLUMNS = tuple(_log_name(i) for i in fixed.SCORE_POSITIONS)
PROFILE_COLUMNS = tuple(_log_name(i) for i in fixed.PROFILE_POSITIONS)
SEED_COLUMN = _log_name(fixed.SEED_POSITION)
LABEL_COLUMN = _log_name(fixed.LABEL_POSITION)

# A log as exported: no order but that of its lines (sources.logs.FILE_ORDER).
RAW_LOG = T.StructType(
    [
        T.StructField(name, T.DoubleType() if name in SCORE_COLUMNS else T.StringType())
        for name in LOG_COLUMNS
    ]
)

# A log that carries the order of its messages as data.
ORDER_COLUMNS = ("msg_ts", "msg_id")
MESSAGE_LOG = T.StructType(
    RAW_LOG.fields
    + [T.StructField("msg_ts", T.TimestampType()), T.StructField("msg_id", T.LongType())]
)

# Windows as text: every cell is a list written as a literal.
TEXT_WINDOWS = T.StructType([T.StructField(name, T.StringType()) for name in LOG_COLUMNS])

CENTERS = T.StructType(
    [
        T.StructField("cluster_id", T.IntegerType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
    ]
)

# DDL text, as spark.read.schema() takes it.
REVIEW_ITEM = """
    item_id BIGINT, region STRING, player_assessment STRING, player_id STRING,
    number_of_past_offences INT,
    conversation STRUCT<
        texts: ARRAY<STRUCT<text: STRING, author: STRING>>,
        filtered_content: ARRAY<STRING>,
        messaging_traits: ARRAY<STRUCT<data: ARRAY<DOUBLE>>>>,
    alliance STRUCT<alliance_id: STRING, alliance_description: STRING,
        moderator: STRING, is_family_friendly: BOOLEAN>,
    priority STRING, assessed_risk DOUBLE, player_name STRING,
    amount_of_times_reported INT, suggested_action STRING, game_id STRING,
    preview STRING, date STRING, violation_type ARRAY<STRING>
"""
DECISIONS = "item_id BIGINT, ts TIMESTAMP, event_id BIGINT, kind STRING, action STRING"
PLAYER_ASSESSMENT = "player_id STRING, assessment STRING"
