"""Queries on message windows and their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatwarden import schema
from chatwarden.functions import fixed_values as fixed
from chatwarden.functions.arrays import list_mean, list_median, list_sum, risk_label
from chatwarden.functions.fixed_values import EMOJI_PATTERN
from chatwarden.functions.text import tokens as word_tokens
from chatwarden.operators import windows as W
from chatwarden.operators.cleaning import clean_windows, drop_malformed, parse_windows
from chatwarden.operators.vectors import risk_profile, riskiest
from chatwarden.plans import flows
from chatwarden.plans.roles import EVENT_SCORES_SQL, EVENT_TYPES, event_log, table
from chatwarden.session import scratch_path, spread
from chatwarden.sources import logs

ORDER = ["ts", "event_id"]
TOP = 50

# Fixed texts put behind each message: two emoji that are stripped, one that stays.
STRIPPED = "\U0001f600\U0001f680"
KEPT = "\U0001f913"


def windows_sql(columns: str, source: str = "events", length: int = 20, step: int = 1) -> str:
    """``user_id``, ``pos`` and one list per column for every window of the log."""
    stride = min(step, length)
    lists = ", ".join(f"list({c}) OVER f AS {c}" for c in columns.split())
    return f"""
        SELECT * FROM (
            SELECT user_id, row_number() OVER w - 1 AS pos,
                   count(*) OVER (PARTITION BY user_id) AS n, {lists}
            FROM {source}
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
                   f AS (PARTITION BY user_id ORDER BY ts, event_id
                         ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING))
        WHERE pos % {stride} = 0 AND (pos = 0 OR pos - {stride} + {length} < n)
    """


def sliding_windows(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return _shown(W.sliding_windows(log, "user_id", ORDER, ["event_id", "value"]))


def _shown(found):
    return found.select(
        "user_id",
        "sample_id",
        "window_start",
        "n_messages",
        F.array_join("event_id", ",").alias("event_ids"),
        F.round(list_sum(F.col("value")), 6).alias("value_sum"),
    )


SLIDING_WINDOWS = f"""
    SELECT user_id, user_id || ':' || pos AS sample_id, pos AS window_start,
           CAST(len(event_id) AS INTEGER) AS n_messages,
           array_to_string(event_id, ',') AS event_ids, round(list_sum(value), 6) AS value_sum
    FROM ({windows_sql('event_id value')})
"""


def sliding_windows_step(spark, sf_dir):
    found = W.sliding_windows(
        table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"], 4, 2
    )
    return found.select(
        "conv_id",
        "window_start",
        "n_messages",
        F.array_join("role", ",").alias("roles"),
        F.array_join("text", " ").alias("texts"),
    )


def _conversation_windows_sql(columns: str) -> str:
    return f"""
        SELECT * FROM (
            SELECT conv_id, row_number() OVER w - 1 AS pos,
                   count(*) OVER (PARTITION BY conv_id) AS n, {columns}
            FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn),
                   f AS (PARTITION BY conv_id ORDER BY turn
                         ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
        WHERE pos % 2 = 0 AND (pos = 0 OR pos - 2 + 4 < n)
    """


SLIDING_WINDOWS_STEP = f"""
    SELECT conv_id, pos AS window_start, CAST(len(roles) AS INTEGER) AS n_messages,
           array_to_string(roles, ',') AS roles, array_to_string(texts, ' ') AS texts
    FROM ({_conversation_windows_sql('list(role) OVER f AS roles, list(text) OVER f AS texts')})
"""


def segmented_windows(spark, sf_dir):
    """The windows again, cut from many short pieces of every group."""
    found = W.sliding_windows(
        event_log(spark, sf_dir), "user_id", ORDER, ["event_id"], 20, 3, piece_rows=30
    )
    return found.select(
        "user_id", "window_start", "n_messages", F.array_join("event_id", ",").alias("event_ids")
    )


SEGMENTED_WINDOWS = f"""
    SELECT user_id, pos AS window_start, CAST(len(event_id) AS INTEGER) AS n_messages,
           array_to_string(event_id, ',') AS event_ids
    FROM ({windows_sql('event_id', step=3)})
"""


def run_windows(spark, sf_dir):
    found = W.run_windows(table(spark, sf_dir, "events"), "event_type", ORDER, ["event_id"], 3, 2)
    return found.select(
        "event_type",
        "run_start",
        "window_start",
        "n_messages",
        F.array_join("event_id", ",").alias("event_ids"),
    )


RUN_WINDOWS = """
    WITH ranked AS (
        SELECT event_type, event_id, row_number() OVER o - 1 AS r,
               lag(event_type) OVER o IS DISTINCT FROM event_type AS fresh
        FROM events WINDOW o AS (ORDER BY ts, event_id)),
    runs AS (
        SELECT event_type, event_id, r,
               max(CASE WHEN fresh THEN r END) OVER (ORDER BY r) AS run_start FROM ranked),
    framed AS (
        SELECT event_type, run_start, r - run_start AS pos,
               count(*) OVER (PARTITION BY run_start) AS n,
               list(event_id) OVER (PARTITION BY run_start ORDER BY r
                   ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ids
        FROM runs)
    SELECT event_type, run_start, pos AS window_start, CAST(len(ids) AS INTEGER) AS n_messages,
           array_to_string(ids, ',') AS event_ids
    FROM framed WHERE pos % 2 = 0 AND (pos = 0 OR pos - 2 + 3 < n)
"""


def _as_literal(texts):
    """A list of texts the way a list is written as text; a NULL is a bare nan."""

    def quoted(text):
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        escaped = F.replace(escaped, F.lit("\n"), F.lit("\\n"))
        escaped = F.replace(escaped, F.lit("'"), F.lit("\\'"))
        return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("nan"))

    return F.concat(F.lit("["), F.array_join(F.transform(texts, quoted), ", "), F.lit("]"))


def clean_chat(spark, sf_dir):
    """Windows stored as text, read back, malformed ones dropped, emoji stripped.

    Messages of the system role are written as missing values. The cleaned
    windows are stored with their chat.
    """
    said = F.when(F.col("role") != "system", F.concat("text", F.lit(f" {STRIPPED}!{KEPT}")))
    log = table(spark, sf_dir, "conversations").withColumn("text", said)
    found = W.sliding_windows(log, "conv_id", ["turn"], ["text"], 4, 2)
    stored = found.select("conv_id", "window_start", _as_literal(F.col("text")).alias("text"))
    path = scratch_path(spark, "clean")
    logs.write_windows(clean_windows(stored, "text", []), path)
    return logs.read_table(spark, path).select("conv_id", "window_start", "chat")


CLEAN_CHAT = f"""
    SELECT conv_id, pos AS window_start,
           regexp_replace(array_to_string(texts, ' '), '{EMOJI_PATTERN}', '', 'g') AS chat
    FROM ({_conversation_windows_sql(
        f"list(text || ' {STRIPPED}!{KEPT}') OVER f AS texts, list(role) OVER f AS roles")})
    WHERE NOT list_contains(roles, 'system')
"""


def parse_list_columns(spark, sf_dir):
    """Vectors written as text and read back; those of one label hold a bad value."""
    numbers = F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", ")
    tail = F.when(F.col("label") == 9, ", nan]").otherwise("]")
    stored = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("["), numbers, tail).alias("scores")
    )
    parsed = drop_malformed(parse_windows(stored, [], ["scores"]), [], ["scores"])
    return parsed.select(
        "vec_id",
        F.size("scores").alias("n_scores"),
        F.round(list_sum(F.col("scores")), 6).alias("score_sum"),
        F.round(F.element_at("scores", 1), 6).alias("first_score"),
        F.round(F.element_at("scores", -1), 6).alias("last_score"),
    )


PARSE_LIST_COLUMNS = """
    SELECT vec_id, CAST(len(s) AS INTEGER) AS n_scores, round(list_sum(s), 6) AS score_sum,
           round(s[1], 6) AS first_score, round(s[len(s)], 6) AS last_score
    FROM (SELECT vec_id, CAST(CAST(embedding::DOUBLE[] AS VARCHAR) AS DOUBLE[]) AS s
          FROM embeddings WHERE label <> 9)
"""


def tokens(spark, sf_dir):
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = texts.select("doc_id", word_tokens(F.col("text"), None).alias("all_tokens"))
    kept = F.slice("all_tokens", 1, 512)
    return found.select(
        "doc_id",
        F.size("all_tokens").alias("n_tokens"),
        F.size(kept).alias("n_kept"),
        F.md5(F.array_join("all_tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join(kept, " ")).alias("kept_md5"),
    )


TOKENS = r"""
    SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(t[1:512]) AS INTEGER) AS n_kept,
           md5(array_to_string(t, ' ')) AS tokens_md5,
           md5(array_to_string(t[1:512], ' ')) AS kept_md5
    FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS t
          FROM documents)
"""


def window_label(spark, sf_dir):
    found = W.sliding_windows(event_log(spark, sf_dir), "user_id", ORDER, ["value"])
    return found.select(
        "user_id",
        "window_start",
        F.round(list_mean(F.col("value")), 6).alias("mean_score"),
        F.round(risk_label(F.col("value")), 9).alias("label"),
    )


WINDOW_LABEL = f"""
    SELECT user_id, pos AS window_start, round(list_avg(value), 6) AS mean_score,
           round((list_avg(value) + 1) / 8, 9) AS label
    FROM ({windows_sql('value')})
"""


def _riskiest(spark, sf_dir, columns):
    found = W.sliding_windows(event_log(spark, sf_dir), "user_id", ORDER, columns)
    return riskiest(found, "value", TOP, "sample_id")


def riskiest_windows(spark, sf_dir):
    return _riskiest(spark, sf_dir, ["value"]).select(
        "user_id", "sample_id", "n_messages", F.round("risk", 6).alias("risk")
    )


_RISKIEST_SQL = f"""
    SELECT *, user_id || ':' || pos AS sample_id, list_aggregate(value, 'median') AS risk
    FROM ({windows_sql('value ' + ' '.join(EVENT_TYPES),
                       f'(SELECT *, {EVENT_SCORES_SQL} FROM events)')})
    ORDER BY risk DESC, sample_id LIMIT {TOP}
"""

RISKIEST_WINDOWS = f"""
    SELECT user_id, sample_id, CAST(len(value) AS INTEGER) AS n_messages, round(risk, 6) AS risk
    FROM ({_RISKIEST_SQL})
"""


def riskiest_profile(spark, sf_dir):
    picked = _riskiest(spark, sf_dir, ["value", *EVENT_TYPES])
    profile = risk_profile(picked, EVENT_TYPES)
    return profile.select(*[F.round(t, 6).alias(t) for t in EVENT_TYPES])


RISKIEST_PROFILE = f"""
    SELECT {', '.join(f'round(avg(list_avg({t})), 6) AS {t}' for t in EVENT_TYPES)}
    FROM ({_RISKIEST_SQL})
"""


def window_medians(spark, sf_dir):
    """Median of every window, of odd and even size."""
    found = W.sliding_windows(event_log(spark, sf_dir), "user_id", ORDER, ["value"], 7, 5)
    return found.select(
        "user_id", "window_start", F.round(list_median(F.col("value")), 6).alias("median_score")
    )


WINDOW_MEDIANS = f"""
    SELECT user_id, pos AS window_start,
           round(list_aggregate(value, 'median'), 6) AS median_score
    FROM ({windows_sql('value', length=7, step=5)})
"""


def csv_roundtrip(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = scratch_path(spark, "csv")
    logs.write_csv(documents, path)
    back = logs.read_csv(spark, path, documents.schema)
    return back.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


CSV_ROUNDTRIP = "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents"


def file_order_windows(spark, sf_dir):
    """The messages as a CSV log without order columns; its lines are the order."""
    path = scratch_path(spark, "log")
    events = table(spark, sf_dir, "events").orderBy(*ORDER).select("user_id", "event_id", "value")
    logs.write_csv(events, path)
    log = logs.read_csv_in_file_order(spark, path, events.schema, multi_line=False)
    return _shown(W.sliding_windows(log, "user_id", logs.FILE_ORDER, ["event_id", "value"]))


def append_windows(spark, sf_dir):
    """Windows appended twice to one table, for two lengths; read back by length."""
    log, path = event_log(spark, sf_dir), scratch_path(spark, "windows")
    for length in (5, 10):
        found = W.sliding_windows(log, "user_id", ORDER, ["value"], length, length)
        logs.append_windows(found.withColumn("seq_length", F.lit(length)), path)
    total = F.round(F.sum(list_sum(F.col("value"))), 4).alias("total")
    stored = logs.read_table(spark, path).groupBy("seq_length")
    return stored.agg(F.count("*").alias("n_windows"), total)


def _append_sql(length: int) -> str:
    return f"""
        SELECT {length} AS seq_length, count(*) AS n_windows,
               round(sum(list_sum(value)), 4) AS total
        FROM ({windows_sql('value', length=length, step=length)})
    """


APPEND_WINDOWS = f"{_append_sql(5)} UNION ALL {_append_sql(10)}"


def first_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return logs.first_rows(events, "event_id", 5000)


FIRST_ROWS = "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 5000"


def group_counts(spark, sf_dir):
    summary = W.group_summary(table(spark, sf_dir, "events"), "user_id", ORDER)
    return summary.select(
        "user_id", "n_rows", F.col("first_event_id").alias("first_event")
    ).orderBy("first_event")


GROUP_COUNTS = """
    SELECT user_id, count(*) AS n_rows, arg_min(event_id, (ts, event_id)) AS first_event
    FROM events GROUP BY user_id
"""


def one_group(spark, sf_dir):
    """All messages of the group that has the highest value."""
    events = table(spark, sf_dir, "events")
    highest = events.agg(F.max_by("user_id", F.struct("value", "event_id"))).scalar()
    return W.one_group(events, "user_id", highest).select("event_id", "user_id", "value")


ONE_GROUP = """
    SELECT event_id, user_id, value FROM events
    WHERE user_id = (SELECT arg_max(user_id, (value, event_id)) FROM events)
"""


def group_batches(spark, sf_dir):
    return W.group_batches(table(spark, sf_dir, "events"), "user_id", ORDER, 500)


GROUP_BATCHES = """
    WITH RECURSIVE laid AS MATERIALIZED (
        SELECT user_id, n_rows, row_number() OVER o AS r, CAST(sum(n_rows) OVER o AS BIGINT) AS through
        FROM (SELECT user_id, count(*) AS n_rows, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS e
              FROM events GROUP BY user_id)
        WINDOW o AS (ORDER BY ts, e, user_id)),
    filled(r, batch_id, held) AS (
        SELECT r, CAST(0 AS BIGINT), n_rows FROM laid WHERE r = 1
        UNION ALL
        SELECT l.r, batch_id + CASE WHEN held >= 500 THEN 1 ELSE 0 END,
               CASE WHEN held >= 500 THEN 0 ELSE held END + l.n_rows
        FROM filled f JOIN laid l ON l.r = f.r + 1)
    SELECT user_id, n_rows, batch_id FROM filled JOIN laid USING (r)
"""

def _whole_log(spark, sf_dir):
    """``events`` as a log of all 29 columns; some messages miss a value in one of them."""
    events = table(spark, sf_dir, "events")
    columns = {}
    for i, name in enumerate(schema.LOG_COLUMNS):
        if name in schema.SCORE_COLUMNS:
            columns[name] = F.col("value") + float(i)
        else:
            columns[name] = F.concat(F.lit(f"f{i} "), F.col("event_id"))
    columns[schema.ALLIANCE] = F.col("user_id").cast("string")
    columns[schema.TEXT] = F.concat("event_type", F.lit(STRIPPED), F.col("event_id"))
    columns["field_0"] = F.when(F.col("event_id") % 97 > 0, columns["field_0"])
    columns["score_28"] = F.when(F.col("event_id") % 101 == 0, float("nan")).otherwise(columns["score_28"])
    return events.select(
        *[c.alias(name) for name, c in columns.items()],
        F.col("ts").cast("timestamp").alias("msg_ts"),
        F.col("event_id").alias("msg_id"),
    )


def whole_log(spark, sf_dir):
    """Clean, labelled windows of a log with all its columns."""
    windows = flows.with_label(flows.clean_message_windows(_whole_log(spark, sf_dir), 20, 5))
    return windows.select(
        schema.ALLIANCE,
        "window_start",
        "n_messages",
        F.md5(schema.CHAT).alias("chat_md5"),
        F.round("label", 9).alias("label"),
        *[F.round(list_sum(F.col(c)), 4).alias(c) for c in schema.SCORE_COLUMNS],
    )


def _whole_log_sql() -> str:
    scores = [int(c.removeprefix("score_")) for c in schema.SCORE_COLUMNS]
    sums = ", ".join(f"round(list_sum(value) + {i} * len(value), 4) AS score_{i}" for i in scores)
    log = "SELECT *, event_id % 97 = 0 OR event_id % 101 = 0 AS lost, event_type || event_id AS said FROM events"
    label = fixed.LABEL_POSITION
    return f"""
        SELECT CAST(user_id AS VARCHAR) AS alliance_id, pos AS window_start,
               CAST(len(value) AS INTEGER) AS n_messages, md5(array_to_string(said, ' ')) AS chat_md5,
               round((list_aggregate(value, 'avg') + {label} + 1) / 8, 9) AS label, {sums}
        FROM ({windows_sql('value lost said', f'({log})', 20, 5)}) WHERE NOT list_contains(lost, true)
    """


QUERIES = {
    "whole_log": (whole_log, _whole_log_sql()),
    "sliding_windows": (sliding_windows, SLIDING_WINDOWS),
    "sliding_windows_step": (sliding_windows_step, SLIDING_WINDOWS_STEP),
    "segmented_windows": (segmented_windows, SEGMENTED_WINDOWS),
    "run_windows": (run_windows, RUN_WINDOWS),
    "clean_chat": (clean_chat, CLEAN_CHAT),
    "parse_list_columns": (parse_list_columns, PARSE_LIST_COLUMNS),
    "tokens": (tokens, TOKENS),
    "window_label": (window_label, WINDOW_LABEL),
    "window_medians": (window_medians, WINDOW_MEDIANS),
    "riskiest_windows": (riskiest_windows, RISKIEST_WINDOWS),
    "riskiest_profile": (riskiest_profile, RISKIEST_PROFILE),
    "csv_roundtrip": (csv_roundtrip, CSV_ROUNDTRIP),
    "file_order_windows": (file_order_windows, SLIDING_WINDOWS),
    "append_windows": (append_windows, APPEND_WINDOWS),
    "first_rows": (first_rows, FIRST_ROWS),
    "group_counts": (group_counts, GROUP_COUNTS),
    "one_group": (one_group, ONE_GROUP),
    "group_batches": (group_batches, GROUP_BATCHES),
}
