"""Chat formatting with tool-call linking (operator 2), DataFrame functions only.

Calls and results are hash-joined by their identifier, calls are put in
topological order of what they refer to, arguments are validated against the
tools' schemas and everything is serialised as canonical JSON (sorted keys, no
blanks, one form of every number).

The topological level of a call is the length of the longest chain of calls that
it depends on. Chains are shortened first: a call with one dependency points to
it, and pointers are doubled until they reach a call with none or with several,
so a conversation of n calls, each after the one before it, takes log n rounds.
Calls with several dependencies are then released in rounds, one for each that
stands behind another. What no round releases is on a cycle or depends on one
and has no level. Each round is written.

Numbers keep their value digit by digit. Before the text is parsed, every number
in it becomes a marked string, and after it is serialised again each becomes a
number in one form: without an exponent if that takes at most 64 digits, no zeros
that could be left out, otherwise one digit before the point.

Defined cases: a repeated identifier counts once, the smallest (turn, name,
arguments) wins and the others are left out; of several results the smallest
(turn, content) counts; calls without result are kept with status
``unanswered``, results without call are listed by ``orphan_results``; NULL
identifiers link with nothing and are left out; references to unknown calls are
an error of the call and do not hold it up; arguments that are no JSON object
are an error; a tool without schema is an error; whole numbers of more than 64
digits count as numbers, not as integers; texts may be of any length; an empty
table gives an empty result; other columns of the inputs are not looked at. In
``chat_rows`` messages that are neither a call nor its result, of any role and
also without identifiers, are rows with status ``orphan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.operators.ranks import number_in_groups
from chatwarden.session import materialize

_CALL = ("conv_id", "call_id", "turn", "name", "arguments", "after")
#: Most digits of a number that is written without an exponent.
PLAIN_DIGITS = 64
# Signs of the private range: a number's mark, the mark of a text's own such sign, and
# what stands for two backslashes and for an escaped quote.
_MARK, _OWN, _BACKSLASHES, _QUOTE = "\ue000", "\ue001", "\ue002", "\ue003"
_PRIVATE = {sign: f"\\u{ord(sign):04x}" for sign in (_MARK, _OWN, _BACKSLASHES, _QUOTE)}
_BESIDE = "[0-9A-Za-z_.+-]"
_NUMBER = rf"(?<!{_BESIDE})(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?!{_BESIDE})"
_NUMBER_PARTS = r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]\+?(-?[0-9]+))?$"


def _unique(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest; a partial aggregate, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in rest] + [c for c in rest if c not in order]
    least = F.min(F.struct(*first)).alias("m")
    return rows.dropna(subset=keys).groupBy(*keys).agg(least).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def _hashed(rows: DataFrame) -> DataFrame:
    """To be the side of a join of which a hash table is made, partition by partition."""
    return rows.hint("shuffle_hash")


def _chains(edges: DataFrame) -> DataFrame:
    """``conv_id, call_id, top, away`` of calls with one dependency: the nearest call up the
    chain that has none or several, and its distance. On a cycle there is none."""
    keys = ["conv_id", "call_id"]
    links = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("on").alias("top")).where("n = 1")
    links = links.select(*keys, "top", F.lit(1).cast("long").alias("away"))
    own = links.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("open"))
    links = links.join(_hashed(own), ["conv_id", "top"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    links = materialize(links.select(*keys, "top", "away", "open"), "chains")
    spans, total = 1, links.count()  # no chain is longer; what is open then leads into a cycle
    while spans <= total and links.where("open").take(1):
        beyond = links.select(
            "conv_id", F.col("call_id").alias("top"), F.col("top").alias("to"),
            F.col("away").alias("more"), F.col("open").alias("still"),
        )
        doubled = links.where("open").join(_hashed(beyond), ["conv_id", "top"]).select(
            *keys, F.col("to").alias("top"), (F.col("away") + F.col("more")).alias("away"), F.col("still").alias("open")
        )
        links = materialize(links.where("NOT open").unionByName(doubled), "chains")
        spans *= 2
    return links.where("NOT open").drop("open")


def call_levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls with ``after``, the identifiers they depend on."""
    keys = ["conv_id", "call_id"]
    ids = calls.select(*keys)
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("on"))
    known = ids.select("conv_id", F.col("call_id").alias("on"))
    edges = materialize(edges.join(_hashed(known), ["conv_id", "on"], "left_semi"), "call-edges")
    counts = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    chains = _chains(edges)
    levels = ids.join(_hashed(counts), keys, "left_anti").withColumn("level", F.lit(0).cast("long"))
    levels = materialize(levels, "levels")
    # Several dependencies: on the tops of their chains. One on a cycle has no top and never is released.
    several = edges.join(_hashed(counts.where("n > 1")), keys).drop("n")
    single = counts.where("n = 1").select("conv_id", F.col("call_id").alias("on"), F.lit(True).alias("chained"))
    tops = chains.select("conv_id", F.col("call_id").alias("on"), "top", "away")
    several = several.join(_hashed(single), ["conv_id", "on"], "left").join(_hashed(tops), ["conv_id", "on"], "left")
    waiting = materialize(
        several.select(
            *keys, F.when(F.col("chained"), F.col("top")).otherwise(F.col("on")).alias("top"),
            F.coalesce("away", F.lit(0)).alias("away"),
        ),
        "waiting",
    )
    while waiting.take(1):
        done = levels.select("conv_id", F.col("call_id").alias("top"), "level")
        tried = waiting.join(_hashed(done), ["conv_id", "top"], "left").groupBy(*keys).agg(
            F.min(F.col("level").isNotNull()).alias("all"), F.max(F.col("level") + F.col("away") + 1).alias("level")
        )
        freed = materialize(tried.where("all").drop("all"), "freed")
        if not freed.take(1):
            break
        levels = materialize(levels.unionByName(freed), "levels")
        waiting = materialize(waiting.join(_hashed(freed.drop("level")), keys, "left_anti"), "waiting")
    at_top = levels.select("conv_id", F.col("call_id").alias("top"), "level")
    chained = chains.join(_hashed(at_top), ["conv_id", "top"]).select(*keys, (F.col("level") + F.col("away")).alias("level"))
    return levels.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def _marked(text: Column) -> Column:
    """JSON text whose numbers are strings that begin with the mark."""
    for sign, escape in _PRIVATE.items():
        text = F.replace(text, F.lit(sign), F.lit(escape))
    text = F.regexp_replace(text, r"\\\\", _BACKSLASHES)  # pairs from the left: what is left escapes
    text = F.regexp_replace(text, r"\\u[eE]000", f"{_PRIVATE[_MARK]}{_PRIVATE[_OWN]}".replace("\\", r"\\"))
    text = F.replace(text, F.lit('\\"'), F.lit(_QUOTE))
    # Quotes that are left are those around strings: every other part is outside of them.
    parts = F.split(text, '"')
    numbers = lambda s: F.regexp_replace(s, _NUMBER, f'"{_MARK}$1"')
    text = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, numbers(s)).otherwise(s)), '"')
    return F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASHES), F.lit("\\\\"))


def _one_form(number: Column) -> Column:
    """A number's text in the one form that stands for its value."""
    part = lambda i: F.regexp_extract(number, _NUMBER_PARTS, i)
    exponent = F.when(part(3) == "", F.lit(0).cast("bigint")).otherwise(part(3).try_cast("bigint"))
    long = F.regexp_replace(F.concat(part(1), part(2)), "^0+", "")
    digits = F.regexp_replace(long, "0+$", "")
    n = F.length(digits)
    # The value is 0.digits times ten to the power of this.
    point = exponent - F.length(part(2)) + F.length(long)
    zeros = lambda k: F.repeat(F.lit("0"), k.cast("int"))
    whole = F.concat(digits, zeros(point - n))
    inner = point.cast("int")
    mixed = F.concat(F.substring(digits, F.lit(1), inner), F.lit("."), F.substring(digits, inner + 1, n))
    small = F.concat(F.lit("0."), zeros(-point), digits)
    rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    with_exponent = F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), (point - 1).cast("string"))
    form = (
        F.when((point >= n) & (point <= PLAIN_DIGITS), whole)
        .when((point > 0) & (point < n), mixed)
        .when((point <= 0) & (n - point <= PLAIN_DIGITS), small)
        .otherwise(with_exponent)
    )
    sign = F.when(number.startswith("-"), "-").otherwise("")
    return F.when(exponent.isNull(), F.lower(number)).when(n == 0, "0").otherwise(F.concat(sign, form))


def _unmarked(json: Column) -> Column:
    """Serialised text whose marked strings are numbers again, in their one form."""
    parts = F.split(json, f'"{_MARK}(?=[-0-9])')

    def back(s: Column) -> Column:
        number = F.substring_index(s, '"', 1)
        return F.concat(_one_form(number), F.substring(s, F.length(number) + 2, F.length(s)))

    text = F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(back(s))), "")
    return F.replace(text, F.lit(_MARK + _OWN), F.lit(_MARK))


def _kind(value: Column) -> Column:
    """The JSON kind of a variant whose numbers are marked strings."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = (kind == "STRING") & F.coalesce(text.rlike(f"^{_MARK}[-0-9]"), F.lit(False))
    whole = _one_form(F.substring(text, F.lit(2), F.length(text))).rlike("^-?[0-9]+$")
    return (
        F.when(number & whole, "integer")
        .when(number, "number")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .otherwise("null")
    )


def validation_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, errors`` of calls with errors.

    ``schemas`` has a row per parameter: ``tool, param, kind, required`` and, if
    strings are bounded, ``longest`` (in characters). A tool without parameters
    has one row with a NULL ``param``.
    """
    keys = ["conv_id", "call_id"]
    parsed = calls.select(*keys, "name", F.try_parse_json(_marked(F.col("arguments"))).alias("v"))
    is_object = F.coalesce(_kind(F.col("v")) == "object", F.lit(False))
    given = F.when(is_object, F.try_variant_get("v", "$", "map<string,variant>"))
    parsed = parsed.withColumns({"is_object": is_object, "given": given})
    if "longest" not in schemas.columns:
        schemas = schemas.withColumn("longest", F.lit(None).cast("int"))
    tools = schemas.groupBy("tool").agg(
        F.collect_set(F.when(F.col("param").isNotNull(), F.struct("param", "kind", "required", "longest"))).alias("params")
    )
    # A tool's name may be that of most calls; the table of tools is one row per tool.
    checked = parsed.join(tools, F.col("name") == F.col("tool"), "left")
    value = lambda p: F.element_at("given", p["param"])
    missing = F.transform(
        F.filter("params", lambda p: p["required"] & ~F.map_contains_key("given", p["param"])),
        lambda p: F.concat(F.lit("missing "), p["param"]),
    )
    wrong = F.transform(
        F.filter(
            "params",
            lambda p: F.map_contains_key("given", p["param"])
            & (_kind(value(p)) != p["kind"])
            & ~((p["kind"] == "number") & (_kind(value(p)) == "integer")),
        ),
        lambda p: F.concat(F.lit("not "), p["kind"], F.lit(": "), p["param"]),
    )
    text = lambda p: F.replace(F.try_variant_get(value(p), "$", "string"), F.lit(_MARK + _OWN), F.lit(_MARK))
    long = F.transform(
        F.filter("params", lambda p: F.coalesce((_kind(value(p)) == "string") & (F.length(text(p)) > p["longest"]), F.lit(False))),
        lambda p: F.concat(F.lit("too long: "), p["param"]),
    )
    names = F.transform("params", lambda p: p["param"])
    unknown = F.transform(F.array_except(F.map_keys("given"), names), lambda k: F.concat(F.lit("unknown "), k))
    errors = (
        F.when(F.col("tool").isNull(), F.array(F.lit("no such tool")))
        .when(~F.col("is_object"), F.array(F.lit("arguments are no object")))
        .otherwise(F.array_sort(F.concat(missing, wrong, long, unknown)))
    )
    return checked.select(*keys, errors.alias("errors")).where(F.size("errors") > 0)


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys, one form of numbers and no blanks; NULL if it is no JSON."""
    return _unmarked(F.to_json(F.try_parse_json(_marked(text))))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: ``conv_id, call_id, turn, result_turn, level, status, errors, message``.

    ``calls``: ``conv_id, call_id, turn, name, arguments`` (JSON text), ``after``
    (identifiers). ``results``: ``conv_id, call_id, turn, content``. ``message``
    is canonical JSON of the call and its result.
    """
    keys = ["conv_id", "call_id"]
    calls = materialize(_unique(calls.select(*_CALL), keys, ["turn", "name", "arguments"]), "calls")
    results = _unique(results.select(*keys, "turn", "content"), keys, ["turn", "content"])
    known = calls.select("conv_id", F.col("call_id").alias("on"))
    lost = (
        calls.select(*keys, F.explode("after").alias("on")).join(_hashed(known), ["conv_id", "on"], "left_anti")
        .groupBy(*keys).agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown call "), "on"))).alias("lost"))
    )
    linked = (
        calls.join(_hashed(results.withColumnRenamed("turn", "result_turn")), keys, "left")
        .join(_hashed(call_levels(calls)), keys, "left")
        .join(_hashed(validation_errors(calls, schemas)), keys, "left")
        .join(_hashed(lost), keys, "left")
    )
    none = F.array().cast("array<string>")
    errors = F.concat(F.coalesce("errors", none), F.coalesce("lost", none))
    arguments = F.coalesce(canonical_json(F.col("arguments")), F.to_json(F.to_variant_object(F.struct("arguments"))))
    message = F.concat(
        F.lit('{"arguments":'), arguments,
        F.lit(',"id":'), _string(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(_string(F.col("name")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_string(F.col("content")), F.lit("null")), F.lit("}"),
    )
    status = F.when(F.col("result_turn").isNull(), "unanswered").when(F.size(errors) > 0, "invalid").otherwise("linked")
    return linked.select(
        *keys, "turn", "result_turn", "level", status.alias("status"), errors.alias("errors"), message.alias("message")
    )


def _string(text: Column) -> Column:
    """A JSON string: the only value of an object, without the object around it."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, 6, F.length(whole) - 6))


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    keys = ["conv_id", "call_id"]
    return results.join(_hashed(calls.select(*keys).distinct()), keys, "left_anti")


def _identifier(turn: Column) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations.

    A user's message is a call, the assistant's message of the next turn its
    result. The first call of a conversation is one of the tool ``open``, each
    later one of the tool ``reply`` and depends on the call before it, which it
    names in its arguments.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    asked = _unique(rows.where("role = 'user'").drop("role"), ["conv_id", "turn"], ["text"])
    placed = materialize(number_in_groups(asked, "conv_id", ["turn"], "place"), "asked")
    before = placed.select("conv_id", (F.col("place") + 1).alias("place"), F.col("turn").alias("prior"))
    placed = placed.join(_hashed(before), ["conv_id", "place"], "left")
    after = F.when(F.col("prior").isNotNull(), F.array(_identifier(F.col("prior"))))
    arguments = F.struct(F.col("prior").alias("after"), F.col("turn"), F.col("text").alias("prompt"))
    calls = placed.select(
        "conv_id",
        _identifier(F.col("turn")).alias("call_id"),
        "turn",
        F.when(F.col("prior").isNull(), "open").otherwise("reply").alias("name"),
        F.to_json(arguments).alias("arguments"),
        F.coalesce(after, F.array().cast("array<string>")).alias("after"),
    )
    results = rows.where("role = 'assistant'").select(
        "conv_id", _identifier(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    schemas = conversations.sparkSession.sql(
        """SELECT * FROM VALUES ('open', 'prompt', 'string', true, 300), ('open', 'turn', 'integer', true, null),
        ('reply', 'prompt', 'string', true, 300), ('reply', 'turn', 'integer', true, null),
        ('reply', 'after', 'integer', true, null) AS t(tool, param, kind, required, longest)"""
    )
    return calls, results, schemas


def chat_rows(conversations: DataFrame) -> DataFrame:
    """All of plain conversations as :func:`link_tool_calls` gives it: a row per call, and a
    row of status ``orphan`` per message that is neither a call nor a result of one."""
    calls, results, schemas = exchanges(conversations)
    linked = link_tool_calls(calls, results, schemas)
    rows = conversations.select("conv_id", "turn", "role", "text")
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    asked = rows.where((F.col("role") == "user") & named).select("conv_id", (F.col("turn") + 1).alias("turn")).distinct()
    is_call = F.coalesce(F.col("role") == "user", F.lit(False)) & named
    is_answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    alone = rows.where(is_answer).join(_hashed(asked), ["conv_id", "turn"], "left_anti").select(*rows.columns)
    orphans = rows.where(~is_call & ~is_answer).unionByName(alone)
    message = F.concat(
        F.lit('{"content":'), F.coalesce(_string(F.col("text")), F.lit("null")),
        F.lit(',"role":'), F.coalesce(_string(F.col("role")), F.lit("null")), F.lit("}"),
    )
    none = F.lit(None)
    return linked.unionByName(
        orphans.select(
            "conv_id", _identifier(F.col("turn")).alias("call_id"), "turn",
            none.cast(linked.schema["result_turn"].dataType).alias("result_turn"), none.cast("int").alias("level"),
            F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"), message.alias("message"),
        )
    )
