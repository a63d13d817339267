"""Mixing sources to target weights (operator 10).

Words are counted per source, targets follow from weights and caps, and each
document is emitted floor(rate) times plus one copy that a hash of its id grants
with a probability of the rest of the rate. All of it is DataFrame work: one
aggregate over the documents, a few over the table of sources, one join.

Sources in code point order, NULL last, weigh 5, 2, 1 and so on. They share
150 % of all words. A target stops at twice the words of its source; what is
above is shared out again by weight until no target is above.

Defined cases: a NULL or empty text has size 0 and is taken 0 times if its
source has no words, else like any other; a NULL id draws by the text's hash;
repeated rows draw alike; an empty table gives an empty result; columns of the
input that have the name of an added one, in any case, are replaced in ``mix``
and stay as they are in ``emit``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.operators.ranks import global_rank
from chatwarden.llm.common import fresh
from chatwarden.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # 150 % of all words
MAX_RATE = 2
_SALTS = 64
#: Up to so many sources (of a short name, a number and a target) go to every task.
BROADCAST_SOURCES = 20_000


def n_words(text: str) -> Column:
    """Runs of other characters than space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share=SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(
        ranked.select("source", "source_size", weight.cast("long").alias("weight")), "sources"
    )
    cap = max_rate * F.col("source_size")
    # Targets are weight * level; each round sets those above their cap to it, which raises the level.
    above, level = F.lit(False), None
    while True:
        row = ranked.agg(
            F.sum("source_size").alias("words"),
            F.sum(F.when(above, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
        ).first()
        if not row.weight or level == (new := (share[0] * row.words / share[1] - row.capped) / row.weight):
            break
        level = new
        above = cap < F.col("weight") * F.lit(level)
    target = F.when(above, cap.cast("double")).otherwise(F.col("weight") * F.lit(level if level is not None else 0.0))
    return ranked.select("source", "source_size", target.alias("target"))


def _mixed(docs, doc_id, text, source, weights, share, max_rate, seed) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies, and the columns that hold them."""
    own = {n: fresh(docs, f"__{n}") for n in ("source", "of", "size", "source_size", "target", "copies", "seat", "salt")}
    column = {n: F.col(f"`{c}`") for n, c in own.items()}
    sized = docs.withColumns({own["source"]: F.col(f"`{source}`"), own["size"]: n_words(text)})
    targets = source_targets(
        sized.select(column["source"].alias("source"), column["size"].alias("size")), weights, share, max_rate
    )
    targets = materialize(targets.toDF(own["of"], own["source_size"], own["target"]), "targets")
    same = column["source"].eqNullSafe(column["of"])
    name = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), same)
    else:  # a hot source is spread over salts
        salted = targets.withColumn(own["salt"], F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        sized = sized.withColumn(own["seat"], F.pmod(F.xxhash64(name), F.lit(_SALTS)).cast("int"))
        joined = sized.join(salted, same & (column["seat"] == column["salt"]))
    share_of = F.when(column["source_size"] > 0, column["target"] / column["source_size"])
    rate = F.least(F.coalesce(share_of, F.lit(0.0)), F.lit(float(max_rate)))
    drawn = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double")
    once_more = drawn / F.lit(float(1 << 32)) < rate - F.floor(rate)
    return joined.withColumn(own["copies"], (F.floor(rate) + once_more.cast("long")).cast("long")), own


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    max_rate: int = MAX_RATE,
    seed: int = 0,
) -> DataFrame:
    """All rows of ``docs`` with ``size, source_size, target, copies``."""
    added = ("size", "source_size", "target", "copies")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    mixed, own = _mixed(docs, doc_id, text, source, weights, share, max_rate, seed)
    return mixed.select(*kept, *[F.col(f"`{own[c]}`").alias(c) for c in added])


def emit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    max_rate: int = MAX_RATE,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken, columns unchanged."""
    mixed, own = _mixed(docs, doc_id, text, source, weights, share, max_rate, seed)
    copies = F.col(f"`{own['copies']}`")
    again = mixed.where(copies > 0).withColumn(fresh(mixed, "__copy"), F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
