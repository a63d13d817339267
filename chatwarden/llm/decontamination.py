"""Benchmark decontamination (operator 8).

The word windows of the benchmark become a hash set that is sent to every task
as a bit table of fixed size. Tasks scan all windows of the training texts
against it and hand out those that may occur, with their words. An exact join
with the benchmark's windows verifies them, so a full table costs time and
never a wrong hit. Words are lower-cased (A-Z) runs of digits, letters and
everything beyond ASCII.

Defined cases: a NULL or empty text has no words and is never contaminated; an
item without words matches nothing; an item shorter than the window is one
window of its own length; repeated rows get the same result each; an empty
table on either side gives no hits; rows with a NULL id are judged like others;
a NULL item id counts as an item with an empty name; an input column with the name of a result column is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chatwarden.session import materialize
from chatwarden.llm.common import as_bytes, bit_table, fields, fresh, in_bit_table, map_batches, map_texts, row_key
from chatwarden.llm.words import ALNUM, blocks, find_words

WINDOW_WORDS = 13


def item_windows(
    items: DataFrame, item_id: str = "item_id", text: str = "text", length: int = WINDOW_WORDS
) -> DataFrame:
    """One row per distinct window: ``words`` (how many), ``hash``, ``window``, ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in blocks(as_bytes(batch.column(1))):
                found = find_words(texts, ALNUM, lower=True)
                counts = np.diff(found.first)
                rows = []
                for k in sorted(set(np.minimum(counts, length).tolist()) - {0}):
                    hashes, inside = found.windows(k)
                    owner = found.text_of_word()[: len(hashes)]
                    for i in np.flatnonzero(inside & (np.minimum(counts, length)[owner] == k)):
                        rows.append((ids[at + owner[i]], k, int(hashes[i].view(np.int64)), _words(found, i, k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[j] for r in rows], t)
                        for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))
                    ],
                    names=["item", "words", "hash", "window"],
                )

    schema = fields(item=T.StringType(), words=T.IntegerType(), hash=T.LongType(), window=T.BinaryType())
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text))
    return (
        map_batches(source, run, schema)
        .groupBy("words", "hash", "window")
        .agg(F.collect_set("item").alias("items"))
    )


def _words(found, at: int, length: int) -> bytes:
    return b" ".join(found.data[found.start[j] : found.end[j]] for j in range(at, at + length))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: int = WINDOW_WORDS,
    share: int = 20,
) -> DataFrame:
    """One row per document: ``doc_id, _row, n_words, n_hit, items, hits, contaminated``.

    ``hits`` lists (first word, number of words) of verified windows; a document
    is contaminated if at least one in ``share`` of its words is hit. ``_row``
    tells rows with the same id and other texts apart.
    """
    windows = materialize(item_windows(items, item_id, item_text, length), "item-windows")
    lengths = [r[0] for r in windows.select("words").distinct().collect()]  # at most `length` rows
    bits = windows.sparkSession.sparkContext.broadcast(bit_table(windows, "hash", 1 << 23))

    def scan(texts: list[bytes]):
        found = find_words(texts, ALNUM, lower=True)
        places: list[list[int]] = [[] for _ in texts]
        sizes: list[list[int]] = [[] for _ in texts]
        spans: list[list[bytes]] = [[] for _ in texts]
        for k in lengths:
            hashes, inside = found.windows(k)
            owner = found.text_of_word()
            for i in np.flatnonzero(in_bit_table(bits.value, hashes) & inside):
                d = owner[i]
                places[d].append(int(i - found.first[d]))
                sizes[d].append(k)
                spans[d].append(_words(found, i, k))
        return np.diff(found.first), places, sizes, spans

    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("_row"), F.col(text).alias("text"))
    added = fields(
        n_words=T.LongType(),
        _at=T.ArrayType(T.IntegerType()),
        _size=T.ArrayType(T.IntegerType()),
        _window=T.ArrayType(T.BinaryType()),
    )
    scanned = materialize(map_texts(source, "text", added, scan, ["doc_id", "_row"]), "scan")
    maybe = (
        scanned.where(F.size("_at") > 0)
        .dropDuplicates(["doc_id", "_row"])
        .select("doc_id", "_row", F.explode(F.arrays_zip("_at", "_size", "_window")).alias("w"))
        .select("doc_id", "_row", "w.*")
    )
    hit = maybe.join(windows.select(F.col("window").alias("_window"), "items"), "_window")
    place = F.struct(F.col("_at").alias("at"), F.col("_size").alias("words"))
    by_doc = hit.groupBy("doc_id", "_row").agg(
        F.array_sort(F.collect_list(place)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.size(
        F.array_distinct(
            F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["words"] - 1)))
        )
    ).cast("long")
    by_doc = by_doc.withColumn("n_hit", covered).withColumnRenamed("doc_id", "_id")
    base = scanned.select("doc_id", "_row", "n_words")
    joined = base.join(
        by_doc.withColumnRenamed("_row", "_other"),
        base["doc_id"].eqNullSafe(F.col("_id")) & (base["_row"] == F.col("_other")),
        "left",
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "_row",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "hits",
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    own_id, own_row = fresh(docs, "__id"), fresh(docs, "__row")
    bad = contamination(docs, items, doc_id, text, **kw).where("contaminated")
    bad = bad.select(F.col("doc_id").alias(own_id), F.col("_row").alias(own_row)).distinct()
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (row_key(doc_id, text) == F.col(own_row))
    return docs.join(bad, same, "left_anti")
