"""Substring dedup by level-wise doubling (operator 9).

A passage of 13 words can only repeat if the passages of half its length
inside it repeat. The first level therefore looks at windows of 7 words, of
which each 13-word window names one: the one with the smallest hash (equal
13-word windows name equal ones). Only windows whose 7 words occur in another
document are candidates for the next, doubled length; there, equal windows are
found and those that also start in a document with a smaller id are marked.
Doubling ends at the asked length: a longer repeat consists of marked windows,
so further levels would have no candidate that removes another word.

A 13-word window travels with the 7 words that it names, so one shuffle serves
both levels. Before it, windows that repeat within a block of a task are marked
on the spot and only one of them is sent on: a passage of very many documents
arrives once per block of texts and not once per document. Of equal windows of
one text the first is sent; the others are marked with it at the end.

Seven words that stand among many others (a short line of very many documents)
would be one key with very many windows. Keys are counted first over a sample
of the windows, drawn by their hash; a frequent one is sent by itself and the
window, so that its windows spread over all tasks.

Words are runs of other characters than space and \\x09-\\x0D, compared as they
are. Windows are compared by 64 bits of the 7 words and 40 more of the window.

Defined cases: a NULL or empty text has no words; a document with fewer words
than the window keeps all; a NULL id counts as larger than every id; rows with
one id never mark each other, whatever their texts, and are told apart by 64 bits
of their texts, which travel only if ids repeat; repeats inside one document
stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from chatwarden.llm.common import as_bytes, fields, map_texts
from chatwarden.llm.words import SPACED, blocks, find_words, mix

WINDOW_WORDS = 13
_BLOCK = 2_000_000
_NO_ID = (1 << 63) - 1
_AT_BITS = 40  # of a place: word number; the bits above tell texts of one id apart
#: A key of more different windows is split by them; so many keys at most, the most frequent ones.
HOT_WINDOWS, HOT_KEYS = 20_000, 1 << 18
HOT_SAMPLE = 64  # one in so many windows is counted
_PIECE = 5  # bytes of a window's hash that travel

_SENT = fields(key=T.LongType(), doc=T.LongType(), place=T.LongType(), done=T.IntegerType(), windows=T.BinaryType())
_MARKS = fields(doc=T.LongType(), place=T.LongType(), mask=T.LongType())
_ROW = fields(row=T.LongType())  # of tables in which ids repeat


def _with_row(schema: T.StructType, wide: bool) -> T.StructType:
    return T.StructType([*schema.fields, *_ROW.fields]) if wide else schema


def _named(hashes: np.ndarray, choices: int, count: int) -> np.ndarray:
    """For each of ``count`` windows, the place of its smallest inner window (leftmost)."""
    best = hashes[:count].copy()
    place = np.arange(count)
    for k in range(1, choices):
        other = hashes[k : k + count]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + k
    return place


def _send(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], length: int, half: int, hot: np.ndarray):
    """Rows of the first level for one block: candidates and windows marked on the spot.
    ``hot`` has the sorted keys that are split."""
    found = find_words(texts, SPACED, lower=False)
    whole, inside = found.windows(length)
    at = np.flatnonzero(inside)
    if not len(at):
        return None
    owner = found.text_of_word()[at]
    doc = ids[owner]
    hashes = whole[at]
    order = np.lexsort((owner, doc, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    smallest = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    marked = np.zeros(len(at), bool)
    marked[order] = doc[order] > smallest
    inner, _ = found.windows(half, seed=1)
    named = _named(inner, length - half + 1, len(whole))[at]
    once = np.ones(len(at), bool)
    once[order[1:]] = new[1:] | (owner[order][1:] != owner[order][:-1])
    at, owner, doc, hashes, marked, named = (x[once] for x in (at, owner, doc, hashes, marked, named))
    keys = inner[named]
    split = np.isin(keys.view(np.int64), hot)
    keys[split] = mix(keys[split] ^ hashes[split])
    # A row: neighboring windows of one text that name the same place, are equally done and go the same way.
    starts = np.ones(len(at), bool)
    starts[1:] = (np.diff(at) != 1) | (np.diff(named) != 0) | (marked[1:] != marked[:-1]) | split[1:] | split[:-1]
    first = np.flatnonzero(starts)
    sizes = np.diff(np.append(first, len(at)))
    place = (at - found.first[owner])[first] | (tags[owner[first]] << _AT_BITS)
    keys = keys[first].view(np.int64)
    done = np.where(marked[first], sizes, 0)
    pieces = hashes.view(np.uint8).reshape(-1, 8)[:, :_PIECE].copy()
    kept = ~marked
    bounds = np.concatenate([[0], np.cumsum(np.where(done > 0, 0, sizes) * _PIECE)])
    return keys, doc[first], place, done, bounds, pieces[kept].tobytes(), owner[first]


def _counter(length: int, half: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in blocks(as_bytes(batch.column(0)), _BLOCK):
                found = find_words(texts, SPACED, lower=False)
                whole, inside = found.windows(length)
                at = np.flatnonzero(inside & (whole % np.uint64(sample) == 0))
                if not len(at):
                    continue
                at = at[np.unique(whole[at], return_index=True)[1]]  # a block sends equal windows once
                inner, _ = found.windows(half, seed=1)
                named = np.min([inner[at + k] for k in range(length - half + 1)], axis=0)
                keys, counts = np.unique(named, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    return run


def _hot_keys(rows: DataFrame, length: int, half: int) -> np.ndarray:
    """Sorted keys of very many different windows, by a sample."""
    counted = rows.select("_text").mapInArrow(_counter(length, half, HOT_SAMPLE), fields(key=T.LongType(), n=T.LongType()))
    many = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SAMPLE > HOT_WINDOWS)
    return np.array(sorted(r.key for r in many.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()), np.int64)


def _sender(length: int, half: int, hot: Broadcast, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for at, texts in blocks(as_bytes(batch.column(2)), _BLOCK):
                rows = _send(ids[at : at + len(texts)], tags[at : at + len(texts)], texts, length, half, hot.value)
                if rows is None:
                    continue
                keys, doc, place, done, bounds, data, owner = rows
                windows = pa.Array.from_buffers(
                    pa.binary(), len(keys), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)]
                )
                made = [pa.array(keys), pa.array(doc), pa.array(place), pa.array(done.astype(np.int32)), windows]
                if wide:
                    made.append(batch.column(3).take(pa.array(at + owner)))
                yield pa.RecordBatch.from_arrays(made, names=_with_row(_SENT, wide).names)

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and document: marks windows that an earlier document has too."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        key = rows["key"].to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and (not held or held[-1]["key"][-1].as_py() == key[-1]):
            held.append(rows)
            continue
        yield from _mark_groups(pa.concat_tables([*held, rows.slice(0, last)]))
        held = [rows.slice(last)]
    if held:
        yield from _mark_groups(pa.concat_tables(held))


def _mark_groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    key, doc, place, done = (rows[c].to_numpy() for c in ("key", "doc", "place", "done"))
    if not len(key):
        return
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    shared = (doc[last] > doc[first])[group]  # level one: the key occurs in two documents
    masks = np.where(done > 0, (np.int64(1) << done.astype(np.int64)) - 1, 0)
    at = np.flatnonzero(shared & (done == 0))
    if len(at):
        cells = rows["windows"].combine_chunks()
        cells = cells.take(pa.array(at))
        bounds = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(at) + 1]
        raw = np.frombuffer(cells.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].reshape(-1, _PIECE)
        padded = np.zeros((len(raw), 8), np.uint8)
        padded[:, :_PIECE] = raw
        hashes = padded.view(np.uint64).ravel()
        sizes = np.diff(bounds) // _PIECE
        owner = np.repeat(np.arange(len(at)), sizes)
        offset = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        groups, docs = group[at][owner], doc[at][owner]
        order = np.lexsort((docs, hashes, groups))
        g, h, d = groups[order], hashes[order], docs[order]
        start = np.ones(len(order), bool)
        start[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        smallest = d[np.flatnonzero(start)][np.cumsum(start) - 1]
        hit = order[d > smallest]
        np.bitwise_or.at(masks, at[owner[hit]], np.int64(1) << offset[hit])
    out = np.flatnonzero(masks)
    made = [pa.array(doc[out]), pa.array(place[out]), pa.array(masks[out])]
    wide = "row" in rows.column_names
    if wide:
        made.append(pa.array(rows["row"].to_numpy()[out]))
    yield pa.RecordBatch.from_arrays(made, names=_with_row(_MARKS, wide).names)


def _repeating(docs: DataFrame, doc_id: str) -> bool:
    """Whether any id, or none, stands in several rows; reads the ids alone."""
    counts = docs.groupBy(F.col(doc_id).alias("id")).agg(F.count("*").alias("n"))
    return not counts.where("n > 1").isEmpty()


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    row = F.xxhash64(text)
    tag = row.bitwiseAND(F.lit((1 << (63 - _AT_BITS)) - 1))
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("_doc"),
        F.coalesce(tag, F.lit(0).cast("long")).alias("_tag"),
        F.col(text).alias("_text"),
        row.alias("_row"),
        F.col(doc_id).alias("_id"),
    )


def _sent(docs: DataFrame, doc_id: str, text: str, length: int, wide: bool = False) -> DataFrame:
    """Windows with the key under which they are compared."""
    half = (length + 1) // 2
    rows = _numbered(docs, doc_id, text).select("_doc", "_tag", "_text", *(["_row"] if wide else []))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_keys(rows, length, half))
    rows = rows.mapInArrow(_sender(length, half, hot, wide), _with_row(_SENT, wide))
    # Windows that are done need no partner: they are spread by place.
    key = F.when(F.col("done") > 0, F.xxhash64("doc", "place")).otherwise(F.col("key"))
    return rows.withColumn("key", key)


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW_WORDS) -> DataFrame:
    """``_doc, _tag, at, mask`` and, if ids repeat, ``_row``: bit ``i`` says that the
    window at word ``at + i`` of the document also starts in a document with a
    smaller id. Of equal windows of a text only the first is told."""
    wide = _repeating(docs, doc_id)
    marks = (
        _sent(docs, doc_id, text, length, wide)
        .repartition("key")
        .sortWithinPartitions("key", "doc")
        .mapInArrow(_mark, _with_row(_MARKS, wide))
    )
    low = F.lit((1 << _AT_BITS) - 1)
    return marks.select(
        F.col("doc").alias("_doc"),
        F.shiftright("place", _AT_BITS).alias("_tag"),
        F.col("place").bitwiseAND(low).alias("at"),
        "mask",
        *([F.col("row").alias("_row")] if wide else []),
    )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (kept words, one space between)."""
    marks = repeated_windows(docs, doc_id, text, length)
    same = [c for c in ("_doc", "_tag", "_row") if c in marks.columns]
    marks = marks.groupBy(*same).agg(F.collect_list("at").alias("_at"), F.collect_list("mask").alias("_mask"))

    def pack(texts: list[bytes]):
        shrink = zstandard.ZstdCompressor(level=3)
        return ([shrink.compress(t) for t in texts],)

    # Texts travel to their marks; compressed well, they take half of what a shuffle makes of them.
    packed = map_texts(_numbered(docs, doc_id, text), "_text", fields(_zip=T.BinaryType()), pack, [*same, "_id"])
    joined = packed.join(marks, same, "left")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            *fields(n_words=T.LongType(), n_removed=T.LongType(), kept=T.StringType()).fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = (expand.decompress(z) for z in batch.column(1).to_pylist())
            counts, removed, kept = [], [], []
            for text_, at, mask in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text_.split()  # of bytes: at \x20 and \x09-\x0D
                gone = 0
                counts.append(len(words))
                if at:
                    cover = np.zeros(len(words) + 1, np.int64)
                    start = np.array(at)[:, None] + np.arange(length - length // 2 + 1)
                    hit = start[(np.array(mask)[:, None] >> np.arange(length - length // 2 + 1)) & 1 > 0]
                    whole, _ = find_words([text_], SPACED, lower=False).windows(length)
                    hit = np.flatnonzero(np.isin(whole, whole[hit]))  # equal windows of the text with them
                    np.add.at(cover, hit, 1)
                    np.add.at(cover, hit + length, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=schema.names,
            )

    return joined.select("_id", "_zip", "_at", "_mask").mapInArrow(run, schema)
