"""Document fingerprints by consistent weighted sampling (operator 12).

A text is a weighted set: its terms are runs of one and of two words, the weight
of a term is the number of times it occurs. For each place of the fingerprint,
every term draws r and c from Gamma(2, 1) and b uniformly, all from a hash of the
term, and from its weight S

    t = floor(ln S / r + b),    ln a = ln c - r (t - b) - r .

The term of the smallest a and its t are the sample. Texts agree in a place with
a probability equal to their generalised Jaccard similarity, sum of min(S, S') by
sum of max(S, S'). A place stores 16 bits of a hash of the smallest a, which is
the same if and only if term and t are; likeness is the share of equal places.

All that is drawn comes from whole-number arithmetic and one table of quantiles
that the driver makes, so that machines of all kinds give equal fingerprints.

Each text is also compared with the document after it and with an edited form
that ends in words of that document. Documents are therefore brought into order
of their ids once, in parts cut at quantiles of the ids; a part is read as a
stream. What the last text of a part lacks, the first text of the next part, is
joined from the parts' edges, a row for each part. An id that fills several parts
is cut by the hash of the text, and rows of one id and text by their place.

Words are runs of other characters than space and \\x09-\\x0D, with A-Z in lower
case.

Defined cases: NULL is an empty text; a text without words has a fingerprint of
its own, equal to that of every other such text; NULL ids come last; rows of one
id are ordered by a hash of their texts; a repeated row follows itself, and a
single document too; counts beyond 65,535 weigh by their first 16 binary digits;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from chatwarden.llm.common import as_bytes, fields
from chatwarden.llm.words import SPACED, blocks, find_words, mix
from chatwarden.session import materialize

HASHES = 48
RUNS = (1, 2)  # words in a term
EDITED = 4  # one in so many code points is replaced
_QUANTILES = 1 << 16
_WEIGHTS = 1 << 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_ADDED = dict(
    n_chars=T.LongType(), edited_sha256=T.StringType(), fingerprint=T.StringType(),
    edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType(),
)
_EDGE = dict(part=T.LongType(), first_text=T.BinaryType(), first_print=T.BinaryType(), last_text=T.BinaryType(), last_print=T.BinaryType())


def draw_table() -> dict[str, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms, and the logarithms of weights."""
    wanted = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    low, high = np.zeros(_QUANTILES), np.full(_QUANTILES, 64.0)
    for _ in range(80):  # of 1 - (1 + x) exp(-x)
        half = (low + high) / 2
        under = 1 - (1 + half) * np.exp(-half) < wanted
        low, high = np.where(under, half, low), np.where(under, high, half)
    ln = np.log(np.maximum(np.arange(_WEIGHTS), 1))
    return {name: values.astype(np.float32) for name, values in (("r", high), ("ln_c", np.log(high)), ("ln", ln))}


def _draws(table, terms: np.ndarray, place: int):
    """r, b and ln a at t = 0 of every term for one place, from 32 bits mixed out of the two
    halves of the term's hash and the place: 16 for r, 16 for c, and another mix for b."""
    z = terms[0] * np.uint32((2 * place + 1) * 0x9E3779B1 & 0xFFFFFFFF)
    z += terms[1]
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        z ^= z >> np.uint32(shift)
        z *= np.uint32(factor)
    z ^= z >> np.uint32(15)
    halves = z.view(np.uint16)  # little-endian: low half first
    r = table["r"].take(halves[::2], mode="clip")
    ln_c = table["ln_c"].take(halves[1::2], mode="clip")
    z *= np.uint32(0x85EBCA6B)
    z ^= z >> np.uint32(13)
    z *= np.uint32(0xC2B2AE35)
    b = (z >> np.uint32(8)).astype(np.float32)
    b += np.float32(0.5)
    b *= np.float32(2.0**-24)
    ln_a = r * b
    ln_a -= r
    ln_a += ln_c
    return r, b, ln_a


def _log_weights(table, weights: np.ndarray) -> np.ndarray:
    shift = np.zeros(len(weights), np.int64)
    while (large := (weights >> shift) >= _WEIGHTS).any():
        shift[large] += 1
    return table["ln"][weights >> shift] + shift.astype(np.float32) * table["ln"][2]


def samples(table, terms: np.ndarray, of: np.ndarray, weights: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """16-bit samples ``[set, place]`` of weighted sets: set ``i`` has ``weights`` of the
    ``terms`` (hashes) that ``of`` numbers, from ``bounds[i]`` to ``bounds[i + 1]``."""
    out = np.full((len(bounds) - 1, hashes), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    halves = (terms & np.uint64(0xFFFFFFFF)).astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32)
    heavy = np.flatnonzero(weights > 1)
    ln_s, rare = _log_weights(table, weights[heavy]), of[heavy]
    starts, ln_a = bounds[:-1][full], np.empty(len(of), np.float32)
    for place in range(hashes):
        r, b, base = _draws(table, halves, place)
        base.take(of, out=ln_a, mode="clip")
        rh = r.take(rare, mode="clip")
        t = ln_s / rh
        t += b.take(rare, mode="clip")
        ln_a[heavy] -= rh * np.floor(t)
        least = np.minimum.reduceat(ln_a, starts)
        out[full, place] = (mix(least.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def fingerprints(table, texts: list[bytes], hashes: int = HASHES, runs=RUNS) -> np.ndarray:
    """Fingerprints ``[text, place]``; texts without words have 0xFFFF in all places."""
    found = find_words(texts, SPACED, lower=True)
    owner = found.text_of_word()
    parts, owners = [], []
    for run in runs:
        h, inside = found.windows(run)
        parts.append(h[inside])
        owners.append(owner[: len(h)][inside])
    h, o = np.concatenate(parts), np.concatenate(owners)
    terms, inverse = np.unique(h, return_inverse=True)
    keys, weights = np.unique(o * max(len(terms), 1) + inverse, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * max(len(terms), 1))
    return samples(table, terms, keys % max(len(terms), 1), weights, bounds, hashes)


def as_text(prints: np.ndarray) -> list[str]:
    """Four hex digits per place."""
    return [row.tobytes().hex() for row in prints.astype(">u2")]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal places: estimates the generalised Jaccard similarity."""
    return (x == y).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // EDITED
    return text[: len(text) - n] + following[:n]


class Stream:
    """Reads texts in order and gives each its row once the text after it is known."""

    def __init__(self, table, hashes: int, runs):
        self.table, self.hashes, self.runs = table, hashes, runs
        self.first = self.last = None  # (id, text, print)

    def rows(self, ids: list, texts: list[bytes]) -> list[tuple]:
        """Rows of all texts so far but the last."""
        plain = [t.decode() for t in texts]
        before = [self.last[1]] if self.last else []
        chain = before + plain
        changed = [edited(a, b).encode() for a, b in zip(chain, chain[1:])]
        prints = fingerprints(self.table, texts + changed, self.hashes, self.runs)
        own, other = prints[: len(texts)], prints[len(texts) :]
        if self.last:
            own = np.concatenate([self.last[2][None, :], own])
            ids = [self.last[0], *ids]
        if self.first is None:
            self.first = (ids[0], chain[0], own[0])
        self.last = (ids[-1], chain[-1], own[-1])
        return _finished(ids[:-1], chain[:-1], changed, own[:-1], other, own[1:])


def _finished(ids, texts: list[str], changed: list[bytes], own, other, after) -> list[tuple]:
    if not len(ids):
        return []
    digests = [hashlib.sha256(c).hexdigest() for c in changed]
    sizes = [len(t) for t in texts]
    near = likeness(own, other).tolist(), likeness(own, after).tolist()
    return list(zip(ids, sizes, digests, as_text(own), as_text(other), *near))


def _bounds(docs: DataFrame, doc_id: str, text: str, parts: int) -> list[tuple[int, int, int]]:
    """Where parts begin in the order of (id, hash of the text, hash of the place).

    Quantiles of the ids; only an id that is a quantile twice is looked at again."""

    def quantiles(rows: DataFrame, column: str, n: int) -> list[int]:
        if n < 2:
            return []
        at = F.percentile_approx(column, [i / n for i in range(1, n)], min(20 * n, 1_000_000))
        return rows.agg(at.alias("q")).first().q or []

    def even(n: int) -> list[int]:
        return [_LEAST + (i << 64) // n for i in range(1, n)]

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_MOST)).alias("id"), F.xxhash64(text).alias("h"))
    ids = quantiles(rows, "id", parts)
    out = []
    for i in sorted(set(ids)):
        out.append((i, _LEAST, _LEAST))
        n = ids.count(i)
        if n > 1:
            hashes = quantiles(rows.where(F.col("id") == i), "h", n + 1)
            for h in sorted(set(hashes)):
                out.append((i, h, _LEAST))
                out += [(i, h, s) for s in even(hashes.count(h) + 1)] if hashes.count(h) > 1 else []
    return out


def _dealer(bounds: list[tuple[int, int, int]]):
    """Adds the part and compresses the texts for their way."""
    ids = np.array([b[0] for b in bounds], np.int64)
    split = {b[0] for b in bounds if b[1] != _LEAST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            id_, h, s = (batch.column(i).to_numpy() for i in range(3))
            part = np.searchsorted(ids, id_, side="right")
            for i in np.flatnonzero(np.isin(id_, list(split))) if split else ():
                part[i] = bisect_right(bounds, (id_[i], h[i], s[i]))
            packed = pa.array([shrink.compress(t) for t in as_bytes(batch.column(4))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), batch.column(0), batch.column(1), batch.column(3), packed],
                names=["part", "id", "h", "doc_id", "zip"],
            )

    return run


def fingerprint_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: int = HASHES, runs=RUNS, parts: int | None = None
) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, doc_id, text, parts)
    draws = spark.sparkContext.broadcast(draw_table())
    id_field = T.StructField("doc_id", docs.schema[doc_id].dataType)
    dealt = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_MOST)).alias("id"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("s"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
    ).mapInArrow(
        _dealer(bounds),
        T.StructType([*fields(part=T.IntegerType(), id=T.LongType(), h=T.LongType()).fields, id_field, *fields(zip=T.BinaryType()).fields]),
    )
    ordered = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "id", F.col("doc_id").isNull(), "h")
    schema = T.StructType([id_field, *fields(**_ADDED, **_EDGE).fields])

    def arrow(rows: list[tuple], edge: tuple, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 7
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        n = len(rows) + bool(edge)
        made = [pa.array([*c, None] if edge else list(c), k) for c, k in zip(columns, kinds)]
        if edge:
            made[0] = pa.array([*columns[0], edge[0]], kind)
        for i, k in enumerate([pa.int64(), *[pa.binary()] * 4]):
            made.append(pa.array([None] * (n - 1) + [edge[i + 1]], k) if edge else pa.nulls(n, k))
        return pa.RecordBatch.from_arrays(made, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, stream, part, kind = zstandard.ZstdDecompressor(), None, None, None

        def closed() -> pa.RecordBatch:
            (_, first, first_print), (id_, last, last_print) = stream.first, stream.last
            edge = (id_, part, first.encode(), first_print.tobytes(), last.encode(), last_print.tobytes())
            return arrow([], edge, kind)

        for batch in batches:
            kind = batch.schema.field(3).type
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if part != numbers[s]:
                    if stream:
                        yield closed()
                    stream, part = Stream(draws.value, hashes, runs), int(numbers[s])
                ids = batch.column(3).slice(s, e - s).to_pylist()
                texts = (expand.decompress(z) for z in batch.column(4).slice(s, e - s).to_pylist())
                for at, block in blocks(texts):
                    yield arrow(stream.rows(ids[at : at + len(block)], block), (), kind)
        if stream:
            yield closed()

    written = materialize(ordered.mapInArrow(run, schema), "fingerprints")
    names = ["doc_id", *_ADDED]
    return written.where("part IS NULL").select(*names).unionByName(_edges(written, draws, hashes, runs).select(*names))


def _edges(written: DataFrame, draws, hashes: int, runs) -> DataFrame:
    """Rows of the last texts of the parts, with the first text of the next part that has any."""
    edges = written.where("part IS NOT NULL").select("doc_id", *_EDGE)
    # Numbers of parts alone are ordered here; texts come by a join.
    order = Window.orderBy("part")
    numbers = edges.select("part").withColumn("next", F.lead("part").over(order))
    wrap = edges.agg(F.min("part")).scalar()
    numbers = numbers.withColumn("next", F.coalesce("next", wrap))
    firsts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("text"), F.col("first_print").alias("print"))
    linked = edges.drop("first_text", "first_print").join(numbers, "part").join(firsts, "next")
    schema = T.StructType([written.schema["doc_id"], *fields(**_ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, own, after, its = (batch.column(i).to_pylist() for i in range(1, 5))
            texts = [t.decode() for t in last]
            changed = [edited(a, b.decode()).encode() for a, b in zip(texts, after)]
            own, its = ([np.frombuffer(p, np.uint16) for p in column] for column in (own, its))
            if not texts:
                continue
            other = fingerprints(draws.value, changed, hashes, runs)
            rows = _finished(batch.column(0).to_pylist(), texts, changed, np.array(own), other, np.array(its))
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    return linked.select("doc_id", "last_text", "last_print", "text", "print").mapInArrow(run, schema)
