"""Target-distribution importance resampling (operator 13).

Features of a text are its runs of 1 to ``longest`` words, dealt to a fixed
number of buckets by a checksum. How much more likely a bucket is in the target
texts than in all documents is its gain; a document weighs the sum of the gains
of its features, read from one array of gains. To its weight comes Gumbel noise
drawn from its id, so that the documents of the highest scores are a sample
without replacement in proportion to the weights.

The highest scores are found by parallel sorting by regular sampling:

1. Each task sorts its scores: a run. At regular steps it gives samples, which
   stand for equally many rows.
2. The sorted samples give splitters at regular steps: segments of similar size.
3. Each run is cut at the splitters. The sizes of the segments are summed, and
   prefix sums over them give the rank at which each segment begins. Segments
   that begin beyond the draw are not exchanged at all.
4. The others go to one task each, are merged there and numbered from the rank
   at which the segment begins: ranks are exact.

The driver gets buckets (a fixed number), samples (about ``SAMPLES`` and one per
task) and segment sizes. Scores are written once, so that all steps see the same
rows. Splitters are (score, id); rows that are equal in both are alike, and where
splitters repeat they are dealt to the segments between in turn.

Words have the characters beyond ASCII, ASCII letters in lower case and digits.

Defined cases: a NULL text or one without words has no features and weight 0; a
NULL id draws its noise as an empty text and comes last among equal scores; rows
of one id draw alike; repeated rows take neighboring ranks; an empty table
gives an empty result; without target texts all gains follow from the documents
alone. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chatwarden.llm.common import as_bytes, fields, map_texts
from chatwarden.llm.words import ALNUM, blocks, find_words
from chatwarden.session import materialize

BUCKETS = 10_000
LONGEST = 1  # words in a feature
LEAST_WORDS = 20  # of a document that can be drawn
SHARE = (10, 100)
SEED = 2024
#: About so many samples (a score and an id each) reach the driver, and one more per task.
SAMPLES = 200_000
_NO_ID = (1 << 63) - 1


def text_buckets(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of the texts. Checksums are made once per distinct run."""
    found = find_words(texts, ALNUM, lower=True)
    owner = found.text_of_word()
    out, of = [], []
    for run in range(1, longest + 1):
        h, inside = found.windows(run)
        at = np.flatnonzero(inside)
        _, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        places = at[first]
        if run == 1:
            spans = zip(found.start[places].tolist(), found.end[places].tolist())
            names = (found.data[s:e] for s, e in spans)
        else:
            words = [found.data[s:e] for s, e in zip(found.start.tolist(), found.end.tolist())]
            names = (b" ".join(words[i : i + run]) for i in places.tolist())
        bucket = np.fromiter((zlib.crc32(n) % buckets for n in names), np.int64, len(places))
        out.append(bucket[inverse])
        of.append(owner[at])
    return np.concatenate(out), np.concatenate(of)


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts: summed inside the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, block in blocks(as_bytes(batch.column(0))):
                total += np.bincount(text_buckets(block, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(F.col(text).alias("t")).mapInArrow(run, fields(bucket=T.LongType(), n=T.LongType()))
    out = np.zeros(buckets, object)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus))."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (s_all + buckets)) / float((s + 1) * (t_all + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def scored(docs: DataFrame, gains: np.ndarray, doc_id: str, text: str, longest: int, least_words: int, seed: int) -> DataFrame:
    """``doc_id, n_features, weight, score, eligible`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    buckets = len(gains)

    def work(texts: list[bytes]):
        gain = shared.value
        bucket, of = text_buckets(texts, longest, buckets)
        features = np.bincount(of, minlength=len(texts))
        weight = np.zeros(len(texts), np.int64)
        np.add.at(weight, of, gain[bucket])
        words = features if longest == 1 else np.diff(find_words(texts, ALNUM, lower=False).first)
        return features, weight, words >= least_words

    added = fields(n_features=T.LongType(), weight=T.LongType(), eligible=T.BooleanType())
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(drawn, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return map_texts(source, "text", added, work, ["doc_id"]).withColumn("score", F.col("weight") + noise)


def _run_of(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, np.ndarray, np.ndarray]:
    """The rows of a task in the order of ranks, with their keys (negated score, id). Rows that
    cannot be drawn come last."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = pa.Table.from_batches(held)
    score = -rows["score"].to_numpy()
    id_ = rows["doc_id"].cast(pa.int64()).fill_null(_NO_ID).to_numpy()
    out = ~rows["eligible"].to_numpy()
    order = np.lexsort((id_, score, out))
    n = len(order) - int(out.sum())
    return rows.take(pa.array(order)), score[order][:n], id_[order][:n]


def _samples(scores: DataFrame, step: int) -> list[tuple[tuple[int, int], int]]:
    """Every ``step``-th key of every run, with the number of rows that it stands for, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, score, id_ = _run_of(batches)
        at = np.arange(0, len(score), step)
        size = np.diff(np.append(at, len(score)))
        yield pa.RecordBatch.from_arrays([pa.array(score[at]), pa.array(id_[at]), pa.array(size)], names=["score", "id", "n"])

    found = scores.select("doc_id", "score", "eligible")
    taken = found.mapInArrow(run, fields(score=T.LongType(), id=T.LongType(), n=T.LongType())).collect()
    return sorted(((r.score, r.id), r.n) for r in taken)


def splitters(samples: list[tuple[tuple[int, int], int]], segments: int) -> list[tuple[int, int]]:
    """``segments - 1`` keys at regular steps of the rows that the samples stand for."""
    through = np.cumsum([n for _, n in samples])
    if not len(through):
        return []
    wanted = [int(through[-1]) * i // segments for i in range(1, segments)]
    return [samples[int(np.searchsorted(through, w, side="right"))][0] for w in wanted]


def segment_of(cuts: list[tuple[int, int]], score: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Segment of every row of a sorted run: the number of splitters that are not above its key."""
    starts = np.searchsorted(score, [c[0] for c in cuts], side="left")
    ends = np.searchsorted(score, [c[0] for c in cuts], side="right")
    at = [s + int(np.searchsorted(id_[s:e], c[1])) for s, e, c in zip(starts.tolist(), ends.tolist(), cuts)]
    begins = np.bincount(np.array(at, np.int64), minlength=len(score) + 1)
    segment = np.cumsum(begins[: len(score)])
    for key in {c for c, d in zip(cuts, cuts[1:]) if c == d}:  # rows of one key that fill several segments
        first, last = bisect_left(cuts, key), bisect_right(cuts, key)
        alike = np.flatnonzero((score == key[0]) & (id_ == key[1]))
        segment[alike] = first + 1 + np.arange(len(alike)) % (last - first)
    return segment


def _segment_sizes(scores: DataFrame, cuts: list[tuple[int, int]]) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, score, id_ = _run_of(batches)
        segment, n = np.unique(segment_of(cuts, score, id_), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(segment.astype(np.int64)), pa.array(n)], names=["segment", "n"])

    found = scores.select("doc_id", "score", "eligible").mapInArrow(run, fields(segment=T.LongType(), n=T.LongType()))
    return {r.segment: r.n for r in found.groupBy("segment").agg(F.sum("n").alias("n")).collect()}


def ranked(scores: DataFrame, draw: int, total: int, segments: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """Adds ``rank`` to written rows: 1 is the highest of ``total`` eligible scores, ties go to
    the smaller id; NULL from ``draw`` on."""
    segments = segments or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(_samples(scores, max(1, total // samples)), segments)
    sizes = _segment_sizes(scores, cuts)
    first, through = {}, 0
    for segment in sorted(sizes):  # prefix sums; segments beyond the draw stay where they are
        if through < draw:
            first[segment] = through
        through += sizes[segment]
    schema = T.StructType([*scores.schema.fields, T.StructField("segment", T.IntegerType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, score, id_ = _run_of(batches)
        if rows is None:
            return
        segment = np.full(rows.num_rows, -1, np.int32)
        segment[: len(score)] = segment_of(cuts, score, id_)
        segment[~np.isin(segment, list(first))] = -1
        yield from rows.append_column("segment", pa.array(segment)).to_batches(max_chunksize=100_000)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, through = None, 0
        for batch in batches:
            numbers = batch.column(batch.num_columns - 1).to_numpy()
            rank = np.zeros(len(numbers), np.int64)
            cuts_ = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for s, e in zip(cuts_, cuts_[1:]):
                if s < e:
                    if numbers[s] != segment:
                        segment = int(numbers[s])
                        through = first[segment]
                    rank[s:e] = through + 1 + np.arange(e - s)
                    through += e - s
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rank, mask=rank > draw)], names=with_rank.names)

    with_rank = T.StructType([*scores.schema.fields, T.StructField("rank", T.LongType())])
    dealt = scores.mapInArrow(cut, schema)
    merged = (
        dealt.where("segment >= 0")
        .repartitionById(len(cuts) + 1, "segment")
        .sortWithinPartitions("segment", F.desc("score"), F.asc_nulls_last("doc_id"))
    )
    rest = dealt.where("segment < 0").drop("segment").withColumn("rank", F.lit(None).cast("long"))
    return merged.mapInArrow(number, with_rank).unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank`` (NULL: not drawn)."""
    gains = bucket_gains(
        bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets
    )
    scores = materialize(scored(docs, gains, doc_id, text, longest, least_words, seed), "scores")
    total = scores.where("eligible").count()
    return ranked(scores, total * share[0] // share[1], total).drop("eligible")
