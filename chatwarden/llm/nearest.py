"""Nearest neighbours by a block matrix join (operator 1).

Vectors are scaled to length 1 and rounded to int8. Candidates are packed into
blocks, queries into blocks, and every block of queries meets every block of
candidates through an ordinary join on the block number: a stated query set
against all rows, in blocks. A tile is the integer product of two blocks; with
the rounding errors' lengths it bounds each cosine from both sides. Only
candidates whose upper bound reaches the k-th best lower bound are computed
again from the original vectors in double precision, and a heap per query keeps
the k best of them. The heaps of all blocks are merged by one grouped top-k, so
the result is exact.

A task holds one block of candidates and reads the blocks of queries one after
the other, so its memory does not follow the input.

Defined cases: vectors that are NULL, empty, zero or hold NULL or a non-finite
number take no part, nor do rows with a NULL id; only vectors of one length are
compared; rows with the query's own id are no candidates; repeated rows of
another id are candidates each; ties go to the smaller id; a query row that
stands several times is one query, query rows of one id with different vectors
are one query each, with ranks of their own; a query without any candidate has
no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chatwarden.session import materialize
from chatwarden.llm.common import fields

#: Candidates in a block and queries in a block.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024

_BLOCK = fields(dim=T.LongType(), ids=T.BinaryType(), data=T.BinaryType())
_HITS = fields(query_id=T.LongType(), query_row=T.LongType(), vec_id=T.LongType(), score=T.DoubleType())


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows of ``id, vector`` as blocks of equal vector length: ``dim, ids, data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            values = [[dim], [ids.tobytes()], [data.tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.binary(), pa.binary()))], names=_BLOCK.names
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            sizes, base = np.diff(offsets), offsets[0]
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                data = flat[(offsets[:-1][own] - base)[:, None] + np.arange(dim)]
                for at in range(0, len(own), size):
                    held.setdefault(dim, []).append((ids[own[at : at + size]], data[at : at + size]))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, _BLOCK)


class _Tile:
    """A block with its int8 form: ``unit`` = ``scale * codes`` + a rest of known length."""

    def __init__(self, dim: int, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.data = np.frombuffer(data, np.float64).reshape(-1, dim)
        big = np.abs(self.data).max(axis=1, keepdims=True)
        fine = self.data / big  # no overflow in the squares
        unit = fine / np.sqrt((fine * fine).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        # Products of int8 codes are whole numbers that the floating type holds exactly.
        self.codes = codes.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        near = codes * self.scale[:, None]
        self.length = np.sqrt((near * near).sum(axis=1))
        self.rest = np.sqrt(((unit - near) ** 2).sum(axis=1))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, summed from the first place to the last in double precision."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    dot, x, y = ((p * q).sum(axis=0) for p, q in ((a, b), (a, a), (b, b)))
    return np.clip(dot / np.sqrt(x * y), -1.0, 1.0)


def _best(queries: _Tile, rows: _Tile, k: int) -> Iterator[tuple[int, float, int]]:
    """(query's place, score, id) of the k best rows of a block for each query."""
    near = (queries.codes @ rows.codes.T) * queries.scale[:, None] * rows.scale[None, :].astype(np.float64)
    error = queries.length[:, None] * rows.rest + queries.rest[:, None] * (rows.length + rows.rest) + 1e-9
    own = queries.ids[:, None] == rows.ids[None, :]
    lower = np.where(own, -np.inf, near - error)
    place = min(k, lower.shape[1]) - 1
    bar = -np.partition(-lower, place, axis=1)[:, place]
    at, row = np.nonzero((near + error >= bar[:, None]) & ~own)
    for s in range(0, len(at), 1 << 16):
        scores = _cosine(queries.data[at[s : s + (1 << 16)]], rows.data[row[s : s + (1 << 16)]])
        if s == 0:
            heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries.ids))]
        for q, score, vec_id in zip(at[s:].tolist(), scores.tolist(), rows.ids[row[s : s + (1 << 16)]].tolist()):
            item = (score, -vec_id)
            if len(heaps[q]) < k:
                heapq.heappush(heaps[q], item)
            elif item > heaps[q][0]:
                heapq.heapreplace(heaps[q], item)
    if len(at):
        for q, heap in enumerate(heaps):
            for score, minus_id in heap:
                yield q, score, -minus_id


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest cosines of each query row."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")
    ).where(F.col("id").isNotNull() & _usable(F.col("v")))
    # Blocks of candidates are numbered by a hash of their ids; queries go to every number.
    blocks = _packed(rows.select("id", "v"), BLOCK_ROWS)
    numbered = materialize(
        blocks.select("dim", F.xxhash64("ids").alias("block"), F.lit(0).alias("side"), "ids", "data"), "blocks"
    )
    queries = _packed(rows.where("q").select("id", "v").dropDuplicates(), QUERY_ROWS)
    wanted = numbered.select("dim", "block").distinct()
    sent = queries.join(wanted, "dim").select("dim", "block", F.lit(1).alias("side"), "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Tile] = []
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["side"] == 0:
                    if row["block"] != block:
                        held, block = [], row["block"]
                    held.append(_Tile(row["dim"], row["ids"], row["data"]))
                    continue
                queries = _Tile(row["dim"], row["ids"], row["data"])
                # Tells query rows of one id apart.
                own_rows = [zlib.crc32(v) | zlib.adler32(v) << 32 for v in map(bytes, queries.data)]
                for rows in held:
                    found = list(_best(queries, rows, k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(queries.ids[q]) for q, _, _ in found], pa.int64()),
                            pa.array([own_rows[q] for q, _, _ in found], pa.uint64()).cast(pa.int64(), safe=False),
                            pa.array([i for _, _, i in found], pa.int64()),
                            pa.array([s for _, s, _ in found], pa.float64()),
                        ],
                        names=_HITS.names,
                    )

    best = (
        numbered.unionByName(sent)
        .repartition("block", "dim")
        .sortWithinPartitions("block", "dim", "side")
        .mapInArrow(run, _HITS)
    )
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
