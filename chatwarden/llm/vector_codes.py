"""Vector code compression with norm-of-sum bounds (operator 11).

Each vector is cut into parts, and each part is coded by the nearest entry of a
codebook of its position, in whole numbers: a component x counts as
floor(scale * x). Codebooks start as parts of the smallest ids; each round codes
all vectors and moves every entry to the floored mean of its parts.

Most parts keep their entry, so a part is not held against all entries in every
round. It keeps a lower bound of its distance to any entry other than its own,
and the round in which that distance was measured (the stamp). The codebooks of
all rounds are retained. An entry may since have moved back and forth; what
counts is the net displacement, the norm of the sum of its steps, read off the
codebooks of the stamp and of now, and not the sum of the steps' norms, which is
never smaller. Only parts whose distance to their own entry is not below the
bound less that displacement are scanned again, exactly, and stamped anew.

A round is one pass. The state travels beside its vector: read from the table of
the round before, written to the next one, which is a whole table on shared
storage, so a lost executor costs its tasks only. Moves between entries are
summed inside the tasks and merged in two steps; the driver gets a fixed number
of partial sums. Tables of rounds before the last are removed once the next one
is written.

Arithmetic is exact: in doubles while every intermediate value is below 2^53,
else in Python's whole numbers.

Defined cases: a NULL or empty vector, one with a NULL, NaN or infinite
component (or one whose scaled value is), and one of another length than the
vector of the smallest id take no part; a length that the number of parts does
not divide makes the first parts one longer; a NULL id is the largest; rows of
one id are ordered by their vectors; repeated rows are coded alike and count as
often as they occur; fewer rows than entries make a smaller codebook; equal
entries stay apart, the first is taken; an empty table gives an empty result. A
squared distance or a sum beyond a long is given as the largest long. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatwarden.llm.common import fields, remove
from chatwarden.session import materialize, scratch_path

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
_MERGERS = 16  # partial sums that reach the driver in a round
_MOST = (1 << 63) - 1
#: Up to so many labels (a number and a sum each) are sent to every task.
BROADCAST_LABELS = 100_000
_SALTS = 64

_SUMS = fields(sums=T.StringType())


@dataclass
class Codebooks:
    """Codebooks of every round so far: ``history[r][part]`` is a list of entries."""

    cuts: list[int]
    history: list[list[list[list[int]]]] = field(default_factory=list)

    def displacement(self, part: int) -> np.ndarray:
        """``[stamp, own entry]``: how far any other entry is now from where it was at the stamp."""
        now = np.array(self.history[-1][part], dtype=np.float64)
        out = np.zeros((len(self.history), len(now)))
        for stamp, books in enumerate(self.history):
            moved = np.sqrt(((now - np.array(books[part], dtype=np.float64)) ** 2).sum(axis=1))
            for own in range(len(now)):
                out[stamp, own] = np.delete(moved, own).max(initial=0.0)
        return out

    def largest(self) -> int:
        return max((abs(v) for part in self.history[-1] for entry in part for v in entry), default=0)

    def sha256(self) -> str:
        values = (str(v) for part in self.history[-1] for entry in part for v in entry)
        return hashlib.sha256(",".join(values).encode()).hexdigest()


def _cuts(width: int, parts: int) -> list[int]:
    """Bounds of the parts, the first ones longer by one where the width asks for it."""
    size, longer = divmod(width, parts)
    return [i * size + min(i, longer) for i in range(parts + 1)]


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """``vec_id, label, x`` (whole numbers as doubles) of the vectors that take part."""
    scaled = F.transform(F.col(vector), lambda v: _floor(v, scale))
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        scaled.alias("x"),
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)))


def _floor(v: Column, scale: int) -> Column:
    """The floor as a double: exact, and without the range of a long. x % 1 is exact too."""
    y = v.cast("double") * F.lit(float(scale))
    rest = y % F.lit(1.0)
    return F.when(rest < 0, y - rest - 1.0).otherwise(y - rest)


def _first_codebooks(rows: DataFrame, entries: int, parts: int) -> Codebooks | None:
    """Parts of the vectors of the smallest ids; one top-k over the table."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    smallest = rows.select("vec_id", "x").orderBy(*order).limit(entries).collect()
    if not smallest:
        return None
    width = len(smallest[0].x)
    if any(len(r.x) != width for r in smallest):  # ragged rows among them
        smallest = rows.where(F.size("x") == width).select("vec_id", "x").orderBy(*order).limit(entries).collect()
    cuts = _cuts(width, parts)
    first = [[[int(v) for v in r.x[s:e]] for r in smallest] for s, e in zip(cuts, cuts[1:])]
    return Codebooks(cuts, [first])


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    if x.dtype == object:
        return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(entries)), object)
    own = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", entries, entries)[None, :]
    return own - 2.0 * (x @ entries.T)


class Coder:
    """Codes the rows of a task against the newest of some codebooks."""

    def __init__(self, books: Codebooks):
        self.books, self.now = books, len(books.history) - 1
        self.spans = list(zip(books.cuts, books.cuts[1:]))
        self.moved = [books.displacement(p) for p in range(len(self.spans))]
        self.entries = [np.array(b, dtype=object).reshape(len(b), -1) for b in books.history[-1]]
        self.largest = books.largest()
        self.scanned = self.seen = 0

    def small(self, x: np.ndarray) -> bool:
        """Whether doubles hold every intermediate value of a distance exactly."""
        width = max((e - s for s, e in self.spans), default=1)
        most = max(float(np.abs(x).max(initial=0)), float(self.largest))
        return 4 * max(width, 1) * most * most < 2.0**53 and most < 2.0**26

    def code(self, x: np.ndarray, code: np.ndarray, lower: np.ndarray, stamp: np.ndarray):
        """(code, lower, stamp, squared distance) of every row and part.

        ``code`` -1 marks parts without an entry yet."""
        exact = self.small(x)
        if not exact:
            x = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        code, lower, stamp = code.copy(), lower.copy(), stamp.copy()
        square = np.zeros(code.shape, np.float64 if exact else object)
        for p, (s, e) in enumerate(self.spans):
            part = x[:, s:e]
            entries = self.entries[p] if not exact else self.entries[p].astype(np.float64)
            own = np.maximum(code[:, p], 0)
            apart = part - entries[own]
            square[:, p] = (apart * apart).sum(axis=1)
            if exact:
                near = np.sqrt(square[:, p])
                bound = lower[:, p].astype(np.float64) - self.moved[p][stamp[:, p], own]
                # Roots and norms are rounded: their last digits decide nothing.
                doubt = np.flatnonzero((code[:, p] < 0) | ~(near * (1 + 1e-9) + 1e-9 < bound * (1 - 1e-9)))
            else:
                doubt = np.arange(len(part))
            self.seen, self.scanned = self.seen + len(part), self.scanned + len(doubt)
            if not len(doubt):
                continue
            squares = _squares(part[doubt], entries)
            best = np.argmin(squares, axis=1)  # the first of equal ones
            rows = np.arange(len(doubt))
            code[doubt, p], square[doubt, p] = best, squares[rows, best]
            if exact:
                rest = squares.copy()
                rest[rows, best] = np.inf
                second = np.sqrt(rest.min(axis=1, initial=np.inf))
                lower[doubt, p] = np.nextafter(second.astype(np.float32), np.float32(-np.inf))
                stamp[doubt, p] = self.now
            else:
                lower[doubt, p] = -np.inf
        return code, lower, stamp, square


class _Moves:
    """Sums and counts per part and entry, as changes against the round before."""

    def __init__(self, books: Codebooks):
        self.spans = list(zip(books.cuts, books.cuts[1:]))
        n = len(books.history[-1][0])
        self.total = [[[0] * (e - s + 1) for _ in range(n)] for s, e in self.spans]

    def add(self, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        for p, (s, e) in enumerate(self.spans):
            at = np.flatnonzero(before[:, p] != after[:, p])
            for codes, sign in ((before[at, p], -1), (after[at, p], 1)):
                for entry in np.unique(codes[codes >= 0]).tolist():
                    rows = at[codes == entry]
                    part = x[rows, s:e]
                    most = float(np.abs(part).max(initial=0)) * max(len(rows), 1)
                    sums = part.sum(axis=0) if most < 2.0**53 else [sum(map(int, c)) for c in part.T]
                    total = self.total[p][entry]
                    total[0] += sign * len(rows)
                    for i, v in enumerate(sums, 1):
                        total[i] += sign * int(v)

    def text(self) -> str:
        return json.dumps(self.total)


def _added(total: list | None, more: list) -> list:
    if total is None:
        return more
    return [[[a + b for a, b in zip(x, y)] for x, y in zip(p, q)] for p, q in zip(total, more)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total = _added(total, json.loads(text))
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(total)])], names=["sums"])


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _round(source: DataFrame, books: Codebooks, first: bool) -> str:
    """Codes all rows against the newest codebooks; the path of the state with the tasks' sums."""
    parts = len(books.cuts) - 1
    width = books.cuts[-1]
    schema = T.StructType(
        [
            source.schema["vec_id"],
            source.schema["label"],
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("code", T.BinaryType()),
            T.StructField("lower", T.ArrayType(T.FloatType())),
            T.StructField("stamp", T.BinaryType()),
            *_SUMS.fields,
        ]
    )
    shared = source.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, moves, kinds = Coder(shared.value), _Moves(shared.value), None
        for batch in batches:
            kinds = batch.schema
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(2), width, np.float64)
            if first:
                before = np.full((n, parts), -1, np.int8)
                lower, stamp = np.full((n, parts), -np.inf, np.float32), np.zeros((n, parts), np.int8)
            else:
                before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(n, parts)
                lower = _matrix(batch.column(4), parts, np.float32)
                stamp = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int8).reshape(n, parts)
            after, lower, stamp, _ = coder.code(x, before, lower, stamp)
            moves.add(x, before, after)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
            bounds = pa.ListArray.from_arrays(offsets, pa.array(lower.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([r.tobytes() for r in after], pa.binary()),
                    bounds, pa.array([r.tobytes() for r in stamp], pa.binary()), pa.nulls(n, pa.string()),
                ],
                names=schema.names,
            )
        if kinds is not None:  # one row of sums per task, committed with its rows or not at all
            empty = [pa.nulls(1, kinds.field(i).type) for i in range(3)]
            rest = [pa.nulls(1, t) for t in (pa.binary(), pa.list_(pa.float32()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, *rest, pa.array([moves.text()])], names=schema.names)

    path = scratch_path(source.sparkSession, f"codes-{len(books.history)}")
    source.mapInArrow(run, schema).write.parquet(path)
    return path


def train(rows: DataFrame, books: Codebooks, rounds: int) -> str:
    """Runs the rounds; ``books`` gets a codebook for each. The path of the last state."""
    spark, path, total = rows.sparkSession, None, None
    for _ in range(rounds):
        if path is None:
            source = rows
        else:
            source = spark.read.parquet(path).where("sums IS NULL").drop("sums")
        last, path = path, _round(source, books, path is None)
        # Only the column of sums is read: a string in one row per task.
        sums = spark.read.parquet(path).where("sums IS NOT NULL").select("sums")
        for row in sums.repartition(_MERGERS).mapInArrow(_merge, _SUMS).collect():
            total = _added(total, json.loads(row.sums))
        if last is not None:
            remove(spark, last)
        new = [
            [[v // sums[0] for v in sums[1:]] if sums[0] else entry for entry, sums in zip(part, part_sums)]
            for part, part_sums in zip(books.history[-1], total or [])
        ]
        books.history.append(new)
    return path


def encode(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | None = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks | None]:
    """``vec_id, label, code, error, exact_error`` of every vector that takes part, and the codebooks.

    ``code`` has an index of two hex digits per part, ``error`` the squared
    distance to the coded vector, ``exact_error`` the same as text if it is
    beyond a long, else NULL.
    """
    if not 1 <= entries <= 127 or parts < 1 or rounds < 1 or rounds > 126:
        raise ValueError("entries have to be 1 to 127, rounds 1 to 126 and parts at least 1")
    rows = prepared(vectors, vec_id, vector, label, scale)
    schema = T.StructType(
        [
            rows.schema["vec_id"],
            rows.schema["label"],
            *fields(code=T.StringType(), error=T.LongType(), exact_error=T.StringType()).fields,
        ]
    )
    books = _first_codebooks(rows, entries, parts)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    path = train(rows.where(F.size("x") == books.cuts[-1]), books, rounds)
    state = vectors.sparkSession.read.parquet(path).where("sums IS NULL").drop("sums")
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = books.cuts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(n, parts)
            lower = _matrix(batch.column(4), parts, np.float32)
            stamp = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.int8).reshape(n, parts)
            code, _, _, square = coder.code(_matrix(batch.column(2), width, np.float64), before, lower, stamp)
            sums = [sum(map(int, row)) for row in square]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([bytes(row.tolist()).hex() for row in code], pa.string()),
                    pa.array([min(s, _MOST) for s in sums], pa.int64()),
                    pa.array([str(s) if s > _MOST else None for s in sums], pa.string()),
                ],
                names=schema.names,
            )

    return materialize(state.mapInArrow(run, schema), "codes"), books


def coded(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **options
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; ``label_error`` is the error
    summed over rows of one label, rows without a label together."""
    codes, books = encode(vectors, vec_id, vector, label, **options)
    most = F.lit(_MOST).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = sums.select(F.col("label").alias("of"), F.least("sum", most).cast("long").alias("label_error"))
    sums = materialize(sums, "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_LABELS:
        joined = codes.join(F.broadcast(sums), same)
    else:  # a hot label is spread over salts
        salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        dealt = codes.withColumn("seat", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col("seat") == F.col("salt")))
    digest = books.sha256() if books else None
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
