"""What the operators of this folder share: tables, text passes, fixed-size bit tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatwarden.session import materialize
from chatwarden.llm.words import blocks, release

#: Bits of a table that is sent to every task; its size does not follow the data.
BIT_TABLE_BITS = 1 << 25
_BUCKET = 1 << 15  # bits of one bitmap of bitmap_construct_agg
_TEXTS = 128  # texts that are taken from a batch at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written intermediate of this library that no later step reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and is none of the table's, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of a text column; NULL is an empty text. Only a few texts are held at a time."""
    for at in range(0, len(column), _TEXTS):
        for text in column.slice(at, _TEXTS).cast(pa.binary()).to_pylist():
            yield b"" if text is None else text


def expanded(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of the compressed texts of :func:`labelled_texts`."""
    expand = zstandard.ZstdDecompressor()
    for text in as_bytes(column):
        yield expand.decompress(text)


def map_batches(
    rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` by workers that give memory back at the end of a task. They wait for the
    next one else with all that their largest block took, beside the JVM of their executor."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return rows.mapInArrow(released, schema)


def map_texts(
    docs: DataFrame,
    text: str,
    added: T.StructType,
    work: Callable[[list[bytes]], Sequence[Iterable]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds columns that ``work`` computes from the texts of one block.

    ``work`` gets the texts of about a megabyte and returns one sequence for
    each added column. A column of ``docs`` with the name of an added one, in any
    case, is replaced; ``keep`` names the columns to pass on (default: all others).
    """
    new = {c.lower() for c in added.names}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([*(docs.schema[c] for c in kept), *added.fields])
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(fresh(docs, "__text")))
    types = [_arrow_type(f.dataType) for f in added.fields]
    names = [*kept, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, texts in blocks(as_bytes(batch.column(len(kept)))):
                columns = [batch.column(i).slice(at, len(texts)) for i in range(len(kept))]
                at += len(texts)
                made = [pa.array(v, t) for v, t in zip(work(texts), types)]
                yield pa.RecordBatch.from_arrays(columns + made, names=names)

    return map_batches(source, run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }[type(kind)]


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def bit_table(keys: DataFrame, key: str, bits: int = BIT_TABLE_BITS) -> np.ndarray:
    """A table of ``bits`` bits in which the bit of every key is set, as bytes.

    A key is tested by ``in_bit_table``. Other keys may pass as well, the more
    the fuller the table is, so an exact join has to follow. The table has the
    same size for any input and is the only thing that reaches the driver.
    """
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(place.alias("p"))
        .groupBy(F.shiftright("p", 15).alias("b"))
        .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(_BUCKET - 1))).alias("m"))
        .collect()  # of fixed size in all; an iterator would run a job for each partition
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row.b * (_BUCKET // 8) : (row.b + 1) * (_BUCKET // 8)] = np.frombuffer(row.m, np.uint8)
    return out


def in_bit_table(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def row_key(doc_id: str, text: str) -> Column:
    """Tells rows apart: equal only for rows with the same id and the same text."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def held_out(doc_id: str) -> Column:
    """The fold that no classifier learns from; a NULL id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text, label`` of the rows that a classifier may learn from, written once.

    Texts are compressed for their way through the shuffle and the written
    table, NULL as an empty one; :func:`expanded` reads them.
    Of contradictory labels of one id the larger counts; labels other than 0 and
    1 and held-out rows are left out. A bit table of the labelled ids keeps most
    other texts out of the shuffle.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id"))
    known = known.agg(F.max(label).cast("int").alias("label"))
    bits = docs.sparkSession.sparkContext.broadcast(
        bit_table(known.select(F.xxhash64("id").alias("k")), "k", 1 << 24)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor()
        for batch in batches:
            batch = batch.filter(pa.array(in_bit_table(bits.value, batch.column(2).to_numpy())))
            packed = pa.array([shrink.compress(t) for t in as_bytes(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "text"])

    source = docs.where(~held_out(doc_id)).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("k")
    )
    maybe = map_batches(source, run, T.StructType([source.schema["id"], T.StructField("text", T.BinaryType())]))
    return materialize(maybe.join(known, "id"), "labelled")


def sample_per_class(rows: DataFrame, size: int) -> DataFrame:
    """About ``size`` rows of each class of :func:`labelled_texts`, by a hash of the id."""
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    limit = F.lit(0)
    for label, count in counts.items():
        limit = F.when(F.col("label") == label, min(1_000_000, round(1_000_000 * size / count))).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < limit)


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """``a, b`` of the logistic curve 1 / (1 + exp(-(a m + b))) by Newton's method."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
