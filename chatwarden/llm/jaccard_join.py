"""N-gram Jaccard join with signature trees (operator 7).

Documents link if their sets of 5-word shingles have a Jaccard similarity of
0.8 or more. No link between different sets is lost:

1. Equal sets become one node. A node keeps the first shingles of its set in one
   order of all shingles, so many that linked nodes share at least one of them,
   whatever the order is. Shingles go by their hashes, but those that very many
   texts have come last: all hashes are counted in a fixed number of cells first,
   and a full cell makes its hashes frequent. A line or template
   that many pages share then is no key as long as they have enough of their own.
2. Nodes that share such a hash meet under its leader, the smallest id that has
   it; hashes of one leader make one group. Hashes of a single node fall out by
   a partial aggregate.
3. Each node is held against the leader with which it shares most hashes. Links
   to leaders join the many copies of one text without pairs.
4. In each group that is not one component by then, a signature tree finds the
   rest: leaves are nodes with a bitmap of their shingles, inner nodes hold the
   OR of the bitmaps below and their range of sizes, and a dual traversal drops
   a pair of tree nodes as soon as the largest possible overlap is too small or
   all below is one component. Groups of thousands are cut by size and by hash.
5. Pairs that are left are verified on whole sets.

Shingles are compared by 64-bit hashes. Words are runs of other characters than
space and \\x09-\\x0D, with A-Z in lower case.

Defined cases: texts with fewer than five words are one shingle; NULL, empty and
blank texts have none and link with nothing; repeated rows are one class and
each gets a row; a NULL id is larger than any id and its component id is NULL
only if no member has an id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatwarden.session import materialize
from chatwarden.llm.common import as_bytes, fields, fresh, in_bit_table, map_batches, map_texts, row_key
from chatwarden.llm.words import SPACED, Words, blocks, find_words, mix

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
#: Larger groups are cut into bands of sizes, and bands by hash into pieces of about this size.
GROUP_ROWS = 2048
#: Cells in which hashes are counted; one of so many, and of four times the mean, is frequent.
CELLS, FREQUENT = 1 << 26, 64
_CELL_BITS = 18  # of a cell's place in its bucket
_HELD_CELLS = 4_000_000
#: Bits of a table that is sent to every task: about 16 for each key, so many at most.
MOST_BITS = 1 << 29
_BITS_PER_SHINGLE = 6  # of the bitmaps, at least
_LEAF = 32
_OF_NODE = ("n", "top", "bitmap")  # what tells whether a pair may link
_NO_ID = (1 << 63) - 1


def shingles(found: Words, length: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (all hashes, bounds per text)."""
    n_texts = len(found.first) - 1
    counts = np.diff(found.first)
    hashes, inside = found.windows(length)
    owner = found.text_of_word()[: len(hashes)]
    parts, owners = [hashes[inside]], [owner[inside]]
    for k in set(counts[(counts > 0) & (counts < length)].tolist()):
        short, fits = found.windows(k)
        of = found.text_of_word()[: len(short)]
        pick = fits & (counts[of] == k)
        parts.append(short[pick])
        owners.append(of[pick])
    h, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(n_texts + 1))


def _needed(n: np.ndarray, a: int, b: int) -> np.ndarray:
    """Shingles that a set of ``n`` shares with any linked set, at least."""
    return -(-n * a // b)


def _bitmap(hashes: np.ndarray) -> bytes:
    """Bits of the shingles; sets of about one size get the same number of bits."""
    bits = 64
    while bits < _BITS_PER_SHINGLE * len(hashes):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(hashes % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _kept(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of ``n`` keeps."""
    return np.where(n > 0, n - _needed(n, *SIMILARITY) + 1, 0)


def sized_bits(keys: DataFrame, key: str) -> np.ndarray:
    """A bit table as :func:`common.bit_table` has it, of about 16 bits for each of the written
    keys up to ``MOST_BITS``; beyond, more of what is tested passes. Keys are dealt by their
    place first, so that each piece of the table is made once."""
    bits = 1 << 20
    wanted = 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.col(key).bitwiseAND(F.lit(bits - 1))
    rows = (
        keys.select(place.alias("p"), F.shiftright(place, 15).alias("b"))
        .repartition("b")
        .groupBy("b")
        .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit((1 << 15) - 1))).alias("m"))
        .collect()  # of MOST_BITS in all; an iterator would run a job for each partition
    )
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row.b << 12 : (row.b + 1) << 12] = np.frombuffer(row.m, np.uint8)
    return out


def frequent_cells(docs: DataFrame, text: str) -> np.ndarray:
    """A bit table of the cells (low bits of a hash) that the hashes of very many texts fall into.

    Tasks count cells in the sets they see, and send a bucket of neighboring cells as
    one compressed row: about a byte per cell. What reaches the driver has one bit per cell."""
    inside = (1 << _CELL_BITS) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        shrink = zstandard.ZstdCompressor(level=1)

        def packed(gaps: np.ndarray, counts: np.ndarray) -> bytes:
            # Byte by byte of all numbers: their upper bytes are nearly all zero.
            both = np.concatenate([gaps, counts]).astype(np.uint32)
            return shrink.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())

        def sent() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            at = np.flatnonzero(np.diff(every, prepend=~every[0])).astype(np.uint32)
            cells, n = every[at], np.diff(at, append=np.uint32(len(every)))
            first = np.flatnonzero(np.diff(cells >> _CELL_BITS, prepend=np.uint32(CELLS)))
            bucket = (cells[first] >> _CELL_BITS).astype(np.int64)
            cuts = [*first.tolist(), len(cells)]
            parts = [
                packed(np.diff(cells[s:e] & inside, prepend=np.uint32(0)), n[s:e]) for s, e in zip(cuts, cuts[1:])
            ]
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(parts, pa.binary())], names=["bucket", "cells"])

        for batch in batches:
            for _, texts in blocks(as_bytes(batch.column(0))):
                h, _ = shingles(find_words(texts, SPACED, lower=True))
                held.append((h & np.uint64(CELLS - 1)).astype(np.uint32))
                if sum(map(len, held)) > _HELD_CELLS:
                    yield sent()
        if sum(map(len, held)):
            yield sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = None, np.zeros(inside + 1, np.int64)
        expand = zstandard.ZstdDecompressor()

        def made() -> pa.RecordBatch:
            full = total >= max(FREQUENT, 4 * total.mean())
            bits = np.packbits(full, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([bits], pa.binary())], names=["bucket", "cells"])

        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != bucket:
                    if bucket is not None:
                        yield made()
                    bucket, total = number, np.zeros(inside + 1, np.int64)
                both = np.frombuffer(expand.decompress(cells), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                gaps, counts = np.split(both.astype(np.int64), 2)
                total[np.cumsum(gaps)] += counts  # a cell stands once in a row
        if bucket is not None:
            yield made()

    schema = fields(bucket=T.LongType(), cells=T.BinaryType())
    counted = map_batches(docs.select(F.col(text).alias("t")), count, schema)
    added = map_batches(counted.repartition("bucket").sortWithinPartitions("bucket"), add, schema)
    out = np.zeros(CELLS // 8, np.uint8)
    size = (inside + 1) // 8
    for row in added.collect():  # one bit per cell, in one job
        out[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(row.cells, np.uint8)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, row, n, node, low`` (first shingles), ``top`` (the last of those)
    and ``bitmap`` of every row.

    A shingle's key has its hash without two bits, and above it whether it is frequent:
    the order of keys, as whole numbers without sign, is the order of shingles."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, text))

    def work(texts: list[bytes]):
        h, bounds = shingles(find_words(texts, SPACED, lower=True))
        n = np.diff(bounds)
        prefix = _kept(n)
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
        node = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(n.astype(np.uint64)))
        often = in_bit_table(frequent.value, h)
        # Hashes of a text are sorted: the frequent ones are moved behind the others.
        order = np.argsort(2 * np.repeat(np.arange(len(texts)), n) + often, kind="stable")
        keys = ((h >> np.uint64(2)) | (often.astype(np.uint64) << np.uint64(62)))[order].view(np.int64)
        low = [keys[s : s + p] for s, p in zip(bounds[:-1], prefix)]
        top = [int(x[-1]) if len(x) else None for x in low]
        maps = [_bitmap(h[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
        return n, node.view(np.int64), low, top, maps

    added = fields(
        n=T.LongType(),
        node=T.LongType(),
        low=T.ArrayType(T.LongType()),
        top=T.LongType(),
        bitmap=T.BinaryType(),
    )
    source = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return map_texts(source, "text", added, work, ["doc_id", "row"])


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, row, n_shingles, component_id, node, component``.

    ``component_id`` is the smallest id that links reach, ``component`` the same
    as a key that is never NULL.
    """
    rows = materialize(signatures(docs, doc_id, text), "signatures")
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        *[F.any_value(c).alias(c) for c in ("n", "top", "bitmap")],
    )
    nodes = materialize(nodes, "nodes")
    shared = materialize(_shared_groups(rows), "groups")

    # The leader of a group is its smallest id: an original more often than a copy of it.
    places = nodes.select(F.col("node").alias("b"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("lead"))
    leaders = (
        shared.join(places, "lead").where("node != b")
        .groupBy("node").agg(F.max(F.struct("common", -F.col("lead"), "b")).alias("m"))
        .select(F.col("node").alias("a"), F.col("m.b").alias("b"), "m.common")
    )
    likely = _near_pairs(_possible(_sided(leaders, nodes)))
    first = materialize(verified(docs, likely, nodes, doc_id, text), "leader-links")
    labels = materialize(components(first), "components")

    second = verified(docs, _group_pairs(shared, nodes, labels), nodes, doc_id, text)
    links = materialize(first.select("a", "b").unionByName(second.select("a", "b")), "links")
    labels = materialize(components(links), "components")

    node_of = rows.select("doc_id", "row", F.col("n").alias("n_shingles"), "node")
    labelled = node_of.join(labels, "node", "left").withColumn(
        "component",
        F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")).otherwise(F.xxhash64("doc_id", F.lit("alone"))),
    )
    # Ids come from nodes: one row per distinct set, so a class of many copies is one row here.
    ids = (
        nodes.select("node", "doc_id").join(labels, "node", "left")
        .groupBy(F.coalesce("label", "node").alias("component")).agg(F.min("doc_id").alias("smallest"))
    )
    named = labelled.where("n_shingles > 0").join(ids, "component")
    alone = labelled.where("n_shingles = 0").withColumn("smallest", F.col("doc_id"))
    columns = ["doc_id", "row", "n_shingles", F.col("smallest").alias("component_id"), "node", "component"]
    return named.select(*columns).unionByName(alone.select(*columns))


def _shared_groups(rows: DataFrame) -> DataFrame:
    """``node, lead, common``: nodes that keep a hash which others keep too, the smallest id
    among those that keep it, and how many such hashes there are."""
    kept = rows.where("n > 0").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "node", F.explode("low").alias("h")
    )
    groups = kept.groupBy("h").agg(F.min("id").alias("lead"), F.min("node").alias("x"), F.max("node").alias("y"))
    groups = materialize(groups.where("x < y").select("h", "lead"), "shared-hashes")
    bits = rows.sparkSession.sparkContext.broadcast(sized_bits(groups.select("h"), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            h = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            node = np.repeat(batch.column(0).to_numpy(), sizes)
            maybe = in_bit_table(bits.value, h)
            yield pa.RecordBatch.from_arrays([pa.array(node[maybe]), pa.array(h[maybe])], names=["node", "h"])

    source = rows.where("n > 0").select("node", "low")
    maybe = map_batches(source, run, fields(node=T.LongType(), h=T.LongType()))
    return maybe.distinct().join(groups, "h").groupBy("node", "lead").agg(F.count("*").alias("common"))


def _overlap_needed(n: Column, m: Column) -> Column:
    a, b = SIMILARITY
    return F.ceil((n + m) * a / (a + b))


def _sided(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` with size, last kept hash and bitmap of both."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(o) for c, o in (("node", side), *((c, f"{c}_{side}") for c in _OF_NODE))]), side)
    return pairs


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs of :func:`_sided` whose number of common kept hashes does not rule a link out.

    Of the two, the node whose kept hashes end first has all of them in the hash
    range that both keep, so those that are not common are missing in the other set.
    """
    a, b = SIMILARITY
    n = F.when(F.col("top_a") <= F.col("top_b"), F.col("n_a")).otherwise(F.col("n_b"))
    prefix = n - F.ceil(n * a / b) + 1
    return pairs.where(prefix - F.col("common") <= n - _overlap_needed(F.col("n_a"), F.col("n_b")))


def _near_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs of :func:`_sided` that sizes and bitmaps do not rule out, the smaller node first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [batch.column(i).to_numpy() for i in (0, 1)]
            n = np.concatenate([batch.column(i).to_numpy() for i in (2, 3)])
            sets = Signatures(np.concatenate(ends), n, batch.column(4).to_pylist() + batch.column(5).to_pylist())
            i, j = sets.linkable(np.arange(batch.num_rows), np.arange(batch.num_rows, 2 * batch.num_rows))
            x, y = ends[0][i], ends[1][j - batch.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    rows = pairs.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
    return map_batches(rows, run, fields(a=T.LongType(), b=T.LongType()))


def _group_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that the signature trees of their groups leave."""
    member = (
        shared.join(labels, "node", "left")
        .select("lead", "node", F.coalesce("label", "node").alias("component"))
    )
    open_groups = (
        member.groupBy("lead")
        .agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"),
            F.min("node").alias("a"), F.max("node").alias("b"),
        )
        .where("x < y")
    )
    open_groups = materialize(open_groups, "open-groups")
    bitmaps = nodes.select("node", "n", "bitmap")
    # A group of two is a pair; many groups have the same two, so pairs are told apart first.
    two = _near_pairs(_sided(open_groups.where("size = 2").select("a", "b").distinct(), nodes))
    rows = member.join(open_groups.where("size > 2").select("lead", "size"), "lead").join(bitmaps, "node")
    a, b = SIMILARITY
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(b / a))).cast("int")
    # Linked sizes differ by at most b / a, so a link lies in one band or in neighboring ones.
    cut = F.col("size") > GROUP_ROWS
    pieces = F.ceil(F.col("size") / (4 * GROUP_ROWS)).cast("int")
    piece = F.pmod(F.col("node"), pieces).cast("int")
    rows = (
        rows.withColumn("band", F.explode(F.when(cut, F.array(band, band + 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("task", F.xxhash64("lead", "band", F.least(piece, "other"), F.greatest(piece, "other")))
    )
    return two.unionByName(_without_far(rows.select("task", "node", "component", "n", "bitmap")))


def _without_far(rows: DataFrame) -> DataFrame:
    """The pairs of each task that sizes and bitmaps do not rule out."""
    rows = rows.repartition("task").sortWithinPartitions("task", "component", "n")
    return map_batches(rows, _traverse_groups, fields(a=T.LongType(), b=T.LongType()))


def _traverse_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        task = rows["task"].to_numpy()
        last = int(np.searchsorted(task, task[-1]))
        if last == 0 and (not held or held[-1]["task"][-1].as_py() == task[-1]):
            held.append(rows)
            continue
        yield from _trees(pa.concat_tables([*held, rows.slice(0, last)]))
        held = [rows.slice(last)]
    if held:
        yield from _trees(pa.concat_tables(held))


def _trees(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of equal ``task``: small groups are one leaf and are checked
    together, larger ones get a tree for each band of sizes."""
    if not rows.num_rows:
        return
    task, node = rows["task"].to_numpy(), rows["node"].to_numpy()
    sets = Signatures(*(rows[c].to_numpy() for c in ("component", "n")), rows["bitmap"].to_pylist())
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
    sizes = np.diff(bounds)
    found = []
    for size in set(sizes[(sizes > 1) & (sizes <= _LEAF)].tolist()):
        starts = bounds[:-1][sizes == size]
        left, right = np.triu_indices(size, 1)
        for part in np.array_split(starts, max(1, len(starts) * len(left) >> 16)):
            found.append(sets.linkable((part[:, None] + left).ravel(), (part[:, None] + right).ravel()))
    for s, e in zip(bounds[:-1][sizes > _LEAF], bounds[1:][sizes > _LEAF]):
        for band in np.unique(sets.band[s:e]):
            near = s + np.flatnonzero((sets.band[s:e] == band) | (sets.band[s:e] == band + 1))
            if sets.component[near].min() != sets.component[near].max():
                found.extend(SignatureTree(sets, near).pairs())
    for i, j in found:
        x, y = node[i], node[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


class Signatures:
    """Component, size and bitmap of each row of a group."""

    def __init__(self, component, n, bitmaps: list[bytes]):
        a, b = SIMILARITY
        self.component, self.n = component, n
        self.band = np.floor(np.log(n) / np.log(b / a)).astype(int)
        self.width = np.fromiter((len(m) for m in bitmaps), np.int64, len(bitmaps))
        self.by_width = {
            w: np.frombuffer(b"".join(bitmaps[i] for i in np.flatnonzero(self.width == w)), np.uint64).reshape(-1, w // 8)
            for w in np.unique(self.width).tolist()
        }
        self.place = np.zeros(len(bitmaps), np.int64)
        for w in self.by_width:
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of ``rows``, larger ones folded to ``width`` bytes (bits are modulo the width)."""
        out = np.empty((len(rows), width // 8), np.uint64)
        for w, maps in self.by_width.items():
            at = np.flatnonzero(self.width[rows] == w)
            if len(at):
                picked = maps[self.place[rows[at]]].reshape(len(at), -1, width // 8)
                out[at] = np.bitwise_or.reduce(picked, axis=1)
        return out

    def linkable(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of different components that sizes and bitmaps do not rule out."""
        a, b = SIMILARITY
        near = (self.component[i] != self.component[j]) & (self.n[i] * b >= self.n[j] * a) & (self.n[j] * b >= self.n[i] * a)
        i, j = i[near], j[near]
        fine = np.zeros(len(i), bool)
        least = np.minimum(self.width[i], self.width[j])
        for w in np.unique(least).tolist():
            for at in np.array_split(np.flatnonzero(least == w), max(1, int((least == w).sum()) * w >> 23)):
                x, y = i[at], j[at]
                m, o = self.matrix(x, w), self.matrix(y, w)
                rest_x = self.n[x] - np.bitwise_count(m).sum(axis=1, dtype=np.int64)
                rest_y = self.n[y] - np.bitwise_count(o).sum(axis=1, dtype=np.int64)
                overlap = np.bitwise_count(m & o).sum(axis=1, dtype=np.int64) + np.minimum(rest_x, rest_y)
                fine[at] = overlap >= _least_overlap(self.n[x], self.n[y])
        return i[fine], j[fine]


def _least_overlap(n, other):
    """Shingles that sets of two sizes share if they link: of the union, a in b."""
    a, b = SIMILARITY
    return np.ceil((n + other) * a / (a + b))


class SignatureTree:
    """A tree over some rows; rows of one component stand together.

    Level 0 holds the rows, each level above joins ``fanout`` neighbors: OR of
    the bitmaps, range of sizes, most shingles without a bit of their own, and
    the range of components. Sets below two tree nodes share at most as many
    shingles as the nodes have bits in common, plus those without an own bit.
    """

    def __init__(self, sets: Signatures, rows: np.ndarray, fanout: int = 8):
        self.rows, self.fanout = rows, fanout
        folded = sets.matrix(rows, int(sets.width[rows].min()))
        n, component = sets.n[rows], sets.component[rows]
        rest = n - np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
        self.levels = [(folded, n, n, rest, component, component)]
        joins = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][0]) > 1:
            cut = np.arange(0, len(self.levels[-1][0]), fanout)
            self.levels.append(tuple(f.reduceat(x, cut, axis=0) for f, x in zip(joins, self.levels[-1])))

    def pairs(self, chunk_bytes: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal from (root, root): pairs of rows that may link, of different components."""
        chunk = max(64, chunk_bytes // (8 * self.levels[0][0].shape[1]))
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if len(i) > chunk:
                half = len(i) // 2
                todo += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
                continue
            keep = self._may_link(level, i, j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                yield self.rows[i], self.rows[j]
                continue
            size, f = len(self.levels[level - 1][0]), self.fanout
            left = np.broadcast_to((i[:, None] * f + np.arange(f))[:, :, None], (len(i), f, f)).ravel()
            right = np.broadcast_to((j[:, None] * f + np.arange(f))[:, None, :], (len(i), f, f)).ravel()
            inside = (left < size) & (right < size) & ((left < right) if level == 1 else (left <= right))
            todo.append((level - 1, left[inside], right[inside]))

    def _may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = SIMILARITY
        bitmap, low, high, rest, least, most = self.levels[level]
        one = (least[i] == most[j]) & (most[i] == least[j])
        near = np.flatnonzero((high[i] * b >= low[j] * a) & (high[j] * b >= low[i] * a) & ~one)
        x, y = i[near], j[near]
        overlap = np.bitwise_count(bitmap[x] & bitmap[y]).sum(axis=1, dtype=np.int64) + np.minimum(rest[x], rest[y])
        fine = overlap >= _least_overlap(low[x], low[y])
        return near[fine]


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs ``a, b`` that link, judged on whole sets. Texts are read again; only
    those of rows that stand for a node of a pair go on."""
    pairs = materialize(pairs.select("a", "b").where("a != b").distinct(), "to-verify")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
    hashed = wanted.select(F.xxhash64("doc_id").alias("k"))
    bits = docs.sparkSession.sparkContext.broadcast(sized_bits(hashed, "k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bit_table(bits.value, batch.column(0).to_numpy())))
            for _, texts in blocks(as_bytes(batch.column(1))):
                h, bounds = shingles(find_words(texts, SPACED, lower=True))
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
                node = mix((total[bounds[1:]] - total[bounds[:-1]]) ^ mix(np.diff(bounds).astype(np.uint64)))
                sets = [h[s:e].view(np.int64) for s, e in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"]
                )

    source = docs.select(F.xxhash64(doc_id).alias("k"), F.col(text).alias("t"))
    sets = map_batches(source, run, fields(node=T.LongType(), set=T.ArrayType(T.LongType())))
    sets = sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(sets, "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
    )
    a, b = SIMILARITY
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(b * common >= a * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the smallest node that links reach) of all nodes with links.

    Alternates two steps until nothing changes: every node takes the smallest
    label around it, then the label of its label. Each round is written.
    """
    both = materialize(
        links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), "edges"
    )
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        least = near.groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(least, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = materialize(
            step.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels"
        )
        if not jumped.where("old != label").take(1):
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of linked documents one row, with all its columns: the smallest id,
    of rows with one id the smallest text hash, of repeated rows any. Texts without
    words stay, all of them.

    Rows that go are known by their keys; a bit table of those keeps most other rows
    out of the join that decides, so texts that stay are not shuffled.
    """
    found = jaccard_components(docs, doc_id, text).where("n_shingles > 0").select("doc_id", "row", "component")
    found = materialize(found, "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")
    chosen = found.groupBy("component").agg(first).select(F.col("m.row").alias("row"), F.lit(True).alias("stays"))
    copies = found.groupBy("row").agg(F.count("*").alias("n")).join(chosen, "row", "left")
    own, other = fresh(docs, "__row"), fresh(docs, "__marked")
    marked = copies.where("stays IS NULL OR n > 1").select(F.col("row").alias(other), "stays")
    marked = materialize(marked, "marked")
    bits = docs.sparkSession.sparkContext.broadcast(sized_bits(marked, other))

    @F.pandas_udf("boolean")
    def may_go(row: pd.Series) -> pd.Series:
        return pd.Series(in_bit_table(bits.value, row.to_numpy()))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(own, row_key(doc_id, text))
    same = F.col(own) == F.col(other)
    stay = keyed.where(~may_go(own)).select(*columns)
    spared = keyed.where(may_go(own)).join(marked.select(other), same, "left_anti").select(*columns)
    out = stay.unionByName(spared)
    repeated = marked.where("stays").select(other)
    if repeated.isEmpty():
        return out
    # Only rows of one id and one text share a key; any of them stands for all.
    whole = fresh(docs, "__whole")
    again = keyed.join(repeated, same, "left_semi").groupBy(own).agg(F.any_value(F.struct(*columns)).alias(whole))
    return out.unionByName(again.select(*[F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns]))
