"""Vector codes, fingerprints and resampling against brute force, and on odd inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatwarden.llm import fingerprints, resampling, vector_codes

# 11


def brute_codes(rows, parts, entries, rounds, scale=4096):
    """(vec_id, label, code, error) by whole numbers and full scans, and the last codebooks."""
    kept = []
    for vec_id, vector, label in rows:
        if vector and all(v is not None and math.isfinite(v) and math.isfinite(v * scale) for v in vector):
            kept.append((vec_id, [math.floor(v * scale) for v in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    sizes = [width // parts + (i < width % parts) for i in range(parts)]
    cuts = [sum(sizes[:i]) for i in range(parts + 1)]
    split = lambda x: [x[s:e] for s, e in zip(cuts, cuts[1:])]
    books = [list(b) for b in zip(*(split(r[1]) for r in kept[:entries]))]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        codes = [[nearest(p, b) for p, b in zip(split(r[1]), books)] for r in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [split(r[1])[p] for r, c in zip(kept, codes) if c[p][1] == j]
                if own:
                    books[p][j] = [sum(v) // len(own) for v in zip(*own)]
    out = []
    for vec_id, x, label in kept:
        found = [nearest(p, b) for p, b in zip(split(x), books)]
        out.append((vec_id, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
    return out, books


def vector_rows():
    draw = random.Random(1)
    rows = [(i * 7 % 301, [draw.gauss(0, 0.3) + i % 5 for _ in range(11)], i % 4 or None) for i in range(300)]
    rows += [(400, None, 1), (401, [], 1), (402, [1.0] * 10 + [None], 1), (403, [float("nan")] * 11, 2)]
    rows += [(404, [float("inf")] * 11, 2), (405, [1.0] * 7, 3), (None, [0.5] * 11, 3), rows[5], rows[5], (rows[5][0], [0.25] * 11, 9)]
    rows += [(410 + i, [1e-9] * 11, 5) for i in range(40)]  # copies
    return rows


@pytest.mark.parametrize("extra", [[], [(500, [3e9] * 11, 1), (501, [-1e30] * 11, 1), (502, [1e200] + [0.0] * 10, None)]])
def test_codes_are_those_of_full_scans(spark, extra):
    rows = vector_rows() + extra
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    options = {"parts": 3, "entries": 6, "rounds": 5}
    found, books = vector_codes.encode(table.repartition(5), **options)
    wanted, wanted_books = brute_codes(rows, **options)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.label or 0, r.code, int(r.exact_error or r.error)) for r in found.collect())
    assert got == sorted((v is None, v or 0, x or 0, c, e) for v, x, c, e in wanted)
    assert books.history[-1] == wanted_books and len(books.history) == 6
    sums = collections.Counter()
    for _, label, _, error in wanted:
        sums[label] += min(error, 2**63 - 1)
    digest = hashlib.sha256(",".join(str(v) for p in wanted_books for e in p for v in e).encode()).hexdigest()
    for r in vector_codes.coded(table, **options).join(found.select("vec_id", "label").distinct(), "vec_id").collect():
        assert r.codebooks_sha256 == digest
    labelled = vector_codes.coded(table, **options).collect()
    assert {r.label_error for r in labelled} == {min(s, 2**63 - 1) for s in sums.values()}


def test_many_labels_are_joined_by_salts(spark, monkeypatch):
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>, label int")
    options = {"parts": 3, "entries": 6, "rounds": 2}
    plain = vector_codes.coded(table, **options).collect()
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    assert sorted(vector_codes.coded(table, **options).collect(), key=repr) == sorted(plain, key=repr)


def test_bounds_spare_scans_and_net_displacement_is_tighter():
    draw = np.random.default_rng(2)
    x = np.floor(4096 * (draw.normal(0, 0.05, (4000, 8)) + draw.integers(0, 8, (4000, 1))))
    books = vector_codes.Codebooks([0, 4, 8], [[[[int(v) for v in r[s:e]] for r in x[:8]] for s, e in ((0, 4), (4, 8))]])
    code = np.full((len(x), 2), -1, np.int8)
    lower, stamp = np.full((len(x), 2), -np.inf, np.float32), np.zeros((len(x), 2), np.int8)
    shares, drift = [], [0.0] * 8
    for _ in range(8):
        coder = vector_codes.Coder(books)
        code, lower, stamp, _ = coder.code(x, code, lower, stamp)
        shares.append(coder.scanned / coder.seen)
        new = []
        for p, (s, e) in enumerate(((0, 4), (4, 8))):
            old = books.history[-1][p]
            own = [x[code[:, p] == j, s:e] for j in range(8)]
            new.append([[int(c.sum()) // len(c) for c in o.T] if len(o) else b for o, b in zip(own, old)])
        drift = [d + math.dist(a, b) for d, a, b in zip(drift, books.history[-1][0], new[0])]
        books.history.append(new)
        net = [math.dist(a, b) for a, b in zip(books.history[0][0], new[0])]
        assert all(n <= d + 1e-6 for n, d in zip(net, drift))
    assert shares[0] == 1 and shares[-1] < 0.5


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded(empty).collect() == []
    bad = spark.createDataFrame([(1, [float("nan")], 1), (2, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded(bad).collect() == []
    one = spark.createDataFrame([(1, [0.5, 1.5], None)], "vec_id int, embedding array<float>, label int")
    row, = vector_codes.coded(one, parts=3).collect()  # a part without components
    assert (row.vec_id, row.code, row.error, row.label_error) == (1, "000000", 0, 0)


# 12


def text_rows():
    draw = random.Random(4)
    words = ["an", "é", "to", "Re", "x-", "ll", "ÄB", "9", "日本", "👍🏽", "of"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " \n ", "one", "ab", "same " * 70_000, "x" * 300_000, texts[3], texts[3]]
    rows = [((i * 37) % 1009, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[5]), (None, None), rows[7], rows[7], (rows[7][0], "other text")]


def term_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return collections.Counter(words + [" ".join(p) for p in zip(words, words[1:])])


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_fingerprints_of_documents_and_of_edited_ones(spark, parts):
    rows = text_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, N_CHARS int")
    h = {r.text: r.h for r in table.select("text", F.xxhash64("text").alias("h")).collect()}
    found = fingerprints.fingerprint_documents(table.repartition(6), parts=parts).collect()
    chain = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    draws = fingerprints.draw_table()
    print_of = lambda t: fingerprints.fingerprints(draws, [t.encode()])[0]
    wanted = []
    for (doc_id, text), (_, after) in zip(chain, chain[1:] + chain[:1]):
        text, after = text or "", after or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        own, other, its = print_of(text), print_of(changed), print_of(after)
        wanted.append(
            (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), *fingerprints.as_text(np.array([own, other])),
             float((own == other).mean()), float((own == its).mean()))
        )
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_one_id_of_very_many_rows_is_cut(spark):
    rows = [(5, f"text {i % 50} of one id") for i in range(400)] + [(i, f"t {i}") for i in range(100, 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bounds = fingerprints._bounds(table, "doc_id", "text", 10)
    assert bounds == sorted(bounds) and len([b for b in bounds if b[0] == 5]) >= 6
    hot = spark.createDataFrame([(5, "copy")] * 400 + rows[400:], "doc_id long, text string")
    assert len([b for b in fingerprints._bounds(hot, "doc_id", "text", 10) if b[0] == 5]) >= 6
    for t in (table, hot):
        once = fingerprints.fingerprint_documents(t, parts=10).collect()
        assert sorted(once) == sorted(fingerprints.fingerprint_documents(t, parts=1).collect()) and len(once) == 500


def test_equal_places_are_as_likely_as_generalised_jaccard():
    draw, table = random.Random(9), fingerprints.draw_table()
    words = [f"w{i}" for i in range(60)]
    for n in (40, 400, 8000):
        x = [draw.choice(words) for _ in range(n)]
        y = x[: n * 3 // 4] + [draw.choice(words) for _ in range(n // 4)]
        a, b = " ".join(x), " ".join(y)
        p, q = term_counts(a), term_counts(b)
        wanted = sum((p & q).values()) / sum((p | q).values())
        got = fingerprints.likeness(*(fingerprints.fingerprints(table, [t.encode()], 3000) for t in (a, b)))[0]
        assert abs(got - wanted) < 0.04
    empty = fingerprints.fingerprints(table, [b"", b" \n", b"a"])
    assert (empty[0] == empty[1]).all() and (empty[0] != empty[2]).mean() > 0.9


def test_fingerprints_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(empty).collect() == []
    one = spark.createDataFrame([(7, "a b c d")], "doc_id int, text string")
    row, = fingerprints.fingerprint_documents(one).collect()
    assert (row.doc_id, row.n_chars, row.near_next) == (7, 7, 1.0)


# 13


def brute_resample(docs, target, longest, buckets, least_words, share, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(d, *features(t)) for d, t in docs]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for d, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    can = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    draw = share[0] * len(can) // share[1]
    rank = {id(r): i for i, r in enumerate(can[:draw], 1)}
    return [(*r[:4], rank.get(id(r))) for r in out]


@pytest.mark.parametrize("longest, share", [(1, (10, 100)), (2, (60, 100)), (1, (100, 100))])
def test_resampling_is_that_of_one_sort(spark, longest, share):
    docs = text_rows()
    target = ["to RE of 日本 9", None, "", "of of of ll", "x" * 50]
    table = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, Rank int, eligible string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    options = dict(longest=longest, buckets=500, least_words=20, share=share, seed=7)
    found = resampling.resample(table.repartition(7), goal, **options).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_resample(docs, target, **options), key=repr)


@pytest.mark.parametrize("segments", [1, 5, 40])
def test_ranks_with_ties_and_hot_scores(spark, segments):
    draw = random.Random(6)
    rows = [(draw.randrange(3000), 100, True) for _ in range(2000)] + [(9, 50, True)] * 1500
    rows += [(i, draw.randrange(-20, 200), i % 9 > 0) for i in range(1000)] + [(None, 100, True)]
    scores = spark.createDataFrame(rows, "doc_id long, score long, eligible boolean").repartition(6, "doc_id")
    path = resampling.materialize(scores, "scores")
    can = sorted((-s, d is None, d or 0) for d, s, e in rows if e)
    for limit in (0, 1, 2500, len(can)):
        found = resampling.ranked(path, limit, len(can), segments, samples=500).collect()
        got = sorted((r.rank, -r.score, r.doc_id is None, r.doc_id or 0) for r in found if r.rank)
        assert got == [(i, *k) for i, k in enumerate(can[:limit], 1)] and len(found) == len(rows)


def test_a_key_that_fills_segments_is_dealt_to_them():
    cuts = [(1, 1), (2, 9), (2, 9), (2, 9), (3, 0)]
    score, id_ = np.array([0, 1, 2, 2, 2, 2, 2, 3]), np.array([5, 1, 8, 9, 9, 9, 9, 0])
    assert resampling.segment_of(cuts, score, id_).tolist() == [0, 1, 1, 2, 3, 4, 2, 5]
    assert resampling.splitters([], 4) == []


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id int, text string")
    assert resampling.resample(empty, some).collect() == []
    rows = resampling.resample(some, empty).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in rows) == [(1, 0, None), (2, 0, None), (3, 2, None)]
