"""Windows against a plain loop over each group."""

import random

import pytest
from pyspark.sql import functions as F

from chatwarden.operators import windows as W
from chatwarden.operators.ranks import global_rank, number_in_groups, rank_within, running_sums


def loop_windows(messages, length, step):
    """Windows of one group, message by message."""
    if not messages:
        return []
    found, held, start = [], [], 0
    for message in messages:
        if len(held) == length:
            found.append((start, list(held)))
            held = held[step:]
            start += min(step, length)
        held.append(message)
    found.append((start, held))
    return found


def log_of(spark, sizes, seed=0):
    """Groups of the given sizes, shuffled; order (ts, id), ids ascending in a group."""
    rows = [(f"g{g}", i // 3, g * 1000 + i, f"m{g}.{i}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "grp STRING, ts INT, id LONG, text STRING")


def expected(sizes, length, step):
    return {
        (f"g{g}", start, tuple(texts))
        for g, n in enumerate(sizes)
        for start, texts in loop_windows([f"m{g}.{i}" for i in range(n)], length, step)
    }


def found(df):
    rows = df.collect()
    result = {(r.grp, r.window_start, tuple(r.text)) for r in rows}
    assert len(result) == len(rows)
    assert all(r.n_messages == len(r.text) and r.sample_id == f"{r.grp}:{r.window_start}" for r in rows)
    return result


SIZES = [1, 3, 4, 5, 9, 17, 30]
SHAPES = [(4, 1), (4, 2), (4, 9), (1, 1), (20, 1), (7, 3)]


@pytest.mark.parametrize("length,step", SHAPES)
def test_sliding_windows(spark, length, step):
    log = log_of(spark, SIZES)
    got = W.sliding_windows(log, "grp", ["ts", "id"], ["text"], length, step)
    assert found(got) == expected(SIZES, length, step)


@pytest.mark.parametrize("length,step", SHAPES)
@pytest.mark.parametrize("piece_rows", [1, 10])
def test_pieces_do_not_change_the_windows(spark, length, step, piece_rows):
    log = log_of(spark, SIZES)
    got = W.sliding_windows(log, "grp", ["ts", "id"], ["text"], length, step, piece_rows)
    assert found(got) == expected(SIZES, length, step)


def test_closed_form_on_many_shapes():
    for n in range(0, 40):
        for length in range(1, 9):
            for step in range(1, 12):
                s = min(step, length)
                closed = [
                    (k, list(range(k, min(k + length, n))))
                    for k in range(0, n)
                    if k % s == 0 and (k == 0 or k - s + length < n)
                ]
                assert closed == loop_windows(list(range(n)), length, step)


def test_null_group_nulls_in_columns_and_bad_arguments(spark):
    rows = [("a", 1, None), ("a", 2, "x"), (None, 3, "y")]
    log = spark.createDataFrame(rows, "grp STRING, id INT, text STRING")
    got = W.sliding_windows(log, "grp", ["id"], ["text", "id"], 5, 1).collect()
    assert [(r.grp, r.text, r.id) for r in got] == [("a", [None, "x"], [1, 2])]
    assert W.sliding_windows(log.limit(0), "grp", ["id"], ["text"]).count() == 0
    for length, step in [(0, 1), (1, 0)]:
        with pytest.raises(ValueError):
            W.sliding_windows(log, "grp", ["id"], ["text"], length, step)


@pytest.mark.parametrize("partitions", [1, 3, 7])
@pytest.mark.parametrize("length,step", [(3, 1), (3, 2), (2, 5)])
def test_run_windows(spark, partitions, length, step):
    rng = random.Random(partitions)
    groups = [rng.choice(["a", "b", None]) for _ in range(60)] + ["a"] * 30 + ["b", None, "b"]
    log = spark.createDataFrame(list(enumerate(groups)), "id INT, grp STRING")
    want, start = set(), 0
    while start < len(groups):
        end = start
        while end < len(groups) and groups[end] == groups[start]:
            end += 1
        if groups[start] is not None:
            for k, ids in loop_windows(list(range(start, end)), length, step):
                want.add((groups[start], start, k, tuple(ids)))
        start = end
    got = W.run_windows(log, "grp", ["id"], ["id"], length, step, piece_rows=4, partitions=partitions)
    assert {(r.grp, r.run_start, r.window_start, tuple(r.id)) for r in got.collect()} == want


@pytest.mark.parametrize("partitions", [1, 2, 9])
def test_ranks_and_running_sums(spark, partitions):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), rng.randrange(10)) for i in range(200)]
    df = spark.createDataFrame(rows, "id INT, g INT, v INT")
    order = [F.desc("v"), F.col("id")]
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    got = {r.id: r["rank"] for r in global_rank(df, order, partitions=partitions).collect()}
    assert got == {r[0]: i for i, r in enumerate(ranked)}
    within = {r.id: r.position for r in rank_within(df, "g", order, partitions=partitions).collect()}
    for g in range(4):
        assert [within[r[0]] for r in ranked if r[1] == g] == list(range(sum(r[1] == g for r in rows)))
    sums = running_sums(df, order, {"total": "v"}, partitions)
    got, total = {r.id: r.total for r in sums.collect()}, 0
    for r in ranked:
        total += r[2]
        assert got[r[0]] == total


def test_group_summary_one_group_and_batches(spark):
    log = log_of(spark, [5, 1, 7, 2])
    summary = {r.grp: (r.n_rows, r.first_id) for r in W.group_summary(log, "grp", ["id"]).collect()}
    assert summary == {"g0": (5, 0), "g1": (1, 1000), "g2": (7, 2000), "g3": (2, 3000)}
    assert W.one_group(log, "grp", "g2").count() == 7
    assert W.one_group(log, "grp", None).count() == 0
    batches = {r.grp: r.batch_id for r in W.group_batches(log, "grp", ["id"], 6).collect()}
    assert batches == {"g0": 0, "g1": 0, "g2": 1, "g3": 2}


def loop_batches(sizes, rows):
    out, batch, held = [], 0, 0
    for n in sizes:
        if held >= rows:
            batch, held = batch + 1, 0
        out.append(batch)
        held += n
    return out


@pytest.mark.parametrize("sizes,rows", [([4, 9, 1, 2, 3], 5), ([3] * 11, 1), ([1] * 23, 4), ([9], 5), ([2, 2], 50)])
def test_batches_have_at_least_the_asked_rows(spark, sizes, rows):
    found_rows = W.group_batches(log_of(spark, sizes), "grp", ["id"], rows).collect()
    found = {r.grp: r.batch_id for r in found_rows}
    assert [found[f"g{i}"] for i in range(len(sizes))] == loop_batches(sizes, rows)
    if sizes[0] == 4:
        assert loop_batches(sizes, rows) == [0, 0, 1, 1, 1]


def test_batches_of_nothing_and_of_a_bad_size(spark):
    log = log_of(spark, [1]).limit(0)
    assert W.group_batches(log, "grp", ["id"], 3).collect() == []
    with pytest.raises(ValueError):
        W.group_batches(log, "grp", ["id"], 0)


@pytest.mark.parametrize("ranges", [3])
@pytest.mark.parametrize(
    "kind", ["int", "double", "date", "timestamp", "timestamp_ntz", "string", "decimal(9,2)"]
)
def test_numbers_in_groups_of_any_order(spark, kind, ranges):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice([None, rng.randrange(9)]), i) for i in range(120)]
    at = {
        "date": F.date_add(F.lit("2024-03-01").cast("date"), F.col("v")),
        "timestamp": F.timestamp_seconds(F.col("v") * 977),
        "timestamp_ntz": F.timestamp_seconds(F.col("v") * 9977).cast("timestamp_ntz"),
    }.get(kind, F.col("v").cast(kind))
    if kind == "double":
        odd = F.when(F.col("v") == 0, float("-inf")).when(F.col("v") == 7, float("inf"))
        at = F.coalesce(odd.when(F.col("v") == 8, float("nan")), at)
    log = spark.createDataFrame(rows, "g INT, v INT, id INT").withColumn("at", at)
    got = {r.id: r.position for r in number_in_groups(log, "g", ["at", "id"], ranges=ranges).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    for g in range(3):
        assert [got[r[2]] for r in ordered if r[0] == g] == list(range(sum(r[0] == g for r in rows)))
