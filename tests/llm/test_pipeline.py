"""The pipeline and the registered queries on small tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from chatwarden.llm.common import table
from compare import differences, sql_tables

SMALL = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
CHECKED = [name for name in entry.oracle_sql() if name.startswith("op")]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, name):
    problem, rows = differences(spark, sql_tables(SMALL), name, SMALL)
    assert not problem and rows


def test_fourteen_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_stages_take_effect(spark, tmp_path):
    docs = table(spark, LARGER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, LARGER)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER).toPandas().sort_values("start")
    assert len(last) == counts[-1]
    assert (last.start.shift(-1).dropna() == (last.start + last.n_tokens).iloc[:-1]).all()
    run = corpus_pipeline.run(spark, LARGER).toPandas()
    columns = ["doc_id", "n_tokens", "ids_crc32"]
    key = lambda t: sorted(map(tuple, t[columns].values.tolist()))
    assert key(run) == key(last)


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = table(spark, SMALL, "documents")
    connection = sql_tables(SMALL)
    groups = connection.execute(entry.oracle_sql()["op7_jaccard"]).fetchall()
    want = {component for _, n, component in groups if n} | {doc for doc, n, _ in groups if not n}
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect()]
    assert sorted(kept) == sorted(want)
    assert isinstance(connection, duckdb.DuckDBPyConnection)


ODD = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, __row string, Size int, __copy int, __text int"


def odd_docs(spark):
    """NULLs in every column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    words = [f"w{i % 97}x{i % 13}" for i in range(400)]
    texts = [" ".join(words[i : i + 40]) for i in range(60)] + [None, "", " \n", "one", "a b", "x " * 400_000]
    rows = [(i, t, "en", f"s{i % 3}", 1, 0.5, "r", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(None, texts[2], None, None, None, None, None, None, None, None)] * 2 + [(None,) * 10, rows[5], rows[5], (5, "other", *rows[5][2:])]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_stages_on_an_odd_table(spark, tmp_path):
    docs = odd_docs(spark)
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            rows = docs.collect()
            assert len(rows) < n and len([r for r in rows if r.doc_id == 5 and r.text != "other"]) <= 1
            assert sum(not (r.text or "").split() for r in rows) == 4  # all texts without words stay
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
