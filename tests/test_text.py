"""Parsing, cleaning and tokens."""

import ast
import math

import pytest
from pyspark.sql import functions as F

from chatwarden.functions.fixed_values import MAX_TOKENS
from chatwarden.functions import text as fn
from chatwarden.functions.arrays import euclidean, list_mean, list_median, risk_label
from chatwarden.operators.cleaning import add_chat, clean_windows, parse_windows

TEXT_CELLS = [
    "['a', 'b']",
    "[]",
    "[\"it's\", 'x']",
    r"""['both \' and "', "y"]""",
    r"['line\nbreak', 'tab\t', 'back\\slash', '‍']",
    r"['\x41', '\x7f']",
    r"['\U0001F600', 'caf\xe9']",
    r"['a\/b', '\\x41', 'bell\a']",
    "['emoji 😀 é 卐']",
    " ['space'] ",
    "('a', 'b')",
    "['a' 'b']",
]
BAD_TEXT_CELLS = ["['a', nan]", "alliance_id", "['a'", "", "5", None]
NUMBER_CELLS = ["[1, 2.5]", "[-1.0]", "[]", "[1e3, .5, 2.]", "['1', '2.5']", "[1_000]", "[True]", "(1, 2)"]
BAD_NUMBER_CELLS = ["[1.0, nan]", "score_8", "['x']", "[NaN]", "[None]", "[1, 2", None]


def parsed(spark, cells, texts, numbers):
    rows = [(i, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "i INT, cell STRING")
    return [r.cell for r in parse_windows(df, texts, numbers).orderBy("i").collect()]


def test_text_lists_read_like_python_literals(spark):
    got = parsed(spark, TEXT_CELLS, ["cell"], [])
    assert got == [list(ast.literal_eval(c.strip())) for c in TEXT_CELLS]
    assert parsed(spark, BAD_TEXT_CELLS, ["cell"], []) == [None] * len(BAD_TEXT_CELLS)
    assert parsed(spark, ["['a', 1]", r"['\x41', 1]"], ["cell"], []) == [["a", "1"], ["A", "1"]]


def test_number_lists_read_like_python_literals(spark):
    got = parsed(spark, NUMBER_CELLS, [], ["cell"])
    assert got == [[float(x) for x in ast.literal_eval(c)] for c in NUMBER_CELLS]
    assert parsed(spark, BAD_NUMBER_CELLS, [], ["cell"]) == [None] * len(BAD_NUMBER_CELLS)


def test_one_python_pass_over_the_cells(spark, capsys):
    df = spark.createDataFrame([(1, "['a']", "[1]")], "i INT, text STRING, score STRING")
    clean_windows(df, "text", ["score"]).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_malformed_rows_go_once_and_neighbours_stay(spark):
    rows = [
        (0, "['hi', 'you']", "[1, 2]", "['g']"),
        (1, "text", "score", "alliance_id"),
        (2, "['x', nan]", "[1, nan]", "['g']"),
        (3, "['stay']", "[3]", "['g']"),
        (4, "['no score']", None, "['g']"),
    ]
    df = spark.createDataFrame(rows, "i INT, text STRING, score STRING, alliance STRING")
    got = clean_windows(df, "text", ["score"], ["alliance"]).orderBy("i").collect()
    assert [(r.i, r.chat, r.score) for r in got] == [(0, "hi you", [1.0, 2.0]), (3, "stay", [3.0])]


def test_only_the_four_emoji_ranges_go(spark):
    text = "a 😀😎 b🚀 c\U0001F1E9\U0001F1EA d🤓 e☺ 🌀🗿 f  g"
    kept = "a  b c d🤓 e☺  f  g"
    df = spark.createDataFrame([(["x", text],)], "text ARRAY<STRING>")
    assert add_chat(df).first().chat == "x " + kept


def test_tokens(spark):
    df = spark.createDataFrame([("Hé llo, wörld42! 😀x_y",), ("",), ("a " * 600,)], "t STRING")
    got = [r[0] for r in df.select(fn.tokens(F.col("t"), MAX_TOKENS)).collect()]
    assert got[0] == ["Hé", "llo", ",", "wörld42", "!", "😀", "x", "_", "y"]
    assert got[1] == [] and len(got[2]) == 512
    assert len(df.select(fn.tokens(F.col("t"))).collect()[2][0]) == 600


@pytest.mark.parametrize(
    "values,mean,median", [([3.0, 1.0, 2.0], 2.0, 2.0), ([4.0, 1.0, 2.0, 9.0], 4.0, 3.0), ([], None, None), ([5.0], 5.0, 5.0)]
)
def test_list_statistics(spark, values, mean, median):
    df = spark.createDataFrame([(values,)], "v ARRAY<DOUBLE>")
    v = F.col("v")
    row = df.select(list_mean(v), list_median(v), risk_label(v)).first()
    assert row[0] == mean and row[1] == median
    assert row[2] == (None if mean is None else (mean + 1) / 8)


def test_euclidean(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<DOUBLE>")
    assert math.isclose(df.select(euclidean(F.col("a"), F.col("b"))).first()[0], 5.0)


def test_very_long_cells(spark):
    """Regular expressions go through them without recursion."""
    texts = ["x" * 300_000, "\n" * 100_000 + "'", "\\" * 100_000, 'it\'s "' * 30_000]
    rows = spark.createDataFrame([(i, repr([t, "end"])) for i, t in enumerate(texts)] + [(9, repr(texts * 500)[:400_000])], "id INT, text STRING")
    found = {r.id: r.text for r in parse_windows(rows, ["text"], []).collect()}
    assert all(found[i] == [t, "end"] for i, t in enumerate(texts)) and found[9] is None
