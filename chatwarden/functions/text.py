"""Column functions over chat text and lists written as text."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from chatwarden.functions.fixed_values import EMOJI_PATTERN, TOKEN_PATTERN

_JSON_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
# Escapes that mean the same in a Python literal and in JSON.
_SHARED_ESCAPES = r"""\\(?:[\\'"nrtbf]|u[0-9a-fA-F]{4})"""
# Behind an even number of backslashes, which stand for themselves in pairs.
_PAIRS = r"(?<!\\)((?:\\\\)*+)"
_REWRITTEN = (
    (_PAIRS + r"\\x([0-9a-fA-F]{2})", r"$1\\u00$2"),
    (_PAIRS + r"\\a", r"$1\\u0007"),
    (_PAIRS + r"\\v", r"$1\\u000b"),
    # No escape in Python: the backslash stays.
    (_PAIRS + r"\\([^\\'\"nrtbfavuUxN0-7\r\n])", r"$1\\\\$2"),
)
# Repetitions are possessive: the engine goes through texts of any length in a loop, not by recursion.
# One list of numbers and of quoted texts (each replaced by one sign), nothing around it.
_QUOTED = r"""'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+\""""
_ONE_LIST = r"""^\s*\[(?:\s*(?:"|[0-9+.-][0-9eE+.-]*)\s*(?:,|(?=\])))*+\s*\]\s*$"""
_PLAIN_NUMBERS = r"^\s*\[[\s0-9eE+.,-]*\]\s*$"


def join_texts(texts: Column) -> Column:
    """The messages of a window, joined with one space."""
    return F.array_join(texts, " ")


def strip_emoji(text: Column) -> Column:
    """Remove emoji of the four fixed ranges; other signs and spaces stay."""
    return F.regexp_replace(text, EMOJI_PATTERN, "")


def tokens(text: Column, limit: int | None = None) -> Column:
    """Word tokens of the text; all of them, unless a ``limit`` is asked for."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return found if limit is None else F.slice(found, 1, limit)


def _literal_list(cell: str | None, convert) -> list | None:
    if cell is None:
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)  # an unknown escape is kept as it is
        try:
            return [convert(x) for x in ast.literal_eval(cell.strip())]
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None


def _as_text(value) -> str:
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TypeError("neither text nor number")


# Not deterministic only in name: it keeps the optimizer from copying the call
# into a filter below, which would run the Python step twice.
@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_texts(cells: pd.Series) -> pd.Series:
    return cells.map(lambda cell: _literal_list(cell, _as_text))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _literal_numbers(cells: pd.Series) -> pd.Series:
    return cells.map(lambda cell: _literal_list(cell, float))


literal_texts = _literal_texts.asNondeterministic()
literal_numbers = _literal_numbers.asNondeterministic()


def json_escapes(cell: Column) -> Column:
    """Escapes that only a Python literal has, as JSON has them, one class at a time:
    two hex digits, bell and vertical tab, and a backslash that stands for itself."""
    for pattern, json in _REWRITTEN:
        cell = F.regexp_replace(cell, pattern, json)
    return cell


def json_texts(cell: Column) -> Column:
    """``"['a', 'b']"`` as an array of strings where JSON reads it the same way.

    Escapes are rewritten first. Cells that are not one list of texts and numbers,
    or have an escape that JSON cannot have, are left to the fallback.

    A number among the texts is kept as its text.
    """
    # Without a backslash there is nothing to rewrite.
    cell = F.when(F.contains(cell, F.lit("\\")), json_escapes(cell)).otherwise(cell)
    shared = ~F.contains(F.regexp_replace(cell, _SHARED_ESCAPES, ""), F.lit("\\"))
    one_list = F.rlike(F.regexp_replace(cell, _QUOTED, '"'), F.lit(_ONE_LIST))
    return F.when(shared & one_list, F.from_json(cell, T.ArrayType(T.StringType()), _JSON_OPTIONS))


def json_numbers(cell: Column) -> Column:
    """``"[1, 2.5]"`` as an array of doubles where JSON reads it the same way."""
    plain = F.rlike(cell, F.lit(_PLAIN_NUMBERS))
    return F.when(plain, F.from_json(cell, T.ArrayType(T.DoubleType()), _JSON_OPTIONS))
