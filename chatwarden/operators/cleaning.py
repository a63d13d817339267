"""From windows stored as text to typed, clean windows with a chat column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chatwarden.functions.arrays import is_clean
from chatwarden.functions.text import (
    join_texts,
    json_numbers,
    json_texts,
    literal_numbers,
    literal_texts,
    strip_emoji,
)


def parse_windows(
    windows: DataFrame, text_columns: Sequence[str], number_columns: Sequence[str]
) -> DataFrame:
    """Turns list columns stored as text into arrays; malformed cells become NULL.

    Cells are rewritten and read as JSON in the JVM. Only rows with a cell that
    this cannot read (an escape that JSON cannot have, or a malformed cell) go
    to Python, in batches; the others never leave the JVM. The plan reads the
    table once for either kind of row.
    """
    in_jvm = {c: json_texts(F.col(c)) for c in text_columns}
    in_jvm.update({c: json_numbers(F.col(c)) for c in number_columns})
    columns = [*text_columns, *number_columns]
    read = F.lit(True)
    for c in columns:
        read = read & (F.col(c).isNull() | in_jvm[c].isNotNull())
    whole = windows.where(read).withColumns(in_jvm)

    def rest(c: str, fallback) -> Column:
        return F.coalesce(F.col(f"_json_{c}"), fallback(F.when(F.col(f"_json_{c}").isNull(), F.col(c))))

    in_python = {c: rest(c, literal_texts) for c in text_columns}
    in_python.update({c: rest(c, literal_numbers) for c in number_columns})
    tried = windows.where(~read).withColumns({f"_json_{c}": in_jvm[c] for c in columns})
    return whole.unionByName(tried.withColumns(in_python).drop(*[f"_json_{c}" for c in columns]))


def drop_malformed(
    windows: DataFrame, text_columns: Sequence[str], number_columns: Sequence[str]
) -> DataFrame:
    """Drops a row if any listed column is unread or holds a missing value."""
    keep = F.lit(True)
    for c in text_columns:
        keep = keep & is_clean(F.col(c), numeric=False)
    for c in number_columns:
        keep = keep & is_clean(F.col(c), numeric=True)
    return windows.filter(keep)


def add_chat(windows: DataFrame, text_column: str = "text", name: str = "chat") -> DataFrame:
    """Appends the window's messages as one text without emoji."""
    return windows.withColumn(name, strip_emoji(join_texts(F.col(text_column))))


def clean_windows(
    windows: DataFrame,
    text_column: str,
    number_columns: Sequence[str],
    other_columns: Sequence[str] = (),
) -> DataFrame:
    """Parse, drop malformed rows, append ``chat``."""
    texts = [text_column, *other_columns]
    parsed = parse_windows(windows, texts, number_columns)
    return add_chat(drop_malformed(parsed, texts, number_columns), text_column)
