"""Text as wide as a terminal shows it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F


def width_of(text: str) -> int:
    """Columns: two of wide and full-width characters, none of marks that combine, of joiners and of controls."""
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cc", "Cf", "Mn", "Me") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cut_to(text: str, width: int) -> str:
    """text, or as much of its beginning as fits before an ellipsis of one column; not half a wide character."""
    if width_of(text) <= width:
        return text
    if width <= 1:
        return "…" * width
    kept, used = [], 0
    for c in text:
        used += width_of(c)
        if used > width - 1:
            break
        kept.append(c)
    return "".join(kept) + "…"


def display_width(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else width_of(t)).astype("Int64")

    return run(text)


def display_shortened(text: Column, width: int) -> Column:
    """cut_to() of a column; texts of ASCII alone needn't leave the JVM, see columns.shortened()."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_to(t, width))

    return run(text)
