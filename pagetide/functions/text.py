"""Text: normalization as Unicode defines it, and exact edit distance."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


@lru_cache(maxsize=1)
def blanks() -> dict[int, str]:
    """Punctuation and symbols, by their Unicode categories, as spaces."""
    return {c: " " for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PS"}


def main_text(value: str) -> str:
    """NFC, case folded, punctuation and symbols as spaces, white space as one space."""
    return " ".join(unicodedata.normalize("NFC", value).casefold().translate(blanks()).split())


def readable_text(value: str) -> str:
    """NFC with white space as one space."""
    return " ".join(unicodedata.normalize("NFC", value).split())


@F.pandas_udf(StringType())
def normalize_main_text(values: pd.Series) -> pd.Series:
    return values.map(main_text, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_readable_text(values: pd.Series) -> pd.Series:
    return values.map(readable_text, na_action="ignore")


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a column of the table at a time as bit vectors (Myers 1999, Hyyrö 2003)."""
    if a == b:
        return 0
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    whole = (1 << m) - 1
    rises, falls = whole, 0  # where the column steps up, and down
    # Bits above the column's reach no lower ones, so they are cut off only now and then.
    step = 32 + m // 16
    for k in range(0, len(b), step):
        for ch in b[k : k + step]:
            hit = at.get(ch, 0) | falls
            diagonal = (((hit & rises) + rises) ^ rises) | hit
            across_up = (falls | (whole ^ (diagonal | rises))) << 1 | 1
            rises = (rises & diagonal) << 1 | (whole ^ (diagonal | across_up))
            falls = across_up & diagonal
        rises, falls = rises & whole, falls & whole
    return len(b) + rises.bit_count() - falls.bit_count()


@F.pandas_udf(IntegerType())
def long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


#: Below this many cells of its table, Spark's own distance is quicker than a trip to Python.
SHORT_CELLS = 250_000


def distance(a: Column, b: Column) -> Column:
    """Edit distance: JVM-side for short pairs, bit vectors in an Arrow batch for long ones. Long pairs alone reach Python with their text."""
    short = F.length(a).cast("long") * F.length(b) <= SHORT_CELLS
    slow = long_distance(F.when(~short, a), F.when(~short, b))
    return F.when(short, F.levenshtein(a, b)).otherwise(slow)
