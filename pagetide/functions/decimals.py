"""Decimal numbers as canonical text: no sign, exponent or final zeros, so that equal text is equal value."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CANONICAL = r"^(0|[1-9][0-9]*)(\.[0-9]*[1-9])?$"


def canonical(value: Decimal | None) -> str | None:
    """The text of a finite number of at least 0; others are errors."""
    if value is None:
        return None
    if not value.is_finite() or value < 0:
        raise ValueError("a decimal must be finite and not negative")
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return text.lstrip("0") if text[:1] == "0" and text[:2] != "0." and text != "0" else text


def position(text: str | None, zero: bool) -> str | None:
    """A position's canonical text, with a comma or a point; None if it is no positive (or with zero set, no non-negative) number."""
    if text is None:
        return None
    try:
        value = Decimal(text.strip().replace(",", "."))
    except InvalidOperation:
        return None
    return canonical(value) if value.is_finite() and (value > 0 or zero and value == 0) else None


def decoded(text: Column) -> Column:
    """The number of a canonical text, or null if it isn't canonical."""
    return F.when(text.rlike(CANONICAL), text.try_cast("decimal(38,18)"))


@F.pandas_udf(StringType())
def canonical_position(values: pd.Series) -> pd.Series:
    return values.map(lambda v: position(v, False), na_action="ignore")
