"""Exact change ratios and what they weigh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, of which five for each digit of the smaller number are enough, and one to put the larger first."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), 5 * F.length(F.least(a, b).cast("string")) + 1), start, step, lambda s: s["a"])


def reduced(numerator: Column, denominator: Column) -> Column:
    """struct(num, den) in lowest terms."""
    g = gcd(numerator, denominator)
    return F.struct((numerator / g).cast("long").alias("num"), (denominator / g).cast("long").alias("den"))


def weight(numerator: Column, denominator: Column) -> Column:
    """1 below a tenth, 2 below three tenths, else 3. A ratio of 0 or less is no change and an error."""
    n, d = numerator.cast("decimal(20,0)"), denominator.cast("decimal(20,0)")  # ten times a long is no long
    return F.when(n <= 0, F.raise_error(F.lit("a change ratio must be positive")).cast("int")).when(10 * n < d, 1).when(10 * n < 3 * d, 2).otherwise(3)


def importance(w: Column) -> Column:
    return F.when(w == 1, "low").when(w == 2, "medium").when(w == 3, "high")
