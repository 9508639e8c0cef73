"""Ordered lists by page. A page is what is asked for; nothing else is cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders and sizes of the lists.
LISTS: dict[str, tuple[list[tuple[str, bool]], int]] = {
    "sites": ([("created_at", False), ("site_id", False)], 20),
    "checks": ([("started_at", False), ("id", False)], 20),
    "imports": ([("imported_at", False), ("id", False)], 20),
    "period_metrics": ([("normalized_url", True), ("id", True)], 20),
    "daily_metrics": ([("metric_date", False), ("normalized_url", True)], 50),
    "journal": ([("scheduled_for", False), ("id", False)], 20),
    "structure": ([("sequence_number", True)], 20),
}


def order_of(name: str) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in LISTS[name][0]]


def rows_of(rows: DataFrame, name: str, number: int, size: int | None = None) -> DataFrame:
    """The rows of a page, without a count of them all; past the end there are none."""
    size = size or LISTS[name][1]
    return rows.orderBy(*order_of(name)).offset((max(number, 1) - 1) * size).limit(size)


def page(rows: DataFrame, name: str, number: int, past_end: str = "error", size: int | None = None) -> tuple[DataFrame, int, int]:
    """The rows of a page, its number and the number of pages (at least 1). past_end: error, last or empty."""
    size = size or LISTS[name][1]
    pages = max(1, -(-rows.count() // size))
    if number < 1 or number > pages:
        if past_end == "error":
            raise ValueError(f"there are {pages} pages")
        number = min(max(number, 1), pages) if past_end == "last" else max(number, 1)
    return rows_of(rows, name, number, size), number, pages
