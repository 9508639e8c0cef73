from datetime import datetime

import pytest
from pagetide.operators import paging, runs


def test_pages(spark):
    rows = spark.createDataFrame([(i, datetime(2026, 1, 1 + i % 5)) for i in range(45)], "id long, scheduled_for timestamp")
    got, number, pages = paging.page(rows, "journal", 2)
    want = sorted(((r.scheduled_for, r.id) for r in rows.collect()), reverse=True)[20:40]
    assert (number, pages) == (2, 3) and [(r.scheduled_for, r.id) for r in got.collect()] == want
    assert paging.page(rows, "journal", 99, "last")[1] == 3 and paging.page(rows, "journal", 99, "empty")[0].isEmpty()
    with pytest.raises(ValueError):
        paging.page(rows, "journal", 0)
    assert paging.page(rows.limit(0), "journal", 1)[2] == 1


def test_recent(spark):
    rows = spark.createDataFrame([(p, i) for p in "ab" for i in range(15)], "provider string, id long")
    got = runs.recent(rows, "provider", ["id"], 3)
    assert sorted((r.provider, r.id, r.place) for r in got.collect()) == [(p, 14 - k, k + 1) for p in "ab" for k in (2, 1, 0)]


def test_source_versions(spark):
    rows = spark.createDataFrame([(1, 1, "x", True), (2, 1, "x", True)], "connection_id long, version int, resource string, active boolean")
    new = runs.with_source(rows, 1, "y")
    assert sorted(tuple(r) for r in new.collect()) == [(1, 1, "x", False), (1, 2, "y", True), (2, 1, "x", True)]
    assert runs.with_source(new, 1, "y") is new and runs.with_source(rows.limit(0), 5, "z").first().version == 1
