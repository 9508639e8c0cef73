"""Every query with an oracle against it, on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest
from pagetide.plans import registry


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return str(v.replace(tzinfo=None))
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert columns == sorted(names) and got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


@pytest.mark.parametrize("ranges", ["1", "3", "50"])
def test_with_previous(spark, ranges):
    import random

    from pagetide.operators.neighbours import with_previous

    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "hot", "hot", "hot", "z"]), i, f"t{i}") for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        table = spark.createDataFrame(rows, "source string, id long, text string").repartition(5)
        got = {r.id: r.previous for r in with_previous(table, "source", "id", "text").collect()}
        assert with_previous(table.limit(0), "source", "id", "text").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, last = {}, {}
    for s, i, t in sorted(rows, key=lambda r: r[1]):
        want[i], last[s] = last.get(s), t
    assert got == want


def test_long_text_distance(spark, tmp_path):
    """The query against a plain table, over texts that reach either way of counting."""
    import random

    from pagetide.functions.text import edit_distance

    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), "".join(rnd.choices("abcé ", k=rnd.choice([0, 3, 40, 700])))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text_distance for r in registry.QUERIES["long_text_distance"](spark, str(tmp_path)).collect()}

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    last, want = {}, {}
    for i, s, t in rows:
        if s in last and last[s] != t:
            want[i] = plain(last[s], t)
            assert want[i] == edit_distance(last[s], t)
        last[s] = t
    assert got == want


def test_long_pairs_are_dealt_anew(spark, tmp_path):
    """Long documents that lie together are compared in many tasks."""
    from pagetide.functions.text import edit_distance

    texts = ["ab" * 400 + str(i) * 30 for i in range(40)]
    spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES["long_text_distance"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 16
    assert {r.doc_id: r.text_distance for r in rows.collect()} == {i: edit_distance(texts[i - 1], texts[i]) for i in range(1, 40)}
