import random
from datetime import datetime

from pagetide.operators import connections as c
from pyspark.sql import functions as F

SITES = "site_id long, site_type string"
CHOICES = "choice_id long, connection_id long, revision int, expected_source_id long, resource_id string, resource_label string, source_id long, run_id long"
AT = datetime(2026, 5, 5)
OLD = datetime(2026, 1, 1)


def model(rnd, n=40):
    """Sites, and connections with sources, runs and schedules in all states."""
    sites = [(i, rnd.choice(["owned", "owned", "competitor"])) for i in range(1, n + 1)]
    connections = [(100 + i, i, "search", rnd.choice(["connected", "connected", "disconnected"]), rnd.randrange(3), OLD) for i in range(1, n + 1)]
    sources = [(10 * k[0] + v, k[0], "search", v, f"r{v}", f"R{v}", v == last and rnd.random() < 0.9) for k in connections for last in [rnd.randrange(3)] for v in range(1, last + 1)]
    runs = [(1000 * k[0] + j, k[0], None, "manual", rnd.choice(["pending", "running", "completed"]), OLD, None, "m") for k in connections for j in range(rnd.randrange(3))]
    schedules = [(k[0], True, "daily", 3, "10:00", OLD) for k in connections if rnd.random() < 0.5]
    return sites, connections, sources, runs, schedules


def tables_of(spark, connections, sources, runs, schedules):
    return c.Tables(*(spark.createDataFrame(rows, schema) for rows, schema in ((connections, c.CONNECTIONS), (sources, c.SOURCES), (runs, c.RUNS), (schedules, c.SCHEDULES))))


def rows_of(tables):
    return [sorted(map(tuple, t.select(*(x.split()[0] for x in s.split(", "))).collect()), key=str) for t, s in zip(tables, (c.CONNECTIONS, c.SOURCES, c.RUNS, c.SCHEDULES), strict=True)]


def one_by_one(sites, connections, sources, runs, schedules, choices):
    """The choices in order, each in its turn."""
    kind, refused = dict(sites), []
    connections, sources, runs, schedules = ({r[0]: list(r) for r in t} for t in (connections, sources, runs, schedules))
    for k in sorted(choices):
        choice, cid, revision, expected, resource, label, sid, rid = k
        own = connections.get(cid)
        if not own or own[3] != "connected" or kind.get(own[1]) != "owned" or revision not in (None, own[4]):
            refused.append((choice, cid, c.CHANGED))
            continue
        active = next((s for s in sources.values() if s[1] == cid and s[6]), None)
        if (active[0] if active else None) != expected:
            refused.append((choice, cid, c.STALE))
            continue
        if active and active[4] == resource:
            continue
        version = max((s[3] for s in sources.values() if s[1] == cid), default=0) + 1
        if active:
            active[6] = False
        for r in runs.values():
            if r[1] == cid and r[4] == "pending":
                r[4], r[6], r[7] = "cancelled", AT, c.RESOURCE_CHANGED
        own[4], own[5] = own[4] + 1, AT
        sources[sid] = [sid, cid, "search", version, resource, label, True]
        runs[rid] = [rid, cid, sid, "initial", "pending", AT, None, c.WAITING]
        schedules.setdefault(cid, [cid, False, "weekly", 0, "09:00", None])
    return [sorted((tuple(r) for r in t.values()), key=str) for t in (connections, sources, runs, schedules)], sorted(refused)


def test_choices_against_one_by_one(spark):
    rnd = random.Random(8)
    given = model(rnd)
    sites, connections, sources = given[:3]
    active = {s[1]: s[0] for s in sources if s[6]}
    choices = []
    for n, k in enumerate([*connections, (999, 1, "search", "connected", 0, OLD)]):
        expected = rnd.choice([active.get(k[0])] * 4 + [None, 5])
        choices.append((n, k[0], rnd.choice([k[4]] * 4 + [None, k[4] + 1]), expected, f"r{rnd.randrange(1, 4)}", "L", 10**6 + n, 10**7 + n))
    out, refused = c.chosen(tables_of(spark, *given[1:]), spark.createDataFrame(sites, SITES), spark.createDataFrame(choices, CHOICES), F.lit(AT))
    want, no = one_by_one(*given, choices)
    assert rows_of(out) == want and sorted(map(tuple, refused.collect())) == no
    assert {r[2] for r in no} == {c.CHANGED, c.STALE} and len(no) < len(choices) - 8


def test_of_choices_at_the_same_time_one_is_made(spark):
    tables = tables_of(spark, [(1, 1, "search", "connected", 0, OLD)], [], [(5, 1, None, "manual", "pending", OLD, None, "m")], [])
    sites = spark.createDataFrame([(1, "owned")], SITES)
    choices = [(1, 1, 9, None, "wrong revision", "L", 20, 30), (2, 1, 0, None, "first", "L", 21, 31), (3, 1, 0, None, "second", "L", 22, 32)]
    out, refused = c.chosen(tables, sites, spark.createDataFrame(choices, CHOICES), F.lit(AT))
    assert [(r.resource_id, r.version, r.active) for r in out.sources.collect()] == [("first", 1, True)]
    assert sorted((r.choice_id, r.reason) for r in refused.collect()) == [(1, c.CHANGED), (3, c.CHANGED)]
    again, refused = c.chosen(out, sites, spark.createDataFrame([(4, 1, 1, 21, "first", "L", 23, 33)], CHOICES), F.lit(AT))
    assert rows_of(again) == rows_of(out) and refused.isEmpty()


def test_disconnected(spark):
    rnd = random.Random(9)
    given = model(rnd)
    sites, connections, sources, runs, schedules = given
    gone = [(k[1], "search", rnd.choice([None, k[4], k[4] + 1])) for k in connections if rnd.random() < 0.6] + [(1, "other", None), (777, "search", None), (2, "search", None), (2, "search", None)]
    out, closed = c.disconnected(tables_of(spark, *given[1:]), spark.createDataFrame(sites, SITES), spark.createDataFrame(gone, "site_id long, provider string, revision int"), F.lit(AT))
    ids = {k[0] for k in connections if dict(sites)[k[1]] == "owned" and any(g[:2] == (k[1], "search") and g[2] in (None, k[4]) for g in gone)}
    want = [
        [(*k[:3], "disconnected", k[4] + 1, AT) if k[0] in ids else k for k in connections],
        sources,
        [(*r[:4], "cancelled", r[5], AT, c.DISCONNECTED) if r[1] in ids and r[4] == "pending" else r for r in runs],
        [(s[0], False, *s[2:5], None) if s[0] in ids else s for s in schedules],
    ]
    assert rows_of(out) == [sorted(t, key=str) for t in want] and {r[0] for r in closed.collect()} == ids and len(ids) > 5


def test_scheduled(spark):
    tables = tables_of(spark, [(i, i, "search", "disconnected" if i == 3 else "connected", 1, OLD) for i in range(1, 7)], [(10 + i, i, "search", 1, "r", "R", i != 4) for i in range(1, 7)], [], [(1, True, "daily", 1, "08:00", OLD), (6, True, "daily", 1, "08:00", OLD)])
    sites = spark.createDataFrame([(i, "competitor" if i == 5 else "owned") for i in range(1, 7)], SITES)
    saved = spark.createDataFrame([(1, 1, False, "weekly", 2, "07:00", AT), (2, 1, True, "daily", 0, "06:00", AT), (3, 1, True, "daily", 0, "06:00", AT), (4, 1, True, "daily", 0, "06:00", AT), (5, 1, True, "daily", 0, "06:00", AT), (6, 2, True, "daily", 0, "06:00", AT)], f"connection_id long, revision int, {c.SCHEDULES.removeprefix('connection_id long, ')}")
    out, refused = c.scheduled(tables, sites, saved)
    assert sorted(map(tuple, out.collect())) == [(1, False, "weekly", 2, "07:00", None), (2, True, "daily", 0, "06:00", AT), (6, True, "daily", 1, "08:00", OLD)]
    assert sorted(map(tuple, refused.collect())) == [(i, c.CHANGED) for i in (3, 4, 5, 6)]
