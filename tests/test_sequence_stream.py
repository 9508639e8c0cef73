import random
from datetime import datetime

from pagetide.operators import diff, runs
from pagetide.streaming import sequence_stream as seq
from pyspark.sql import functions as F

RUNS = "run_id long, site_id long, completed_at timestamp, status string"
PRICE = {"amount": "10", "currency": "EUR", "kind": "price", "source": "x"}
PAGES = "page_id long, run_id long, url string, title string, description string, h1 string, normalized_text string, content_hash string, internal_links array<string>, prices array<struct<amount: string, currency: string, kind: string, source: string>>"


def landed(spark, folder, rows):
    spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(folder)


def history(rnd, n=44):
    """Runs of some sites, several at the same moment, some of which aren't completed."""
    return [(i, i % 4, datetime(2026, 1, 1 + rnd.randrange(20)), rnd.choice(["completed"] * 5 + ["partial", "failed"])) for i in range(1, n + 1)]


def pages_of(spark, rnd, rows):
    return spark.createDataFrame([(100 * r[0] + k, r[0], f"/{k}", rnd.choice("ab"), None, None, rnd.choice("xy"), None, [], [{**PRICE, "amount": rnd.choice(["10", "11"])}]) for r in rows for k in rnd.sample(range(5), rnd.randrange(1, 5))], PAGES)


def run(spark, folder, tmp_path, name="c"):
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(folder)
    q = seq.start(stream, str(tmp_path / "pages"), str(tmp_path / "events"), str(tmp_path / "stale"), str(tmp_path / name), str(tmp_path / "prices"))
    q.awaitTermination(300)
    assert not q.isActive and q.exception() is None


def state(spark, tmp_path, name):
    return spark.read.parquet(str(tmp_path / name)).drop("bucket")


KEY = ["current_run_id", "previous_run_id", "event_type", "url"]


def test_out_of_order_runs_and_a_restart(spark, tmp_path):
    """Runs land in any order, in several batches, with the stream stopped and started in between; each time the events that live are those of the batch engine."""
    rnd = random.Random(7)
    rows = history(rnd)
    pages = pages_of(spark, rnd, rows)
    pages.write.parquet(str(tmp_path / "pages"))
    folder = str(tmp_path / "runs")
    order = rnd.sample(rows, len(rows))
    done = []
    for part in (order[:20], order[20:32], order[32:] + order[:5]):  # the last batch repeats runs that have landed
        for k in range(0, len(part), 10):
            landed(spark, folder, part[k : k + 10])
        done = [*done, *part]
        run(spark, folder, tmp_path)
        table = spark.createDataFrame(sorted(set(done)), RUNS)
        events, stale, prices = (state(spark, tmp_path, n) for n in ("events", "stale", "prices"))
        want, want_prices = diff.process(table, pages)
        ids = lambda e, key=KEY: sorted(map(tuple, e.select(*key).collect()))
        assert ids(seq.live(events, stale)) == ids(want)
        assert ids(seq.live(prices, stale), diff.PRICE_KEY) == ids(want_prices, diff.PRICE_KEY)
        # What the batch check finds broken is what the stream has put aside.
        broken = diff.broken_sequence(events, table)
        assert ids(broken) == ids(events.join(stale, ["current_run_id", "previous_run_id"], "left_semi"))
    assert broken.count() > 10
    before = events.count(), stale.count()
    run(spark, folder, tmp_path)  # nothing new
    run(spark, folder, tmp_path, "other")  # all again, from no state: nothing is stored twice
    assert ids(seq.live(state(spark, tmp_path, "events"), state(spark, tmp_path, "stale"))) == ids(want)
    again = state(spark, tmp_path, "events")
    assert again.groupBy(*KEY).count().where("count > 1").isEmpty() and again.count() >= before[0]


def test_what_a_late_run_says(spark, tmp_path):
    day = lambda n: datetime(2026, 1, n)
    folder = str(tmp_path / "r")
    told = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", seq.ROCKSDB)
    for part in ([(1, 9, day(1), "completed"), (3, 9, day(3), "completed")], [(2, 9, day(2), "completed")], [(4, 9, day(1), "completed"), (5, 9, day(9), "partial")], [(2, 9, day(2), "completed")], [(8, 9, datetime(2025, 1, 1), "completed")]):
        landed(spark, folder, part)
        q = seq.pairs_of(spark.readStream.schema(RUNS).parquet(folder)).writeStream.foreachBatch(lambda b, _: told.append(sorted(map(tuple, b.select("kind", "current_run_id", "previous_run_id").collect()), key=str))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [t for t in told if t] == [
        [("next", 1, None), ("next", 3, 1)],
        [("late", 2, 1), ("moved", 3, 2), ("stale", 3, 1)],
        [("late", 4, 1), ("moved", 2, 4), ("stale", 2, 1)],
        [("late", 8, None), ("moved", 1, 8), ("stale", 1, None)],
    ]


def test_pairs_told_together(spark):
    rows = [("next", 1, 1, None), ("next", 1, 3, 1), ("late", 1, 2, 1), ("moved", 1, 3, 2), ("stale", 1, 3, 1), ("late", 1, 8, None), ("moved", 1, 1, 8), ("stale", 1, 1, None)]
    told = spark.createDataFrame(rows, "kind string, site_id long, current_run_id long, previous_run_id long").withColumn("current_completed_at", F.lit(None).cast("timestamp"))
    assert sorted(map(tuple, seq.holding(told).select("current_run_id", "previous_run_id").collect()), key=str) == [(1, 8), (2, 1), (3, 2), (8, None)]
    table = spark.createDataFrame([(8, 1, datetime(2025, 1, 1), "completed"), (1, 1, datetime(2026, 1, 1), "completed"), (2, 1, datetime(2026, 1, 2), "completed"), (3, 1, datetime(2026, 1, 3), "completed")], RUNS)
    assert sorted(map(tuple, runs.predecessors(table).select("current_run_id", "previous_run_id").collect()), key=str) == [(1, 8), (2, 1), (3, 2), (8, None)]


def test_a_shard_of_many_sites(monkeypatch):
    """Sites of any number, without one, with repeats and late runs, against runs that land one by one; a visit calls the state twice at most, however many runs it has."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(seq, "PIECE", 50)
    monkeypatch.setattr(seq, "PARTS", 5)
    calls, held = [], []

    class State:
        get = lambda self: calls.append("get") or iter(list(held))
        put = lambda self, rows: calls.append("put") or held.__setitem__(slice(None), rows)
        appendList = lambda self, rows: calls.append("append") or held.extend(rows)

    class Handle:
        getListState = lambda self, name, schema: State()

    rnd = random.Random(3)
    shard = seq.Sequence()
    shard.init(Handle())
    known: dict = {}
    for visit in range(12):
        runs = [(rnd.choice([None, *range(40)]), rnd.randrange(60), rnd.randrange(30)) for _ in range(rnd.choice([1, 30, 200]))]
        want = []
        for site, at, run in sorted(runs, key=lambda r: r[1:]):
            own = known.setdefault(site, [])
            if (at, run) in own:
                continue
            before, after = max((x for x in own if x < (at, run)), default=None), min((x for x in own if x > (at, run)), default=None)
            own.append((at, run))
            pair = lambda kind, one, other, site=site: (kind, site, one[1], other and other[1], one[0])
            want += [pair("late", (at, run), before), pair("moved", after, (at, run)), pair("stale", after, before)] if after else [pair("next", (at, run), before)]
        frame = pd.DataFrame({"nowhere": [r[0] is None for r in runs], "site": [r[0] or 0 for r in runs], "at": [r[1] for r in runs], "run": [r[2] for r in runs]})
        calls.clear()
        got = [tuple(None if x is pd.NA else x for x in r) for out in shard.handleInputRows((0,), iter([frame[:7], frame[7:]]), None) for r in out.astype(object).itertuples(index=False)]
        assert sorted(got, key=str) == sorted(want, key=str) and len(calls) <= 2
    assert sum(len(np.frombuffer(p, seq.RUN)) for (p,) in held) == sum(map(len, known.values())) and len(held) <= 60


def test_runs_without_a_site(spark, tmp_path):
    """They are a group of their own, as predecessors() has them."""
    day = lambda n: datetime(2026, 1, n)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", seq.ROCKSDB)
    rows = [(1, None, day(1), "completed"), (2, None, day(2), "completed"), (3, 0, day(1), "completed"), (4, 0, datetime(1890, 1, 1), "completed")]
    landed(spark, str(tmp_path / "r"), rows)
    told = []
    q = seq.pairs_of(spark.readStream.schema(RUNS).parquet(str(tmp_path / "r"))).writeStream.foreachBatch(lambda b, _: told.extend(map(tuple, b.select("site_id", "current_run_id", "previous_run_id", "current_completed_at").collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = runs.predecessors(spark.createDataFrame(rows, RUNS)).select("site_id", "current_run_id", "previous_run_id", "current_completed_at").collect()
    assert sorted(told, key=str) == sorted(map(tuple, want), key=str) and len(told) == 4
