from datetime import UTC, datetime

import pandas as pd
import pytest
from pagetide.operators import diff, feed, graph, metrics, runs, schedule
from pagetide.schemas import SNAPSHOTS
from pyspark.sql import functions as F

T = datetime(2026, 1, 1)
PRICE = {"amount": "10", "currency": "EUR", "kind": "price", "source": "json-ld"}


def page(page_id, run_id, url="/", title="t", description="d", h1="h", text="text", links=("/a",), prices=(PRICE,)):
    return (page_id, run_id, url, title, description, h1, text, "hash", list(links), list(prices))


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), SNAPSHOTS)


def two_runs(spark):
    return spark.createDataFrame([(1, 9, datetime(2026, 1, 1), "completed"), (2, 9, datetime(2026, 1, 2), "completed")], "run_id long, site_id long, completed_at timestamp, status string")


def kinds(df):
    return sorted(r.event_type for r in df.collect())


def test_predecessors(spark):
    rows = [(1, 1, T, "completed"), (2, 1, T, "completed"), (3, 1, T, "partial"), (4, 1, datetime(2026, 1, 2), "completed"), (5, 1, None, "completed"), (6, 2, T, "completed"), (7, 1, datetime(2026, 1, 3), "failed")]
    df = spark.createDataFrame(rows, "run_id long, site_id long, completed_at timestamp, status string")
    assert {r.current_run_id: r.previous_run_id for r in runs.predecessors(df).collect()} == {1: None, 2: 1, 4: 2, 6: None}
    assert {r.site_id: r.run_id for r in runs.latest(df).collect()} == {1: 4, 2: 6}


def test_every_change_once(spark):
    new = pages(spark, page(1, 1), page(2, 2, title=None, description="", h1="H", text="test", links=("/b", "/a", "/a"), prices=({**PRICE, "amount": "11"},)))
    events, price = diff.process(two_runs(spark), new)
    assert kinds(events) == ["description_changed", "h1_changed", "internal_links_changed", "text_changed", "title_changed"]
    by = {r.event_type: r for r in events.collect()}
    assert (by["text_changed"].text_distance, by["text_changed"].ratio_numerator, by["text_changed"].ratio_denominator, by["text_changed"].importance) == (1, 1, 4, "medium")
    assert (by["internal_links_changed"].ratio_numerator, by["internal_links_changed"].ratio_denominator, by["internal_links_changed"].weight) == (1, 2, 3)
    assert [(str(r.previous_low).rstrip("0").rstrip("."), r.price_profile) for r in price.collect()] == [("10", "price")]
    assert diff.page_importance(events).first().weight == 3
    assert diff.new_events(events, events).isEmpty()


def test_null_is_not_empty(spark):
    events, _ = diff.process(two_runs(spark), pages(spark, page(1, 1, title=None, description=None), page(2, 2, title="", description=None)))
    assert kinds(events) == ["title_changed"]


def test_added_removed_and_baseline(spark):
    events, _ = diff.process(two_runs(spark), pages(spark, page(1, 1, "/old"), page(2, 2, "/new")))
    assert {(r.event_type, r.current_page_id, r.previous_page_id, r.weight) for r in events.collect()} == {("page_added", 2, None, 2), ("page_removed", None, 1, 3)}
    alone, _ = diff.process(two_runs(spark), pages(spark, page(1, 1, "/old")))
    assert kinds(alone) == ["page_removed"]
    baseline, _ = diff.process(two_runs(spark).where("run_id = 1"), pages(spark, page(1, 1)))
    assert baseline.isEmpty()


def test_text_from_nothing(spark):
    events, _ = diff.process(two_runs(spark), pages(spark, page(1, 1, text=""), page(2, 2, text="abc")))
    e = events.first()
    assert (e.text_distance, e.ratio_numerator, e.ratio_denominator, e.weight) == (3, 1, 1, 3)


def test_repeated_url(spark):
    with pytest.raises(Exception, match="twice"):
        diff.unique_urls(pages(spark, page(1, 1), page(2, 1))).collect()
    for double in ((page(1, 1), page(2, 1)), (page(1, 2), page(2, 2)), (page(1, 1), page(2, 1), page(3, 2)), (page(1, 1), page(2, 2), page(3, 2))):
        with pytest.raises(Exception, match="twice"):
            diff.process(two_runs(spark), pages(spark, *double))[0].collect()


LOW, HIGH = {**PRICE, "kind": "low"}, {**PRICE, "kind": "high", "amount": "20"}


@pytest.mark.parametrize(
    ("prices", "want"),
    [
        ([PRICE], "price"),
        ([LOW, HIGH], "range"),
        ([], None),
        ([PRICE, PRICE], None),
        ([LOW], None),
        ([{**LOW, "amount": "30"}, HIGH], None),
        ([{**LOW, "currency": "USD"}, HIGH], None),
        ([{**PRICE, "currency": None}], None),
        ([{**PRICE, "amount": None}], None),
        ([{**PRICE, "amount": "-1"}], None),
    ],
)
def test_price_profiles(spark, prices, want):
    row = pages(spark, page(1, 1, prices=prices)).select(diff.price_profile(F.col("prices")).alias("p")).first()
    assert (row.p.profile if row.p else None) == want


def test_price_source_does_not_matter(spark):
    _, price = diff.process(two_runs(spark), pages(spark, page(1, 1), page(2, 2, prices=[{**PRICE, "source": "microdata"}])))
    assert price.isEmpty()


def test_late_run_breaks_a_sequence(spark):
    all_runs = two_runs(spark)
    events, _ = diff.process(all_runs, pages(spark, page(1, 1, "/old"), page(2, 2, "/new")))
    assert diff.broken_sequence(events, all_runs).isEmpty()
    late = all_runs.unionByName(spark.createDataFrame([(3, 9, datetime(2026, 1, 1, 12), "completed")], all_runs.schema))
    assert diff.broken_sequence(events, late).count() == 2


def small_feed(spark):
    rows = [(i, "snapshot", 0, 1, "owned", "title_changed", "high", datetime(2026, 1, 1 + i % 3), None) for i in range(6)] + [(3, "price", 1, 2, "competitor", "price_changed", None, datetime(2026, 1, 1), datetime(2026, 2, 1))]
    return spark.createDataFrame(rows, "event_id long, source string, source_rank int, site_id long, site_type string, event_type string, importance string, current_completed_at timestamp, viewed_at timestamp")


def test_feed_order_and_filters(spark):
    f = small_feed(spark)
    assert [(r.source, r.event_id) for r in feed.page(f, 200).collect()] == [("snapshot", i) for i in (5, 2, 4, 1, 3, 0)] + [("price", 3)]
    assert [r.event_id for r in feed.page(f, 2, 2).collect()] == [4, 1]
    at = lambda d: datetime(2026, 1, d, tzinfo=UTC)
    assert feed.filtered(f, from_time=at(2), before_time=at(3)).count() == 2
    assert feed.filtered(f, importance=["high"]).count() == 6 and feed.filtered(f, viewed=True).count() == 1 and feed.filtered(f, site_type="owned", viewed=False).count() == 6
    assert feed.local_days(f, "2026-01-02", "2026-01-02", "UTC").count() == 2
    for bad in ({"from_time": datetime(2026, 1, 1)}, {"from_time": at(2), "before_time": at(2)}, {"event_types": ["x"]}, {"importance": ["x"]}):
        with pytest.raises(ValueError):
            feed.filtered(f, **bad)
    for limit, offset in ((0, 0), (201, 0), (True, 0), (1, -1)):
        with pytest.raises(ValueError):
            feed.page(f, limit, offset)


def test_views_keep_their_first_time(spark):
    empty = spark.createDataFrame([], "source string, event_id long, viewed_at timestamp")
    at = lambda d: F.lit(f"2026-01-0{d}").cast("timestamp")
    once = feed.set_viewed(empty, "price", 1, at(1))
    assert [r.viewed_at.day for r in feed.set_viewed(once, "price", 1, at(2)).collect()] == [1]
    assert feed.clear_viewed(once, "price", 1).isEmpty() and feed.clear_viewed(once, "snapshot", 1).count() == 1


def test_sides(spark):
    new = pages(spark, page(1, 1, title=None), page(2, 2, title="", links=()))
    events, _ = diff.process(two_runs(spark), new)
    by = {r.event_type: (r.current.state, r.previous.state) for r in feed.with_sides(events, new).collect()}
    assert by == {"title_changed": ("empty_text", "none"), "internal_links_changed": ("empty_links", "links")}
    assert feed.inconsistent(events, new).isEmpty()
    assert feed.inconsistent(events.withColumn("current_page_id", F.lit(None).cast("long")), new).count() == 2


def test_safe_cells(spark):
    rows = spark.createDataFrame([("=1",), ("+1",), ("@x",), ("a=1",), ("a\nb",), (None,)], "c string")
    assert [r[0] for r in rows.select(feed.safe_cell(F.col("c"))).collect()] == ["'=1", "'+1", "'@x", "a=1", "a\r\nb", None]


def test_validation(spark):
    rows = [(2, "https://example.com/a", "3", "2", "0"), (3, "https://other.com/", "x", "", ""), (4, "https://EXAMPLE.com/a#f", "1", "2", "1,2300"), (5, "", "", "-1", "x")]
    checked = metrics.validated(spark.createDataFrame(rows, "line int, page string, clicks string, impressions string, position string"), "https://example.com")
    got = {r.line: r.errors for r in checked.collect()}
    assert got == {2: ["clicks over impressions", "bad position"], 3: ["no impressions", "bad clicks", "other origin"], 4: ["same url as line 2"], 5: ["no page", "no clicks", "bad impressions", "bad position"]}
    assert [(r.line, r.place) for r in metrics.error_report(checked, 3).collect()] == [(2, 0), (2, 1), (3, 0)]
    assert {r.line: r.position_text for r in checked.collect()}[4] == "1.23"


def test_upsert(spark):
    schema = "site_id long, url string, clicks long, impressions long, import_id int"
    old = spark.createDataFrame([(1, "/a", 1, 2, 1), (1, "/b", 1, 2, 1), (1, "/c", 1, 2, 1)], schema)
    new = spark.createDataFrame([(1, "/a", 3, 10, 2), (1, "/b", 1, 2, 2), (1, "/d", 0, 0, 2)], schema)
    key, values = ["site_id", "url"], ["clicks", "impressions"]
    out = metrics.upserted(old, new, key, values, ("import_id",))
    assert {r.url: (r.action, r.import_id) for r in out.collect()} == {"/a": ("updated", 2), "/b": ("unchanged", 2), "/c": ("kept", 1), "/d": ("added", 2)}
    assert {r.url: r.import_id for r in metrics.upserted(old, new, key, values, ("import_id",), touch_unchanged=False).collect()}["/b"] == 1
    assert metrics.outcome(out).first().asDict() == {"row_count": 3, "added": 1, "updated": 1, "unchanged": 1}
    rates = new.select(metrics.ctr_text(F.col("clicks"), F.col("impressions"))).collect()
    assert [r[0] for r in rates] == ["30.00 %", "50.00 %", "0.00 %"]
    with pytest.raises(Exception, match="twice"):
        metrics.unique_batch(new.unionByName(new), key).collect()


def test_provider_rows(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "metric_date string, url string, clicks string, impressions string, position string").withColumn("metric_date", F.to_date("metric_date"))
    row = metrics.provider_rows(rows(("2026-01-01", "https://www.example.com/a", "1.0", "2", "0")), "https://example.com").first()
    assert (row.normalized_url, row.clicks, row.impressions, row.position_text) == ("https://www.example.com/a", 1, 2, "0")
    for bad in (("2026-01-01", "https://other.com/", "1", "2", None), ("2026-01-01", "https://example.com/", "1.5", "2", None), ("2026-01-01", "https://example.com/", "3", "2", None)):
        with pytest.raises(Exception, match="host|whole|over"):
            metrics.provider_rows(rows(bad), "https://example.com").collect()


def test_schedule(spark):
    now = F.lit("2026-01-10 12:00:00").cast("timestamp")
    s = spark.createDataFrame([(1, True, "daily", 0, "09:00", datetime(2026, 1, 8, 9)), (2, True, "weekly", 0, "09:00", datetime(2026, 1, 11)), (3, False, "daily", 0, "09:00", datetime(2026, 1, 1))], "site_id long, enabled boolean, frequency string, local_weekday int, local_time string, next_run_at timestamp")
    row = schedule.missed(s, now, "UTC").collect()
    assert [(r.site_id, r.missed_periods, r.next_run_at) for r in row] == [(1, 3, datetime(2026, 1, 11, 9))]
    e = spark.createDataFrame([(1, 1, datetime(2026, 1, 8, 9), "pending")], "id long, site_id long, scheduled_for timestamp, status string")
    assert schedule.due(s, e.limit(0), now).count() == 1 and schedule.due(s, e, now).isEmpty()
    assert schedule.recovered(e).first().status == "interrupted" and schedule.journal_page(e, 99).count() == 1


GRAPH = "run_id long, page_id long, sequence_number int, url string, depth int, outcome string, http_status int, internal_links array<string>"


def site(spark, links, outcome=None, depth=None):
    rows = [(1, i, i, f"/{i}", (depth or {}).get(i, 0), (outcome or {}).get(i, "html"), 404 if (outcome or {}).get(i) == "http_error" else None, [f"/{j}" for j in to] if (outcome or {}).get(i, "html") == "html" else None) for i, to in links.items()]
    return spark.createDataFrame(rows, GRAPH)


def test_edges_and_states(spark):
    p = site(spark, {1: [2, 3, 9, 2], 2: [], 3: []}, {2: "http_error", 3: "forbidden"})
    e = graph.edges(p)
    assert [(r.position, r.target_id, r.state) for r in e.orderBy("position").collect()] == [(0, 2, "broken"), (1, 3, "forbidden"), (2, None, "unchecked")]
    d = {r.page_id: (r.outgoing, r.incoming, r.broken, r.unchecked) for r in graph.degrees(p, e).collect()}
    assert d == {1: (3, 0, 1, 1), 2: (0, 1, 0, 0), 3: (0, 1, 0, 0)}
    assert graph.among(e, p.where("page_id < 3")).count() == 1


def test_checks(spark):
    good = site(spark, {1: [2], 2: []})
    assert graph.checked(good) is good
    for bad in (good.withColumn("url", F.lit("/")), good.withColumn("depth", F.lit(-1)), good.withColumn("outcome", F.lit("odd")), good.withColumn("internal_links", F.lit(None).cast("array<string>"))):
        with pytest.raises(ValueError):
            graph.checked(bad)


def test_pagerank(spark):
    for links in ({1: [2], 2: [3], 3: [1]}, {1: [2, 3], 2: [], 3: [1], 4: [4, 1]}):
        p = site(spark, links)
        nodes, arcs = graph.html_graph(p, graph.edges(p))
        small = {r.page_id: r.pagerank for r in graph.pagerank(nodes, arcs).collect()}
        large = {r.page_id: r.pagerank for r in graph.large_pagerank(nodes, arcs, tolerance=1e-6, steps=4).collect()}
        assert abs(sum(small.values()) - 1) < 1e-9 and all(abs(small[i] - large[i]) < 1e-5 for i in small)
    assert small[1] == max(small.values())


def test_signals(spark):
    # 1 leads to 2, which alone leads to a loop of 3, 4 and 5; 6 is an island; 7 has no way on
    p = site(spark, {1: [2, 7], 2: [3], 3: [4], 4: [5], 5: [3], 6: [1], 7: []})
    found = {r.page_id: r for r in graph.signals(p, graph.edges(p)).collect()}
    assert {i: r.signals for i, r in found.items()} == {1: [], 2: ["bottleneck"], 3: ["dead_end", "cycle_trap", "bottleneck"], 4: ["dead_end", "cycle_trap"], 5: ["dead_end", "cycle_trap"], 6: ["island"], 7: ["dead_end"]}
    assert found[2].stranded == 3 and found[4].cycle == [3, 4, 5] and found[7].dead_end_is_page and not found[3].dead_end_is_page


def test_bottlenecks_by_removal():
    import random

    rnd = random.Random(5)
    for _ in range(60):
        n = rnd.randrange(2, 14)
        out = {i: sorted({rnd.randrange(n) for _ in range(rnd.randrange(4))}) for i in range(n)}
        whole = set(graph.reach(0, out))
        want = {v: len(whole - {v} - set(graph.reach(0, out, v))) for v in whole if v}
        got = graph.stranded(0, out)
        assert {v: got[v] for v in want} == want


def test_depth_and_low_connectivity():
    ids = list(range(1, 13))
    rows = pd.DataFrame({"run_id": 1, "page_id": ids, "sequence_number": ids, "depth": [0] * 11 + [7], "outcome": "html"})
    arcs = [(1, i) for i in ids[1:]]
    rank = {i: 0.1 for i in ids} | {5: 0.01}
    got = graph.analyzed(rows, arcs, rank).set_index("page_id").signals
    assert "anomalous_depth" in got[12] and "low_connectivity" not in got[12] and "low_connectivity" not in got[6]


def test_reachable_and_crawl(spark):
    p = site(spark, {1: [2], 2: [3], 3: [1], 4: [1]})
    _, arcs = graph.html_graph(p, graph.edges(p))
    assert {r.page_id: r.steps for r in graph.reachable(graph.starts(p), arcs).collect()} == {1: 0, 2: 1, 3: 2}
    links = spark.createDataFrame([(1, "/", 0, "/b"), (1, "/", 1, "/a"), (1, "/b", 0, "/c"), (1, "/a", 0, "/d"), (1, "/c", 0, "/")], "run_id long, url string, position int, link string")
    start = spark.createDataFrame([(1, "/")], "run_id long, url string")
    assert {r.url: (r.ord, r.depth) for r in graph.crawl_order(start, links, 4, 10).collect()} == {"/": (1, 0), "/b": (2, 1), "/a": (3, 1), "/c": (4, 2)}
    assert graph.crawl_order(start, links, 10, 1).count() == 3


def test_tree(spark):
    p = site(spark, {1: [2], 2: [3, 1], 3: [], 4: [5], 5: [4], 6: []})
    rows = {r.page_id: (r.parent_id, r.root_id, r.level) for r in graph.tree(p, graph.edges(p)).collect()}
    assert rows == {1: (None, 1, 0), 2: (1, 1, 1), 3: (2, 1, 2), 4: (None, 4, 0), 5: (4, 4, 1), 6: (None, 6, 0)}


def test_layout(spark):
    rows = {r.page_id: (r.x, r.y) for r in graph.layout(site(spark, {i: [] for i in range(1, 5)})).collect()}
    assert rows == {1: (450.0, 45.0), 2: (735.0, 330.0), 3: (450.0, 615.0), 4: (165.0, 330.0)}


def test_availability(spark):
    rows = spark.createDataFrame([("robots_redirect", None), ("completed", "html"), ("completed", "http_error"), ("completed", "timeout")], "s string, o string")
    assert [r[0] for r in rows.select(runs.availability(F.col("s"), F.col("o"))).collect()] == ["redirect", "available", "deferred", "network_error"]


def test_stream(spark, tmp_path):
    from pagetide.streaming import diff_stream

    all_runs, snap = two_runs(spark), pages(spark, page(1, 1, "/old"), page(2, 2, "/new"))
    runs_path, pages_path, events, landed = (str(tmp_path / n) for n in ("runs", "pages", "events", "landed"))
    all_runs.write.parquet(runs_path)
    snap.write.parquet(pages_path)
    all_runs.write.parquet(landed)
    for k in range(2):  # the second stream sees the same runs again
        q = diff_stream.start(spark.readStream.schema(all_runs.schema).parquet(landed), runs_path, pages_path, events, str(tmp_path / f"c{k}"), str(tmp_path / "prices"))
        q.awaitTermination(60)
        assert q.exception() is None
    assert kinds(spark.read.parquet(events)) == ["page_added", "page_removed"] and spark.read.parquet(str(tmp_path / "prices")).isEmpty()


def test_stream_appends_prices_once(spark, tmp_path):
    from pagetide.streaming import diff_stream

    snap = pages(spark, page(1, 1), page(2, 2, prices=({**PRICE, "amount": "12"},)), page(3, 3, text="other", prices=({**PRICE, "amount": "12"},)))
    runs_ = spark.createDataFrame([(1, 9, datetime(2026, 1, 1), "completed"), (2, 9, datetime(2026, 1, 2), "completed"), (3, 9, datetime(2026, 1, 3), "completed"), (4, 8, datetime(2026, 1, 3), "completed")], "run_id long, site_id long, completed_at timestamp, status string")
    for batch in ("run_id = 2", "run_id IN (2, 4)", "run_id = 3"):
        diff_stream.process_batch(runs_.where(batch), runs_, snap, str(tmp_path / "e"), str(tmp_path / "p"))
    assert [(r.current_run_id, str(r.current_low)[:2]) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(2, "12")]
    assert kinds(spark.read.parquet(str(tmp_path / "e"))) == ["text_changed"]


def chain(rnd, n):
    """Runs of a few sites with some pages each, several of them at the same moment."""
    runs_ = [(i, i % 3, datetime(2026, 1, 1 + rnd.randrange(6)), rnd.choice(["completed"] * 4 + ["partial"])) for i in range(n)]
    return runs_, [page(100 * i + k, i, f"/{k}", text=rnd.choice("ab")) for i in range(n) for k in rnd.sample(range(6), rnd.randrange(5))]


def test_matched_against_joins(spark):
    """All pairs, and any choice of them, against a plain join of both sides."""
    import random

    rnd = random.Random(3)
    runs_, rows = chain(rnd, 40)
    pairs = runs.predecessors(spark.createDataFrame(runs_, "run_id long, site_id long, completed_at timestamp, status string")).cache()
    snap = pages(spark, *rows).cache()
    by = {}
    for r in rows:
        by.setdefault(r[1], {})[r[2]] = r[0]
    for chosen in (pairs, pairs.where("current_run_id % 2 = 0"), pairs.where("current_run_id % 5 = 1"), pairs.limit(0)):
        want = set()
        for p in chosen.where("previous_run_id IS NOT NULL").collect():
            now, then = by.get(p.current_run_id, {}), by.get(p.previous_run_id, {})
            want |= {(p.current_run_id, p.previous_run_id, p.current_completed_at, u, now.get(u), then.get(u)) for u in {*now, *then}}
        out = diff.matched(chosen, snap).select("current_run_id", "previous_run_id", "current_completed_at", "url", "cur.page_id", F.col("prev.page_id").alias("old"))
        got = [tuple(r) for r in out.collect()]
        assert set(got) == want and len(got) == len(want)
        for added, side_ in ((True, 4), (False, 5)):
            ones = {(r.current_run_id, r.previous_run_id, r.url, r.page_id) for r in diff.one_sided(chosen, snap, added).collect()}
            assert ones == {(*x[:2], x[3], x[side_]) for x in want if x[9 - side_] is None}


def test_filters_reach_the_pairs(spark):
    """A filtered feed is the whole feed filtered, and compares only the runs it shows; other kinds of change aren't computed."""
    import random

    rnd = random.Random(5)
    runs_, rows = chain(rnd, 30)
    table = spark.createDataFrame(runs_, "run_id long, site_id long, completed_at timestamp, status string")
    sites = spark.createDataFrame([(i, f"s{i}", "u", "owned" if i else "competitor") for i in range(3)], "site_id long, name string, url string, site_type string")
    snap = pages(spark, *rows)
    with_ids = lambda e: e.withColumn("event_id", F.xxhash64("current_run_id", "event_type", "url"))
    args = (runs.predecessors(table), snap, table, sites, with_ids)
    day = lambda n: datetime(2026, 1, n, tzinfo=UTC)
    for conditions in ({}, {"site_type": "owned", "event_types": ["text_changed"]}, {"site_id": 1, "from_time": day(2)}, {"before_time": day(4), "importance": ["high"], "event_types": ["page_removed", "price_changed"]}):
        want = feed.filtered(feed.feed(with_ids(diff.all_events(diff.matched(args[0], snap))), table, sites), **conditions)
        assert sorted(map(str, feed.changes(*args, **conditions).collect())) == sorted(map(str, want.collect()))
    plan = feed.changes(*args, event_types=["text_changed"], from_time=day(2))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and "page_added" not in plan and plan.rindex("2026-01-02 00:00:00") > plan.index("lag(version")
    sided = feed.changes(*args, sides=True)
    stored = feed.with_sides(sided.drop("cur", "prev"), snap)
    assert sorted(map(str, feed.with_sides(sided).select(*stored.columns).collect())) == sorted(map(str, stored.collect()))


def test_exports_deal_a_page_out_once(spark, sf):
    """Lines go to their run, pages to their url; events, which hold two versions each, stay where they are made."""
    from pagetide.plans import registry

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("export_json_rows", "export_csv_rows"):
            plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet [l_orderkey") == 1
            assert "Exchange" not in plan[: plan.index("lag(version")]
            dealt = [line for line in plan[: plan.index("FileScan parquet [l_orderkey")].splitlines() if "Exchange hashpartitioning" in line]
            assert len(dealt) == 2 and "url" in dealt[0] and "l_orderkey" in dealt[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sites_that_are_there_twice(spark):
    """A site's events come once for each of its rows, as a join with them gives them, and not at all without one."""
    import random

    runs_, rows = chain(random.Random(7), 20)
    table = spark.createDataFrame(runs_, "run_id long, site_id long, completed_at timestamp, status string")
    sites = spark.createDataFrame([(1, "a", "u", "owned"), (1, "b", "v", "competitor"), (2, "c", "w", None)], "site_id long, name string, url string, site_type string")
    snap, with_ids = pages(spark, *rows), lambda e: e.withColumn("event_id", F.xxhash64("current_run_id", "event_type", "url"))
    pairs = runs.predecessors(table)
    want = feed.feed(with_ids(diff.all_events(diff.matched(pairs, snap))), table, sites)
    got = feed.changes(pairs, snap, table, sites, with_ids)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_no_row_of_a_pair_is_left_behind(spark):
    pairs = spark.range(-3000, 3000).selectExpr("id * 7 AS current_run_id", "CASE WHEN id % 2 = 0 THEN id * 7 + 1 END AS previous_run_id")
    paired = {r for x in range(-3000, 3000, 2) for r in (x * 7, x * 7 + 1)}
    rows = spark.range(-25000, 25000).selectExpr("CAST(id AS INT) AS run").union(spark.sql("SELECT CAST(NULL AS INT)"))
    kept = [r.run for r in diff.perhaps_paired(rows, "run", pairs).collect()]
    assert paired <= set(kept) and len(kept) == len(set(kept)) < len(paired) + 50
    assert diff.perhaps_paired(rows, "run", pairs.limit(0)).isEmpty()


def test_graphs_that_no_task_may_hold(spark, monkeypatch):
    rows = spark.createDataFrame([(1, k, k, 0) for k in range(1, 6)], "run_id long, page_id long, sequence_number int, depth int")
    arcs = spark.createDataFrame([(1, 1, 2)], "run_id long, source_id long, target_id long")
    assert graph.pagerank(rows, arcs).count() == 5
    held = {r.page_id: r.pagerank for r in graph.pagerank(rows, arcs).collect()}
    monkeypatch.setattr(graph, "HELD_PAGES", 4)
    joined = {r.page_id: r.pagerank for r in graph.pagerank(rows, arcs).collect()}
    assert len(joined) == 5 and all(abs(joined[k] - held[k]) < 1e-9 for k in held)


def test_limits_of_a_crawl(spark):
    links = spark.createDataFrame([(1, "a", 0, "b"), (1, "a", 1, "c"), (1, "b", 0, "d"), (1, "c", 0, "x"), (2, "a", 0, "a")], "run_id long, url string, position int, link string")
    start = spark.createDataFrame([(1, "a"), (2, "a")], "run_id long, url string")
    closed = spark.createDataFrame([(1, "c")], "run_id long, url string")
    told = lambda *args: {(r.run_id, r.url): (r.depth, r.ord, r.forbidden, r.limited) for r in graph.crawl_order(start, links, *args).collect()}
    assert told(10, 5) == {(1, "a"): (0, 1, False, False), (1, "b"): (1, 2, False, False), (1, "c"): (1, 3, False, False), (1, "d"): (2, 4, False, False), (1, "x"): (2, 5, False, False), (2, "a"): (0, 1, False, False)}
    assert {k[1]: v[2:] for k, v in told(10, 1).items() if k[0] == 1} == {"a": (False, True), "b": (False, True), "c": (False, True)}
    assert sorted(k[1] for k in told(2, 5) if k[0] == 1) == ["a", "b"] and told(2, 5)[1, "a"][3] and not told(2, 5)[2, "a"][3]
    shut = told(10, 5, closed)
    assert shut[1, "c"] == (1, 3, True, False) and (1, "x") not in shut


def test_payloads_are_bounded(spark):
    from pagetide.sources import payloads

    landed = spark.createDataFrame([("{" + " " * (2 * 1024 * 1024) + "}",)], "payload string")
    for read in (payloads.row_payload, payloads.nested_statistics):
        with pytest.raises(Exception, match="2 MiB"):
            read(landed).collect()
