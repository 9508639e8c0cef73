"""Queries of lists, views, graphs, schedules, sites and syncs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.functions import calendar
from pagetide.operators import connections, diff, feed, graph, paging, schedule, sites, sync
from pagetide.operators import runs as run_ops
from pagetide.plans import bindings as b
from pagetide.plans.registry import query
from pagetide.plans.storage import shared_dir

def eid():
    return F.col("event_id")


def moment(n, minutes=1):
    """So many minutes after the start of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + n * 60 * minutes)


def sql_moment(n: str, minutes: int = 1) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({minutes} * ({n}) AS BIGINT)))"


def events(spark, sf_dir):
    return b.table(spark, sf_dir, "events")


# Lists by page -----------------------------------------------------------------------------------------------------------


@query(f"WITH {b.SITES}, s AS (SELECT site_id, name, {sql_moment('site_id % 10')} AS created_at FROM sites) SELECT * FROM s ORDER BY created_at DESC, site_id DESC LIMIT 20 OFFSET 20", ("created_at",))
def list_sites(spark, sf_dir):
    rows = b.sites(spark, sf_dir).select("site_id", "name", moment(F.col("site_id") % 10).alias("created_at"))
    return paging.page(rows, "sites", 2)[0]


@query(f"WITH {b.SITES}, s AS (SELECT site_id, {sql_moment('site_id % 10')} AS created_at FROM sites WHERE site_type = 'owned') SELECT * FROM s", ("created_at",))
def sites_of_type(spark, sf_dir):
    rows = b.sites(spark, sf_dir).withColumn("created_at", moment(F.col("site_id") % 10))
    return sites.listed(rows, "owned").select("site_id", "created_at")


CHECKS = f"checks AS (SELECT event_id AS id, user_id AS site_id, {sql_moment('event_id % 100')} AS started_at FROM events)"


@query(f"WITH {CHECKS} SELECT * FROM checks ORDER BY started_at DESC, id DESC LIMIT 20 OFFSET 40", ("started_at",))
def list_checks(spark, sf_dir):
    return paging.page(events(spark, sf_dir).select(eid().alias("id"), F.col("user_id").alias("site_id"), moment(eid() % 100).alias("started_at")), "checks", 3)[0]


@query(f"WITH i AS (SELECT event_id AS id, {sql_moment('event_id % 100')} AS imported_at, event_id % 50 AS row_count FROM events) SELECT * FROM i ORDER BY imported_at DESC, id DESC LIMIT 20", ("imported_at",))
def list_imports(spark, sf_dir):
    return paging.rows_of(events(spark, sf_dir).select(eid().alias("id"), moment(eid() % 100).alias("imported_at"), (eid() % 50).alias("row_count")), "imports", 1)


@query("SELECT event_id AS id, 'https://example.com/' || (event_id % 30) AS normalized_url FROM events ORDER BY normalized_url, id LIMIT 20 OFFSET 60")
def list_period_metrics(spark, sf_dir):
    return paging.page(events(spark, sf_dir).select(eid().alias("id"), F.concat(F.lit("https://example.com/"), (eid() % 30).cast("string")).alias("normalized_url")), "period_metrics", 4)[0]


@query(f"WITH {b.METRICS} SELECT metric_date, 'https://example.com/u/' || site_id AS normalized_url, clicks FROM metrics ORDER BY metric_date DESC, normalized_url LIMIT 50 OFFSET 50", ("metric_date",))
def list_daily_metrics(spark, sf_dir):
    m = b.daily_metrics(spark, sf_dir).select("metric_date", F.concat(F.lit("https://example.com/u/"), F.col("site_id").cast("string")).alias("normalized_url"), "clicks")
    return paging.page(m, "daily_metrics", 2)[0]


@query(f"WITH {b.ENTRIES}, n AS (SELECT count(*) AS n FROM entries) SELECT id, site_id, status FROM entries ORDER BY scheduled_for DESC, id DESC LIMIT 20 OFFSET (SELECT CAST(20 * (greatest(1, ceil(n / 20.0)) - 1) AS BIGINT) FROM n)")
def list_journal(spark, sf_dir):
    """A page past the end is the last one."""
    return schedule.journal_page(b.entries(spark, sf_dir), 10**6).select("id", "site_id", "status")


@query(f"{b.GRAPH} SELECT page_id, sequence_number FROM gpages WHERE run_id = 1 ORDER BY sequence_number LIMIT 20 OFFSET 20")
def list_structure(spark, sf_dir):
    return paging.page(b.graph_pages(spark, sf_dir).where("run_id = 1").select("page_id", "sequence_number"), "structure", 2)[0]


# Events and their views --------------------------------------------------------------------------------------------------

VIEWS = "views AS (SELECT 'snapshot' AS source, (l_orderkey * 10 + l_suppkey % 10) * 10 + 5 AS event_id, max(l_shipdate) AS viewed_at FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2)"


def views(spark, sf_dir):
    """Changes of texts that have been viewed: those of pages with a large line."""
    lines = b.table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return lines.groupBy(F.lit("snapshot").alias("source"), ((F.col("l_orderkey") * 10 + F.col("l_suppkey") % 10) * 10 + 5).alias("event_id")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("viewed_at"))


def viewed_feed(spark, sf_dir, **conditions):
    runs = b.runs(spark, sf_dir)
    return feed.changes(run_ops.predecessors(runs), b.pages(spark, sf_dir), runs, b.sites(spark, sf_dir), b.event_ids, views(spark, sf_dir), **conditions)


@query(f"{b.FEED}, {VIEWS} SELECT f.event_id, f.event_type, f.url, v.viewed_at FROM feed f LEFT JOIN views v ON v.source = f.source AND v.event_id = f.event_id WHERE event_type IN ('text_changed', 'h1_changed')", ("viewed_at",))
def feed_views(spark, sf_dir):
    return viewed_feed(spark, sf_dir, event_types=["text_changed", "h1_changed"]).select("event_id", "event_type", "url", "viewed_at")


@query(f"{b.FEED}, {VIEWS} SELECT f.event_id, f.site_id, f.url FROM feed f JOIN views v ON v.source = f.source AND v.event_id = f.event_id WHERE event_type = 'text_changed' AND site_type = 'competitor'")
def feed_viewed(spark, sf_dir):
    return viewed_feed(spark, sf_dir, event_types=["text_changed"], site_type="competitor", viewed=True).select("event_id", "site_id", "url")


@query(f"{b.FEED} SELECT event_id, event_type, url FROM feed WHERE event_type IN ('title_changed', 'page_added') AND current_completed_at >= TIMESTAMP '1995-03-04 21:00:00' AND current_completed_at < TIMESTAMP '1996-05-06 21:00:00'")
def feed_local_days(spark, sf_dir):
    """Local days of a zone three hours ahead, both ends included."""
    runs = b.runs(spark, sf_dir)
    rows = feed.changes(run_ops.predecessors(runs), b.pages(spark, sf_dir), runs, b.sites(spark, sf_dir), b.event_ids, event_types=["title_changed", "page_added"])
    return feed.local_days(rows, "1995-03-05", "1996-05-06", "Etc/GMT-3").select("event_id", "event_type", "url")


@query(f"WITH {VIEWS}, least AS (SELECT min(event_id) AS m FROM views) SELECT source, event_id, viewed_at FROM views, least WHERE event_id <> m UNION ALL SELECT 'price', 7, TIMESTAMP '2024-01-01 00:00:00'", ("viewed_at",))
def views_toggled(spark, sf_dir):
    """One more event is viewed; one that is viewed already keeps its time; another's view is cleared."""
    old = views(spark, sf_dir)
    first, other = (r[0] for r in old.groupBy().agg(F.min("event_id")).collect()), old.groupBy().agg(F.max("event_id")).first()[0]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    more = feed.set_viewed(feed.set_viewed(old, "price", 7, at), "snapshot", other, at)
    return feed.clear_viewed(more, "snapshot", next(first))


@query(f"{b.DIFF} SELECT current_run_id, previous_run_id, url FROM twins WHERE c_price <> p_price AND current_run_id % 2 = 1")
def price_events_append(spark, sf_dir):
    """What an append adds when the price events of even runs are stored already."""
    rows = diff.price_events(diff.matched(run_ops.predecessors(b.runs(spark, sf_dir)), b.pages(spark, sf_dir), ["page_id", "prices"]))
    return diff.new_events(rows, rows.where("current_run_id % 2 = 0"), diff.PRICE_KEY).select("current_run_id", "previous_run_id", "url")


@query(f"{b.DIFF}, {b.EVENTS} SELECT event_type, count(*) AS events FROM events GROUP BY 1 UNION ALL SELECT 'price_changed', count(*) FROM twins WHERE c_price <> p_price")
def processed_counts(spark, sf_dir):
    """Both kinds of events of all completed runs, as they are processed."""
    snapshot, prices = diff.process(b.runs(spark, sf_dir), b.pages(spark, sf_dir))
    return snapshot.select("event_type").unionByName(prices.select(F.lit("price_changed").alias("event_type"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query(f"{b.DIFF}, {b.EVENTS} SELECT count(*) FILTER (event_type = 'h1_changed') AS wrong FROM events")
def export_checks(spark, sf_dir):
    """Events that their pages contradict: those that say the heading appeared with the page."""
    rows = diff.all_events(diff.matched(run_ops.predecessors(b.runs(spark, sf_dir)), b.pages(spark, sf_dir)), ["h1_changed", "text_changed"], sides=True)
    claimed = rows.withColumn("event_type", F.when(F.col("event_type") == "h1_changed", "page_added").otherwise(F.col("event_type")))
    return feed.inconsistent(claimed).agg(F.count(F.lit(1)).alias("wrong"))


# Runs and sites ----------------------------------------------------------------------------------------------------------


@query(f"{b.GRAPH} SELECT page_id, sequence_number, outcome FROM gpages WHERE run_id = 1 AND outcome IN ('redirect', 'http_error', 'timeout')")
def run_error_pages(spark, sf_dir):
    return run_ops.error_pages(b.graph_pages(spark, sf_dir), 1).select("page_id", "sequence_number", "outcome")


@query(f"{b.GRAPH} SELECT page_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY url) AS INT) AS sequence_number FROM gpages")
def page_sequence(spark, sf_dir):
    return run_ops.with_sequence(b.graph_pages(spark, sf_dir).drop("sequence_number"), "url").select("page_id", "sequence_number")


@query(f"WITH {b.SITES}, {b.RUNS} SELECT run_id FROM runs WHERE site_id % 10 <> 3")
def sites_cascade(spark, sf_dir):
    gone = b.sites(spark, sf_dir).where("site_id % 10 = 3").select("site_id")
    return run_ops.without_sites(b.runs(spark, sf_dir), gone).select("run_id")


@query(f"WITH {b.SITES} SELECT site_id, CASE WHEN site_type = 'owned' AND site_id % 3 = 0 AND site_id NOT IN (SELECT user_id FROM events) THEN 'competitor' ELSE site_type END AS site_type FROM sites")
def sites_transferred(spark, sf_dir):
    """Owned sites become competitors, unless they have imports."""
    rows = b.sites(spark, sf_dir)
    imports = events(spark, sf_dir).select(F.col("user_id").alias("site_id"))
    return sites.transferred(rows, rows.where("site_id % 3 = 0"), "owned", "competitor", imports).select("site_id", "site_type")


@query(f"WITH {b.SITES} SELECT site_id, CASE WHEN site_id % 3 = 0 THEN 'competitor' ELSE site_type END AS site_type FROM sites")
def sites_backfilled(spark, sf_dir):
    rows = b.sites(spark, sf_dir)
    return sites.backfilled(rows.withColumn("site_type", F.when(F.col("site_id") % 3 > 0, F.col("site_type")))).select("site_id", "site_type")


def committed(spark, sf_dir):
    """A store to which the crawls of even runs were committed, then those of all runs, whose titles had changed by then, twice. Every tenth page couldn't be read."""
    runs, rows = b.runs(spark, sf_dir), b.pages(spark, sf_dir)
    slug = F.col("page_id") % 10
    pages = rows.select("run_id", "page_id", (slug + 1).alias("sequence_number"), "url", F.when(slug == 9, "http_error").otherwise("html").alias("outcome"))
    snapshots = rows.where(slug != 9).select("run_id", "page_id", "title", "prices")
    prices = snapshots.select("run_id", "page_id", F.posexplode("prices").alias("place", "p")).select("run_id", "page_id", (F.col("place") + 1).alias("sequence_number"), F.col("p.amount").alias("amount"))
    store = run_ops.crawl_store(spark, shared_dir(spark))
    run_ops.commit_crawls(store, "even", runs.where("run_id % 2 = 0"), pages, snapshots.drop("prices"), prices)
    for _ in range(2):
        run_ops.commit_crawls(store, "all", runs, pages, snapshots.drop("prices").withColumn("title", F.lit("later")), prices)
    return store


KEPT = f"{b.RUNS}, {b.PAGES}, kept AS (SELECT pages.*, runs.status FROM pages JOIN runs USING (run_id) WHERE status IN ('completed', 'partial'))"


@query(f"WITH {KEPT} SELECT page_id, run_id, CASE WHEN run_id % 2 = 0 THEN title ELSE 'later' END AS title FROM kept WHERE page_id % 10 < 9")
def snapshots_stored(spark, sf_dir):
    """What is stored stays, whatever a later commit says of it."""
    return committed(spark, sf_dir).view().table("snapshots").select("page_id", "run_id", "title")


@query(f"""WITH {KEPT} SELECT runs.run_id, runs.status, count(page_id) AS pages, count(page_id) FILTER (page_id % 10 < 9) AS snapshots, sum(price) FILTER (page_id % 10 < 9) AS prices
FROM runs LEFT JOIN kept USING (run_id) GROUP BY ALL""")
def crawls_committed(spark, sf_dir):
    """Runs, pages, snapshots and prices as of one commit: runs that failed have left nothing but themselves."""
    view = committed(spark, sf_dir).view()
    count = lambda name: view.table(name).groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    total = view.table("prices").groupBy("run_id").agg(F.sum(F.col("amount").cast("decimal(18, 2)")).alias("prices"))
    joined = view.table("runs").join(count("pages"), "run_id", "left").join(count("snapshots"), "run_id", "left").join(total, "run_id", "left")
    return joined.select("run_id", "status", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pages", "snapshots")), "prices")


SITE_CASES = [("n", "https://example.com"), (" ", ""), ("n", " http://example.com:8080/x "), ("n", "https://exa mple.com"), ("n", "https://example.com:x/"), ("n", "example.com"), ("n", "ftp://example.com"), ("", "https://u:p@example.com/"), ("n", "https://example.com:99999"), ("n", "https:///x"), ("n", "http://[::1]:80/")]
SITE_WANT = ["", "no name|no url", "", "space in url", "bad port", "no full url", "no full url", "no name|credentials", "bad port", "no full url", ""]


@query(f"SELECT event_id, list_extract({SITE_WANT}, CAST(event_id % 11 + 1 AS INT)) AS errors FROM events")
def site_checks(spark, sf_dir):
    name, url = (F.get(F.array(*map(F.lit, c)), (eid() % 11).cast("int")) for c in zip(*SITE_CASES, strict=True))
    return events(spark, sf_dir).select("event_id", F.array_join(sites.site_errors(name, url), "|").alias("errors"))


@query(f"WITH {b.SITES}, m AS (SELECT max(site_id) AS last FROM sites) SELECT site_id, CASE WHEN site_id % 4 = 0 THEN 'new ' || site_id ELSE name END AS name, url, site_type FROM sites UNION ALL SELECT last + 1, 'a', 'https://a.example.com', 'owned' FROM m UNION ALL SELECT last + 2, 'b', 'https://b.example.com', 'competitor' FROM m")
def sites_edited(spark, sf_dir):
    """Two sites are added, and every fourth is renamed."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = b.sites(spark, sf_dir).withColumn("created_at", now)
    new = spark.range(2).select(F.when(F.col("id") == 0, " a ").otherwise("b").alias("name"), F.when(F.col("id") == 0, " https://a.example.com").otherwise("https://b.example.com").alias("url"), F.when(F.col("id") == 0, "owned").otherwise("competitor").alias("site_type"))
    names = rows.where("site_id % 4 = 0").select("site_id", F.concat(F.lit(" new "), F.col("site_id").cast("string")).alias("name"), "url")
    return sites.added(sites.updated(rows, names), new, now).drop("created_at")


@query(f"SELECT event_id AS check_id, CASE WHEN event_id % 3 = 0 THEN {sql_moment('event_id + 5')} END AS completed_at, CASE WHEN event_id % 3 = 0 THEN 'available' ELSE 'running' END AS status FROM events", ("completed_at",))
def checks_completed(spark, sf_dir):
    open_ = sites.started_checks(events(spark, sf_dir).withColumnRenamed("event_id", "site_id"), moment(F.col("site_id"))).withColumn("check_id", F.col("site_id"))
    results = events(spark, sf_dir).where("event_id % 3 = 0").select(eid().alias("check_id"), moment(eid() + 5).alias("finished_at"), F.lit("available").alias("result"))
    return sites.completed_checks(open_, results).select("check_id", "completed_at", "status")


@query("SELECT user_id AS site_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS place FROM events QUALIFY place <= 10")
def recent_runs(spark, sf_dir):
    return run_ops.recent(events(spark, sf_dir).select(F.col("user_id").alias("site_id"), "event_id", "ts"), "site_id", ["ts", "event_id"]).select("site_id", "event_id", "place")


# Schedules ---------------------------------------------------------------------------------------------------------------

NOW = "2024-01-03 12:00:00"


def rules(spark, sf_dir):
    site = F.col("c_custkey")
    return b.table(spark, sf_dir, "customer").select(site.alias("site_id"), (site % 5 > 0).alias("enabled"), F.when(site % 2 == 0, "daily").otherwise("weekly").alias("frequency"), (site % 7).cast("int").alias("local_weekday"), F.lit("09:30").alias("local_time"), moment(site % 6000).alias("next_run_at"))


RULES = f"rules AS (SELECT c_custkey AS site_id, c_custkey % 5 > 0 AS enabled, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS frequency, {sql_moment('c_custkey % 6000')} AS next_run_at FROM customer)"


@query(f"WITH {RULES} SELECT site_id, next_run_at AS scheduled_for, 'pending' AS status FROM rules WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}' AND site_id % 3 > 0", ("scheduled_for",))
def schedule_due(spark, sf_dir):
    """Due sites without an entry for that moment yet."""
    table = rules(spark, sf_dir)
    entries = table.where("site_id % 3 = 0").select("site_id", F.col("next_run_at").alias("scheduled_for"))
    return schedule.due(table, entries, F.lit(NOW).cast("timestamp"))


@query(f"""WITH {RULES}, late AS (SELECT *, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(next_run_at)) / (86400 * CASE frequency WHEN 'weekly' THEN 7 ELSE 1 END)) + 1 AS INT) AS n FROM rules WHERE enabled AND next_run_at <= TIMESTAMP '{NOW}')
SELECT site_id, n AS missed_periods, next_run_at + to_days(CAST(n * CASE frequency WHEN 'weekly' THEN 7 ELSE 1 END AS INT)) AS next_run_at FROM late""", ("next_run_at",))
def schedule_missed(spark, sf_dir):
    return schedule.missed(rules(spark, sf_dir), F.lit(NOW).cast("timestamp"), "UTC").select("site_id", "missed_periods", "next_run_at")


@query(f"WITH {b.ENTRIES} SELECT site_id, id AS retry_of_id FROM entries WHERE status IN ('partial', 'failed')")
def schedule_retries(spark, sf_dir):
    return schedule.retries(b.entries(spark, sf_dir)).select("site_id", "retry_of_id")


@query(f"WITH {b.ENTRIES} SELECT id, CASE WHEN status = 'pending' THEN 'interrupted' ELSE status END AS status FROM entries")
def schedule_recovered(spark, sf_dir):
    return schedule.recovered(b.entries(spark, sf_dir)).select("id", "status")


@query(f"WITH {b.ENTRIES} SELECT id, CASE WHEN status = 'pending' AND site_id % 2 = 0 THEN 'cancelled' ELSE status END AS status, status = 'pending' AND site_id % 2 = 0 AS ended FROM entries")
def schedule_saved_entries(spark, sf_dir):
    """Sites' rules are saved, which cancels what hasn't begun."""
    rows = b.entries(spark, sf_dir).withColumn("completed_at", F.lit(None).cast("timestamp"))
    table = rules(spark, sf_dir)
    form = rows.where("site_id % 2 = 0").select("site_id").distinct().select("site_id", F.lit(True).alias("enabled"), F.lit("daily").alias("frequency"), F.lit(0).alias("local_weekday"), F.lit("09:30").alias("local_time"))
    after = schedule.saved(table, rows, form, F.lit(NOW).cast("timestamp"), "UTC")[1]
    return after.select("id", "status", F.col("completed_at").isNotNull().alias("ended"))


@query(f"WITH {RULES} SELECT site_id, CASE WHEN site_id % 4 = 0 THEN CASE WHEN site_id % 8 = 0 THEN TIMESTAMP '2024-01-04 09:30:00' END ELSE next_run_at END AS next_run_at FROM rules", ("next_run_at",))
def schedule_saved_rules(spark, sf_dir):
    table = rules(spark, sf_dir)
    site = F.col("site_id")
    form = table.where("site_id % 4 = 0").select("site_id", (site % 8 == 0).alias("enabled"), F.lit("daily").alias("frequency"), "local_weekday", "local_time")
    none = b.entries(spark, sf_dir).withColumn("completed_at", F.lit(None).cast("timestamp"))
    return schedule.saved(table, none, form, F.lit(NOW).cast("timestamp"), "UTC")[0].select("site_id", "next_run_at")


@query(f"WITH {RULES} SELECT site_id, next_run_at + CASE frequency WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END AS advanced, CAST(next_run_at AS DATE) - 32 AS begins, CAST(next_run_at AS DATE) - 2 AS ends FROM rules", ("advanced", "begins", "ends"))
def schedule_advanced(spark, sf_dir):
    """A schedule's next moment, and the window of dates that a sync of thirty days asks for."""
    at = F.col("next_run_at")
    begins, ends = calendar.sync_window(at, 30)
    return rules(spark, sf_dir).select("site_id", calendar.advanced(at, F.col("frequency"), "UTC").alias("advanced"), begins.alias("begins"), ends.alias("ends"))


# Syncs -------------------------------------------------------------------------------------------------------------------


def sync_runs(spark, sf_dir):
    status = F.when(eid() % 4 == 0, "pending").when(eid() % 4 == 1, "completed").when(eid() % 4 == 2, "partial").otherwise("failed")
    return events(spark, sf_dir).select(eid().alias("id"), F.col("user_id").alias("connection_id"), status.alias("status"), moment(eid() % 50).alias("created_at"), F.when(eid() % 4 > 0, moment(eid() % 70)).alias("completed_at"))


SYNCS = f"syncs AS (SELECT event_id AS id, user_id AS connection_id, list_extract(['pending', 'completed', 'partial', 'failed'], CAST(event_id % 4 + 1 AS INT)) AS status, {sql_moment('event_id % 50')} AS created_at, CASE WHEN event_id % 4 > 0 THEN {sql_moment('event_id % 70')} END AS completed_at FROM events)"


@query(f"WITH {SYNCS} SELECT id, connection_id FROM syncs WHERE status = 'pending' ORDER BY created_at, id LIMIT 1")
def sync_next(spark, sf_dir):
    return sync.next_run(sync_runs(spark, sf_dir)).select("id", "connection_id")


@query(f"WITH {SYNCS} SELECT connection_id, arg_max(id, (created_at, id)) AS last_id, arg_max(id, (completed_at, id)) FILTER (status IN ('completed', 'partial')) AS last_success_id FROM syncs GROUP BY 1")
def sync_overview(spark, sf_dir):
    return sync.overview(sync_runs(spark, sf_dir))


@query("SELECT user_id % 10 AS id, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS actual_start, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS actual_end FROM events GROUP BY 1 UNION ALL SELECT 999, NULL, NULL")
def sync_dates(spark, sf_dir):
    """The first and last date that each run brought; one brought nothing."""
    rows = events(spark, sf_dir).select((F.col("user_id") % 10).alias("run_id"), F.to_date("ts").alias("metric_date"))
    runs = rows.select(F.col("run_id").alias("id")).distinct().unionByName(spark.range(999, 1000).select("id"))
    return sync.finished(runs, rows).select("id", F.col("actual_start").cast("string").alias("actual_start"), F.col("actual_end").cast("string").alias("actual_end"))


@query("WITH c AS (SELECT c_custkey AS id FROM customer) SELECT id AS connection_id, id * 2 AS source_id FROM c WHERE id % 3 > 0 AND id % 4 > 0 AND id % 5 > 0 AND id % 7 > 0")
def sync_enqueued(spark, sf_dir):
    """Not connected, of another revision, without the active source, or with a run already: left out."""
    key = F.col("c_custkey")
    table = b.table(spark, sf_dir, "customer")
    connections = table.select(key.alias("connection_id"), F.when(key % 3 == 0, "disconnected").otherwise("connected").alias("status"), F.lit(2).alias("revision"))
    sources = table.select(key.alias("connection_id"), (key * 2).alias("source_id"), (key % 5 > 0).alias("active"))
    wanted = table.select(key.alias("connection_id"), (key * 2).alias("source_id"), F.when(key % 4 == 0, 1).when(key % 4 == 1, 2).alias("revision"))
    runs = table.select(key.alias("connection_id"), F.when(key % 7 == 0, "running").otherwise("failed").alias("status"))
    return sync.enqueued(runs, wanted.unionByName(wanted), connections, sources).select("connection_id", "source_id")


@query("SELECT c_custkey AS connection_id, CASE WHEN c_custkey % 6 IN (0, 2) THEN 'disconnected' ELSE 'connected' END AS status, CASE WHEN c_custkey % 6 IN (0, 2) THEN 3 ELSE 2 END AS revision FROM customer")
def sync_disconnected(spark, sf_dir):
    key = F.col("c_custkey")
    connections = b.table(spark, sf_dir, "customer").select(key.alias("connection_id"), F.lit("connected").alias("status"), F.lit(2).alias("revision"))
    gone = connections.where("connection_id % 2 = 0").select("connection_id", F.when(F.col("connection_id") % 6 == 0, 2).when(F.col("connection_id") % 6 == 4, 1).alias("revision"))
    return sync.disconnected(connections, gone)


def services(spark, sf_dir):
    """A connection for each customer, with as many sources, runs and revisions as its key says."""
    key = F.col("c_custkey")
    rows = b.table(spark, sf_dir, "customer").select(key.alias("connection_id"), key.alias("site_id"), F.lit("search").alias("provider"), F.when(key % 7 == 0, "disconnected").otherwise("connected").alias("status"), (key % 3).cast("int").alias("revision"), moment(F.lit(0)).alias("updated_at"))
    each = lambda n: rows.select("connection_id", F.explode(F.sequence(F.lit(0), n)).alias("v")).where("v > 0")
    versions = each(F.col("revision")).withColumn("last", F.col("connection_id") % 3)
    sources = versions.select((F.col("connection_id") * 10 + F.col("v")).alias("source_id"), "connection_id", F.lit("search").alias("provider"), "v", F.concat(F.lit("r"), F.col("v").cast("string")).alias("resource_id"), F.lit("R").alias("resource_label"), (F.col("v") == F.col("last")).alias("active")).withColumnRenamed("v", "version")
    runs = each((F.col("connection_id") % 4).cast("int")).select((F.col("connection_id") * 10 + F.col("v")).alias("id"), "connection_id", F.lit(None).cast("long").alias("source_id"), F.lit("manual").alias("trigger"), F.when(F.col("v") == 1, "pending").when(F.col("v") == 2, "running").otherwise("completed").alias("status"), moment(F.lit(0)).alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit("").alias("message"))
    schedules = rows.where("connection_id % 2 = 0").select("connection_id", F.lit(True).alias("enabled"), F.lit("daily").alias("frequency"), F.lit(1).alias("local_weekday"), F.lit("08:00").alias("local_time"), moment(F.lit(5)).alias("next_run_at"))
    return connections.Tables(rows, sources, runs, schedules)


SERVICES = """WITH conn AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS own, c_custkey % 7 > 0 AS open, CAST(c_custkey % 3 AS INT) AS revision FROM customer),
src AS (SELECT id AS connection_id, CAST(v AS INT) AS version, 'r' || v AS resource_id, v = revision AS active FROM conn, range(1, 3) t(v) WHERE v <= revision),
run AS (SELECT id * 10 + v AS id, id AS connection_id, CASE v WHEN 1 THEN 'pending' WHEN 2 THEN 'running' ELSE 'completed' END AS status FROM conn, range(1, 4) t(v) WHERE v <= id % 4),
choice AS (SELECT id, 'r' || id % 4 AS resource_id, CASE WHEN NOT own OR NOT open OR id % 11 = 0 THEN 'connection_changed' WHEN id % 13 = 0 AND revision > 0 THEN 'stale_resource' END AS reason, revision FROM conn),
made AS (SELECT id, resource_id, revision FROM choice WHERE reason IS NULL AND NOT (revision > 0 AND resource_id = 'r' || revision))"""


def taken(spark, sf_dir):
    """Each connection is to take another resource; some ask of an older revision, some of another source."""
    key, tables = F.col("connection_id"), services(spark, sf_dir)
    source = F.when((F.col("revision") > 0) & (key % 13 != 0), key * 10 + F.col("revision"))
    choices = tables.connections.select(key.alias("choice_id"), "connection_id", F.when(key % 11 == 0, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), source.alias("expected_source_id"), F.concat(F.lit("r"), (key % 4).cast("string")).alias("resource_id"), F.lit("R").alias("resource_label"), (key * 10 + 9).alias("source_id"), (key * 10 + 9).alias("run_id"))
    return connections.chosen(tables, b.sites(spark, sf_dir), choices, moment(F.lit(9)))


@query(f"""{SERVICES} SELECT connection_id, version, resource_id, active AND connection_id NOT IN (SELECT id FROM made) AS active FROM src
UNION ALL SELECT id, revision + 1, resource_id, true FROM made""")
def sources_chosen(spark, sf_dir):
    return taken(spark, sf_dir)[0].sources.select("connection_id", "version", "resource_id", "active")


@query(f"{SERVICES} SELECT id AS connection_id, reason FROM choice WHERE reason IS NOT NULL")
def sources_refused(spark, sf_dir):
    return taken(spark, sf_dir)[1].select("connection_id", "reason")


@query(f"""{SERVICES} SELECT connection_id, id, CASE WHEN status = 'pending' AND connection_id IN (SELECT id FROM made) THEN 'cancelled' ELSE status END AS status FROM run
UNION ALL SELECT id, id * 10 + 9, 'pending' FROM made""")
def sources_chosen_runs(spark, sf_dir):
    return taken(spark, sf_dir)[0].runs.select("connection_id", "id", "status")


@query(f"""{SERVICES}, gone AS (SELECT id FROM conn WHERE own AND id % 5 < 3) SELECT conn.id AS connection_id, CASE WHEN NOT open OR conn.id IN (FROM gone) THEN 'disconnected' ELSE 'connected' END AS status, CAST(revision + CAST(conn.id IN (FROM gone) AS INT) AS INT) AS revision,
CAST(count(run.id) FILTER (run.status = 'pending' AND conn.id IN (FROM gone)) AS BIGINT) AS cancelled, own AND conn.id NOT IN (FROM gone) AS enabled FROM conn LEFT JOIN run ON run.connection_id = conn.id GROUP BY ALL""")
def sources_disconnected(spark, sf_dir):
    """What closing connections does to their runs and schedules."""
    tables = services(spark, sf_dir)
    key = F.col("connection_id")
    gone = tables.connections.where(key % 5 < 4).select("site_id", "provider", F.when(key % 5 == 3, F.col("revision") + 1).when(key % 5 == 2, F.col("revision")).alias("revision"))
    out, _ = connections.disconnected(tables, b.sites(spark, sf_dir), gone, moment(F.lit(9)))
    stopped = out.runs.where("status = 'cancelled'").groupBy("connection_id").agg(F.count(F.lit(1)).alias("cancelled"))
    rows = out.connections.join(stopped, "connection_id", "left").join(out.schedules.select("connection_id", "enabled"), "connection_id", "left")
    return rows.select("connection_id", "status", "revision", F.coalesce("cancelled", F.lit(0)).alias("cancelled"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


@query("SELECT CAST(1 AS BIGINT) AS connection_id, CAST(v AS INT) AS version, 'r' || v AS resource, v = 3 AS active FROM range(1, 4) t(v)")
def source_versions(spark, sf_dir):
    """A connection takes one resource after another, the last one twice."""
    table = spark.createDataFrame([], "connection_id long, version int, resource string, active boolean")
    for name in ("r1", "r2", "r3", "r3"):
        table = run_ops.with_source(table, 1, name)
    return table


# Graphs ------------------------------------------------------------------------------------------------------------------


@query(f"{b.GRAPH} SELECT run_id, page_id, sequence_number, url, depth, outcome FROM gpages")
def graph_checked(spark, sf_dir):
    return graph.checked(b.graph_pages(spark, sf_dir)).select("run_id", "page_id", "sequence_number", "url", "depth", "outcome")


@query(f"""{b.GRAPH}, o AS (SELECT source_id AS page_id, count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'unchecked') AS unchecked FROM edges GROUP BY 1)
SELECT run_id, page_id FROM gpages LEFT JOIN o USING (page_id) WHERE outcome = 'html' AND depth = 3 AND contains(lower(url), '/p/1') AND coalesce(unchecked, 0) = 0""")
def graph_filtered(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    e = graph.edges(pages)
    found = graph.signals(pages, e).drop("cycle")
    return graph.filtered(pages, found, graph.degrees(pages, e), url="/P/1", depth=3, outcome="html", unchecked=False).select("run_id", "page_id")


@query(f"{b.GRAPH} SELECT run_id, source_id, target_id FROM edges WHERE source_id % 3 = 0 AND target_id % 3 = 0")
def graph_among(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.among(graph.edges(pages), pages.where("page_id % 3 = 0")).select("run_id", "source_id", "target_id")


CRAWL = f"""{b.GRAPH}, hops AS (SELECT run_id, 0 AS depth, url FROM gpages WHERE sequence_number = 1
UNION SELECT h.run_id, h.depth + 1, l.link FROM hops h JOIN gpages g ON g.run_id = h.run_id AND g.url = h.url JOIN glinks l ON l.source_id = g.page_id WHERE h.depth < 3 AND NOT (g.page_id % 17 = 4)),
crawled AS (SELECT run_id, url, min(depth) AS depth FROM hops GROUP BY 1, 2),
beyond AS (SELECT DISTINCT c.run_id FROM crawled c JOIN gpages g ON g.run_id = c.run_id AND g.url = c.url JOIN glinks l ON l.source_id = g.page_id WHERE g.page_id % 17 <> 4 AND NOT EXISTS (SELECT 1 FROM crawled x WHERE x.run_id = c.run_id AND x.url = l.link))"""


@query(f"{CRAWL} SELECT c.run_id, c.url, CAST(c.depth AS INT) AS depth, coalesce(g.page_id % 17 = 4, false) AS forbidden, c.run_id IN (SELECT run_id FROM beyond) AS limited FROM crawled c LEFT JOIN gpages g ON g.run_id = c.run_id AND g.url = c.url")
def crawl_bounded(spark, sf_dir):
    """A crawl three links deep from each run's first page, with some pages that robots.txt forbids."""
    pages = b.graph_pages(spark, sf_dir)
    links = pages.select("run_id", "url", F.posexplode("internal_links").alias("position", "link"))
    start = pages.where("sequence_number = 1").select("run_id", "url")
    return graph.crawl_order(start, links, 10_000, 3, pages.where("page_id % 17 = 4").select("run_id", "url")).drop("ord")
