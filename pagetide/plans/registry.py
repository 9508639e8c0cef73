"""Every registered query of the engine and its SQL oracle."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import calendar, ratio
from pagetide.functions.text import distance, normalize_main_text
from pagetide.operators import diff, feed, graph, metrics, neighbours, schedule
from pagetide.operators import runs as run_ops
from pagetide.plans import bindings as b
from pagetide.schemas import SNAPSHOT_EVENTS
from pagetide.sources.pages import extract_pages

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query under its function's name; its dates are returned as text, which all engines print alike."""

    def register(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in dates})) if dates else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return register


def matched(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return diff.matched(run_ops.predecessors(b.runs(spark, sf_dir)), b.pages(spark, sf_dir), columns)


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return diff.snapshot_events(matched(spark, sf_dir, ["page_id", *columns] if columns else None))


def whole_feed(spark: SparkSession, sf_dir: str, sides: bool = False, **conditions) -> DataFrame:
    """Every third event has been viewed a day after it was found."""
    runs, viewed = b.runs(spark, sf_dir), conditions.pop("viewed", None)
    pairs = run_ops.predecessors(runs)
    rows = feed.changes(pairs, b.pages(spark, sf_dir, pairs if sides else None), runs, b.sites(spark, sf_dir), b.event_ids, sides=sides, **conditions)
    return feed.filtered(rows.withColumn("viewed_at", F.when(F.col("event_id") % 3 == 0, F.col("current_completed_at") + F.expr("INTERVAL 1 DAY"))), viewed=viewed)


def where_type(kind: str) -> str:
    return f"{b.DIFF}, {b.EVENTS} SELECT current_run_id, previous_run_id, url, current_page_id, previous_page_id, {b.IMPORTANCE}, weight, text_distance, ratio_numerator, ratio_denominator FROM events WHERE event_type = '{kind}'"


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("event_type") == kind).drop("event_type", "current_completed_at")


def whole_pages(rows: DataFrame, kind: str) -> DataFrame:
    weight, none = (2, F.lit(None)) if kind == "page_added" else (3, F.lit(None))
    ids = {"current_page_id": F.col("page_id"), "previous_page_id": none.cast("long")}
    if kind == "page_removed":
        ids = {"current_page_id": none.cast("long"), "previous_page_id": F.col("page_id")}
    return rows.select("current_run_id", "previous_run_id", "url", *(c.alias(n) for n, c in ids.items()), ratio.importance(F.lit(weight)).alias("importance"), F.lit(weight).alias("weight"), none.cast("int").alias("text_distance"), none.cast("long").alias("ratio_numerator"), none.cast("long").alias("ratio_denominator"))


@query(f"WITH {b.RUNS}, {b.PAIRS} SELECT * FROM pairs")
def runs_predecessor(spark, sf_dir):
    return run_ops.predecessors(b.runs(spark, sf_dir))


@query(f"WITH {b.RUNS} SELECT site_id, run_id, completed_at, status FROM runs WHERE status IN ('completed', 'partial') QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, run_id DESC) = 1")
def runs_latest_eligible(spark, sf_dir):
    return run_ops.latest(b.runs(spark, sf_dir))


@query(f"{b.GRAPH} SELECT run_id, count(*) AS processed, count(*) FILTER (outcome IN ('html', 'non_html')) AS successful, count(*) FILTER (outcome = 'forbidden') AS forbidden, count(*) FILTER (outcome IN ('redirect', 'http_error', 'timeout')) AS errors FROM gpages GROUP BY 1")
def run_counters(spark, sf_dir):
    return run_ops.counters(b.graph_pages(spark, sf_dir))


@query(f"{b.GRAPH}, c AS (SELECT run_id, count(*) FILTER (outcome IN ('redirect', 'http_error', 'timeout')) AS e FROM gpages GROUP BY 1) SELECT run_id, CASE WHEN run_id % 7 = 3 THEN 'deferred' WHEN e > 0 THEN 'partial' ELSE 'completed' END AS status FROM c")
def run_status(spark, sf_dir):
    c = run_ops.counters(b.graph_pages(spark, sf_dir))
    return c.select("run_id", run_ops.stored_status(F.when(F.col("run_id") % 7 == 3, "robots_deferred").otherwise("completed"), F.col("errors")).alias("status"))


@query(f"{b.GRAPH} SELECT page_id, CASE outcome WHEN 'redirect' THEN 'redirect' WHEN 'http_error' THEN 'deferred' WHEN 'timeout' THEN 'network_error' ELSE 'available' END AS availability FROM gpages")
def availability_classes(spark, sf_dir):
    return b.graph_pages(spark, sf_dir).select("page_id", run_ops.availability(F.lit("completed"), F.col("outcome")).alias("availability"))


@query(f"WITH {b.RUNS}, {b.PAGES}, n AS (SELECT run_id, count(*) AS n FROM pages GROUP BY 1) SELECT site_id, count(*) AS runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages FROM runs LEFT JOIN n USING (run_id) GROUP BY 1")
def site_page_counts(spark, sf_dir):
    return run_ops.page_counts(b.pages(spark, sf_dir).select("run_id"), b.runs(spark, sf_dir))


@query(where_type("page_added"))
def pages_added(spark, sf_dir):
    return whole_pages(diff.one_sided(run_ops.predecessors(b.runs(spark, sf_dir)), b.pages(spark, sf_dir), True), "page_added")


@query(where_type("page_removed"))
def pages_removed(spark, sf_dir):
    return whole_pages(diff.one_sided(run_ops.predecessors(b.runs(spark, sf_dir)), b.pages(spark, sf_dir), False), "page_removed")


@query(f"{b.DIFF} SELECT current_run_id, previous_run_id, url, cp AS current_page_id, pp AS previous_page_id FROM twins")
def pages_matched(spark, sf_dir):
    rows = matched(spark, sf_dir, ["page_id"]).where("cur IS NOT NULL AND prev IS NOT NULL")
    return rows.select("current_run_id", "previous_run_id", "url", F.col("cur.page_id").alias("current_page_id"), F.col("prev.page_id").alias("previous_page_id"))


@query(f"{b.DIFF}, {b.EVENTS} SELECT current_run_id, url, event_type, {b.IMPORTANCE}, weight FROM events WHERE event_type IN ('title_changed', 'description_changed', 'h1_changed')")
def metadata_changes(spark, sf_dir):
    return events(spark, sf_dir, "title", "description", "h1").where(F.col("event_type").isin("title_changed", "description_changed", "h1_changed")).select("current_run_id", "url", "event_type", "importance", "weight")


@query(f"""{b.DIFF}, {b.EVENTS} SELECT current_run_id, url, array_to_string(list_sort(list_filter(cl, lambda x: NOT list_contains(pl, x))), ' ') AS added, array_to_string(list_sort(list_filter(pl, lambda x: NOT list_contains(cl, x))), ' ') AS removed,
CAST(n // gcd(n, d) AS BIGINT) AS ratio_numerator, CAST(d // gcd(n, d) AS BIGINT) AS ratio_denominator, {b.WEIGH.format(n="n", d="d")} AS weight FROM linkd WHERE n > 0""")
def link_set_changes(spark, sf_dir):
    rows = matched(spark, sf_dir, ["internal_links"]).where("cur IS NOT NULL AND prev IS NOT NULL")
    c = diff.with_link_change(rows, F.col("cur.internal_links"), F.col("prev.internal_links"), "c").where("c IS NOT NULL")
    return c.select("current_run_id", "url", F.array_join("c.added", " ").alias("added"), F.array_join("c.removed", " ").alias("removed"), F.col("c.num").alias("ratio_numerator"), F.col("c.den").alias("ratio_denominator"), ratio.weight(F.col("c.num"), F.col("c.den")).alias("weight"))


@query(f"{b.DIFF} SELECT current_run_id, previous_run_id, url, 'price' AS price_profile, 'USD' AS price_currency, CAST(p_price AS DOUBLE) AS previous_low, CAST(c_price AS DOUBLE) AS current_low FROM twins WHERE c_price <> p_price")
def price_changes(spark, sf_dir):
    p = diff.price_events(matched(spark, sf_dir, ["page_id", "prices"]))
    return p.select("current_run_id", "previous_run_id", "url", "price_profile", "price_currency", F.col("previous_low").cast("double"), F.col("current_low").cast("double"))


@query(where_type("text_changed"))
def text_changes_ascii(spark, sf_dir):
    return of_type(events(spark, sf_dir, "normalized_text"), "text_changed")


@query(f"{b.DIFF}, {b.EVENTS}, top AS (SELECT current_run_id, url, max(weight) AS weight, count(*) AS changes FROM events GROUP BY 1, 2) SELECT *, {b.IMPORTANCE} FROM top")
def page_importance(spark, sf_dir):
    return diff.page_importance(events(spark, sf_dir))


@query(f"{b.DIFF}, {b.EVENTS} SELECT *, {b.IMPORTANCE} FROM events")
def change_events_all(spark, sf_dir):
    return events(spark, sf_dir)


@query(f"{b.DIFF}, {b.EVENTS} SELECT current_run_id, event_type, url FROM events WHERE hash(url) IS NOT NULL AND current_run_id % 2 = 1")
def events_idempotent_append(spark, sf_dir):
    """What an append adds when the events of even runs are stored already."""
    rows = events(spark, sf_dir)
    return diff.new_events(rows, rows.where("current_run_id % 2 = 0")).select("current_run_id", "event_type", "url")


@query(f"""{b.DIFF}, {b.EVENTS}, late AS (SELECT run_id, site_id, completed_at, CASE WHEN status = 'partial' AND run_id % 5 = 0 THEN 'completed' ELSE status END AS status FROM runs),
now AS (SELECT run_id, lag(run_id) OVER (PARTITION BY site_id ORDER BY completed_at, run_id) AS prior FROM late WHERE status = 'completed')
SELECT current_run_id, previous_run_id, event_type, url FROM events JOIN now ON run_id = current_run_id WHERE previous_run_id IS DISTINCT FROM prior""")
def sequence_gap_check(spark, sf_dir):
    """Events that late runs have made stale."""
    late = b.runs(spark, sf_dir).withColumn("status", F.when((F.col("status") == "partial") & (F.col("run_id") % 5 == 0), "completed").otherwise(F.col("status")))
    return diff.broken_sequence(events(spark, sf_dir), late).select("current_run_id", "previous_run_id", "event_type", "url")


@query(f"{b.FEED} SELECT * FROM seen")
def feed_all(spark, sf_dir):
    return whole_feed(spark, sf_dir)


FILTER = "site_type = 'owned' AND event_type IN ('text_changed', 'internal_links_changed', 'price_changed') AND importance IN ('medium', 'high') AND current_completed_at >= TIMESTAMP '1995-01-01' AND current_completed_at < TIMESTAMP '1997-01-01' AND viewed_at IS NULL"


def narrowed(spark, sf_dir):
    years = datetime(1995, 1, 1, tzinfo=UTC), datetime(1997, 1, 1, tzinfo=UTC)
    return whole_feed(spark, sf_dir, site_type="owned", event_types=["text_changed", "internal_links_changed", "price_changed"], importance=["medium", "high"], from_time=years[0], before_time=years[1], viewed=False)


@query(f"{b.FEED} SELECT event_id, source, event_type, url, current_completed_at, importance FROM seen WHERE {FILTER}")
def feed_filtered(spark, sf_dir):
    return narrowed(spark, sf_dir).select("event_id", "source", "event_type", "url", "current_completed_at", "importance")


@query(f"{b.FEED} SELECT * FROM seen ORDER BY current_completed_at DESC, source_rank, event_id DESC LIMIT 20 OFFSET 40")
def feed_page(spark, sf_dir):
    return feed.page(whole_feed(spark, sf_dir), 20, 40)


@query(f"{b.FEED} SELECT count(*) AS events, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM seen WHERE {FILTER}")
def feed_count(spark, sf_dir):
    n = F.count(F.lit(1))
    return narrowed(spark, sf_dir).agg(n.alias("events"), feed.page_count(n, 20).alias("pages"))


@query(f"{b.FEED} SELECT site_type, count(*) > 0 AS has_events FROM seen GROUP BY 1")
def feed_exists(spark, sf_dir):
    return whole_feed(spark, sf_dir).select("site_type").distinct().withColumn("has_events", F.lit(True))


SIDE = "CASE WHEN {id} IS NULL THEN 'absent_side' WHEN event_type IN ('page_added', 'page_removed') THEN 'text' WHEN event_type = 'internal_links_changed' THEN 'links' WHEN event_type = 'title_changed' THEN 'text' WHEN event_type = 'text_changed' THEN 'text' WHEN event_type = 'description_changed' THEN CASE WHEN {v}.description IS NULL THEN 'none' ELSE 'text' END ELSE CASE WHEN {v}.h1 IS NULL THEN 'none' ELSE 'text' END END"
SIDE_TEXT = "CASE WHEN {id} IS NULL THEN NULL WHEN event_type IN ('page_added', 'page_removed') THEN e.url WHEN event_type = 'title_changed' THEN {v}.title WHEN event_type = 'description_changed' THEN {v}.description WHEN event_type = 'h1_changed' THEN {v}.h1 WHEN event_type = 'text_changed' THEN {v}.normalized_text END"
SIDES = "FROM {t} e LEFT JOIN pages c ON c.page_id = e.current_page_id LEFT JOIN pages p ON p.page_id = e.previous_page_id"


@query(f"""{b.DIFF}, {b.EVENTS} SELECT e.current_run_id, event_type, e.url, {SIDE.format(id="current_page_id", v="c")} AS current_state, {SIDE_TEXT.format(id="current_page_id", v="c")} AS current_text,
{SIDE.format(id="previous_page_id", v="p")} AS previous_state, {SIDE_TEXT.format(id="previous_page_id", v="p")} AS previous_text {SIDES.format(t="events")}""")
def side_states(spark, sf_dir):
    rows = feed.with_sides(diff.all_events(matched(spark, sf_dir), SNAPSHOT_EVENTS, sides=True))
    return rows.select("current_run_id", "event_type", "url", F.col("current.state").alias("current_state"), F.col("current.text").alias("current_text"), F.col("previous.state").alias("previous_state"), F.col("previous.text").alias("previous_text"))


def cell(state: str, text: str, links: str, price: str) -> str:
    return f"CASE {state} WHEN 'text' THEN {text} WHEN 'links' THEN replace(array_to_string({links}, chr(10)), chr(10), chr(13) || chr(10)) WHEN 'price' THEN regexp_replace(CAST({price} AS VARCHAR), '\\.?0+$', '') || ' USD' ELSE map_extract_value(MAP {feed.STATE_TITLES}, {state}) END"


@query(f"""{b.FEED}, x AS (SELECT e.*, c.internal_links AS cl, p.internal_links AS pl, c.price AS cpr, p.price AS ppr, CASE WHEN source = 'price' THEN 'price' ELSE {SIDE.format(id="current_page_id", v="c")} END AS cs, {SIDE_TEXT.format(id="current_page_id", v="c")} AS ctx,
CASE WHEN source = 'price' THEN 'price' ELSE {SIDE.format(id="previous_page_id", v="p")} END AS ps, {SIDE_TEXT.format(id="previous_page_id", v="p")} AS ptx {SIDES.format(t="seen")})
SELECT CAST(site_id AS VARCHAR) AS site_id, site_name, site_url, source, CAST(event_id AS VARCHAR) AS event_id, map_extract_value(MAP {feed.TITLES}, event_type) AS event_type, strftime(current_completed_at, '%Y-%m-%dT%H:%M:%S') AS detected_at, url, coalesce(map_extract_value(MAP {feed.IMPORTANCE_TITLES}, importance), '{feed.NOT_RATED}') AS importance,
coalesce(CAST(weight AS VARCHAR), '') AS weight, map_extract_value(MAP {feed.EXPLANATIONS}, event_type) AS explanation, CASE WHEN viewed_at IS NULL THEN '{feed.NOT_VIEWED}' ELSE '{feed.VIEWED}' END AS view_status, coalesce(strftime(viewed_at, '%Y-%m-%dT%H:%M:%S'), '') AS viewed_at, {cell("cs", "ctx", "cl", "cpr")} AS current, {cell("ps", "ptx", "pl", "ppr")} AS previous FROM x""")
def export_csv_rows(spark, sf_dir):
    return feed.csv_rows(feed.verified(feed.with_sides(whole_feed(spark, sf_dir, sides=True))))


def json_side(state: str, text: str, links: str, price: str) -> str:
    amount = f"regexp_replace(CAST({price} AS VARCHAR), '\\.?0+$', '')"
    held = f"CASE WHEN {state} = 'price' THEN"
    return f"{{'state': {state}, 'text': {text}, 'links': CASE WHEN {state} = 'links' THEN {links} END, 'currency': {held} 'USD' END, 'low': {held} {amount} END, 'high': CAST(NULL AS VARCHAR)}}"


@query(f"""{b.FEED}, x AS (SELECT e.*, c.internal_links AS cl, p.internal_links AS pl, c.price AS cpr, p.price AS ppr, CASE WHEN source = 'price' THEN 'price' ELSE {SIDE.format(id="current_page_id", v="c")} END AS cs, {SIDE_TEXT.format(id="current_page_id", v="c")} AS ctx,
CASE WHEN source = 'price' THEN 'price' ELSE {SIDE.format(id="previous_page_id", v="p")} END AS ps, {SIDE_TEXT.format(id="previous_page_id", v="p")} AS ptx {SIDES.format(t="seen")})
SELECT CAST(to_json({{'site_id': site_id, 'site_name': site_name, 'site_url': site_url, 'source': source, 'event_id': event_id, 'event_type': event_type, 'detected_at': strftime(current_completed_at, '%Y-%m-%dT%H:%M:%SZ'), 'url': url, 'importance': importance, 'importance_weight': weight,
'explanation': map_extract_value(MAP {feed.EXPLANATIONS}, event_type), 'viewed': viewed_at IS NOT NULL, 'viewed_at': strftime(viewed_at, '%Y-%m-%dT%H:%M:%SZ'), 'current': {json_side("cs", "ctx", "cl", "cpr")}, 'previous': {json_side("ps", "ptx", "pl", "ppr")}}}) AS VARCHAR) AS value FROM x""")
def export_json_rows(spark, sf_dir):
    return feed.json_rows(feed.verified(feed.with_sides(whole_feed(spark, sf_dir, sides=True))))


@query(f"WITH {b.METRICS} SELECT site_id, metric_date, impressions, clicks, clicks / impressions AS ctr FROM metrics", ("metric_date",))
def metrics_ctr(spark, sf_dir):
    return b.daily_metrics(spark, sf_dir).withColumn("ctr", metrics.ctr(F.col("clicks"), F.col("impressions")))


@query(f"WITH {b.METRICS} SELECT DISTINCT site_id, CAST(date_trunc('week', metric_date) AS DATE) AS period_start, CAST(date_trunc('week', metric_date) + INTERVAL 6 DAY AS DATE) AS period_end FROM metrics", ("period_start", "period_end"))
def metrics_periods(spark, sf_dir):
    week = F.to_date(F.date_trunc("week", "metric_date"))
    return metrics.periods(b.daily_metrics(spark, sf_dir).withColumns({"period_start": week, "period_end": F.date_add(week, 6)}))


@query(f"""WITH {b.RUNS}, {b.PAGES}, {b.METRICS}, latest AS (SELECT site_id, run_id FROM runs WHERE status IN ('completed', 'partial') QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY completed_at DESC, run_id DESC) = 1)
SELECT m.site_id, metric_date, 'https://example.com/p/' || (impressions % 10) AS normalized_url, CASE WHEN l.run_id IS NULL THEN NULL ELSE EXISTS (SELECT 1 FROM pages g WHERE g.run_id = l.run_id AND g.url = 'https://example.com/p/' || (m.impressions % 10)) END AS in_crawl
FROM metrics m LEFT JOIN latest l ON l.site_id = m.site_id""", ("metric_date",))
def metrics_coverage(spark, sf_dir):
    m = b.daily_metrics(spark, sf_dir).withColumn("normalized_url", F.concat(F.lit("https://example.com/p/"), (F.col("impressions") % 10).cast("string")))
    found = metrics.coverage(m, run_ops.latest(b.runs(spark, sf_dir)), b.pages(spark, sf_dir).select("run_id", "url"))
    return found.select("site_id", "metric_date", "normalized_url", "in_crawl")


@query("""WITH h AS (SELECT user_id AS site_id, CAST(ts AS DATE) AS metric_date, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS half, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1, 2, 3)
SELECT coalesce(n.site_id, o.site_id) AS site_id, coalesce(n.metric_date, o.metric_date) AS metric_date, coalesce(n.clicks, o.clicks) AS clicks, coalesce(n.impressions, o.impressions) AS impressions, CASE WHEN n.site_id IS NULL THEN 0 ELSE 1 END AS import_id,
CASE WHEN n.site_id IS NULL THEN 'kept' WHEN o.site_id IS NULL THEN 'added' WHEN n.clicks = o.clicks AND n.impressions = o.impressions THEN 'unchanged' ELSE 'updated' END AS action
FROM (SELECT * FROM h WHERE half = 1) n FULL OUTER JOIN (SELECT * FROM h WHERE half = 0) o ON n.site_id = o.site_id AND n.metric_date = o.metric_date""", ("metric_date",))
def metrics_upsert(spark, sf_dir):
    """The afternoon's counts over the morning's."""
    m = b.daily_metrics(spark, sf_dir, halves=True).withColumn("import_id", F.col("half"))
    return metrics.upserted(m.where("half = 0"), m.where("half = 1"), ["site_id", "metric_date"], ["clicks", "impressions"], ("import_id",))


@query("""WITH r AS (SELECT CAST(event_id AS INT) + 2 AS line, 'https://example.com/p/' || (event_id % 400) AS url, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN '-3' ELSE CAST(event_id % 50 AS VARCHAR) END AS clicks, CAST(event_id % 40 AS VARCHAR) AS impressions FROM events),
f AS (SELECT *, min(line) OVER (PARTITION BY url) AS first FROM r)
SELECT line, CASE WHEN clicks = '' THEN 1 ELSE 0 END AS no_clicks, CASE WHEN clicks = '-3' THEN 1 ELSE 0 END AS bad_clicks, CASE WHEN TRY_CAST(nullif(clicks, '-3') AS INT) > CAST(impressions AS INT) THEN 1 ELSE 0 END AS over, CASE WHEN first < line THEN first END AS same_as FROM f""")
def metrics_validation(spark, sf_dir):
    """Rows of a made-up import with every kind of slip."""
    e = F.col("event_id")
    rows = b.table(spark, sf_dir, "events").select(
        (e.cast("int") + 2).alias("line"),
        F.concat(F.lit("HTTPS://Example.com:443/p/./"), (e % 400).cast("string"), F.lit("#x")).alias("page"),
        F.when(e % 7 == 0, "").when(e % 7 == 1, "-3").otherwise((e % 50).cast("string")).alias("clicks"),
        (e % 40).cast("string").alias("impressions"),
        F.lit("1,250").alias("position"),
    )
    x = metrics.validated(rows, "https://example.com")
    flag = lambda m: F.array_contains("errors", m).cast("int")
    same = F.element_at(F.filter("errors", lambda s: s.startswith("same url")), -1)
    return x.select("line", flag("no clicks").alias("no_clicks"), flag("bad clicks").alias("bad_clicks"), flag("clicks over impressions").alias("over"), F.when(F.exists("errors", lambda s: s.startswith("same url")), F.regexp_extract(same, r"(\d+)$", 1).cast("int")).alias("same_as"))


@query(f"WITH {b.METRICS} SELECT metric_date, 'https://example.com/u/' || site_id AS url, CAST(clicks AS VARCHAR) AS clicks, CAST(impressions AS VARCHAR) AS impressions, CAST(NULL AS VARCHAR) AS position FROM metrics", ("metric_date",))
def nested_pivot(spark, sf_dir):
    """Daily metrics as a service nests them, read back and turned to columns."""
    from pagetide.sources import payloads

    m = b.daily_metrics(spark, sf_dir)
    stat = lambda name, c: F.struct(F.col("metric_date").cast("string").alias("date"), F.lit(name).alias("field"), F.col(c).cast("string").alias("value"))
    each = m.select("site_id", F.explode(F.array(stat("CLICKS", "clicks"), stat("IMPRESSIONS", "impressions"))).alias("s"))
    nested = each.groupBy("site_id").agg(F.collect_list("s").alias("statistics"))
    item = F.struct(F.struct(F.lit("URL").alias("type"), F.concat(F.lit("https://example.com/u/"), F.col("site_id").cast("string")).alias("value")).alias("text_indicator"), "statistics")
    landed = nested.select(F.to_json(F.struct(F.lit(1).alias("count"), F.array(item).alias("text_indicator_to_statistics"))).alias("payload"))
    return payloads.pivoted(payloads.nested_statistics(landed))


@query(f"WITH {b.ENTRIES} SELECT site_id, scheduled_for, id, status FROM entries WHERE status <> 'pending' QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY scheduled_for DESC, id DESC) = 1")
def schedule_latest(spark, sf_dir):
    return schedule.latest_per_site(b.entries(spark, sf_dir))


@query(f"WITH {b.ENTRIES} SELECT * FROM entries WHERE status = 'pending' ORDER BY scheduled_for, site_id, id LIMIT 1")
def queue_next(spark, sf_dir):
    return schedule.next_pending(b.entries(spark, sf_dir))


NOW = "TIMESTAMP '2024-06-30 12:00:00'"


@query(f"""WITH s AS (SELECT event_id AS site_id, ts AS next_run_at, CASE WHEN event_id % 3 = 0 THEN 'weekly' ELSE 'daily' END AS frequency FROM events)
SELECT site_id, CAST(CASE WHEN next_run_at > {NOW} THEN 0 ELSE floor((epoch({NOW}) - epoch(date_trunc('second', next_run_at))) / (86400 * CASE frequency WHEN 'weekly' THEN 7 ELSE 1 END)) + 1 END AS INT) AS missed_periods FROM s""")
def missed_periods(spark, sf_dir):
    rows = b.table(spark, sf_dir, "events").select(F.col("event_id").alias("site_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("next_run_at"), F.when(F.col("event_id") % 3 == 0, "weekly").otherwise("daily").alias("frequency"))
    return rows.select("site_id", calendar.missed_periods(F.col("next_run_at"), F.col("frequency"), F.lit("2024-06-30 12:00:00").cast("timestamp"), "UTC").alias("missed_periods"))


@query("""WITH s AS (SELECT event_id AS site_id, date_trunc('second', ts) AS now, CASE WHEN event_id % 3 = 0 THEN 'weekly' ELSE 'daily' END AS frequency, CAST(event_id % 7 AS INT) AS weekday FROM events),
f AS (SELECT *, CASE frequency WHEN 'weekly' THEN date_trunc('day', now) + to_days(CAST((weekday - (isodow(now) - 1) + 7) % 7 AS INT)) ELSE date_trunc('day', now) END + INTERVAL 570 MINUTE AS first FROM s)
SELECT site_id, CASE WHEN first > now THEN first WHEN frequency = 'weekly' THEN first + INTERVAL 7 DAY ELSE first + INTERVAL 1 DAY END AS next_run_at FROM f""")
def schedule_next_run(spark, sf_dir):
    now = F.date_trunc("second", F.col("ts").cast("timestamp"))
    frequency = F.when(F.col("event_id") % 3 == 0, "weekly").otherwise("daily")
    return b.table(spark, sf_dir, "events").select(F.col("event_id").alias("site_id"), calendar.next_run(now, frequency, (F.col("event_id") % 7).cast("int"), F.lit("09:30"), "UTC").alias("next_run_at"))


@query(f"{b.GRAPH} SELECT run_id, source_id, position, link, target_id, state FROM edges")
def graph_edges(spark, sf_dir):
    return graph.edges(b.graph_pages(spark, sf_dir))


@query(f"""{b.GRAPH}, o AS (SELECT source_id AS page_id, count(*) AS outgoing, count(*) FILTER (state = 'broken') AS broken, count(*) FILTER (state = 'unchecked') AS unchecked FROM edges GROUP BY 1),
i AS (SELECT target_id AS page_id, count(*) AS incoming FROM edges WHERE target_id IS NOT NULL GROUP BY 1)
SELECT run_id, page_id, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(broken, 0) AS broken, coalesce(unchecked, 0) AS unchecked FROM gpages LEFT JOIN o USING (page_id) LEFT JOIN i USING (page_id)""")
def graph_degrees(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.degrees(pages, graph.edges(pages))


@query(f"{b.GRAPH} SELECT run_id, state, count(*) AS links FROM edges GROUP BY 1, 2")
def link_states(spark, sf_dir):
    return graph.state_counts(graph.edges(b.graph_pages(spark, sf_dir)))


def reached_pages(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    nodes, arcs = graph.html_graph(pages, graph.edges(pages))
    return pages, nodes, graph.reachable(graph.starts(pages), arcs)


@query(f"{b.GRAPH} SELECT run_id, page_id FROM reached")
def graph_reachable(spark, sf_dir):
    return reached_pages(spark, sf_dir)[2].select("run_id", "page_id")


@query(f"{b.GRAPH} SELECT run_id, page_id FROM gpages g WHERE outcome = 'html' AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.page_id = g.page_id) AND sequence_number > 1")
def graph_islands(spark, sf_dir):
    pages, nodes, seen = reached_pages(spark, sf_dir)
    first = pages.groupBy("run_id").agg(F.min_by("page_id", "sequence_number").alias("page_id"))
    return nodes.select("run_id", "page_id").join(seen, ["run_id", "page_id"], "left_anti").join(first, ["run_id", "page_id"], "left_anti")


@query(f"""{b.GRAPH}, d AS (SELECT g.run_id, g.depth, row_number() OVER (PARTITION BY g.run_id ORDER BY g.depth) AS k, count(*) OVER (PARTITION BY g.run_id) AS n FROM reached r JOIN gpages g USING (page_id))
SELECT run_id, n AS reachable_pages, CAST(depth AS DOUBLE) AS p90 FROM d WHERE k = ceil(0.9 * n)""")
def depth_p90(spark, sf_dir):
    _, nodes, seen = reached_pages(spark, sf_dir)
    rows = seen.join(nodes, ["run_id", "page_id"]).groupBy("run_id")
    return rows.agg(F.count(F.lit(1)).alias("reachable_pages"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY depth)").cast("double").alias("p90"))


@query(f"""{b.GRAPH}, c AS (SELECT e.target_id AS page_id, arg_min(e.source_id, g.sequence_number) AS parent_id FROM edges e JOIN gpages g ON g.page_id = e.source_id WHERE e.target_id IS NOT NULL AND e.target_id <> e.source_id GROUP BY 1)
SELECT run_id, page_id, CASE WHEN sequence_number > 1 THEN parent_id END AS parent_id FROM gpages LEFT JOIN c USING (page_id)""")
def tree_parents(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.first_parents(pages, graph.edges(pages))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


#: Reachability of all pairs, and with each page left out in turn: what the per-run algorithms must come to.
CLOSURE = f"""{b.GRAPH}, html AS (SELECT run_id, page_id, depth, sequence_number FROM gpages WHERE outcome = 'html'),
walk AS (SELECT source_id AS a, target_id AS b FROM arcs UNION SELECT w.a, c.target_id FROM walk w JOIN arcs c ON c.source_id = w.b),
without AS (SELECT s.run_id, r.page_id AS gone, s.page_id FROM starts s JOIN reached r ON r.run_id = s.run_id AND r.page_id <> s.page_id UNION SELECT w.run_id, w.gone, a.target_id FROM without w JOIN arcs a ON a.source_id = w.page_id AND a.target_id <> w.gone),
sizes AS (SELECT run_id, count(*) AS n FROM reached GROUP BY 1),
lost AS (SELECT w.run_id, gone AS page_id, any_value(n) - 1 - count(*) AS stranded, greatest(2, ceil(0.10 * (any_value(n) - 1))) AS least FROM without w JOIN sizes USING (run_id) GROUP BY 1, 2),
dead AS (SELECT run_id, page_id FROM html h WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.a = h.page_id AND NOT EXISTS (SELECT 1 FROM walk v WHERE v.a = w.b AND v.b = h.page_id))),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY h.run_id ORDER BY h.depth) AS k, n FROM reached r JOIN html h USING (page_id) JOIN sizes s ON s.run_id = h.run_id),
p90 AS (SELECT run_id, depth AS bar FROM ranked WHERE k = ceil(0.9 * n) AND n >= 10)"""
#: PageRank as the linear system that spreading the rank of dead ends only scales; html is a table before it.
PAGERANK = """outs AS (SELECT source_id, count(*) AS n FROM arcs GROUP BY 1),
powers AS (SELECT 0 AS k, run_id, page_id, CAST(1.0 AS DOUBLE) AS x FROM html UNION ALL
SELECT any_value(kk.k) + 1, h.run_id, h.page_id, 1.0 + 0.85 * coalesce(sum(i.x / o.n), 0.0) FROM html h CROSS JOIN (SELECT max(k) AS k FROM powers) kk LEFT JOIN arcs a ON a.target_id = h.page_id LEFT JOIN powers i ON i.page_id = a.source_id LEFT JOIN outs o ON o.source_id = a.source_id WHERE kk.k < 180 GROUP BY h.run_id, h.page_id),
pr AS (SELECT run_id, page_id, round(x / sum(x) OVER (PARTITION BY run_id), 9) AS pagerank FROM powers WHERE k = 180)"""
FOUND = """found AS (
SELECT run_id, page_id, 'dead_end' AS signal FROM dead
UNION ALL SELECT run_id, page_id, 'cycle_trap' FROM dead d WHERE EXISTS (SELECT 1 FROM walk w WHERE w.a = d.page_id AND w.b = d.page_id)
UNION ALL SELECT run_id, page_id, 'island' FROM html h WHERE sequence_number > 1 AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.page_id = h.page_id)
UNION ALL SELECT r.run_id, page_id, 'anomalous_depth' FROM ranked r JOIN p90 USING (run_id) WHERE depth >= 5 AND depth > bar
UNION ALL SELECT run_id, page_id, 'bottleneck' FROM lost WHERE stranded >= least)"""


@query(f"""{b.GRAPH}, c AS (SELECT e.target_id AS page_id, arg_min(e.source_id, g.sequence_number) AS parent_id FROM edges e JOIN gpages g ON g.page_id = e.source_id WHERE e.target_id IS NOT NULL AND e.target_id <> e.source_id GROUP BY 1),
par AS (SELECT run_id, page_id, CASE WHEN sequence_number > 1 THEN parent_id END AS parent_id FROM gpages LEFT JOIN c USING (page_id)),
up AS (SELECT page_id AS a, parent_id AS b FROM par WHERE parent_id IS NOT NULL UNION SELECT u.a, p.parent_id FROM up u JOIN par p ON p.page_id = u.b WHERE p.parent_id IS NOT NULL),
cuts AS (SELECT a FROM up GROUP BY a HAVING bool_or(a = b) AND min(b) = a),
forest AS (SELECT run_id, page_id, CASE WHEN page_id IN (SELECT a FROM cuts) THEN NULL ELSE parent_id END AS parent_id FROM par),
lev AS (SELECT run_id, page_id, parent_id, page_id AS root_id, 0 AS level FROM forest WHERE parent_id IS NULL UNION ALL SELECT f.run_id, f.page_id, f.parent_id, l.root_id, l.level + 1 FROM lev l JOIN forest f ON f.parent_id = l.page_id)
SELECT * FROM lev""")
def structure_tree(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.tree(pages, graph.edges(pages))


@query(f"{b.GRAPH}, html AS (SELECT run_id, page_id, sequence_number FROM gpages WHERE outcome = 'html'), {PAGERANK} SELECT f.run_id, f.page_id, pagerank, CAST(row_number() OVER (PARTITION BY f.run_id ORDER BY pagerank DESC, sequence_number) AS INT) AS rank FROM pr f JOIN html USING (page_id)")
def pagerank(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    nodes, arcs = graph.html_graph(pages, graph.edges(pages))
    return graph.ranked(graph.pagerank(nodes, arcs), nodes)


@query(f"""{CLOSURE}, {PAGERANK}, {FOUND},
cand AS (SELECT p.*, row_number() OVER (PARTITION BY p.run_id ORDER BY pagerank) AS k, count(*) OVER (PARTITION BY p.run_id) AS n FROM pr p JOIN reached r USING (page_id) WHERE p.page_id NOT IN (SELECT page_id FROM starts)),
bars AS (SELECT run_id, pagerank AS bar FROM cand WHERE k = ceil(0.2 * n) AND n >= 10),
low AS (SELECT c.run_id, page_id, 'low_connectivity' AS signal FROM cand c JOIN bars USING (run_id) WHERE pagerank < bar AND (SELECT count(*) FROM arcs a WHERE a.target_id = c.page_id) <= 1),
listed AS (SELECT page_id, list(signal) AS s FROM (SELECT * FROM found UNION ALL SELECT * FROM low) GROUP BY 1),
loops AS (SELECT d.page_id, array_to_string(list(w.b ORDER BY w.b), ' ') AS cycle FROM dead d JOIN walk w ON w.a = d.page_id JOIN walk v ON v.a = d.page_id AND v.b = d.page_id GROUP BY 1)
SELECT g.run_id, g.page_id, coalesce(array_to_string(list_filter({list(graph.SIGNALS)}, lambda x: list_contains(s, x)), ' '), '') AS signals, d.page_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM arcs a WHERE a.source_id = g.page_id) AS dead_end_is_page, coalesce(cycle, '') AS cycle, CAST(coalesce(stranded, 0) AS INT) AS stranded
FROM gpages g LEFT JOIN listed l USING (page_id) LEFT JOIN dead d USING (page_id) LEFT JOIN loops o USING (page_id) LEFT JOIN (SELECT * FROM lost WHERE stranded >= least) x USING (page_id)""")
def structure_signals(spark, sf_dir):
    """All six signals, low connectivity among them; lists as text."""
    pages = b.graph_pages(spark, sf_dir)
    e = graph.edges(pages)
    found = graph.signals(pages, e, graph.pagerank(*graph.html_graph(pages, e)))
    return found.withColumns({"signals": F.array_join("signals", " "), "cycle": F.array_join(F.col("cycle").cast("array<string>"), " ")})


@query(f"{CLOSURE}, {FOUND} SELECT run_id, signal, count(*) AS pages FROM found GROUP BY 1, 2")
def scc_signals(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.signal_counts(graph.signals(pages, graph.edges(pages)))


@query(f"{CLOSURE} SELECT run_id, page_id, CAST(stranded AS INT) AS stranded FROM lost WHERE stranded >= least")
def bottlenecks(spark, sf_dir):
    pages = b.graph_pages(spark, sf_dir)
    return graph.signals(pages, graph.edges(pages)).where(F.array_contains("signals", "bottleneck")).select("run_id", "page_id", "stranded")


@query(ORACLE_SQL["structure_tree"])
def structure_tree_joined(spark, sf_dir):
    """The forest of runs of any size."""
    pages = b.graph_pages(spark, sf_dir)
    return graph.large_tree(pages, graph.edges(pages))


@query(ORACLE_SQL["scc_signals"])
def structure_signals_joined(spark, sf_dir):
    """Components, traps, islands and dominators of runs of any size."""
    pages = b.graph_pages(spark, sf_dir)
    return graph.signal_counts(graph.large_signals(pages, graph.edges(pages)))



@query(f"""{b.GRAPH}, n AS (SELECT *, -pi() / 2 + 2 * pi() * (row_number() OVER (PARTITION BY run_id ORDER BY sequence_number) - 1) / count(*) OVER (PARTITION BY run_id) AS angle FROM gpages)
SELECT run_id, page_id, round(450.0 + 285.0 * cos(angle), 2) AS x, round(330.0 + 285.0 * sin(angle), 2) AS y FROM n""")
def graph_layout(spark, sf_dir):
    return graph.layout(b.graph_pages(spark, sf_dir))


@query()
def extract_page(spark, sf_dir):
    return extract_pages(b.table(spark, sf_dir, "pages"))


#: Right for letters whose lower case folds no further, but for the German sharp s; other tests hold the rest.
FOLDED = r"trim(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {FOLDED} AS normalized_text, sha256({FOLDED}) AS content_hash FROM documents")
def normalize_text_unicode(spark, sf_dir):
    text = normalize_main_text(F.col("text"))
    return b.table(spark, sf_dir, "documents").select("doc_id", text.alias("normalized_text"), F.sha2(text, 256).alias("content_hash"))


@query()
def long_text_distance(spark, sf_dir):
    """Edit distance of consecutive documents of a source. Pairs are dealt anew: their time grows with the product of their lengths, and long documents may lie together."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pairs = neighbours.with_previous(docs, "source", "doc_id", "text").where("previous IS NOT NULL AND text <> previous")
    pairs = pairs.select("doc_id", "text", "previous").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return pairs.select("doc_id", distance(F.col("text"), F.col("previous")).alias("text_distance"))


from pagetide.plans import queries_control, queries_sources, queries_sql  # noqa: E402, F401  They register theirs, with what is defined above.
