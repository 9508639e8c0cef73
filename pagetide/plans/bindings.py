"""The driver's tables as model tables, in DataFrame operations and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators import diff


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.when(key % 2 == 0, "owned").otherwise("competitor")
    return table(spark, sf_dir, "customer").select(key.alias("site_id"), F.col("c_name").alias("name"), F.concat(F.lit("https://s"), key.cast("string"), F.lit(".example.com/")).alias("url"), kind.alias("site_type"))


SITES = "sites AS (SELECT c_custkey AS site_id, c_name AS name, 'https://s' || c_custkey || '.example.com/' AS url, CASE WHEN c_custkey % 2 = 0 THEN 'owned' ELSE 'competitor' END AS site_type FROM customer)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("site_id"), F.col("o_orderdate").cast("timestamp").alias("completed_at"), status.alias("status"))


RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS site_id, o_orderdate AS completed_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status FROM orders)"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]


def pages(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """A page for each run and slug: its first line. The run's parts are the links of all its pages. A line is dealt out once, by its run, for both, and lies where the run's row can join it. With pairs, most lines of runs that aren't among them stay behind."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select("l_orderkey", *LINE_ORDER)
    lines = (lines if pairs is None else diff.perhaps_paired(lines, "l_orderkey", pairs)).sortWithinPartitions("l_orderkey")
    whole = W.partitionBy("l_orderkey").orderBy("l_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.partitionBy("l_orderkey", "slug").orderBy(*LINE_ORDER)
    linked = lines.withColumn("parts", F.collect_set("l_partkey").over(whole)).withColumn("slug", F.col("l_suppkey") % 10)
    links = F.array_sort(F.array_distinct(F.transform("parts", lambda p: F.concat(F.lit("/p/"), (p % 50).cast("string")))))
    first = linked.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(F.col("l_orderkey").alias("run_id"), "slug", F.struct(*LINE_ORDER).alias("l"), links.alias("internal_links"))
    text = F.concat_ws(" ", "l.l_returnflag", "l.l_linestatus", F.date_format("l.l_shipdate", "yyyy-MM-dd"), F.col("l.l_quantity").cast("int").cast("string"))
    price = F.array(F.struct(F.regexp_replace(F.col("l.l_extendedprice").cast("decimal(18,2)").cast("string"), r"\.?0+$", "").alias("amount"), F.lit("USD").alias("currency"), F.lit("price").alias("kind"), F.lit("json-ld").alias("source")))
    return first.select(
        (F.col("run_id") * 10 + F.col("slug")).alias("page_id"),
        "run_id",
        F.concat(F.lit("https://example.com/p/"), F.col("slug").cast("string")).alias("url"),
        F.col("l.l_returnflag").alias("title"),
        F.nullif(F.col("l.l_linestatus"), F.lit("O")).alias("description"),
        F.nullif(F.col("l.l_returnflag"), F.lit("N")).alias("h1"),
        text.alias("normalized_text"),
        "internal_links",
        price.alias("prices"),
    )


PAGES = f"""lines AS (SELECT *, l_suppkey % 10 AS slug, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 10 ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lineitem),
links AS (SELECT l_orderkey AS run_id, list_sort(list(DISTINCT '/p/' || (l_partkey % 50))) AS internal_links FROM lineitem GROUP BY 1),
pages AS (SELECT l_orderkey * 10 + slug AS page_id, l_orderkey AS run_id, 'https://example.com/p/' || slug AS url, l_returnflag AS title, nullif(l_linestatus, 'O') AS description,
  nullif(l_returnflag, 'N') AS h1, l_returnflag || ' ' || l_linestatus || ' ' || strftime(l_shipdate, '%Y-%m-%d') || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS normalized_text,
  internal_links, CAST(l_extendedprice AS DECIMAL(18, 2)) AS price FROM lines JOIN links ON links.run_id = l_orderkey WHERE rn = 1)"""
PAIRS = "pairs AS (SELECT run_id AS current_run_id, site_id, completed_at AS current_completed_at, lag(run_id) OVER (PARTITION BY site_id ORDER BY completed_at, run_id) AS previous_run_id FROM runs WHERE status = 'completed')"
MATCHED = """cur AS (SELECT p.*, g.* FROM pairs p JOIN pages g ON g.run_id = p.current_run_id WHERE previous_run_id IS NOT NULL),
prev AS (SELECT p.*, g.* FROM pairs p JOIN pages g ON g.run_id = p.previous_run_id),
twins AS (SELECT c.current_run_id, c.previous_run_id, c.current_completed_at, c.url, c.page_id AS cp, p.page_id AS pp, c.title AS ct, p.title AS pt, c.description AS cd, p.description AS pd, c.h1 AS ch, p.h1 AS ph,
  c.normalized_text AS cx, p.normalized_text AS px, c.internal_links AS cl, p.internal_links AS pl, c.price AS c_price, p.price AS p_price FROM cur c JOIN prev p ON c.current_run_id = p.current_run_id AND c.url = p.url)"""
WEIGH = "CASE WHEN 10 * {n} < {d} THEN 1 WHEN 10 * {n} < 3 * {d} THEN 2 ELSE 3 END"
EVENTS = f"""textd AS (SELECT *, levenshtein(cx, px) AS n, greatest(length(cx), length(px)) AS d FROM twins WHERE cx <> px),
linkd AS (SELECT *, len(list_filter(cl, lambda x: NOT list_contains(pl, x))) + len(list_filter(pl, lambda x: NOT list_contains(cl, x))) AS n, len(list_distinct(list_concat(cl, pl))) AS d FROM twins),
events AS (
SELECT current_run_id, previous_run_id, 'page_added' AS event_type, url, page_id AS current_page_id, CAST(NULL AS BIGINT) AS previous_page_id, current_completed_at, 2 AS weight, CAST(NULL AS INT) AS text_distance, CAST(NULL AS BIGINT) AS ratio_numerator, CAST(NULL AS BIGINT) AS ratio_denominator
  FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.current_run_id = c.current_run_id AND p.url = c.url)
UNION ALL SELECT current_run_id, previous_run_id, 'page_removed', url, NULL, page_id, current_completed_at, 3, NULL, NULL, NULL
  FROM prev p WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE p.current_run_id = c.current_run_id AND p.url = c.url)
UNION ALL SELECT current_run_id, previous_run_id, 'title_changed', url, cp, pp, current_completed_at, 3, NULL, NULL, NULL FROM twins WHERE ct IS DISTINCT FROM pt
UNION ALL SELECT current_run_id, previous_run_id, 'description_changed', url, cp, pp, current_completed_at, 2, NULL, NULL, NULL FROM twins WHERE cd IS DISTINCT FROM pd
UNION ALL SELECT current_run_id, previous_run_id, 'h1_changed', url, cp, pp, current_completed_at, 3, NULL, NULL, NULL FROM twins WHERE ch IS DISTINCT FROM ph
UNION ALL SELECT current_run_id, previous_run_id, 'text_changed', url, cp, pp, current_completed_at, {WEIGH.format(n="n", d="d")}, CAST(n AS INT), CAST(n // gcd(n, d) AS BIGINT), CAST(d // gcd(n, d) AS BIGINT) FROM textd
UNION ALL SELECT current_run_id, previous_run_id, 'internal_links_changed', url, cp, pp, current_completed_at, {WEIGH.format(n="n", d="d")}, NULL, CAST(n // gcd(n, d) AS BIGINT), CAST(d // gcd(n, d) AS BIGINT) FROM linkd WHERE n > 0
)"""
IMPORTANCE = "CASE weight WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS importance"
RANKS = ["page_added", "page_removed", "title_changed", "description_changed", "h1_changed", "text_changed", "internal_links_changed", "price_changed"]
DIFF = f"WITH {RUNS}, {PAGES}, {PAIRS}, {MATCHED}"


def event_ids(events: DataFrame) -> DataFrame:
    """An id for each event that follows from what it is about."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(RANKS) for x in (k, i)))[F.col("event_type")]
    return events.withColumn("event_id", F.coalesce("current_page_id", "previous_page_id") * 10 + rank)


FEED = f"""{DIFF}, {EVENTS}, {SITES},
feed AS (
SELECT coalesce(current_page_id, previous_page_id) * 10 + list_position({RANKS}, event_type) - 1 AS event_id, 'snapshot' AS source, 0 AS source_rank, r.site_id, s.name AS site_name, s.url AS site_url, s.site_type, event_type, e.url,
  current_completed_at, {IMPORTANCE}, weight, current_run_id, previous_run_id, current_page_id, previous_page_id, text_distance, ratio_numerator, ratio_denominator, CAST(NULL AS VARCHAR) AS price_profile, CAST(NULL AS VARCHAR) AS price_currency
  FROM events e JOIN runs r ON r.run_id = e.current_run_id JOIN sites s USING (site_id)
UNION ALL
SELECT cp * 10 + 7, 'price', 1, r.site_id, s.name, s.url, s.site_type, 'price_changed', e.url, current_completed_at, NULL, NULL, current_run_id, previous_run_id, cp, pp, NULL, NULL, NULL, 'price', 'USD'
  FROM twins e JOIN runs r ON r.run_id = e.current_run_id JOIN sites s USING (site_id) WHERE c_price <> p_price
), seen AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN current_completed_at + INTERVAL 1 DAY END AS viewed_at FROM feed)"""


def graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of small sites, linked as they follow each other in orders. Some links lead to no page."""
    lines = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    steps = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).where("dst IS NOT NULL AND src div 100 = dst div 100")
    url = lambda c: F.concat(F.lit("https://s"), F.floor(c / 100).cast("string"), F.when(c % 13 == 5, "/missing/").otherwise("/p/"), c.cast("string"))
    links = steps.groupBy("src").agg(F.array_sort(F.collect_set(url(F.col("dst")))).alias("links"))
    key = F.col("p_partkey")
    outcome = F.when(key % 11 == 1, "http_error").when(key % 11 == 2, "redirect").when(key % 11 == 3, "timeout").when(key % 11 == 4, "non_html").otherwise("html")
    rows = table(spark, sf_dir, "part").join(links, key == F.col("src"), "left")
    return rows.select(
        F.floor(key / 100).alias("run_id"),
        (key + 1).alias("page_id"),
        (key % 100 + 1).cast("int").alias("sequence_number"),
        F.concat(F.lit("https://s"), F.floor(key / 100).cast("string"), F.lit("/p/"), key.cast("string")).alias("url"),
        (F.col("p_size") % 8).cast("int").alias("depth"),
        outcome.alias("outcome"),
        F.when(outcome == "http_error", 404).alias("http_status"),
        F.when(outcome == "html", F.coalesce("links", F.array().cast("array<string>"))).alias("internal_links"),
    )


GRAPH = f"""WITH RECURSIVE steps AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS dst FROM lineitem),
gpages AS (SELECT p_partkey // 100 AS run_id, p_partkey + 1 AS page_id, CAST(p_partkey % 100 + 1 AS INT) AS sequence_number, 'https://s' || (p_partkey // 100) || '/p/' || p_partkey AS url, CAST(p_size % 8 AS INT) AS depth,
  CASE p_partkey % 11 WHEN 1 THEN 'http_error' WHEN 2 THEN 'redirect' WHEN 3 THEN 'timeout' WHEN 4 THEN 'non_html' ELSE 'html' END AS outcome FROM part),
glinks AS (SELECT DISTINCT src + 1 AS source_id, src // 100 AS run_id, 'https://s' || (dst // 100) || CASE WHEN dst % 13 = 5 THEN '/missing/' ELSE '/p/' END || dst AS link FROM steps JOIN gpages ON page_id = src + 1 WHERE dst IS NOT NULL AND src // 100 = dst // 100 AND outcome = 'html'),
edges AS (SELECT l.run_id, l.source_id, CAST(row_number() OVER (PARTITION BY l.source_id ORDER BY link) - 1 AS INT) AS position, link, t.page_id AS target_id,
  CASE WHEN t.page_id IS NULL THEN 'unchecked' WHEN t.outcome IN ('html', 'non_html') THEN 'available' WHEN t.outcome = 'http_error' THEN 'broken' ELSE t.outcome END AS state
  FROM glinks l LEFT JOIN gpages t ON t.run_id = l.run_id AND t.url = l.link),
arcs AS (SELECT DISTINCT e.run_id, source_id, target_id FROM edges e JOIN gpages g ON g.page_id = e.target_id WHERE g.outcome = 'html'),
starts AS (SELECT run_id, page_id FROM gpages g WHERE outcome = 'html' AND sequence_number = (SELECT min(sequence_number) FROM gpages h WHERE h.run_id = g.run_id)),
reached AS (SELECT run_id, page_id FROM starts UNION SELECT a.run_id, a.target_id FROM reached r JOIN arcs a ON a.run_id = r.run_id AND a.source_id = r.page_id)"""


def daily_metrics(spark: SparkSession, sf_dir: str, halves: bool = False) -> DataFrame:
    """Impressions and clicks of a user's day."""
    e = table(spark, sf_dir, "events").withColumn("metric_date", F.to_date("ts"))
    extra = ["half"] if halves else []
    if halves:
        e = e.withColumn("half", F.when(F.hour("ts") < 12, 0).otherwise(1))
    return e.groupBy(F.col("user_id").alias("site_id"), "metric_date", *extra).agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))


METRICS = "metrics AS (SELECT user_id AS site_id, CAST(ts AS DATE) AS metric_date, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1, 2)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "click", "partial").when(kind == "error", "failed").when(kind == "signup", "missed").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("site_id"), F.col("ts").cast("timestamp").alias("scheduled_for"), status.alias("status"))


ENTRIES = "entries AS (SELECT event_id AS id, user_id AS site_id, ts AS scheduled_for, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'missed' ELSE 'pending' END AS status FROM events)"
