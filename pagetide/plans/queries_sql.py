"""Queries written in SQL with the engine's functions, and of local time where clocks change."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetide.functions import calendar, titles
from pagetide.operators import runs, schedule
from pagetide.plans import bindings as b
from pagetide.plans.queries_control import committed
from pagetide.plans.queries_sources import PARTS, cases, unescaped
from pagetide.plans.registry import query
from pagetide.plans.storage import shared_dir
from pagetide.sources import sql_functions
from pagetide.streaming import sequence_stream


@query(rf"""{PARTS}, x AS (SELECT page_id, url, home, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS k FROM p),
y AS (SELECT page_id, url, k, home || {unescaped("href")} AS link, regexp_replace(url, '#.*', '') AS own FROM x),
z AS (SELECT url, page_id, link, min(k) AS k FROM y WHERE link <> own GROUP BY 1, 2, 3)
SELECT link, count(*) AS pages, min(url) AS first_url FROM z GROUP BY 1""")
def links_in_sql(spark, sf_dir):
    """How many pages link to each address."""
    sql_functions.register(spark)
    pages = b.table(spark, sf_dir, "pages")
    return spark.sql("SELECT link, count(*) AS pages, min(url) AS first_url FROM explode_links(TABLE(SELECT url, html FROM {pages})) GROUP BY link", pages=pages)


#: Ways to write the same address, by the supplier's key, and that address.
WRITTEN = """CASE s_suppkey % 6 WHEN 0 THEN 'HTTPS://S' || s_suppkey || '.Example.COM:443/a/./b#top' WHEN 1 THEN 'http://s' || s_suppkey || '.example.com:8080' WHEN 2 THEN 'https://s' || s_suppkey || '.example.com/x/../a/' || s_nationkey || '/?q=' || s_nationkey
WHEN 3 THEN 'https://user:pw@s' || s_suppkey || '.example.com/' WHEN 4 THEN 'ftp://s' || s_suppkey || '.example.com/' ELSE '/only/' || s_suppkey END"""
CLEAN = """CASE s_suppkey % 6 WHEN 0 THEN 'https://s' || s_suppkey || '.example.com/a/b' WHEN 1 THEN 'http://s' || s_suppkey || '.example.com:8080/' WHEN 2 THEN 'https://s' || s_suppkey || '.example.com/a/' || s_nationkey || '/?q=' || s_nationkey END"""


@query(f"SELECT s_suppkey AS site_id, {CLEAN} AS url, CASE WHEN s_suppkey % 6 < 3 THEN 's' || s_suppkey || '.example.com' END AS host, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS name, CAST(levenshtein(s_name, 'Nation ' || s_nationkey) AS INT) AS distance FROM supplier")
def addresses_in_sql(spark, sf_dir):
    """Addresses made of the suppliers' keys, their names normalized, and how far these are from another text."""
    sql_functions.register(spark)
    suppliers = b.table(spark, sf_dir, "supplier")
    return spark.sql(f"SELECT s_suppkey AS site_id, normalize_url(written) AS url, url_host(normalize_url(written)) AS host, normalize_text(s_name) AS name, edit_distance(s_name, 'Nation ' || s_nationkey) AS distance FROM (SELECT *, {WRITTEN} AS written FROM {{suppliers}})", suppliers=suppliers)


# Local time --------------------------------------------------------------------------------------------------------------

ZONE = "Europe/Berlin"


def sunday(year: str, month: str, day: int) -> str:
    """The last Sunday of a month, whose last day is given."""
    end = f"make_date({year}, {month}, {day})"
    return f"CAST({end} - CAST(dayofweek({end}) AS INT) AS TIMESTAMP)"


def summer(t: str, begins: int, ends: int) -> str:
    """SQL: the hours that the zone is ahead of UTC at t, where summer time begins and ends at these hours of t's clock. Until 1995 it ended in September."""
    year = f"CAST(year({t}) AS INT)"
    autumn = f"CASE WHEN year({t}) < 1996 THEN {sunday(year, '9', 30)} ELSE {sunday(year, '10', 31)} END"
    return f"CAST(CASE WHEN {t} >= {sunday(year, '3', 31)} + INTERVAL {begins} HOUR AND {t} < {autumn} + INTERVAL {ends} HOUR THEN 2 ELSE 1 END AS BIGINT)"


def to_local(t: str) -> str:
    return f"({t} + to_hours({summer(t, 1, 1)}))"


def to_utc(t: str) -> str:
    """A local time that the clock skips counts from before the change, one that it shows twice is the first."""
    return f"({t} - to_hours({summer(t, 3, 3)}))"


MOMENTS = """SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS now, o_orderkey % 2 = 0 AS daily, CAST(o_orderkey % 7 AS INT) AS weekday, CASE o_orderkey % 3 WHEN 0 THEN '02:30' WHEN 1 THEN '00:00' ELSE '23:15' END AS time FROM orders"""
RUNS_NEXT = f"""WITH m AS ({MOMENTS}), here AS (SELECT *, {to_local("now")} AS here_at FROM m),
day AS (SELECT *, CAST(here_at AS DATE) + CASE WHEN daily THEN 0 ELSE CAST((weekday - isodow(here_at) + 8) % 7 AS INT) END AS day, CASE WHEN daily THEN 1 ELSE 7 END AS step FROM here),
begin_at AS (SELECT *, CAST(day AS TIMESTAMP) + to_minutes(CAST(split_part(time, ':', 1) AS BIGINT) * 60 + CAST(split_part(time, ':', 2) AS BIGINT)) AS first FROM day),
local AS (SELECT *, CASE WHEN first > here_at THEN first ELSE first + to_days(step) END AS next FROM begin_at),
utc AS (SELECT *, {to_utc("next")} AS next_run FROM local),
back AS (SELECT *, {to_local("next_run")} + to_days(step) AS again, CAST(CAST(here_at AS DATE) AS TIMESTAMP) AS midnight FROM utc)"""


def moments(spark, sf_dir):
    """Moments of all days of seven years, at which a schedule of some time, often one that clocks skip or show twice, is asked for its next run."""
    key = F.col("o_orderkey")
    now = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + key % 1440 * 60).cast("timestamp")
    return b.table(spark, sf_dir, "orders").select(key.alias("id"), now.alias("now"), F.when(key % 2 == 0, "daily").otherwise("weekly").alias("frequency"), (key % 7).cast("int").alias("weekday"), F.when(key % 3 == 0, "02:30").when(key % 3 == 1, "00:00").otherwise("23:15").alias("time"))


@query(f"{RUNS_NEXT} SELECT id, next_run, {to_utc('again')} AS advanced, {to_utc('midnight')} AS day_begins FROM back", ("next_run", "advanced", "day_begins"))
def schedule_in_a_zone(spark, sf_dir):
    rows = moments(spark, sf_dir).withColumn("next_run", calendar.next_run(F.col("now"), F.col("frequency"), F.col("weekday"), F.col("time"), ZONE))
    day = F.to_date(calendar.local(F.col("now"), ZONE))
    return rows.select("id", "next_run", calendar.advanced(F.col("next_run"), F.col("frequency"), ZONE).alias("advanced"), calendar.midnight_utc(day, ZONE).alias("day_begins"))


@query(f"""{RUNS_NEXT}, n AS (SELECT id, next_run, {to_local("next_run")} AS l, step, id % 40 AS times FROM back), periods AS (SELECT id, k, {to_utc("(l + to_days(CAST(k * step AS INT)))")} AS begins, next_run + to_days(CAST(times AS INT)) + INTERVAL 1 HOUR AS asked FROM n, range(0, 45) t(k))
SELECT id, CAST(count(*) FILTER (begins <= asked) AS INT) AS missed FROM periods GROUP BY 1""")
def missed_in_a_zone(spark, sf_dir):
    """How many periods had begun up to forty days after a run was due."""
    rows = moments(spark, sf_dir).withColumn("next_run", calendar.next_run(F.col("now"), F.col("frequency"), F.col("weekday"), F.col("time"), ZONE))
    asked = (F.unix_timestamp("next_run") + F.col("id") % 40 * 86400 + 3600).cast("timestamp")
    return rows.select("id", calendar.missed_periods(F.col("next_run"), F.col("frequency"), asked, ZONE).alias("missed"))


# The queue ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {b.ENTRIES} SELECT site_id, id AS retry_of_id, CAST(id % 200 + 1 AS INT) AS max_pages, CAST(id % 10 AS INT) AS max_depth, 'bot ' || site_id AS user_agent, 'pending' AS status, '{schedule.RETRY_MESSAGE}' AS message FROM entries WHERE status IN ('partial', 'failed')""")
def schedule_retried(spark, sf_dir):
    """All entries that can be tried again are, with the settings that they had."""
    key = F.col("id")
    entries = b.entries(spark, sf_dir).withColumns({"max_pages": (key % 200 + 1).cast("int"), "max_depth": (key % 10).cast("int"), "delay": F.lit(1.0), "timeout": F.lit(10.0), "user_agent": F.concat(F.lit("bot "), F.col("site_id").cast("string"))})
    asked = entries.where(F.col("status").isin(*schedule.RETRYABLE)).select("site_id", F.col("id").alias("entry_id"))
    out = schedule.retried(entries, asked, F.lit("2024-06-30 12:00:00").cast("timestamp"))
    return out.select("site_id", "retry_of_id", "max_pages", "max_depth", "user_agent", "status", "message")


@query(f"""WITH {b.ENTRIES} SELECT id, {cases(titles.ENTRY_STATUS, "status", titles.STATUS_UNKNOWN)} AS status, {cases(titles.FREQUENCY, "CASE WHEN id % 3 = 0 THEN 'daily' ELSE 'weekly' END", "")} AS frequency, list_extract({list(titles.WEEKDAYS)}, isodow(scheduled_for)) AS weekday FROM entries""")
def queue_titles(spark, sf_dir):
    """What entries, their rules and their days are called."""
    rows = b.entries(spark, sf_dir)
    frequency = F.when(F.col("id") % 3 == 0, "daily").otherwise("weekly")
    return rows.select("id", titles.title(titles.ENTRY_STATUS, F.col("status"), titles.STATUS_UNKNOWN).alias("status"), titles.title(titles.FREQUENCY, frequency, "").alias("frequency"), titles.weekday_title(F.weekday("scheduled_for")).alias("weekday"))


# Runs --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {b.RUNS}, {b.PAGES} SELECT page_id, run_id, url FROM pages JOIN runs USING (run_id) WHERE run_id % 50 = 7 AND status IN ('completed', 'partial')")
def crawls_looked_up(spark, sf_dir):
    """The pages of some runs, by their numbers, from the folders in which these lie."""
    view = committed(spark, sf_dir).view()
    return view.table("pages", b.runs(spark, sf_dir).where("run_id % 50 = 7").select("run_id")).select("page_id", "run_id", "url")


LIVES = f"""WITH {b.RUNS}, lines AS (SELECT l_orderkey AS run_id, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY 1)
SELECT run_id, CASE WHEN run_id % 10 = 3 THEN 'failed' WHEN status = 'failed' THEN 'running' ELSE status END AS status, CASE WHEN run_id % 10 = 3 THEN '{runs.FAILED_MESSAGE}e' || run_id END AS message,
CAST(CASE WHEN status = 'failed' THEN coalesce(last, 0) ELSE 0 END AS INT) AS processed FROM runs LEFT JOIN lines USING (run_id)"""


@query(LIVES)
def runs_going_on(spark, sf_dir):
    """Runs that go on take in their progress, of which the furthest counts; every tenth then fails."""
    rows = b.runs(spark, sf_dir)
    rows = rows.withColumns({"status": F.when(F.col("status") == "failed", "running").otherwise(F.col("status")), "message": F.lit(None).cast("string"), "started_at": F.col("completed_at"), **{c: F.lit(0) for c in runs.COUNTERS}})
    n = F.col("l_linenumber").cast("int")
    progress = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), *(n.alias(c) for c in runs.COUNTERS))
    failures = rows.where("run_id % 10 = 3").select("run_id", F.concat(F.lit("e"), F.col("run_id").cast("string")).alias("error"), F.col("completed_at").alias("at"))
    return runs.failed(runs.progressed(rows, progress), failures).select("run_id", "status", "message", "processed")


@query(f"WITH {b.RUNS}, {b.PAIRS} SELECT current_run_id, previous_run_id FROM pairs")
def runs_in_order_by_stream(spark, sf_dir):
    """Runs that land in three parts, out of their order: the pairs that the stream has told and not taken back."""
    landed, told, checkpoint = (shared_dir(spark) for _ in range(3))
    rows = b.runs(spark, sf_dir).withColumn("part", F.col("run_id") % 3)
    for part in (2, 0, 1):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(landed)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sequence_stream.ROCKSDB)
    stream = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(landed)
    writer = sequence_stream.pairs_of(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start(told).awaitTermination()
    return sequence_stream.holding(spark.read.schema(sequence_stream.PAIRS).parquet(told)).select("current_run_id", "previous_run_id")
