"""Crawl runs: predecessors, latest runs, counters and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators.store import BUCKETS, Store, View
from pagetide.schemas import ERROR_OUTCOMES


def predecessors(runs: DataFrame) -> DataFrame:
    """current_run_id, site_id, current_completed_at, previous_run_id (null for a baseline): completed runs with the greatest strictly smaller (completed_at, run_id) of their site."""
    done = runs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
    order = W.partitionBy("site_id").orderBy("completed_at", "run_id")
    return done.select(F.col("run_id").alias("current_run_id"), "site_id", F.col("completed_at").alias("current_completed_at"), F.lag("run_id").over(order).alias("previous_run_id"))


def latest(runs: DataFrame, statuses: tuple[str, ...] = ("completed", "partial")) -> DataFrame:
    """The latest run of each site by (completed_at, run_id): combined before the shuffle, unlike a window."""
    eligible = runs.where(F.col("status").isin(*statuses) & F.col("completed_at").isNotNull())
    best = eligible.groupBy("site_id").agg(F.max(F.struct("completed_at", "run_id", "status")).alias("r"))
    return best.select("site_id", "r.run_id", "r.completed_at", "r.status")


def counters(records: DataFrame) -> DataFrame:
    """run_id, processed, successful, forbidden, errors of page records."""
    among = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return records.groupBy("run_id").agg(F.count(F.lit(1)).alias("processed"), among("html", "non_html").alias("successful"), among("forbidden").alias("forbidden"), among(*ERROR_OUTCOMES).alias("errors"))


def stored_status(crawl_status: Column, errors: Column) -> Column:
    """Not completed is deferred; errors make a run partial, forbidden or limited pages don't."""
    return F.when(crawl_status != "completed", "deferred").when(errors > 0, "partial").otherwise("completed")


def error_pages(records: DataFrame, run_id: int) -> DataFrame:
    return records.where((F.col("run_id") == run_id) & F.col("outcome").isin(*ERROR_OUTCOMES)).orderBy("sequence_number")


def with_sequence(records: DataFrame, *order: str) -> DataFrame:
    """sequence_number from 1 within each run."""
    return records.withColumn("sequence_number", F.row_number().over(W.partitionBy("run_id").orderBy(*order)))


def interrupted(runs: DataFrame) -> DataFrame:
    """What a restart makes of runs that were running."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def page_counts(records: DataFrame, runs: DataFrame) -> DataFrame:
    """site_id, runs, pages of each site."""
    pages = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(pages, "run_id", "left").groupBy("site_id").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))


def availability(crawl_status: Column, outcome: Column) -> Column:
    """What a check of a start page says of its site."""
    return (
        F.when(crawl_status == "robots_redirect", "redirect")
        .when(crawl_status == "robots_deferred", "deferred")
        .when(crawl_status.isin("robots_timeout", "robots_network_error"), "network_error")
        .when(outcome == "forbidden", "forbidden")
        .when(outcome == "redirect", "redirect")
        .when(outcome == "http_error", "deferred")
        .when(outcome.isin("timeout", "network_error"), "network_error")
        .otherwise("available")
    )


#: The tables that a crawl's outcome goes to, and where each row's place follows from.
CRAWL_TABLES = {"runs": "run_id", "pages": "run_id", "snapshots": "run_id", "prices": "run_id"}
#: The statuses of runs whose pages are stored.
STORED = ("completed", "partial")


def crawl_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, CRAWL_TABLES, buckets)


def whole_crawl(tables: dict[str, DataFrame]) -> None:
    """Raises a ValueError unless html pages, and only they, have a snapshot, prices belong to snapshots, and a run has each page id, url, sequence number and place of a price once."""
    pages, snapshots, prices = tables["pages"], tables["snapshots"], tables["prices"]
    html, key = pages.where("outcome = 'html'").select("run_id", "page_id"), ["run_id", "page_id"]
    twice = lambda rows, *by: rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    faults = {
        "an html page has no snapshot": html.join(snapshots, key, "left_anti"),
        "a snapshot has no html page": snapshots.join(html, key, "left_anti"),
        "a price has no snapshot": prices.join(snapshots, key, "left_anti"),
        "a run is there twice": twice(tables["runs"], "run_id"),
        "a page is there twice": twice(pages, "page_id"),
        "a run has a url twice": twice(pages, "run_id", "url"),
        "a run has a sequence number twice": twice(pages, "run_id", "sequence_number"),
        "a snapshot is there twice": twice(snapshots, "page_id"),
        "a snapshot has a price's place twice": twice(prices, "page_id", "sequence_number"),
    }
    found = None
    for what, rows in faults.items():
        first = rows.select(F.lit(what).alias("what"), F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns if c in ("run_id", "page_id"))).alias("where"))
        found = first if found is None else found.unionByName(first)
    if bad := found.limit(1).collect():
        raise ValueError(f"{bad[0]['what']}: {bad[0]['where']}")


def commit_crawls(store: Store, id: str, runs: DataFrame, pages: DataFrame, snapshots: DataFrame, prices: DataFrame) -> int:
    """Stores what crawls have found, all of it or nothing, and returns the commit's number.

    runs (run_id, status, ...), pages (run_id, page_id, sequence_number, url, outcome, ...), snapshots (run_id, page_id, ...),
    prices (run_id, page_id, sequence_number, ...). A run that is stored stays as it is, whichever commit it came with;
    runs that aren't among STORED leave no pages. What isn't whole_crawl() is refused.
    """

    def new(base: View) -> dict[str, DataFrame]:
        stored = base.table("runs", runs.select("run_id"))
        fresh = runs if stored is None else runs.join(stored.select("run_id"), "run_id", "left_anti")
        kept = fresh.where(F.col("status").isin(*STORED)).select("run_id")
        return {"runs": fresh} | {name: rows.join(kept, "run_id", "left_semi") for name, rows in (("pages", pages), ("snapshots", snapshots), ("prices", prices))}

    return store.commit(id, new, whole_crawl)


COUNTERS = ("processed", "requested", "successful", "forbidden", "errors")
#: What a run's message says as it starts, when a restart has ended it, and before the error that has.
RUNNING_MESSAGE = "Обход выполняется."
INTERRUPTED_MESSAGE = "Обход был прерван перезапуском приложения."
FAILED_MESSAGE = "Обход завершился неожиданной ошибкой: "


def started(runs: DataFrame, sites: DataFrame, asked: DataFrame) -> DataFrame:
    """runs (run_id, site_id, status, message, started_at, completed_at and COUNTERS) with the run of asked (run_id, site_id, started_at; one row) as a running one.

    A site that isn't known is a LookupError. While a run is going on, whatever its site, another is refused by a
    RuntimeError that names the one that started first.
    """
    if unknown := asked.join(sites.select("site_id"), "site_id", "left_anti").limit(1).collect():
        raise LookupError(f"no such site: {unknown[0]['site_id']}")
    going = runs.where("status = 'running'").agg(F.min(F.struct("started_at", "run_id")).alias("r")).first()["r"]
    if going is not None:
        raise RuntimeError(f"a crawl is running: {going['run_id']}")
    row = asked.select("run_id", "site_id", F.lit("running").alias("status"), F.lit(RUNNING_MESSAGE).alias("message"), "started_at", *(F.lit(0).alias(c) for c in COUNTERS))
    return runs.unionByName(row, allowMissingColumns=True)


def progressed(runs: DataFrame, progress: DataFrame) -> DataFrame:
    """runs with the counters of progress (run_id and COUNTERS) where they are running; others stay as they are. Of a run's rows the one with most processed counts."""
    last = progress.groupBy("run_id").agg(F.max(F.struct(*COUNTERS)).alias("p"))
    going = (F.col("status") == "running") & F.col("p").isNotNull()
    return runs.join(last, "run_id", "left").withColumns({c: F.when(going, F.col("p")[c]).otherwise(F.col(c)) for c in COUNTERS}).drop("p")


def failed(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """runs, of which those in failures (run_id, error, at) have failed: with the error in their message and the time as their end. Of a run's rows the earliest counts."""
    of = failures.groupBy("run_id").agg(F.min(F.struct("at", "error")).alias("f"))
    hit = F.col("f").isNotNull()
    new = {"status": F.lit("failed"), "message": F.concat(F.lit(FAILED_MESSAGE), F.col("f.error")), "completed_at": F.col("f.at")}
    return runs.join(of, "run_id", "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("f")


def without_sites(table: DataFrame, deleted: DataFrame, key: str = "site_id") -> DataFrame:
    """A cascade's delete from one table."""
    return table.join(deleted.select(key), key, "left_anti")


def transferable(sites: DataFrame, *blocking: DataFrame) -> DataFrame:
    """Sites without rows in any table that would stay behind."""
    for table in blocking:
        sites = sites.join(table.select("site_id"), "site_id", "left_anti")
    return sites


def recent(runs: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The n latest of each key, newest first by order."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return runs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def with_source(sources: DataFrame, connection_id: int, resource: str) -> DataFrame:
    """sources (connection_id, version, resource, active) after a connection takes another resource: a new active version, and no other. Taking the active one again changes nothing."""
    own = F.col("connection_id") == connection_id
    same = sources.where(own & F.col("active") & (F.col("resource") == resource))
    last = sources.where(own).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    new = last.select(F.lit(connection_id).cast("long").alias("connection_id"), (F.col("v") + 1).cast("int").alias("version"), F.lit(resource).alias("resource"), F.lit(True).alias("active"))
    if not same.isEmpty():
        return sources
    return sources.withColumn("active", F.col("active") & ~own).unionByName(new)
