"""Schedules and their journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.functions import calendar

#: Statuses that end an entry, and those that can be tried again.
TERMINAL = ("completed", "partial", "deferred", "failed", "interrupted", "missed", "cancelled")
RETRYABLE = ("partial", "deferred", "failed", "interrupted")


def latest_per_site(entries: DataFrame, statuses: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The latest ended entry of each site by (scheduled_for, id), combined before the shuffle."""
    rest = [c for c in entries.columns if c not in ("site_id", "scheduled_for", "id")]
    best = entries.where(F.col("status").isin(*statuses)).groupBy("site_id").agg(F.max(F.struct("scheduled_for", "id", *rest)).alias("e"))
    return best.select("site_id", "e.*")


def due(schedules: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Entries to reserve: one for each schedule that is due and has none for that moment yet."""
    ready = schedules.where(F.col("enabled") & (F.col("next_run_at") <= now)).select("site_id", F.col("next_run_at").alias("scheduled_for"))
    return ready.join(entries.select("site_id", "scheduled_for"), ["site_id", "scheduled_for"], "left_anti").withColumn("status", F.lit("pending"))


def missed(schedules: DataFrame, now: Column, zone: str) -> DataFrame:
    """One entry for all periods that a schedule missed, and when it runs next."""
    late = schedules.where(F.col("enabled") & (F.col("next_run_at") <= now))
    n = calendar.missed_periods(F.col("next_run_at"), F.col("frequency"), now, zone)
    return late.select("site_id", F.col("next_run_at").alias("scheduled_for"), F.lit("missed").alias("status"), n.alias("missed_periods")).join(late.select("site_id", "frequency"), "site_id").withColumn("next_run_at", calendar.advanced(F.col("scheduled_for"), F.col("frequency"), zone, F.col("missed_periods"))).drop("frequency")


def next_pending(entries: DataFrame) -> DataFrame:
    """The entry at the head of the queue."""
    return entries.where(F.col("status") == "pending").orderBy("scheduled_for", "site_id", "id").limit(1)


def journal_page(entries: DataFrame, page: int, size: int = 20) -> DataFrame:
    """A page of the journal, newest first; a page past the end is the last one."""
    last = max(1, -(-entries.count() // size))
    return entries.orderBy(F.desc("scheduled_for"), F.desc("id")).offset((min(max(page, 1), last) - 1) * size).limit(size)


def retries(entries: DataFrame) -> DataFrame:
    """Entries that can be tried again, as new pending ones that name them."""
    return entries.where(F.col("status").isin(*RETRYABLE)).select("site_id", F.col("id").alias("retry_of_id"), F.lit("pending").alias("status"))


#: What a crawl is asked to do; a retry does the same, whatever the site's settings are by then.
SETTINGS = ("max_pages", "max_depth", "delay", "timeout", "user_agent")
#: Fixed value: what a retry's message says while it waits.
RETRY_MESSAGE = "Ручной повтор ожидает освобождения очереди."


def retried(entries: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The entries to add for asked (site_id, entry_id): pending ones at now, outside any schedule, with the settings of the entry that each repeats.

    entries: id, site_id, status and SETTINGS. An entry that the site doesn't have is a LookupError, one whose status can't be
    tried again a ValueError; then nothing is added. Who asks twice gets two.
    """
    own = entries.select(F.col("id").alias("entry_id"), "site_id", F.col("status").alias("__status"), *SETTINGS)
    found = asked.join(own, ["site_id", "entry_id"], "left")
    bad = found.where(F.col("__status").isNull() | ~F.col("__status").isin(*RETRYABLE)).select("entry_id", "__status").limit(1).collect()
    if bad and bad[0]["__status"] is None:
        raise LookupError(f"the site has no entry {bad[0]['entry_id']}")
    if bad:
        raise ValueError(f"entry {bad[0]['entry_id']} is {bad[0]['__status']}")
    none = F.lit(None).cast("long").alias("schedule_id")
    return found.select("site_id", none, now.alias("scheduled_for"), F.lit("pending").alias("status"), F.lit(RETRY_MESSAGE).alias("message"), *SETTINGS, F.col("entry_id").alias("retry_of_id"), F.lit("not_applicable").alias("notification_status"))


def recovered(entries: DataFrame) -> DataFrame:
    """What a restart makes of entries that were under way."""
    return entries.withColumn("status", F.when(F.col("status").isin("pending", "running"), "interrupted").otherwise(F.col("status")))


def saved(schedules: DataFrame, entries: DataFrame, form: DataFrame, now: Column, zone: str) -> tuple[DataFrame, DataFrame]:
    """schedules and entries after form (site_id, enabled, frequency, local_weekday, local_time) is saved.

    A site's rule is replaced or added, with its next run if it is enabled; its entries that haven't begun are cancelled.
    """
    at = F.when(F.col("enabled"), calendar.next_run(now, F.col("frequency"), F.col("local_weekday"), F.col("local_time"), zone))
    new = form.withColumn("next_run_at", at).select(*schedules.columns)
    told = form.select("site_id", F.lit(True).alias("told"))
    cancels = F.coalesce("told", F.lit(False)) & (F.col("status") == "pending")
    after = entries.join(told, "site_id", "left").withColumns({"completed_at": F.when(cancels, now).otherwise(F.col("completed_at")), "status": F.when(cancels, "cancelled").otherwise(F.col("status"))})
    return schedules.join(form.select("site_id"), "site_id", "left_anti").unionByName(new), after.select(*entries.columns)
