"""Syncs with search-metric services: connections, their queue of runs, and what a site's page shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses of runs that wait or work, and of those that brought data.
ACTIVE = ("pending", "running")
SUCCESSFUL = ("completed", "partial")


def enqueued(runs: DataFrame, wanted: DataFrame, connections: DataFrame, sources: DataFrame) -> DataFrame:
    """The runs to add for wanted (connection_id, source_id, revision): pending ones, one to a connection.

    A connection must be connected, of that revision (null: of any), and the source active and its own; else it is left out.
    A connection with a run that waits or works gets no other.
    """
    open_ = connections.where("status = 'connected'").select("connection_id", F.col("revision").alias("now"))
    live = sources.where("active").select("connection_id", "source_id")
    fit = wanted.join(open_, "connection_id").where(F.col("revision").isNull() | (F.col("revision") == F.col("now"))).join(live, ["connection_id", "source_id"], "left_semi")
    once = fit.groupBy("connection_id").agg(F.min("source_id").alias("source_id"))
    return once.join(runs.where(F.col("status").isin(*ACTIVE)).select("connection_id"), "connection_id", "left_anti").select("connection_id", "source_id", F.lit("pending").alias("status"))


def next_run(runs: DataFrame) -> DataFrame:
    """The run at the head of the queue."""
    return runs.where("status = 'pending'").orderBy("created_at", "id").limit(1)


def overview(runs: DataFrame) -> DataFrame:
    """connection_id, last_id, last_success_id: the newest run by (created_at, id), and the newest by (completed_at, id) that brought data, or null."""
    good = F.col("status").isin(*SUCCESSFUL) & F.col("completed_at").isNotNull()
    return runs.groupBy("connection_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("last_id"), F.max(F.when(good, F.struct("completed_at", "id")))["id"].alias("last_success_id"))


def finished(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """runs with actual_start and actual_end: the first and last date of the rows (run_id, metric_date) a run brought, null for none."""
    span = rows.groupBy(F.col("run_id").alias("id")).agg(F.min("metric_date").alias("actual_start"), F.max("metric_date").alias("actual_end"))
    return runs.join(span, "id", "left")


def disconnected(connections: DataFrame, gone: DataFrame) -> DataFrame:
    """connections after those of gone (connection_id, revision; null: any) are closed: a new revision, so that what is under way no longer fits."""
    asked = gone.select("connection_id", F.col("revision").alias("asked"), F.lit(True).alias("told"))
    joined = connections.join(asked, "connection_id", "left")
    closes = F.coalesce(F.col("told") & (F.col("asked").isNull() | (F.col("asked") == F.col("revision"))), F.lit(False))
    return joined.withColumns({"status": F.when(closes, "disconnected").otherwise(F.col("status")), "revision": F.col("revision") + closes.cast("int")}).select(*connections.columns)
