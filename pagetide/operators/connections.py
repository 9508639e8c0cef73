"""Connections to search-metric services, all at once: the versions of their resources, and what a change of one does to its runs and schedule.

What is asked for names the revision that it was asked of. Who finds another one is refused, and a change makes a new one;
so of changes that were asked for at the same time one is made. Refused rows come back with the reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONNECTIONS = "connection_id long, site_id long, provider string, status string, revision int, updated_at timestamp"
SOURCES = "source_id long, connection_id long, provider string, version int, resource_id string, resource_label string, active boolean"
RUNS = "id long, connection_id long, source_id long, trigger string, status string, created_at timestamp, completed_at timestamp, message string"
SCHEDULES = "connection_id long, enabled boolean, frequency string, local_weekday int, local_time string, next_run_at timestamp"
#: Messages of runs that wait, or that a change has cancelled; the schedule that a connection begins with; reasons of a refusal.
WAITING, RESOURCE_CHANGED, DISCONNECTED = "Ожидает запуска.", "Запуск отменён после смены ресурса.", "Запуск отменён после отключения."
FREQUENCY, WEEKDAY, TIME = "weekly", 0, "09:00"
CHANGED, STALE = "connection_changed", "stale_resource"


class Tables(NamedTuple):
    """connections, sources, runs and schedules: rows that have at least the columns of CONNECTIONS, SOURCES, RUNS and SCHEDULES."""

    connections: DataFrame
    sources: DataFrame
    runs: DataFrame
    schedules: DataFrame


def owned(connections: DataFrame, sites: DataFrame) -> DataFrame:
    """Connections of owned sites."""
    return connections.join(sites.where("site_type = 'owned'").select("site_id"), "site_id", "left_semi")


def updated(rows: DataFrame, key: str, changes: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """rows with values where their key is in changes (key and other columns, a row for each key) and the condition holds, which may read the columns of changes."""
    marked = changes.withColumn("__in", F.lit(True))
    hit = F.coalesce(F.col("__in") & when, F.lit(False))
    return rows.join(marked, key, "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*rows.columns)


def fits(asked: DataFrame, connections: DataFrame, sites: DataFrame) -> DataFrame:
    """asked (connection_id, revision) with fits: whether the connection is connected, of an owned site and of that revision (null: of any)."""
    now = owned(connections, sites).where("status = 'connected'").select("connection_id", F.col("revision").alias("__now"))
    rows = asked.join(now, "connection_id", "left")
    same = F.col("__now").isNotNull() & (F.col("revision").isNull() | (F.col("revision") == F.col("__now")))
    return rows.withColumn("fits", same).drop("__now")


def chosen(tables: Tables, sites: DataFrame, choices: DataFrame, at: Column) -> tuple[Tables, DataFrame]:
    """The tables after connections have taken other resources, and the choices that were refused, with reason.

    choices: choice_id, connection_id, revision (that it was asked of; null: any), expected_source_id (the active source then;
    null: none), resource_id, resource_label, source_id and run_id (of the rows that it may add). Of several choices for a
    connection the one with the least choice_id is looked at; the others are refused, as it comes first. Who takes the
    resource that is active changes nothing. Else the active source ends, waiting runs are cancelled, and a new version
    begins with an initial run, and with a schedule if the connection has none; the connection gets a new revision.
    """
    asked = fits(choices, tables.connections, sites)
    first = asked.groupBy("connection_id").agg(F.min(F.when(F.col("fits"), F.col("choice_id"))).alias("__first"))
    active = tables.sources.where("active").select("connection_id", F.col("source_id").alias("__active"), F.col("resource_id").alias("__resource"))
    rows = asked.join(first, "connection_id", "left").join(active, "connection_id", "left")
    own = F.col("fits") & (F.col("choice_id") == F.col("__first"))
    current = F.col("__active").eqNullSafe(F.col("expected_source_id"))
    reason = F.when(~F.coalesce(own, F.lit(False)), CHANGED).when(~current, STALE)
    judged = rows.withColumn("reason", reason)
    refused = judged.where("reason IS NOT NULL").select("choice_id", "connection_id", "reason")
    new = judged.where(F.col("reason").isNull() & ~F.coalesce(F.col("__resource") == F.col("resource_id"), F.lit(False)))
    new = new.select("connection_id", "resource_id", "resource_label", "source_id", "run_id")
    ids, yes = new.select("connection_id"), F.lit(True)

    last = tables.sources.groupBy("connection_id").agg(F.max("version").alias("v"))
    provider = tables.connections.select("connection_id", "provider")
    begun = new.join(provider, "connection_id").join(last, "connection_id", "left").select("source_id", "connection_id", "provider", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"), "resource_id", "resource_label", yes.alias("active"))
    initial = new.select(F.col("run_id").alias("id"), "connection_id", "source_id", F.lit("initial").alias("trigger"), F.lit("pending").alias("status"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.lit(WAITING).alias("message"))
    unplanned = ids.join(tables.schedules.select("connection_id"), "connection_id", "left_anti")
    planned = unplanned.select("connection_id", F.lit(False).alias("enabled"), F.lit(FREQUENCY).alias("frequency"), F.lit(WEEKDAY).alias("local_weekday"), F.lit(TIME).alias("local_time"), F.lit(None).cast("timestamp").alias("next_run_at"))
    out = Tables(
        updated(tables.connections, "connection_id", ids, yes, {"revision": F.col("revision") + 1, "updated_at": at}),
        updated(tables.sources, "connection_id", ids, F.col("active"), {"active": F.lit(False)}).unionByName(begun, allowMissingColumns=True),
        cancelled(tables.runs, ids, at, RESOURCE_CHANGED).unionByName(initial, allowMissingColumns=True),
        tables.schedules.unionByName(planned, allowMissingColumns=True),
    )
    return out, refused


def cancelled(runs: DataFrame, ids: DataFrame, at: Column, message: str) -> DataFrame:
    """runs, of which those of the connections that wait are cancelled; one that works goes on."""
    return updated(runs, "connection_id", ids, F.col("status") == "pending", {"status": F.lit("cancelled"), "completed_at": at, "message": F.lit(message)})


def disconnected(tables: Tables, sites: DataFrame, gone: DataFrame, at: Column) -> tuple[Tables, DataFrame]:
    """The tables after connections are closed, and the connection_id of those.

    gone: site_id, provider, revision (null: any). Only connections of owned sites close, whatever their status; waiting runs
    are cancelled, schedules are switched off, and sources stay as they are. A connection asked for twice closes once, if one
    of the askers knew its revision.
    """
    asked = gone.select("site_id", "provider", F.col("revision").alias("__asked"))
    fit = owned(tables.connections, sites).join(asked, ["site_id", "provider"]).where(F.col("__asked").isNull() | (F.col("__asked") == F.col("revision")))
    ids, yes = fit.select("connection_id").distinct(), F.lit(True)
    out = Tables(
        updated(tables.connections, "connection_id", ids, yes, {"status": F.lit("disconnected"), "revision": F.col("revision") + 1, "updated_at": at}),
        tables.sources,
        cancelled(tables.runs, ids, at, DISCONNECTED),
        updated(tables.schedules, "connection_id", ids, yes, {"enabled": F.lit(False), "next_run_at": F.lit(None).cast("timestamp")}),
    )
    return out, ids


def scheduled(tables: Tables, sites: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The schedules after those of saved (connection_id, revision and the columns of SCHEDULES), a row for each connection, and what was refused, with reason.

    A schedule is saved for a connection that is connected, of that revision, of an owned site and has an active source; one
    that isn't enabled has no next run.
    """
    live = tables.sources.where("active").select("connection_id", F.lit(True).alias("__live")).distinct()
    judged = fits(saved, tables.connections, sites).join(live, "connection_id", "left").withColumn("ok", F.col("fits") & F.col("revision").isNotNull() & F.col("__live").isNotNull())
    good = judged.where("ok").select("connection_id", "enabled", "frequency", "local_weekday", "local_time", F.when(F.col("enabled"), F.col("next_run_at")).alias("next_run_at"))
    out = tables.schedules.join(good.select("connection_id"), "connection_id", "left_anti").unionByName(good, allowMissingColumns=True)
    return out, judged.where("NOT ok").select("connection_id", F.lit(CHANGED).alias("reason"))
