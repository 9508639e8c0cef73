"""Change events as runs complete: a stream of completed runs, compared batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagetide.operators import diff, runs as run_ops
from pagetide.operators.store import in_buckets, near
from pagetide.plans.storage import exists


def appended(events: DataFrame, path: str, runs: DataFrame, key: tuple[str, ...]) -> None:
    """Appends the events that path doesn't have yet. They lie in folders by a hash of their run, and of what is stored only the folders of the batch's runs are read."""
    spark = events.sparkSession
    if exists(spark, path):
        schema = StructType([*events.schema.fields]).add("bucket", "integer")
        stored = near(spark.read.schema(schema).parquet(path), "current_run_id", runs).join(runs, "current_run_id", "left_semi")
        events = diff.new_events(events, stored, key)
    else:  # an empty file, so that a table without events can be read
        events.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/bucket=0")
    in_buckets(events, "current_run_id").write.mode("append").partitionBy("bucket").parquet(path)


def process_batch(batch: DataFrame, all_runs: DataFrame, pages: DataFrame, path: str, price_path: str | None = None) -> None:
    """Appends the snapshot events of the batch's completed runs that path doesn't have yet, and their price events to price_path. Doing it again for a batch changes nothing.

    Only runs of the batch's sites take part, and only pages of the pairs' runs: a table that is laid out by run_id is read
    in these places alone.
    """
    new = batch.where("status = 'completed'").select(F.col("run_id").alias("current_run_id"), "site_id").distinct().cache()
    try:
        runs = new.select("current_run_id")
        own = all_runs.join(new.select("site_id").distinct(), "site_id", "left_semi")
        pairs = run_ops.predecessors(own).join(runs, "current_run_id", "left_semi")
        rows = diff.matched(pairs, pages)
        appended(diff.snapshot_events(rows), path, runs, diff.EVENT_KEY)
        if price_path:
            appended(diff.price_events(rows), price_path, runs, diff.PRICE_KEY)
    finally:
        new.unpersist()


def start(run_stream: DataFrame, runs_path: str, pages_path: str, events_path: str, checkpoint: str, prices_path: str | None = None, every: str | None = None):
    """run_stream: landed run records. A batch is compared with the tables as they are when it starts; a run that lands late makes
    events of its neighbours' old pair stale, which diff.broken_sequence() finds. every: a processing-time interval; without one, what has landed is processed once."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        process_batch(batch, spark.read.parquet(runs_path), spark.read.parquet(pages_path), events_path, prices_path)

    writer = run_stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def outcome_counts(records: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Requests by outcome in windows of event time, for a dashboard of running crawls; rows later than late are dropped by the watermark."""
    return records.withWatermark("ts", late).groupBy(F.window("ts", window), "outcome").agg(F.count(F.lit(1)).alias("pages"))
