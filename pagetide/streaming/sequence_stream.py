"""Runs as they land, in any order: the state of a site is the order of its completed runs.

A run that lands after all others of its site makes a pair with the last of them. One that lands late, between two others,
makes two pairs, and the pair of these two no longer holds: that is told apart, so that what was found for it can be passed
over. So what has been told at any moment adds up to what predecessors() says of all runs that have landed.

Sites are dealt into shards, whose runs are kept and compared as arrays: a call of the state takes longer than a run does,
and most sites have few runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagetide.operators import diff
from pagetide.streaming.diff_stream import appended

PAIRS = "kind string, site_id long, current_run_id long, previous_run_id long, current_completed_at timestamp"
#: What a row says: a pair of a run that came last; of one that came late; of the run after that one; and a pair that no longer holds.
NEXT, LATE, MOVED, STALE = "next", "late", "moved", "stale"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards of sites, as many as a stream began with. A batch reads what is known of the shards that it has runs of.
SHARDS = 256
#: A shard's runs are kept in so many parts at most: a batch adds some, and once they are more they are dealt anew.
PARTS = 32
#: Runs in a part, and rows told at once, at most.
PIECE = 200_000
#: nowhere: without a site. at: microseconds.
RUN = np.dtype([("nowhere", "?"), ("site", "<i8"), ("at", "<i8"), ("run", "<i8")])


def told(known: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """The runs of new that aren't known, once each, and what they say when those of a site land one by one in their order."""
    runs, fresh = np.concatenate([known, new]), np.repeat([False, True], [len(known), len(new)])
    order = np.lexsort((fresh, runs["run"], runs["at"], runs["site"], runs["nowhere"]))
    runs, fresh = runs[order], fresh[order]
    once = np.concatenate([[True], runs[1:] != runs[:-1]])[: len(runs)]  # a known run comes before its repeats
    runs, fresh = runs[once], fresh[once]
    n = np.arange(len(runs))
    same = lambda i, j: (runs["site"][i] == runs["site"][j]) & (runs["nowhere"][i] == runs["nowhere"][j])
    before = np.where((n > 0) & same(n, n - 1), n - 1, -1)
    # The next run that was known: those of the batch that come after a run land after it.
    after = np.minimum.accumulate(np.where(fresh, len(runs), n)[::-1])[::-1]
    after = np.where((after < len(runs)) & same(n, np.minimum(after, len(runs) - 1)), after, -1)
    last, late = n[fresh & (after < 0)], n[fresh & (after >= 0)]
    parts = [(NEXT, last, before[last]), (LATE, late, before[late]), (MOVED, after[late], late), (STALE, after[late], before[late])]
    one, other = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    out = pd.DataFrame({
        "kind": np.repeat([p[0] for p in parts], [len(p[1]) for p in parts]).astype(object),
        "site_id": pd.arrays.IntegerArray(runs["site"][one], runs["nowhere"][one]),
        "current_run_id": runs["run"][one],
        "previous_run_id": pd.arrays.IntegerArray(runs["run"][other], other < 0),
        "at": runs["at"][one],
    })
    return runs[fresh], out


class Sequence(StatefulProcessor):
    """Keeps the completed runs of a shard's sites."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "runs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            new.append(np.empty(len(frame), RUN))
            for name in RUN.names:
                new[-1][name] = frame[name].to_numpy()
        parts = [np.frombuffer(p, RUN) for (p,) in self.known.get()]
        known = np.concatenate([np.empty(0, RUN), *parts])
        fresh, out = told(known, np.concatenate(new))
        pieces = lambda x: [(x[k : k + PIECE].tobytes(),) for k in range(0, len(x), PIECE)]
        if len(parts) >= max(PARTS, 2 * len(known) // PIECE):
            self.known.put(pieces(np.concatenate([known, fresh])))
        elif len(fresh):
            self.known.appendList(pieces(fresh))
        for k in range(0, len(out), PIECE):
            yield out[k : k + PIECE]

    def close(self) -> None:
        pass


def pairs_of(run_stream: DataFrame) -> DataFrame:
    """PAIRS of a stream of run records (run_id, site_id, completed_at, status); those that aren't completed and those that have landed before say nothing."""
    done = run_stream.where("status = 'completed' AND completed_at IS NOT NULL")
    site = F.col("site_id").cast("long")
    runs = done.select(F.pmod(F.xxhash64(site), F.lit(SHARDS)).alias("shard"), site.isNull().alias("nowhere"), F.coalesce(site, F.lit(0)).alias("site"), F.unix_micros("completed_at").alias("at"), F.col("run_id").cast("long").alias("run"))
    pairs = runs.groupBy("shard").transformWithStateInPandas(Sequence(), "kind string, site_id long, current_run_id long, previous_run_id long, at long", "Append", "None")
    return pairs.select("kind", "site_id", "current_run_id", "previous_run_id", F.timestamp_micros("at").alias("current_completed_at"))


def holding(told: DataFrame) -> DataFrame:
    """Of PAIRS that were told together, those that none of them takes back."""
    stale = told.where(F.col("kind") == STALE).select("current_run_id", F.col("previous_run_id").alias("gone"))
    same = (told["current_run_id"] == stale["current_run_id"]) & told["previous_run_id"].eqNullSafe(stale["gone"])
    return told.where(F.col("kind") != STALE).join(stale, same, "left_anti")


def live(events: DataFrame, stale: DataFrame) -> DataFrame:
    """Events of pairs of runs that still follow each other. stale: the pairs that start() has put aside."""
    return events.join(stale.select("current_run_id", "previous_run_id"), ["current_run_id", "previous_run_id"], "left_anti")


def start(run_stream: DataFrame, pages_path: str, events_path: str, stale_path: str, checkpoint: str, prices_path: str | None = None, every: str | None = None):
    """Appends the events of new pairs to events_path, their price events to prices_path, and pairs that no longer hold to stale_path, as runs land.

    A batch that is done again changes nothing. Which runs have landed is known from the state, so the runs' table isn't read.
    every: a processing-time interval; without one, what has landed is processed once.
    """
    spark = run_stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the one that can hold several states of a key

    def each(batch: DataFrame, _: int) -> None:
        told = batch.cache()
        try:
            pairs = holding(told).where("previous_run_id IS NOT NULL").select("current_run_id", "site_id", "current_completed_at", "previous_run_id")
            rows = diff.matched(pairs, batch.sparkSession.read.parquet(pages_path))
            runs = pairs.select("current_run_id")
            appended(diff.snapshot_events(rows), events_path, runs, diff.EVENT_KEY)
            if prices_path:
                appended(diff.price_events(rows), prices_path, runs, diff.PRICE_KEY)
            stale = told.where((F.col("kind") == STALE) & F.col("previous_run_id").isNotNull()).select("current_run_id", "previous_run_id").distinct()
            appended(stale, stale_path, stale.select("current_run_id").distinct(), ("current_run_id", "previous_run_id"))
        finally:
            told.unpersist()

    writer = pairs_of(run_stream).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
