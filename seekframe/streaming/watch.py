"""The change feed: guard, coalesce, route and apply, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.languages import included
from ..operators.ignore import watch_excluded

BULK, DEBOUNCE = 50, "800 milliseconds"


def guarded(changes: DataFrame) -> DataFrame:
    """Changes (path, action, ts, seq) of files that are indexed at all: inside the root, not excluded, of a known extension."""
    path = F.col("path")
    return changes.where((path != "") & ~path.startswith("..") & ~watch_excluded(path) & included(path))


def coalesced(changes: DataFrame) -> DataFrame:
    """The last action of each path."""
    last = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("seq"))
    return changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def quiet_periods(changes: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """True debouncing: per path a session ends after a gap without events, and its last action counts (works on streams with a watermark)."""
    session = changes.groupBy(F.session_window("ts", gap).alias("w"), "path")
    return session.agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.count("*").alias("events")).select("path", "action", F.col("w.end").alias("quiet_at"), "events")


def route(changes: DataFrame, bulk: int = BULK) -> str:
    """``sync`` for many distinct paths, else ``single``; the count stops at the threshold."""
    return "sync" if changes.select("path").distinct().limit(bulk).count() >= bulk else "single"


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Paths after the last actions: deleted ones go, updated ones carry the new ts and seq."""
    last = coalesced(changes)
    rest = state.join(last.select("path"), "path", "left_anti")
    return rest.unionByName(last.where("action = 'up'").select(state.columns))


def start_watch(feed: DataFrame, checkpoint: str, on_sync: Callable[[DataFrame, int], None], on_single: Callable[[DataFrame, int], None], bulk: int = BULK, once: bool = False) -> StreamingQuery:
    """Runs a handler on each micro-batch of coalesced changes. Batches are serial, and a restart repeats a batch with its id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        last = coalesced(guarded(batch)).persist()
        try:
            if not last.isEmpty():
                (on_sync if route(last, bulk) == "sync" else on_single)(last, batch_id)
        finally:
            last.unpersist()

    writer = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
