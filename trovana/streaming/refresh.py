"""Paths waiting for a refresh, as keyed state with timers.

Events of a root are dealt over shards by their paths. A shard holds its pending paths; the first of them sets a timer,
so that events which follow closely join it (debounce). When the timer fires, up to ``most`` paths leave as a
batch and the rest stays. The next batch waits until the last one is reported as applied: then at once, or
later if it made a large overlay (back-off), and without what lies under directories that were reconciled meanwhile. A
report that doesn't come within ``lease`` lets the next batch go all the same.

Reports come in by the same stream (``reports`` makes them of what was applied), one for each shard. A path that comes
again while it waits is refreshed once. State lies in the query's checkpoint, so a restart goes on with what waits;
a batch that is put out again by a restart has the same number and paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds from the first path to its batch, and after a large overlay; paths of a batch.
DEBOUNCE, BACK_OFF, MOST = 150, 5000, 512
#: Milliseconds after which a batch without a report doesn't hold up the next one.
LEASE = 600_000
SHARDS = 16
#: What goes in: an event's path, or a report with the directories that were reconciled.
INPUT = "root string, shard int, at timestamp, path string, event_id long, applied long, large boolean, reconciled array<string>"
#: What comes out: the paths of numbered batches.
OUTPUT = "root string, shard int, batch long, path string, event_id long"
#: Spark's setting for the store that such state needs.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Waiting(StatefulProcessor):
    """One shard of a root."""

    def __init__(self, debounce: int, back_off: int, most: int, lease: int, event_time: bool):
        self.debounce, self.back_off, self.most, self.lease, self.event_time = debounce, back_off, most, lease, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "event_id long")
        #: The next batch's number; when it is due (-1: no timer); the batch that isn't reported yet (-1: none).
        self.plan = handle.getValueState("plan", "next long, due long, open long")

    def _now(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _set(self, number: int, due: int, before: int, is_open: int) -> None:
        if due != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            if due >= 0:
                self.handle.registerTimer(due)
        self.plan.update((number, due, is_open))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, due, is_open = self.plan.get() if self.plan.exists() else (0, -1, -1)
        delay, before, covered, now = self.debounce, due, [], max(self._now(timerValues), 0)
        for part in rows:
            if self.event_time:
                # the watermark lags by a batch, and is 0 at first
                now = max(now, int(part["at"].max().timestamp() * 1000))
            for path, event_id in zip(part["path"], part["event_id"], strict=True):
                if isinstance(path, str):
                    held = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else (-1,)
                    if event_id > held[0]:
                        self.paths.updateValue((path,), (int(event_id),))
            for applied, large, reconciled in zip(part["applied"], part["large"], part["reconciled"], strict=True):
                if not pd.isna(applied):
                    if int(applied) == is_open:
                        is_open, due, delay = -1, -1, self.back_off if large else 0
                    if large and reconciled is not None:
                        covered += [p.rstrip("/") for p in reconciled if p]
        if covered:
            tops = set(covered)
            gone = [k for k in self.paths.keys() if any(k[0] == t or k[0].startswith(t + "/") for t in tops)]
            for k in gone:
                self.paths.removeKey(k)
        if due < 0 and is_open < 0 and next(self.paths.keys(), None) is not None:
            due = now + delay
        self._set(number, due, before, is_open)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, due, is_open = self.plan.get()
        if expiredTimerInfo.getExpiryTimeInMs() != due:
            return
        batch = [(k[0], v[0]) for k, v in islice(self.paths.iterator(), self.most)]
        for path, _ in batch:
            self.paths.removeKey((path,))
        # the timer that has fired is gone; the next one is for a report that doesn't come
        lease = self._now(timerValues) + self.lease
        if batch:
            self._set(number + 1, lease, -1, number)
            yield pd.DataFrame({"root": key[0], "shard": key[1], "batch": number, "path": [p for p, _ in batch], "event_id": [i for _, i in batch]})
        else:
            self._set(number, -1, -1, -1)

    def close(self) -> None:
        """Nothing is held besides state."""


def events_in(events: DataFrame, roots: DataFrame | None = None, shards: int = SHARDS, at: str | None = None) -> DataFrame:
    """Events (root, path, event_id, and a time ``at`` if timers follow event time) as input rows."""
    root = F.col("root")
    shard = F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")
    when = F.col(at).cast("timestamp") if at else F.current_timestamp()
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("applied", "long"), ("large", "boolean"), ("reconciled", "array<string>"))]
    return events.where("root is not null and path is not null").select(root, shard.alias("shard"), when.alias("at"), "path", "event_id", *nothing)


def reports(batches: DataFrame, large: bool, reconciled: list[str], at=None) -> DataFrame:
    """What becomes of applied batches: a report to each of their shards, and of reconciled directories to the roots' other shards too, by their callers."""
    each = batches.select("root", "shard", "batch").distinct()
    directories = F.array(*map(F.lit, reconciled)) if reconciled else F.array().cast("array<string>")
    return each.select("root", "shard", (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("at"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("event_id"), F.col("batch").alias("applied"), F.lit(large).alias("large"), directories.alias("reconciled"))


def batches(feed: DataFrame, debounce: int = DEBOUNCE, back_off: int = BACK_OFF, most: int = MOST, lease: int = LEASE, late: str | None = None) -> DataFrame:
    """Batches of paths to refresh, of a stream of input rows.

    With ``late`` (such as "0 seconds") timers follow the rows' own times, by a watermark so far behind, and not the clock.
    """
    if late is not None:
        feed = feed.withWatermark("at", late)
    one = Waiting(debounce, back_off, most, lease, late is not None)
    return feed.groupBy("root", "shard").transformWithStateInPandas(statefulProcessor=one, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime" if late is not None else "ProcessingTime")


def start(found: DataFrame, apply: Callable[[DataFrame, int], tuple[bool, list[str]]], report: Callable[[DataFrame], None], checkpoint: str, seconds: float = 0.15) -> StreamingQuery:
    """Gives batches to ``apply`` (events of path, flags and event_id; the batch's number), which says whether the overlay is large
    and which directories were reconciled, and hands the reports to ``report``, which puts them into the feed."""

    def run(rows: DataFrame, number: int) -> None:
        if not rows.limit(1).count():
            return
        rows = rows.persist()
        try:
            large, reconciled = apply(rows.select("path", F.lit(0).cast("long").alias("flags"), "event_id"), number)
            report(reports(rows, large, reconciled))
        finally:
            rows.unpersist()

    return found.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

