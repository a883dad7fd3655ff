"""Structured Streaming: change events into new versions of a snapshot.

Events may come late, twice or out of order: a batch only says which paths to look at,
and what is there now decides. A batch that is run again writes the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovana.operators import catalog, changes, exclusion, insights
from trovana.operators.kept import Kept, rollup_change
from trovana.sources.logs import EVENTS_SCHEMA
from trovana.sources.snapshot import Store

#: Seconds between batches while someone waits, and otherwise; files that a batch takes at most.
INTERACTIVE, BACKGROUND, FILES = 0.05, 3.0, 512


def read_changes(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """The feed: JSON lines of path, flags and event_id, so many files a batch."""
    return spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files).json(path)


def coalesced(events: DataFrame) -> DataFrame:
    """The batch coalescing as a running aggregate, for the update or complete mode."""
    return changes.coalesced(events)


class Upkeep:
    """Applies batches to a store.

    ``current`` gives what exists now at and under some paths, as catalog rows: a crawl, or a table. It is asked
    once for a batch, and its answer written down, so that all that follows sees one state. Batches become deltas
    of the current version; a new version is made only when these have grown large, and not before the next batch,
    so that changes are seen at once. ``rollup`` keeps figures per root: a batch adds what its rows change, once.
    """

    def __init__(self, store: Store, roots: list[str], current: Callable[[DataFrame], DataFrame], patterns=exclusion.DEFAULT_PATTERNS, large: int = changes.LARGE_DELTA, rollup: Kept | None = None):
        self.store, self.roots, self.current, self.patterns, self.large, self.rollup = store, roots, current, patterns, large, rollup
        self.last_batch = -1
        self.due = False

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        if self.due:
            self.store.compact()
            self.due = False
        kept = changes.indexable(events, self.roots, self.patterns).select("path").distinct()
        if not kept.limit(1).count():
            self.last_batch = batch
            return
        with self.store.held(kept, f"paths-{batch}") as kept, self.store.held(exclusion.indexable(self.current(kept), self.roots, self.patterns).select(*catalog.COLUMNS), f"now-{batch}") as now:
            manifest = self.store.manifest()
            if manifest is None:
                self._count(catalog.empty(spark), now, batch)
                self.store.write(catalog.with_virtual(changes.upsert(catalog.empty(spark), now)), self.roots, list(self.patterns))
            else:
                base = self.store.rows().select(*catalog.COLUMNS)
                before = catalog.under(base, kept)
                self._count(before, now, batch)
                # a directory was looked at with all that lies under it
                gone = kept.unionByName(before.select("path")).distinct().join(now.select("path"), "path", "left_anti")
                same, other = changes.split_changes(base, now)
                if other.limit(1).count() or catalog.under(base, gone).limit(1).count():
                    self.store.append_rows(now, gone, batch)
                else:
                    self.store.append_delta(same, batch)
                self.due = self.store.pending() > self.large
        self.last_batch = batch

    def _count(self, before: DataFrame, now: DataFrame, batch: int) -> None:
        """Adds to the roll-up what the rows at and under the batch's paths were and are."""
        if self.rollup is not None:
            roots = catalog.roots_table(before.sparkSession, self.roots)
            of = lambda rows: insights.root_rollup(catalog.with_root(rows, roots))
            self.rollup.add(rollup_change(of(now), of(before)), batch)

    def start(self, feed: DataFrame, checkpoint: str, seconds: float | None = BACKGROUND) -> StreamingQuery:
        """Runs until stopped, or with ``seconds`` None through what is there now (a replay)."""
        writer = feed.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
        return writer.trigger(**trigger).start()


def cursors(events: DataFrame, roots: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The latest event id of each root, never less than it was."""
    now = changes.cursors(events, roots)
    if before is None:
        return now
    return now.unionByName(before.select("root", "event_id")).groupBy("root").agg(F.max("event_id").alias("event_id"))


class ScopeQueue:
    """Scopes waiting for a reconcile, on the driver: one runs at a time.

    ``add`` says what becomes of a scope: ignored (already waiting), coveredByActive, started or queued.
    """

    def __init__(self) -> None:
        self.active: list[str] | None = None
        self.waiting: list[str] = []
        self.generation = 0

    @staticmethod
    def covers(paths: list[str], path: str) -> bool:
        return any(path == p or path.startswith(p.rstrip("/") + "/") for p in paths)

    def add(self, path: str) -> str:
        if self.active is not None and self.covers(self.active, path):
            return "coveredByActive"
        if self.covers(self.waiting, path):
            return "ignored"
        self.waiting = [p for p in self.waiting if not self.covers([path], p)] + [path]
        return self.start() if self.active is None else "queued"

    def start(self) -> str:
        self.active, self.waiting = self.waiting, []
        self.generation += 1
        return "started"

    def finish(self, generation: int) -> bool:
        """True if the finished run is the present one; what waits then starts."""
        if generation != self.generation:
            return False
        self.active = None
        if self.waiting:
            self.start()
        return True
