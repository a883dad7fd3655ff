"""A crawl as rounds over a frontier of directories, which can be stopped anywhere and taken up again.

The frontier is a table: directories that are pending, active in the running round, completed, or failed. A round
deals all pending ones out anew and lists each of them once, so one deep or wide subtree is spread over all tasks. What a
round finds (rows, directories to enter, and what has become of those listed) is written in one pass, and counts only
once its checkpoint stands in the store; a round that was cut off leaves nothing and is run again. A checkpoint
tells where rounds lie and holds counts, no paths: nothing of the frontier's size reaches the driver but roots.

Tasks list the directories themselves, so these must be mounted wherever tasks run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trovana.operators import catalog, exclusion
from trovana.sources.crawl import SCHEMA, Walker, preflight
from trovana.sources.snapshot import Manifest, Store

#: What a line of a round says: a row of the catalog, a directory to enter, one that was listed, one that couldn't be.
ROW, ENTER, DONE, FAILED = "row", "enter", "done", "failed"
LINES = f"kind string, {SCHEMA}, n_entries long, seconds double, reason string, task int"
NAMES = [part.split()[0] for part in LINES.split(", ")]
#: Directories that a task lists, about.
PER_TASK = 256


@dataclass(frozen=True)
class Round:
    """Counts of a round, and of the crawl so far."""

    number: int
    n_listed: int
    n_rows: int
    n_pending: int
    n_failed: int
    total_rows: int
    total_listed: int
    most_pending: int
    seconds: float


class FrontierCrawl:
    """A crawl of some roots into a store's folder; ``run`` goes on from what an earlier one has left, if that may be taken up."""

    def __init__(self, store: Store, roots: list[str], patterns=exclusion.DEFAULT_PATTERNS, per_task: int = PER_TASK):
        self.store, self.spark = store, store.spark
        self.roots, self.patterns, self.per_task = [r.rstrip("/") or "/" for r in roots], list(patterns), per_task
        held = store.manifest()
        found = store._checkpoint() if store.resumable(self.roots, self.patterns, held.saved_at if held else 0.0) else None
        self.folders: list[str] = found["folders"] if found and "folders" in found else []
        self.rounds: list[Round] = [Round(**r) for r in found["rounds"]] if self.folders else []
        self.skipped: dict[str, str] = found["skipped"] if self.folders else {}
        self.active: int | None = None

    # --- the frontier

    def _lines(self, folders: list[str] | None = None) -> DataFrame:
        """What rounds have found; tables of all rounds are one."""
        picked = self.folders if folders is None else folders
        if not picked:
            return self.spark.createDataFrame([], LINES)
        return self.spark.read.schema(LINES).parquet(*[f"{self.store.path}/{f}" for f in picked])

    def pending(self) -> DataFrame:
        """Directories that the last round has found and no round has listed."""
        return self._lines(self.folders[-1:]).where(F.col("kind") == ENTER).select("path")

    def frontier(self) -> DataFrame:
        """path and state of each directory met so far: pending, active (being listed now), completed or failed."""
        old = self._lines().where(F.col("kind").isin(DONE, FAILED)).select("path", F.when(F.col("kind") == DONE, "completed").otherwise("failed").alias("state"))
        return old.unionByName(self.pending().select("path", F.lit("pending" if self.active is None else "active").alias("state")))

    def rows(self) -> DataFrame:
        """Catalog rows found so far; none is found twice."""
        return catalog.derive(self._lines().where(F.col("kind") == ROW).select(*[n.split()[0] for n in SCHEMA.split(", ")]))

    def failures(self) -> DataFrame:
        return self._lines().where(F.col("kind") == FAILED).select("path", "reason")

    @property
    def finished(self) -> bool:
        return bool(self.rounds) and self.rounds[-1].n_pending == 0

    # --- rounds

    def _start(self) -> DataFrame:
        """The first round's lines: roots that can be scanned. Roots are few."""
        states = preflight(self.roots, self.patterns)
        self.skipped = {r: s for r, s in states.items() if s != "readable"}
        walker = Walker(self.roots, self.patterns)
        usable = [r for r in dict.fromkeys(self.roots) if r not in self.skipped]
        lines = [(ROW, *walker.root_row(r), None, None, None, 0) for r in usable if walker.decision(r, True) == exclusion.INDEX]
        lines += [(ENTER, r, True, *[None] * 4, None, None, None, 0) for r in usable]
        return self.spark.createDataFrame(lines, LINES)

    def _list(self) -> DataFrame:
        """All pending directories, dealt out anew and listed."""
        roots, patterns = self.roots, self.patterns
        kinds = _arrow_kinds()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            walker, task = Walker(roots, patterns), TaskContext.get().partitionId()
            known = set(roots)
            for b in batches:
                for directory in b.column(0).to_pylist():
                    began, lines, n = time.monotonic(), [], 0
                    try:
                        for found, enter in walker.entries(directory):
                            n += 1
                            # a root within another one has been met as a root
                            if found and found[0] not in known:
                                lines.append((ROW, *found, None, None, None, task))
                            if enter and enter not in known:
                                lines.append((ENTER, enter, True, *[None] * 4, None, None, None, task))
                            if len(lines) >= 10_000:
                                yield _batch(lines, kinds)
                                lines = []
                        lines.append((DONE, directory, True, *[None] * 4, n, time.monotonic() - began, None, task))
                    except OSError as e:
                        lines.append((FAILED, directory, True, *[None] * 4, n, time.monotonic() - began, e.strerror or str(e), task))
                    yield _batch(lines, kinds)

        width = max(1, -(-self.rounds[-1].n_pending // self.per_task), min(self.rounds[-1].n_pending, self.spark.sparkContext.defaultParallelism))
        return self.pending().repartition(width, "path").mapInArrow(run, LINES)

    def step(self) -> Round:
        """One round. Its lines are written and counted in one pass, and stand once the checkpoint does."""
        began, number = time.time(), len(self.rounds)
        lines = self._list() if self.rounds else self._start()
        self.active = number if self.rounds else None
        counted = Observation(f"round-{number}")
        seen = lines.observe(counted, *[F.count_if(F.col("kind") == k).alias(k) for k in (ROW, ENTER, DONE, FAILED)])
        folder = f"crawl-{number:05d}-{time.time_ns()}"
        seen.write.parquet(f"{self.store.path}/{folder}")
        n = counted.get
        last = self.rounds[-1] if self.rounds else None
        done = Round(
            number, n[DONE] + n[FAILED], n[ROW], n[ENTER], n[FAILED], (last.total_rows if last else 0) + n[ROW], (last.total_listed if last else 0) + n[DONE] + n[FAILED],
            max(last.most_pending if last else 0, n[ENTER]), time.time() - began,
        )
        self.folders, self.rounds, self.active = [*self.folders, folder], [*self.rounds, done], None
        self.store.note_checkpoint({"roots": self.roots, "patterns": self.patterns, "saved_at": time.time(), "folders": self.folders, "rounds": [vars(r) for r in self.rounds], "skipped": self.skipped})
        return done

    def run(self, most_rounds: int | None = None) -> bool:
        """Rounds until nothing is pending, or so many; True if the crawl is at its end."""
        while not self.finished and (most_rounds is None or most_rounds > 0):
            self.step()
            most_rounds = None if most_rounds is None else most_rounds - 1
        return self.finished

    def publish(self) -> Manifest:
        """The crawl's rows as a new version of the store; the rounds are no longer needed then."""
        if not self.finished:
            raise RuntimeError("directories are still pending")
        held = self.store.manifest()
        out = self.store.write(catalog.with_virtual(self.rows()), self.roots, self.patterns, expected=held.version if held else None)
        for folder in self.folders:
            self.store.delete(folder)
        return out


def _arrow_kinds() -> list[pa.DataType]:
    text, whole, when = pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")
    return [text, text, pa.bool_(), whole, when, when, text, whole, pa.float64(), text, pa.int32()]


def _batch(lines: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines, strict=True), kinds, strict=True)], names=NAMES)
