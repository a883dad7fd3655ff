"""A change feed with event ids as offsets: ``spark.readStream.format("trovana_changes")``.

The feed is a folder of JSON lines (path, flags, event_id); each file's name begins with the ids of its first and last
event, as ``ChangeLog.append`` writes them, so which files a range of ids needs is read off a listing. An offset is
the last id taken: a query that starts again goes on behind it, a new one starts behind the cursors of its roots, from
the beginning, or from now on. A replay takes what there is up to the event that says that history is done.

Cursors lie in the folder beside the feed: a file for each update, the latest readable one counting.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from trovana.operators import changes

SCHEMA = "path string, flags long, event_id long"
#: Events that a task reads, about: small files share a task, none is cut.
PER_TASK = 100_000
#: Seconds after which a replay that has seen no end of history gives up.
REPLAY_SECONDS = 30.0


@dataclass(frozen=True)
class File:
    first: int
    last: int
    n: int
    path: str


def listed(folder: str) -> list[File]:
    """The feed's files by their first event; names of others are passed over."""
    out = []
    for entry in os.scandir(folder) if os.path.isdir(folder) else []:
        parts = entry.name.removesuffix(".jsonl").split("-")
        if entry.name.endswith(".jsonl") and len(parts) >= 3 and all(p.isdigit() for p in parts[:3]):
            out.append(File(*map(int, parts[:3]), entry.path))
    return sorted(out, key=lambda f: (f.first, f.last, f.path))


class ChangeLog:
    """The feed's folder as its writers and its cursors' keeper see it. It must be mounted wherever tasks run."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").rstrip("/")

    def append(self, events: list[tuple[str, int, int]]) -> None:
        """Events as they come (path, flags, id) become one file, which appears whole."""
        if not events:
            return
        os.makedirs(self.folder, exist_ok=True)
        ids = [e[2] for e in events]
        name = f"{min(ids):020d}-{max(ids):020d}-{len(ids):09d}-{time.time_ns()}.jsonl"
        temp = f"{self.folder}/.temp-{name}"
        with open(temp, "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"path": p, "flags": g, "event_id": i}) + "\n" for p, g, i in events)
        os.rename(temp, f"{self.folder}/{name}")

    def latest_id(self) -> int:
        return max((f.last for f in listed(self.folder)), default=0)

    # --- cursors

    def cursors(self) -> dict[str, int]:
        place = f"{self.folder}/cursors"
        for name in sorted(os.listdir(place), reverse=True) if os.path.isdir(place) else []:
            try:
                with open(f"{place}/{name}", encoding="utf-8") as f:
                    return {str(k): int(v) for k, v in json.load(f).items()}
            except (OSError, ValueError):  # a file that was cut short
                continue
        return {}

    def _save(self, cursors: dict[str, int]) -> None:
        place = f"{self.folder}/cursors"
        os.makedirs(place, exist_ok=True)
        name = f"{time.time_ns():020d}.json"
        with open(f"{place}/.{name}", "w", encoding="utf-8") as f:
            json.dump(cursors, f)
        os.rename(f"{place}/.{name}", f"{place}/{name}")
        for old in sorted(n for n in os.listdir(place) if not n.startswith("."))[:-3]:
            os.remove(f"{place}/{old}")

    def update(self, latest: dict[str, int]) -> None:
        """Cursors never go back."""
        if latest:
            held = self.cursors()
            self._save(held | {r: max(i, held.get(r, 0)) for r, i in latest.items()})

    def mark_baseline(self, roots: list[str], event_id: int | None = None) -> None:
        """From now on: what has happened up to here is known."""
        at = self.latest_id() if event_id is None else event_id
        self.update(dict.fromkeys(roots, at))

    def invalidate(self, roots: list[str]) -> None:
        """The roots' past is not known any more: the next catch-up scans them."""
        self._save({r: i for r, i in self.cursors().items() if r not in set(roots)})

    def since(self, roots: list[str]) -> int | None:
        """Where a replay for some roots begins: behind the earliest of their cursors; None if one has none."""
        held = self.cursors()
        return None if not roots or any(r not in held for r in roots) else min(held[r] for r in roots)


class Slice(InputPartition):
    def __init__(self, paths: list[str], after: int, upto: int):
        self.paths, self.after, self.upto = paths, after, upto


def _slices(options: dict, after: int, upto: int) -> list[InputPartition]:
    most = int(options.get("perTask", str(PER_TASK)))
    out: list[list[str]] = []
    held = most
    for f in listed(options["path"].removeprefix("file://")):
        if f.last > after and f.first <= upto:
            if held + f.n > most:
                out.append([])
                held = 0
            out[-1].append(f.path)
            held += f.n
    return [Slice(paths, after, upto) for paths in out or [[]]]


def _read(part: Slice) -> Iterator[tuple]:
    """The slice's events; lines that aren't JSON, such as a last one that was cut off, are passed over."""
    for path in part.paths:
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                try:
                    e = json.loads(line)
                    found = str(e["path"]), int(e["flags"]), int(e["event_id"])
                except (ValueError, KeyError, TypeError):
                    continue
                if part.after < found[2] <= part.upto:
                    yield found


class ChangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _slices(self.options, int(self.options.get("after", "0")), int(self.options.get("upto", str(1 << 62))))

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(partition)


class ChangeStreamReader(DataSourceStreamReader):
    """Offsets are {"event_id": the last id taken}; ids grow, so a file that comes later with lower ones isn't read.

    A batch is all there is behind the last one: Spark asks a Python source for no less. Its tasks are cut by events.
    """

    def __init__(self, options: dict):
        self.options, self.log = options, ChangeLog(options["path"])

    def initialOffset(self) -> dict:
        start = self.options.get("after", "beginning")
        return {"event_id": self.log.latest_id() if start == "now" else 0 if start == "beginning" else int(start)}

    def latestOffset(self) -> dict:
        # never before where the query begins, if its cursor is ahead of the feed
        start = self.options.get("after", "beginning")
        return {"event_id": max(self.log.latest_id(), int(start) if start.isdigit() else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _slices(self.options, start["event_id"], end["event_id"])

    def read(self, partition: Slice) -> Iterator[tuple]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to give back: files stay for other readers."""


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trovana_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChangeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeStreamReader(self.options)


def read_changes(spark: SparkSession, folder: str, after: str | int = "beginning", per_task: int = PER_TASK) -> DataFrame:
    """The feed as a stream, behind an event id, from the ``beginning``, or from ``now`` on."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format("trovana_changes").options(path=folder, after=str(after), perTask=str(per_task)).load()


def history(spark: SparkSession, folder: str, after: int = 0, upto: int = 1 << 62) -> DataFrame:
    """The events with ids beyond ``after``, up to ``upto``."""
    spark.dataSource.register(ChangeSource)
    return spark.read.format("trovana_changes").options(path=folder, after=str(after), upto=str(upto)).load()


def wait_for_history(spark: SparkSession, folder: str, after: int, seconds: float = REPLAY_SECONDS, pause: float = 0.2) -> int | None:
    """The id of the first event beyond ``after`` that says history is done; None if none comes in time."""
    until, seen = time.monotonic() + seconds, after
    while True:
        end = ChangeLog(folder).latest_id()
        if end > seen:
            found = history(spark, folder, seen, end).where(changes.has(changes.HISTORY_DONE)).agg(F.min("event_id")).first()[0]
            if found is not None:
                return found
            seen = end
        if time.monotonic() >= until:
            return None
        time.sleep(min(pause, max(0.0, until - time.monotonic())))


def catch_up(spark: SparkSession, folder: str, roots: list[str], patterns=changes.exclusion.DEFAULT_PATTERNS, seconds: float = REPLAY_SECONDS) -> tuple[str, DataFrame | None, dict[str, int]]:
    """What to do after a downtime, by the roots' cursors and the history since: the action, its scopes, and the new cursors.

    Without cursors for all roots, or without an end of history in time, everything has to be scanned. Each root's
    events count from its own cursor on.
    """
    from trovana.operators import catalog

    log = ChangeLog(folder)
    begin = log.since(roots)
    if begin is None:
        return "full", None, {}
    upto = wait_for_history(spark, folder, begin, seconds)
    if upto is None:
        return "full", None, {}
    table = catalog.roots_table(spark, roots)
    events = history(spark, folder, begin, upto)
    known = spark.createDataFrame(list(log.cursors().items()), "root string, cursor long")  # as many as roots
    fresh = changes.with_event_root(events, table).join(F.broadcast(known), "root", "left")
    fresh = fresh.where(changes.has(changes.HISTORY_DONE) | F.col("root").isNull() | (F.col("event_id") > F.col("cursor"))).select("path", "flags", "event_id")
    action, scopes = changes.catch_up(fresh, table, roots, patterns=patterns)
    return action, scopes, dict.fromkeys(roots, upto)


def replay(spark: SparkSession, folder: str, roots: list[str], apply, checkpoint: str) -> StreamingQuery:
    """History since the roots' cursors, to its present end, given to ``apply`` (events, batch id); cursors follow each batch."""
    log = ChangeLog(folder)

    def run(events: DataFrame, number: int) -> None:
        apply(events, number)
        latest = events.agg(F.max("event_id")).first()[0]
        if latest is not None:
            log.update(dict.fromkeys(roots, latest))

    feed = read_changes(spark, folder, log.since(roots) or 0)
    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
