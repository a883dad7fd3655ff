"""Aggregates that are kept between batches: partial results by key, merged when they are read.

Each batch adds its own partial aggregate, published under its number, so a batch that is run again counts once.
Reading merges the last base with the parts after it; compacting makes these a new base. Only sums, minima and
maxima are kept, which merge in any order, so what one batch adds is small whatever is kept already, and a key that
most rows have is one row of each part.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.operators import insights
from trovana.sources.snapshot import Store

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


class Kept:
    """``values`` names each kept column's way of merging: sum, min or max."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], values: dict[str, str]):
        self.spark, self.keys, self.values = spark, keys, values
        self._store = Store(spark, path)

    def _names(self, kind: str) -> list[int]:
        """Numbers published under ``kind``, in order."""
        place = self._store._at(kind)
        if not self._store._fs.exists(place):
            return []
        return sorted(int(n[:-5]) for n in (x.getPath().getName() for x in self._store._fs.listStatus(place)) if n.endswith(".json"))

    def _folder(self, kind: str, number: int) -> str:
        return f"{self._store.path}/{json.loads(self._store._read(f'{kind}/{number:012d}.json') or '{}')['folder']}"

    def _publish(self, rows: DataFrame, kind: str, number: int) -> None:
        folder = f"{kind}-{number:012d}-{time.time_ns()}"
        rows.write.parquet(f"{self._store.path}/{folder}")
        self._store._write(f"{kind}/{number:012d}.json", json.dumps({"folder": folder}))

    @property
    def upto(self) -> int:
        """The last batch that the base holds; -1 without a base."""
        return max(self._names("base"), default=-1)

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[_MERGE[how](v).alias(v) for v, how in self.values.items()])

    def add(self, partial: DataFrame, batch: int) -> bool:
        """Rows with the keys and values, of a batch; False if the batch has been counted before."""
        if batch <= self.upto or batch in self._names("part"):
            return False
        self._publish(self.merged(partial.select(*self.keys, *self.values)), "part", batch)
        return True

    def read(self) -> DataFrame | None:
        """One row a key; None if nothing was ever added."""
        base, parts = self.upto, [n for n in self._names("part") if n > self.upto]
        folders = ([self._folder("base", base)] if base >= 0 else []) + [self._folder("part", n) for n in parts]
        return self.merged(self.spark.read.parquet(*folders)) if folders else None

    def compact(self, where: str | None = None) -> int:
        """All parts become a new base, less the keys that ``where`` leaves out; returns how many were taken up."""
        before, parts = self.upto, [n for n in self._names("part") if n > self.upto]
        if not parts:
            return 0
        rows = self.read()
        self._publish(rows.where(where) if where else rows, "base", parts[-1])
        # what the new base holds is read no more
        for kind, numbers in (("part", [n for n in self._names("part") if n <= parts[-1]]), ("base", [before] if before >= 0 else [])):
            for n in numbers:
                folder = self._folder(kind, n).removeprefix(f"{self._store.path}/")
                self._store.delete(f"{kind}/{n:012d}.json")
                self._store.delete(folder)
        return len(parts)


def kept_rollup(spark: SparkSession, path: str) -> Kept:
    """Figures per root, as sums of changes: what came in less what went."""
    return Kept(spark, path, ("root",), dict.fromkeys(insights.ROLLUP, "sum"))


def rollup_change(added: DataFrame, removed: DataFrame) -> DataFrame:
    """The roll-ups of rows that came and of rows that went, as one change."""
    minus = removed.select("root", *[(-F.col(c)).alias(c) for c in insights.ROLLUP])
    return added.select("root", *insights.ROLLUP).unionByName(minus)


def kept_actions(spark: SparkSession, path: str) -> Kept:
    """Actions per local day, with when the first and the last was."""
    return Kept(spark, path, ("day", "action"), {"n": "sum", "first_seen": "min", "last_seen": "max"})


def action_part(events: DataFrame) -> DataFrame:
    """A batch's part of ``kept_actions``: events (ts, action)."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return events.where("ts is not null and action is not null").groupBy(day, "action").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def kept_searches(spark: SparkSession, path: str) -> Kept:
    """Searches by route: how many, how many completed, all their seconds and the slowest."""
    return Kept(spark, path, ("execution_path",), {"n_searches": "sum", "n_completed": "sum", "total_latency": "sum", "slowest": "max"})


def search_part(profiles: DataFrame) -> DataFrame:
    """A batch's part of ``kept_searches``: profiles (execution_path, completed, elapsed)."""
    done = F.col("completed")
    return profiles.groupBy("execution_path").agg(
        F.count("*").alias("n_searches"), F.count_if(done).alias("n_completed"), F.coalesce(F.sum(F.when(done, F.col("elapsed"))), F.lit(0.0)).alias("total_latency"), F.max("elapsed").alias("slowest")
    )
