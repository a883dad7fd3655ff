"""Versioned snapshots: Parquet directories, and a manifest for each that is published last.

Everything goes through Spark or Hadoop's file system, so a snapshot can lie in any store
that Spark reads. A version is never overwritten; readers hold the one they resolved, the
latest whose manifest can be read. A writer claims its version's number by creating a file
that must not exist, so two writers never work on one. Between versions, changes lie in
deltas: of metadata, of rows, and of subtrees that are gone.
"""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.operators import catalog, changes

SCHEMA_VERSION = 1
#: Old versions that are kept beside the current one, and seconds after which a stray one goes.
KEPT, STALE_SECONDS = 1, 600


@dataclass(frozen=True)
class Manifest:
    version: int
    saved_at: float
    roots: list[str]
    patterns: list[str]
    n_rows: int
    schema: int = SCHEMA_VERSION
    base: int | None = None


class PublishRule:
    """When a running scan is published: after so many rows or seconds, whichever comes first."""

    def __init__(self, rows: int = 25_000, seconds: float = 1.0):
        self.most_rows, self.most_seconds = rows, seconds
        self.rows, self.since = 0, time.monotonic()

    def due(self, more: int) -> bool:
        self.rows += more
        if self.rows and (self.rows >= self.most_rows or time.monotonic() - self.since >= self.most_seconds):
            self.rows, self.since = 0, time.monotonic()
            return True
        return False


def checkpoint_rule(first: bool) -> PublishRule:
    """When a running scan is checkpointed: the first time sooner than later ones."""
    return PublishRule(25_000, 60.0) if first else PublishRule(100_000, 300.0)


class Store:
    """Snapshots under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _write(self, name: str, text: str) -> None:
        """Written beside its place and renamed into it; the name must be new."""
        temp = self._at(f"temp-{time.time_ns()}")
        self._fs.mkdirs(self._at(name).getParent())
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(temp, self._at(name)):
            self._fs.delete(temp, False)
            raise OSError(f"could not publish {name}")

    def _claim(self, version: int) -> bool:
        """True for one writer only; a claim that has led to nothing for a while may be taken over."""
        path = self._at(f"claims/{version:012d}")
        self._fs.mkdirs(path.getParent())
        if self._fs.exists(path) and version not in self._published() and time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(path, False)
        return bool(self._fs.createNewFile(path))

    @contextlib.contextmanager
    def held(self, rows: DataFrame, name: str) -> Iterator[DataFrame]:
        """Rows written down for a while, so that what reads them several times sees one state."""
        path = f"{self.path}/temp-{name}-{time.time_ns()}"
        rows.write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)

    def _read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def _published(self) -> list[int]:
        """Versions with a manifest, the latest first."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("manifests"))]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def manifest(self) -> Manifest | None:
        """The latest version's whose manifest can be read, has this schema and still has its rows; None without one."""
        for version in self._published():
            try:
                found = Manifest(**json.loads(self._read(f"manifests/{version:012d}.json") or "null"))
            except Exception:  # a file that was cut short or written by another schema
                continue
            if found.schema == SCHEMA_VERSION and self._fs.exists(self._at(f"v{found.version}/rows")):
                return found
        return None

    def write(self, tree: DataFrame, roots: list[str], patterns: list[str], expected: int | None = None, orders: tuple[str, ...] = ()) -> Manifest:
        """A new version of the whole tree, in depth-first order; refused if another writer came first.

        ``expected`` is the version that the caller read. ``orders`` names columns by which further copies are kept
        in order, so that a range of theirs reads few files.
        """
        now = self.manifest()
        if expected is not None and (now.version if now else None) != expected:
            raise RuntimeError("the snapshot has changed since it was read")
        version = (expected if expected is not None else max([0, *self.versions(), *self._published()])) + 1
        while not self._claim(version):
            if expected is not None:
                raise RuntimeError("another writer is at the next version")
            version += 1
        path = f"{self.path}/v{version}"
        parts = tree.withColumn("_c", catalog.text.components(F.col("path")))
        parts.repartitionByRange("_c").sortWithinPartitions("_c").drop("_c").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
        kept = self.spark.read.parquet(f"{path}/rows")
        for order in orders:
            kept.repartitionByRange(order, "path").sortWithinPartitions(order, "path").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/by_{order}")
        found = Manifest(version, time.time(), list(roots), list(patterns), kept.count())
        self._write(f"manifests/{version:012d}.json", json.dumps(asdict(found)))
        return found

    def publish(self, parts: Iterable[DataFrame], roots: list[str], patterns: list[str], rule: PublishRule | None = None) -> list[Manifest]:
        """Versions of a scan that comes in parts: what has come is published whenever the rule says so, and at the end."""
        rule = rule or PublishRule()
        out, rows = [], None
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
            if rule.due(part.count()):
                out.append(self.write(catalog.with_virtual(rows), roots, patterns))
                rows = self.spark.read.parquet(f"{self.path}/v{out[-1].version}/rows").where("not is_virtual").drop("is_virtual")
        if rows is not None and (rule.rows or not out):
            out.append(self.write(catalog.with_virtual(rows), roots, patterns))
        return out

    def ordered(self, order: str) -> DataFrame | None:
        """The current version in another order; None if it wasn't kept or deltas have come since."""
        m = self.manifest()
        if m is None or self.pending() or not self._fs.exists(self._at(f"v{m.version}/by_{order}")):
            return None
        return self.spark.read.parquet(f"{self.path}/v{m.version}/by_{order}")

    def _deltas(self, kind: str) -> DataFrame | None:
        m = self.manifest()
        if m is None or not self._fs.exists(self._at(f"v{m.version}/deltas/{kind}")):
            return None
        return self.spark.read.parquet(f"{self.path}/v{m.version}/deltas/{kind}/*")

    def tree(self) -> DataFrame | None:
        """All rows of the current version, virtual ones included, under its deltas."""
        m = self.manifest()
        if m is None:
            return None
        rows = self.spark.read.parquet(f"{self.path}/v{m.version}/rows")
        new, gone, delta = (self._deltas(k) for k in ("rows", "gone", "metadata"))
        if new is None and gone is None:
            return rows if delta is None else changes.replace_metadata(rows, changes.latest(delta, order="batch"))
        # of a path the latest row counts, if no subtree that it lies in has gone since
        real = (catalog.results_only(rows) if "is_virtual" in rows.columns else rows).withColumn("batch", F.lit(-1).cast("long"))
        if new is not None:
            old = real.join(new.select("path").distinct(), "path", "left_anti").select(*real.columns)
            real = old.unionByName(changes.latest(new.select(*real.columns), order="batch"))
        if gone is not None:
            tops = gone.groupBy(F.col("path").alias("ancestor")).agg(F.max("batch").alias("_gone"))
            above = real.select("path", "batch", F.explode(catalog.ancestors(F.col("path"), True)).alias("ancestor"))
            real = real.join(above.join(tops, "ancestor").where("_gone > batch").select("path").distinct(), "path", "left_anti").select(*real.columns)
        if delta is not None:
            last = changes.latest(delta, order="batch").withColumnRenamed("batch", "_at")
            since = last.join(real.select("path", "batch"), "path").where("_at > batch").drop("_at", "batch")
            real = changes.replace_metadata(real, since)
        return catalog.with_virtual(real.drop("batch"))

    def rows(self) -> DataFrame | None:
        """What searches see: no virtual rows."""
        tree = self.tree()
        return None if tree is None else catalog.results_only(tree) if "is_virtual" in tree.columns else tree

    def _append(self, kind: str, rows: DataFrame, batch: int) -> None:
        m = self.manifest()
        if m is None:
            raise RuntimeError("no snapshot to change")
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/v{m.version}/deltas/{kind}/b{batch:012d}")

    def append_delta(self, delta: DataFrame, batch: int) -> None:
        """Metadata changes of the current version; the same batch written twice counts once."""
        self._append("metadata", delta.select("path", *changes.METADATA), batch)

    def append_rows(self, upserts: DataFrame, gone: DataFrame, batch: int) -> None:
        """Rows that are new or have changed, and paths whose subtrees are gone; in a batch the rows win."""
        self._append("rows", upserts.select(*catalog.COLUMNS), batch)
        self._append("gone", gone.select("path"), batch)

    def delta(self) -> DataFrame | None:
        """The latest metadata change of each path; None without any. Deltas of other versions don't count."""
        found = self._deltas("metadata")
        return None if found is None else changes.latest(found, order="batch")

    def pending(self) -> int:
        """Rows of all deltas of the current version."""
        return sum(d.count() for d in map(self._deltas, ("metadata", "rows", "gone")) if d is not None)

    def compact(self) -> Manifest:
        m = self.manifest()
        return self.write(self.tree(), m.roots, m.patterns, expected=m.version)

    def checkpoint(self, rows: DataFrame, roots: list[str], patterns: list[str], done: list[str]) -> None:
        """Rows scanned so far and the directories that are done."""
        stamp = f"{time.time_ns():020d}"
        rows.write.parquet(f"{self.path}/checkpoint-{stamp}")
        self._write(f"checkpoints/{stamp}.json", json.dumps({"roots": list(roots), "patterns": list(patterns), "saved_at": time.time(), "rows": f"checkpoint-{stamp}", "done": done}))

    def note_checkpoint(self, found: dict) -> None:
        """A checkpoint that tells of roots, patterns, when it was saved, and where a crawl's rounds lie."""
        self._write(f"checkpoints/{time.time_ns():020d}.json", json.dumps(found))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def _checkpoint(self) -> dict | None:
        """The latest checkpoint that can be read."""
        if not self._fs.exists(self._at("checkpoints")):
            return None
        for name in sorted((x.getPath().getName() for x in self._fs.listStatus(self._at("checkpoints"))), reverse=True):
            try:
                return json.loads(self._read(f"checkpoints/{name}") or "null")
            except Exception:  # a file that was cut short
                continue
        return None

    def resumable(self, roots: list[str], patterns: list[str], newer_than: float) -> bool:
        """May a checkpoint be taken up: same roots and patterns, newer than what is published?"""
        c = self._checkpoint()
        return bool(c) and c["roots"] == list(roots) and c["patterns"] == list(patterns) and c["saved_at"] > newer_than

    def resume(self) -> tuple[DataFrame, list[str]] | None:
        c = self._checkpoint()
        return (self.spark.read.parquet(f"{self.path}/{c['rows']}"), c["done"]) if c else None

    def clean(self, kept: int = KEPT) -> list[int]:
        """Delete versions before the current one, but for the latest ``kept``, and stray files that are old enough."""
        m = self.manifest()
        old = [v for v in self.versions() if m and v < m.version]
        gone = old[: len(old) - kept] if kept else old
        for v in gone:
            for name in (f"manifests/{v:012d}.json", f"claims/{v:012d}", f"v{v}"):
                self._fs.delete(self._at(name), True)
        for x in self._fs.listStatus(self._at("")) if self._fs.exists(self._at("")) else []:
            if x.getPath().getName().startswith("temp-") and time.time() - x.getModificationTime() / 1000 > STALE_SECONDS:
                self._fs.delete(x.getPath(), True)
        return gone

    def storage(self) -> list[tuple[str, int]]:
        """(part, bytes) of the current version."""
        m = self.manifest()
        parts = ["rows", "deltas"] if m else []
        return [(p, self._fs.getContentSummary(self._at(f"v{m.version}/{p}")).getLength()) for p in parts if self._fs.exists(self._at(f"v{m.version}/{p}"))]
