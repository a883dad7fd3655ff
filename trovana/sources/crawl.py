"""A Python data source that lists directories: ``spark.read.format("trovana_crawl")``.

The driver walks down only until there are enough directories to deal out; each partition
then walks its own, pruning excluded subtrees before it lists them. Symbolic links are
rows of their own and never followed.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trovana.operators import catalog, exclusion

SCHEMA = "path string, is_directory boolean, size_bytes long, modified_time timestamp, created_time timestamp, volume_name string"
#: Directories to deal out before partitions take over.
FRONTIER = 64


class Walker:
    """Decides with the same compiled rules as the columns do, one path at a time."""

    def __init__(self, roots: list[str], patterns: list[str]):
        self.roots = sorted(roots, key=len, reverse=True)
        self.rules = [(r, re.compile(r.for_file) if r.for_file else None, re.compile(r.for_directory) if r.for_directory else None) for r in exclusion.compile_rules(patterns)]

    def decision(self, path: str, is_directory: bool) -> str:
        rels = [path[len(r.rstrip("/")) + 1 :] for r in self.roots if path.startswith(r.rstrip("/") + "/")] or ([""] if path in self.roots else [path.strip("/")])
        last = -1
        for i, (_, file, directory) in enumerate(self.rules):
            e = directory if is_directory else file
            if e and any(rel and e.search(rel) for rel in rels):
                last = i
        rule = self.rules[last][0] if last >= 0 else None
        excluded = rule is not None and not rule.negated
        if not is_directory:
            return exclusion.PRUNE if excluded else exclusion.INDEX
        if rule is not None and rule.traversal:
            return exclusion.DESCEND
        if not excluded:
            return exclusion.INDEX
        for r, _, _ in self.rules[last + 1 :]:
            p = r.literal_prefix
            if r.negated and not r.traversal and p and any(not rel or rel == p or p.startswith(rel + "/") or rel.startswith(p + "/") for rel in rels):
                return exclusion.DESCEND
        return exclusion.PRUNE

    def list(self, directory: str) -> Iterator[tuple]:
        """``entries``; unreadable directories are empty."""
        with contextlib.suppress(OSError):
            yield from self.entries(directory)

    def root_row(self, root: str) -> tuple:
        return row(root, os.lstat(root))

    def entries(self, directory: str) -> Iterator[tuple]:
        """(row or None, directory to enter or None) of what lies in a directory and the rules leave."""
        for e in sorted(os.scandir(directory), key=lambda e: e.name):
            try:
                s = e.stat(follow_symlinks=False)
            except OSError:
                continue
            is_directory = stat.S_ISDIR(s.st_mode)
            choice = self.decision(e.path, is_directory)
            if choice != exclusion.PRUNE:
                yield (row(e.path, s) if choice == exclusion.INDEX else None, e.path if is_directory else None)

    def walk(self, directory: str) -> Iterator[tuple]:
        waiting = [directory]
        while waiting:
            for found, enter in self.list(waiting.pop()):
                if found:
                    yield found
                if enter:
                    waiting.append(enter)


def row(path: str, s: os.stat_result) -> tuple:
    born = getattr(s, "st_birthtime", 0)
    when = lambda t: datetime.fromtimestamp(t, UTC).replace(tzinfo=None)
    return path, stat.S_ISDIR(s.st_mode), max(s.st_size, 0), when(s.st_mtime), when(born) if born else None, str(s.st_dev)


def preflight(roots: list[str], patterns=()) -> dict[str, str]:
    """Why a root can't be scanned: missing, notDirectory, notReadable, excluded (by the rules of a root above it), or readable."""
    out = {}
    walker = Walker(roots, patterns)
    for r in roots:
        out[r] = "missing" if not os.path.lexists(r) else "notDirectory" if os.path.islink(r) or not os.path.isdir(r) else "readable" if os.access(r, os.R_OK | os.X_OK) else "notReadable"
        if out[r] == "readable" and walker.decision(r, True) == exclusion.PRUNE:
            out[r] = "excluded"
    return out


class Part(InputPartition):
    def __init__(self, directories: list[str], rows: list[tuple]):
        self.directories, self.rows = directories, rows


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.patterns = json.loads(options.get("patterns", "null")) or []
        self.width = int(options.get("partitions", "8"))
        self.shallow = options.get("shallow", "false").lower() == "true"

    def partitions(self) -> list[Part]:
        w = Walker(self.roots, self.patterns)
        usable = [r for r, state in preflight(self.roots).items() if state == "readable"]
        rows = [row(r, os.lstat(r)) for r in usable]
        frontier = list(dict.fromkeys(usable))
        if self.shallow:
            return [Part([], rows + [x for d in frontier for x, _ in w.list(d) if x])]
        while frontier and len(frontier) < FRONTIER:
            below = []
            for d in frontier:
                for found, enter in w.list(d):
                    if found:
                        rows.append(found)
                    if enter:
                        below.append(enter)
            frontier = below
        parts = [Part(frontier[i :: self.width], []) for i in range(self.width) if frontier[i :: self.width]]
        return [Part([], rows), *parts]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows
        w = Walker(self.roots, self.patterns)
        for d in partition.directories:
            yield from w.walk(d)


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trovana_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CrawlReader(self.options)


def crawl(spark: SparkSession, roots: list[str], patterns=exclusion.DEFAULT_PATTERNS, partitions: int = 8, shallow: bool = False) -> DataFrame:
    """Catalog rows of everything under the roots that the rules leave; nested roots count once."""
    spark.dataSource.register(CrawlSource)
    raw = spark.read.format("trovana_crawl").options(roots=json.dumps(list(roots)), patterns=json.dumps(list(patterns)), partitions=str(partitions), shallow=str(shallow)).load()
    return catalog.derive(raw.dropDuplicates(["path"]))
