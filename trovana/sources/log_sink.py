"""A rotating sink for diagnostic events: ``df.write.format("trovana_log")``.

Lines are made by Spark: an event's line is its JSON with capped fields, with more narrowly capped ones if that
is too long, or else an event that says so. Tasks write parts of a bounded size that no reader sees; committing puts
them in their places, all or none of a write, and takes old parts away, by age and by the size of all.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trovana.operators import diagnostics

#: Bytes of a line and of a part, the caps of fields (length of texts, number of texts), first and then.
LINE_BYTES, PART_BYTES = 64 * 1024, 5 * 1024 * 1024
CAPS = ((4096, 50), (1024, 10))
#: Bytes of all parts, and seconds that a part is kept.
TOTAL_BYTES, AGE_SECONDS = 50 * 1024 * 1024, 14 * 86_400.0
TOO_LARGE = ("diagnosticLog", "diagnosticLog.eventTooLarge")


def _line(events: DataFrame, fields: Column) -> Column:
    rest = [c for c in ("schemaVersion", "timestamp", "level", "category", "event") if c in events.columns]
    return F.to_json(F.struct(*rest, fields.alias("fields")))


def lines(events: DataFrame, most: int = LINE_BYTES) -> DataFrame:
    """``line`` of each event, and ``form``: whole, reduced or tooLarge. No line, its end included, has more than ``most`` bytes."""
    out = events.where("_malformed is null").drop("_malformed") if "_malformed" in events.columns else events
    public = lambda value, kind: F.struct(F.lit("public").alias("privacy"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    told = F.create_map(F.lit("originalCategory"), public(F.col("category"), "string"), F.lit("originalEvent"), public(F.col("event"), "string"), F.lit("fieldCount"), public(F.coalesce(F.size("fields"), F.lit(0)), "int"))
    instead = F.struct(
        *[F.col(c) for c in ("schemaVersion", "timestamp", "level") if c in out.columns], F.lit(TOO_LARGE[0]).alias("category"), F.lit(TOO_LARGE[1]).alias("event"), told.alias("fields")
    )
    for name, (longest, texts) in zip(("_whole", "_reduced"), CAPS, strict=True):
        out = out.withColumn(name, _line(events, diagnostics.capped_fields(events, longest, texts)))
    fits = lambda c: F.octet_length(c) < most
    form = F.when(fits("_whole"), "whole").when(fits("_reduced"), "reduced").otherwise("tooLarge")
    line = F.when(fits("_whole"), F.col("_whole")).when(fits("_reduced"), F.col("_reduced")).otherwise(F.to_json(instead))
    return out.select(line.alias("line"), form.alias("form"))


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, int]]


class LogWriter(DataSourceArrowWriter):
    """Parts appear in the folder under names that sort by time of writing, once all tasks are done."""

    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.part_bytes = int(options.get("partBytes", str(PART_BYTES)))
        self.total_bytes = int(options.get("totalBytes", str(TOTAL_BYTES)))
        self.age = float(options.get("ageSeconds", str(AGE_SECONDS)))
        self.write_id = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place = f"{self.folder}/.writing-{self.write_id}"
        os.makedirs(place, mode=0o700, exist_ok=True)
        parts: list[tuple[str, int]] = []
        out = None
        try:
            for batch in iterator:
                for line in batch.column(0):
                    raw = (line.as_py() or "").encode() + b"\n"
                    if out is None or parts[-1][1] + len(raw) > self.part_bytes:
                        if out:
                            out.close()
                        name = uuid.uuid4().hex  # a task that is tried again writes others
                        parts.append((name, 0))
                        out = os.fdopen(os.open(f"{place}/{name}", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb")
                    out.write(raw)
                    parts[-1] = (parts[-1][0], parts[-1][1] + len(raw))
        finally:
            if out:
                out.close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        place = f"{self.folder}/.writing-{self.write_id}"
        stamp, n = time.time_ns(), 0
        for message in messages:
            for name, _ in message.parts if message else []:
                os.rename(f"{place}/{name}", f"{self.folder}/events-{stamp:020d}-{n:05d}.jsonl")
                n += 1
        self.abort(messages)
        prune(self.folder, self.total_bytes, self.age)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks have written goes, that of tasks tried more than once too."""
        place = f"{self.folder}/.writing-{self.write_id}"
        for name in os.listdir(place) if os.path.isdir(place) else []:
            os.remove(f"{place}/{name}")
        if os.path.isdir(place):
            os.rmdir(place)


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trovana_log"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


def prune(folder: str, total_bytes: int = TOTAL_BYTES, age: float = AGE_SECONDS, now: float | None = None) -> list[str]:
    """Parts that are too old go, then the oldest until the rest is small enough; the newest part is no exception."""
    now = time.time() if now is None else now
    found = sorted((e.stat().st_mtime, e.name, e.stat().st_size) for e in os.scandir(folder) if e.name.startswith("events-") and e.name.endswith(".jsonl"))
    gone = [name for at, name, _ in found if now - at > age]
    kept = [(name, size) for at, name, size in found if now - at <= age]
    left = sum(size for _, size in kept)
    for name, size in kept:
        if left <= total_bytes:
            break
        gone.append(name)
        left -= size
    for name in gone:
        os.remove(f"{folder}/{name}")
    return gone


def write_rotating(events: DataFrame, folder: str, part_bytes: int = PART_BYTES, total_bytes: int = TOTAL_BYTES, age: float = AGE_SECONDS) -> None:
    """Append events to a log folder, which must be mounted wherever tasks run."""
    events.sparkSession.dataSource.register(LogSink)
    options = {"path": folder, "partBytes": str(part_bytes), "totalBytes": str(total_bytes), "ageSeconds": str(age)}
    lines(events).select("line").write.format("trovana_log").mode("append").options(**options).save()
