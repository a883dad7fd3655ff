"""JSON sources and sinks: diagnostic events, usage metrics, property lists, change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.operators import diagnostics

METRICS_SCHEMA = "version int, firstLaunch timestamp, started long, completed long, cancelled long, totalLatency double, routeCounts map<string,long>, latencyBuckets map<string,long>, days array<struct<day:string,completed:long>>"
METRICS_VERSION = 2
EVENTS_SCHEMA = "path string, flags long, event_id long"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Diagnostic lines; ``_malformed`` holds those that can't be read."""
    schema = diagnostics.EVENT_SCHEMA + ", _malformed string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed").json(path)


def malformed(events: DataFrame) -> DataFrame:
    # a column besides that of malformed lines has to be read for them to be told
    return events.agg(F.count_if(F.col("_malformed").isNotNull() & F.coalesce(F.length("event") >= 0, F.lit(True))).alias("n_malformed"))


def write_events(events: DataFrame, path: str, lines_per_file: int = 50_000) -> None:
    """JSON lines in files of a bounded number of lines."""
    kept = events.where("_malformed is null").drop("_malformed") if "_malformed" in events.columns else events
    kept.write.option("maxRecordsPerFile", lines_per_file).mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Usage metrics; what is missing counts as zero, older versions become the present one."""
    raw = spark.read.schema(METRICS_SCHEMA).option("multiLine", "true").json(path)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("started", "completed", "cancelled")}
    empty = F.create_map().cast("map<string,bigint>")
    return raw.withColumns(
        {
            **zero,
            "totalLatency": F.coalesce("totalLatency", F.lit(0.0)),
            "routeCounts": F.coalesce("routeCounts", empty),
            "latencyBuckets": F.coalesce("latencyBuckets", empty),
            "days": F.coalesce("days", F.array().cast("array<struct<day:string,completed:bigint>>")),
            "version": F.lit(METRICS_VERSION),
        }
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def property_lists(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the Info.plist files of bundles."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Info.plist").load(path).select("path", "content")
