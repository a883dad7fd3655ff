"""Roll-ups: roots, extensions, search telemetry, usage and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovana.operators import catalog

#: Bounds of the latency buckets in seconds, lower-inclusive, and their names.
LATENCY = ((0.01, "<10ms"), (0.05, "10-50ms"), (0.1, "50-100ms"), (0.25, "100-250ms"), (1.0, "250ms-1s"))
SLOWEST = ">1s"
#: Indexes that count as mapped, and the routes of execution paths.
MAPPED_USES = ("nameGrams", "componentGrams", "pathGrams")
ROUTE_OF_PATH = {
    "emptyQuerySortedOrder": "sidecar",
    "extensionCandidateIntersection": "sidecar",
    "optimizedSortedFastPath": "sidecar",
    "nameComponentIndex": "mappedIndex",
    "pathGramIndex": "mappedIndex",
    "indexedCandidateIntersection": "mappedIndex",
    "unprofiledIndexed": "mappedIndex",
    "fullFallbackScan": "fullScan",
}
#: The file actions that are counted.
ACTIONS = ("open", "reveal", "copyFile", "copyPath", "quickLook", "rename", "moveToTrash", "getInfo")
KEPT_DAYS = 365


def counts(df: DataFrame) -> DataFrame:
    """One row: results, and visible ones."""
    return df.agg(F.count("*").alias("n_results"), F.count_if("is_visible").alias("n_visible"))


def root_rollup(df: DataFrame) -> DataFrame:
    """Per root: files, directories, hidden rows, bytes of files and of paths; rows outside all roots don't count."""
    rows = df.where("root is not null")
    if "is_virtual" in df.columns:
        rows = rows.where("not is_virtual")
    return rows.groupBy("root").agg(
        F.count_if(~F.col("is_directory")).alias("n_files"),
        F.count_if("is_directory").alias("n_directories"),
        F.count_if("is_hidden").alias("n_hidden"),
        F.sum(F.when(~F.col("is_directory"), F.col("size_bytes")).otherwise(0)).alias("content_bytes"),
        F.sum(F.octet_length("path")).alias("path_bytes"),
    )


ROLLUP = ("n_files", "n_directories", "n_hidden", "content_bytes", "path_bytes")


def updated_rollup(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A roll-up after a change: what came in less what went, no figure below 0."""
    signed = base.unionByName(added)
    minus = removed.select("root", *[(-F.col(c)).alias(c) for c in ROLLUP])
    return signed.unionByName(minus).groupBy("root").agg(*[F.greatest(F.lit(0), F.sum(c)).cast("long").alias(c) for c in ROLLUP])


def allocate(rollup: DataFrame, package_bytes: int, weight: str = "path_bytes") -> DataFrame:
    """``estimated_bytes``: a package's size in proportion to a weight, rounded; 0 if nothing weighs."""
    total = F.sum(weight).over(Window.partitionBy())
    return rollup.withColumn("estimated_bytes", F.when(total > 0, F.round(F.col(weight) / total * package_bytes)).otherwise(0).cast("long"))


def configured_roots(spark: SparkSession, rollup: DataFrame, configured: list[str]) -> DataFrame:
    """Configured roots in their order, zero-filled, then roots that only the snapshot has."""
    order = catalog.roots_table(spark, configured).withColumnRenamed("root_id", "position")
    if not configured:
        return rollup.withColumn("position", F.lit(None).cast("int")).withColumn("is_configured", F.lit(False))
    out = order.join(rollup, "root", "full")
    return out.select("root", "position", F.col("position").isNotNull().alias("is_configured"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ROLLUP])


def root_status(roots: DataFrame) -> DataFrame:
    """``status``: empty (no rows at all), unrepresented (no estimate either) or indexed."""
    none = (F.col("n_files") == 0) & (F.col("n_directories") == 0) & (F.col("content_bytes") == 0) & (F.col("path_bytes") == 0)
    estimate = F.col("estimated_bytes") if "estimated_bytes" in roots.columns else F.lit(0)
    return roots.withColumn("status", F.when(none & (estimate == 0), "unrepresented").when(none, "empty").otherwise("indexed"))


#: What a state of the index is called while a root has no rows.
PHASES = {"optimizing": "Optimizing", "saving": "Saving"}


def activity_label(phase: Column, indexing: Column, catching_up: Column, reconciling: Column, updating: Column) -> Column:
    scanning = F.when(reconciling, "Reconciling").when(updating, "Updating").otherwise("Indexing")
    label = F.when(phase == "scanning", scanning)
    for k, v in PHASES.items():
        label = label.when(phase == k, v)
    return F.when(phase == "loading", "Loading").when(~indexing, None).when(catching_up, "Catching up").otherwise(label)


def percent_text(part: Column, whole: Column) -> Column:
    """Whole per cents; below one "<1%"."""
    p = F.try_divide(part * 100.0, whole)
    return F.when(whole <= 0, "0%").when((p > 0) & (p < 1), "<1%").otherwise(F.concat(F.round(p).cast("long").cast("string"), F.lit("%")))


def share_text(part: Column, whole: Column) -> Column:
    """One decimal below ten per cent, "<0.1%" for less than that."""
    p = F.try_divide(part * 100.0, whole)
    return F.when(whole <= 0, "0%").when((p > 0) & (p < 0.1), "<0.1%").when(p < 10, F.concat(F.format_number(p, 1), F.lit("%"))).otherwise(F.concat(F.round(p).cast("long").cast("string"), F.lit("%")))


def sort_roots(roots: DataFrame, by: str = "estimated_bytes", ascending: bool = False) -> DataFrame:
    return roots.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "root")


def layout_weight(estimated: Column, path_bytes: Column, files: Column, directories: Column) -> Column:
    return F.when(estimated > 0, estimated).when(path_bytes > 0, path_bytes).otherwise(F.greatest(files + directories, F.lit(0)))


def treemap(weights: list[float], x: float, y: float, width: float, height: float) -> list[tuple[int, float, float, float, float]]:
    """(index, x, y, width, height): one slice after the other, in order, off the longer side of what is left.

    A slice has its share of the remaining weight in whole units, one at least, and leaves one for each of those
    behind it where there is room; the last one takes the rest. Zero weights are dropped.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    out, rest = [], sum(w for _, w in live)
    for behind, (i, w) in zip(range(len(live) - 1, -1, -1), live, strict=True):
        side = max(width, height)
        if min(width, height) <= 0:
            break
        most = side - behind if side > behind else side
        cut = side if not behind else min(most, max(1, side * w // rest))
        across = width >= height
        out.append((i, x, y, cut, height) if across else (i, x, y, width, cut))
        x, width = (x + cut, width - cut) if across else (x, width)
        y, height = (y, height) if across else (y + cut, height - cut)
        rest -= w
    return out


def suffix_labels(roots: DataFrame) -> DataFrame:
    """``label``: the shortest path suffixes that tell all roots apart; the paths themselves if none do."""
    parts = catalog.text.components(F.col("root"))
    rows = roots.select("root", parts.alias("_c"))
    deep = rows.select(F.max(F.size("_c")).alias("d")).select(F.explode(F.sequence(F.lit(1), F.greatest("d", F.lit(1)))).alias("depth"))
    label = F.when(F.size("_c") == 0, "/").otherwise(F.array_join(F.slice("_c", F.greatest(F.size("_c") - F.col("depth") + 1, F.lit(1)), F.col("depth")), "/"))
    every = rows.join(F.broadcast(deep)).withColumn("label", label)  # as many rows as the deepest root has parts
    good = every.groupBy("depth").agg(F.count("*").alias("n"), F.countDistinct("label").alias("m")).where("n = m").agg(F.min("depth").alias("depth"))
    chosen = every.join(F.broadcast(good), "depth").select("root", "label")
    return roots.join(chosen, "root", "left").withColumn("label", F.coalesce("label", "root"))


def extension_histogram(df: DataFrame) -> DataFrame:
    return df.where("not is_directory").groupBy("file_extension").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("content_bytes"))


def path_lengths(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_paths"), F.sum(F.octet_length("path")).alias("path_bytes"), F.max(F.octet_length("path")).alias("longest"))


def latency_bucket(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    out = F.when(s < LATENCY[0][0], LATENCY[0][1])
    for bound, name in LATENCY[1:]:
        out = out.when(s < bound, name)
    return out.otherwise(SLOWEST)


def route(execution_path: Column, indexes_used: Column, fell_back: Column) -> Column:
    """How a search was answered: by its fallback, then the application catalog, then mapped indexes, then its path."""
    mapped = F.arrays_overlap(indexes_used, F.array(*map(F.lit, MAPPED_USES)))
    out = F.when(fell_back | (execution_path == "fullFallbackScan"), "fullScan")
    out = out.when((execution_path == "applicationCatalog") | F.array_contains(indexes_used, "applicationCatalog"), "applicationCatalog").when(mapped, "mappedIndex")
    for path, name in ROUTE_OF_PATH.items():
        out = out.when(execution_path == path, name)
    return out.otherwise("other")


def with_route(profiles: DataFrame) -> DataFrame:
    """Profiles: phase, execution_path, indexes_used, candidates, scanned, fell_back, cancelled, stale, elapsed."""
    return profiles.withColumn("route", route(F.col("execution_path"), F.col("indexes_used"), F.col("fell_back"))).withColumn("elapsed", F.greatest("elapsed", F.lit(0.0)))


def search_counters(profiles: DataFrame) -> DataFrame:
    """Per phase: counts, rows examined, latency; the average is over completed and cancelled searches, 0 without any."""
    n = F.count_if("completed") + F.count_if("cancelled")
    return profiles.groupBy("phase").agg(
        F.count("*").alias("n_started"),
        F.count_if("completed").alias("n_completed"),
        F.count_if("cancelled").alias("n_cancelled"),
        F.count_if("stale").alias("n_stale"),
        F.count_if(F.size("indexes_used") > 0).alias("n_indexed"),
        F.count_if("fell_back").alias("n_fallback"),
        F.sum(F.greatest("candidates", F.lit(0))).alias("candidate_rows"),
        F.sum(F.greatest("scanned", F.lit(0))).alias("scanned_rows"),
        F.sum("elapsed").alias("total_latency"),
        F.max("elapsed").alias("max_latency"),
        F.coalesce(F.try_divide(F.sum("elapsed"), n), F.lit(0.0)).alias("average_latency"),
    )


def latency_histogram(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("phase", latency_bucket(F.col("elapsed")).alias("bucket")).agg(F.count("*").alias("n_searches"))


def route_mix(profiles: DataFrame) -> DataFrame:
    """Per phase and route: searches, latency, share of the phase; previews leave the application catalog out."""
    rows = with_route(profiles).where(~((F.col("phase") == "preview") & (F.col("route") == "applicationCatalog")))
    per = rows.groupBy("phase", "route").agg(F.count("*").alias("n_searches"), F.sum("elapsed").alias("total_latency"), F.avg("elapsed").alias("average_latency"))
    return per.withColumn("share", F.col("n_searches") / F.sum("n_searches").over(Window.partitionBy("phase")))


def index_uses(profiles: DataFrame) -> DataFrame:
    """Searches per index used; one search may use several."""
    return profiles.select("phase", F.explode("indexes_used").alias("index_use")).groupBy("phase", "index_use").agg(F.count("*").alias("n_searches"))


def as_map(rows: DataFrame, by: list[str], key: str, value: str, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def daily(events: DataFrame, days: int = KEPT_DAYS) -> DataFrame:
    """Actions per local day, the latest ``days`` days that have any."""
    per = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "action").agg(F.count("*").alias("n"))
    kept = per.select("day").distinct().orderBy(F.col("day").desc()).limit(days)
    return per.join(kept, "day", "left_semi")


def memory_by_day(samples: DataFrame) -> DataFrame:
    """Per day the latest, least and most bytes; samples that aren't positive don't count."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return samples.where("bytes > 0").groupBy(day).agg(F.max_by("bytes", "ts").alias("latest_bytes"), F.min("bytes").alias("least_bytes"), F.max("bytes").alias("most_bytes"))


def action_counts(events: DataFrame) -> DataFrame:
    """Every action, those that never happened too."""
    spark = events.sparkSession
    names = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    return names.join(events.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"))


def health(events: DataFrame) -> DataFrame:
    """Per kind of work: how often, failures, the first, last and total duration; negative durations count as 0."""
    d = F.greatest(F.col("seconds"), F.lit(0.0))
    return events.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if("failed").alias("n_failed"),
        F.min_by(d, "ts").alias("initial_seconds"),
        F.max_by(d, "ts").alias("last_seconds"),
        F.sum(d).alias("total_seconds"),
    )


def launches(events: DataFrame) -> DataFrame:
    """First launch ever, and when each version was first seen."""
    seen = events.groupBy("version").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n_launches"))
    return seen.withColumn("first_launch", F.min("first_seen").over(Window.partitionBy()))


def storage(files: DataFrame) -> DataFrame:
    """Allocated bytes per location and in all."""
    return files.groupBy("location").agg(F.count("*").alias("n_files"), F.sum("bytes").alias("allocated_bytes"))


def interval_union(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Half-open intervals (start, end) merged where they overlap or touch; empty ones go."""
    keys = by or []
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.where("start < end").withColumn("_new", (seen.isNull() | (F.col("start") > seen)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def health_snapshot(df: DataFrame, phase: str, revision: int) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if("is_directory").alias("n_directories"), F.count_if("is_hidden").alias("n_hidden"), F.sum(F.octet_length("path")).alias("path_bytes")).withColumn("phase", F.lit(phase)).withColumn("revision", F.lit(revision).cast("long"))
