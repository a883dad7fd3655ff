"""Diagnostic events: gating, capping, anonymising, export and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels from the most detailed on; warnings and errors are always kept.
LEVELS = ("debug", "diagnostic", "info", "warning", "error")
ALWAYS = ("warning", "error")
#: What each privacy class leaves readable.
READABLE = {"path": "/\\.-_ ", "pathArray": "/\\.-_ ", "query": " \t\n:!|-*?/.()[]{}\"'", "privateString": " \t\n/\\.:,;()[]{}\"'", "errorText": " \t\n/\\.:,;()[]{}\"'"}
#: Days that a report covers, seconds within which events are one context.
REPORT_DAYS, CONTEXT_SECONDS = 14, 1.1

#: A field's value is one text (numbers and flags as theirs, ``type`` telling them apart) or an array of texts.
FIELD = "struct<privacy:string,type:string,value:string,values:array<string>,truncated:boolean,originalLength:bigint,totalCount:bigint>"
EVENT_SCHEMA = f"schemaVersion int, timestamp timestamp, level string, category string, event string, fields map<string,{FIELD}>"


def level_rank(level: Column) -> Column:
    out = F.lit(-1)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def recorded(events: DataFrame, minimum: str) -> DataFrame:
    return events.where(F.col("level").isin(*ALWAYS) | (level_rank(F.col("level")) >= LEVELS.index(minimum)))


def _parts(events: DataFrame) -> set[str]:
    """What a field's value consists of in these events; the schema's optional parts may be missing."""
    return set(events.schema["fields"].dataType.valueType.fieldNames())


def capped_fields(events: DataFrame, longest: int, most: int) -> Column:
    """The fields of ``events`` with texts cut to a length and arrays to a number of texts."""
    parts = _parts(events)

    def cut(v: Column) -> Column:
        size = F.length(v["value"])
        over = F.coalesce(size > longest, F.lit(False))
        out = v.withField("value", F.substring(v["value"], 1, longest)).withField("originalLength", F.when(over, size.cast("long")))
        if "values" in parts:
            values = v["values"]
            over = over | F.coalesce((F.size(values) > most) | F.exists(F.slice(values, 1, most), lambda x: F.length(x) > longest), F.lit(False))
            count = F.size(values).cast("long")
            if "totalCount" in parts:
                count = F.greatest(v["totalCount"], count)
            out = out.withField("values", F.transform(F.slice(values, 1, most), lambda x: F.substring(x, 1, longest))).withField("totalCount", F.when(values.isNotNull(), count))
        if "truncated" in parts:
            over = over | F.coalesce(v["truncated"], F.lit(False))
        return out.withField("truncated", over)

    return F.transform_values("fields", lambda _, v: cut(v))


def capped(events: DataFrame, longest: int = 4096, most: int = 100) -> DataFrame:
    """Texts cut to a length and arrays to a number of texts; a field that was cut says so, and how long it was.

    ``truncated`` names these fields.
    """
    rows = events.withColumn("fields", capped_fields(events, longest, most))
    return rows.withColumn("truncated", F.map_keys(F.map_filter("fields", lambda _, v: v["truncated"])))


def shaped(value: Column, privacy: Column, salt: str) -> Column:
    """A text of the same shape, alike for equal texts and salts: readable characters and white space stay, digits
    become digits, capitals capitals, other letters small letters, anything else a sign.

    A character's substitute is picked by a hash of the whole text, the salt and its place, so nothing leaves the JVM.
    """
    readable = F.lit("")
    for name, kept in READABLE.items():
        readable = F.when(privacy == name, kept).otherwise(readable)
    pools = (("^\\p{N}$", "0123456789"), ("^\\p{Lu}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("^\\p{L}$", "abcdefghijklmnopqrstuvwxyz"))

    def substitute(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        draw = lambda pool: F.substring(F.lit(pool), F.pmod(F.xxhash64(F.lit(salt), value, i), F.lit(len(pool))).cast("int") + 1, F.lit(1))
        out = F.when((F.instr(readable, c) > 0) | c.rlike("^\\s$"), c)
        for kind, pool in pools:
            out = out.when(c.rlike(kind), draw(pool))
        return out.otherwise(draw("*+=~"))

    places = F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value))).otherwise(F.array().cast("array<int>"))
    return F.when(privacy == "public", value).when(value.isNotNull(), F.array_join(F.transform(places, substitute), ""))


def anonymise(events: DataFrame, salt: str) -> DataFrame:
    """All fields but public ones, texts and arrays of texts; numbers and flags of other classes as well."""

    def hidden(v: Column) -> Column:
        out = v.withField("value", shaped(v["value"], v["privacy"], salt))
        if "values" in _parts(events):
            out = out.withField("values", F.transform(v["values"], lambda x: shaped(x, v["privacy"], salt)))
        return out

    return events.withColumn("fields", F.transform_values("fields", lambda _, v: hidden(v)))


def with_context(events: DataFrame, context: DataFrame, seconds: float = CONTEXT_SECONDS) -> DataFrame:
    """Events that a context event has been persisted as, with its fuller ``context_fields``: the nearest in time of those
    with the same level, category, event and fields.

    Fields are compared as text, so that the join is an equi-join; the time is a band within it.
    """
    key = lambda df, c: F.to_json(F.array_sort(F.map_entries(df[c])))
    names = ("level", "category", "event")
    c = context.select(*[F.col(n).alias(f"_{n}") for n in names], key(context, "persisted").alias("_k"), F.col("timestamp").alias("_t"), F.col("fields").alias("context_fields"))
    e = events.withColumn("_row", F.monotonically_increasing_id()).withColumn("_own", key(events, "fields"))
    gap = F.abs(F.col("timestamp").cast("double") - F.col("_t").cast("double"))
    same = F.col("_own") == F.col("_k")
    for n in names:
        same = same & (F.col(n) == F.col(f"_{n}"))
    met = e.join(c, same & (gap < seconds)).withColumn("_gap", gap)
    whole = F.struct(*[F.col(x) for x in events.columns], "context_fields")
    return met.groupBy("_row").agg(F.min_by(whole, F.struct("_gap", "_t")).alias("_e")).select("_e.*")


def export(events: DataFrame, context: DataFrame | None = None, salt: str | None = None) -> DataFrame:
    """What leaves the machine: events in order, fuller where a context event is known, raw or with a salt anonymised."""
    out = events
    if context is not None:
        told = with_context(events, context)
        alone = events.withColumn("_k", F.to_json(F.struct(*events.columns))).join(told.select(F.to_json(F.struct(*events.columns)).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
        out = alone.unionByName(told.withColumn("fields", F.col("context_fields")).drop("context_fields"))
    return (anonymise(out, salt) if salt is not None else out).orderBy("timestamp", "category", "event")


def summary(events: DataFrame) -> DataFrame:
    return events.groupBy("category", "level").agg(F.count("*").alias("n_events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def retained(files: DataFrame, total_bytes: int, now: str, max_days: int) -> DataFrame:
    """Log files to keep: not older than ``max_days`` and, newest first, within a total size."""
    from pyspark.sql import Window

    young = files.where(F.datediff(F.lit(now).cast("timestamp"), F.col("modified")) <= max_days)
    before = F.sum("bytes").over(Window.orderBy(F.col("modified").desc(), "name").rowsBetween(Window.unboundedPreceding, 0))  # a directory listing
    return young.withColumn("_sum", before).where(F.col("_sum") <= total_bytes).drop("_sum")


def report(events: DataFrame, roots: list[str], now: str, days: int = REPORT_DAYS, show_roots: bool = False) -> str:
    """Markdown over the last days: roots are counted, not named, unless asked for. A few dozen lines at most."""
    recent = events.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    lines = ["# Diagnostics", "", f"Events of the last {days} days.", "", "| category | level | events |", "|-|-|-|"]
    lines += [f"| {r['category']} | {r['level']} | {r['n_events']} |" for r in summary(recent).orderBy("category", "level").limit(500).collect()]
    lines += ["", "## Roots", ""] + ([f"- {r}" for r in roots] if show_roots else [f"{len(roots)} configured, not shown."])
    return "\n".join(lines) + "\n"
