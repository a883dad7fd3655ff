"""More registered catalog queries and their SQL: previews, applications, diagnostics, roll-ups, usage and upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana import queries as base
from trovana.operators import apps, catalog, changes, diagnostics, exclusion, insights
from trovana.operators.search import Catalog, prefix_range

ALL = 10**6

# --- search --------------------------------------------------------------------------------------


def search_preview(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(base.part_files(spark, d)).preview("bolt", limit=ALL).select("path", F.col("match.class").alias("class"), "score")


def search_prefix_range(spark: SparkSession, d: str) -> DataFrame:
    return prefix_range(base.part_files(spark, d), "Large_Gear").select("path")


def _apps(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/Applications/"), F.replace("s_name", F.lit("#"), F.lit(" Studio ")), F.lit(".app"))
    return catalog.derive(base._t(spark, d, "supplier").select(path.alias("path"), F.lit(True).alias("is_directory")))


def search_applications(spark: SparkSession, d: str) -> DataFrame:
    found = Catalog(_apps(spark, d)).search("apps: ss00000000", limit=ALL)
    return found.select("path", "score", F.col("match.class").alias("class"), "is_alias")


def apps_bundles(spark: SparkSession, d: str) -> DataFrame:
    outer = _apps(spark, d)
    inner = catalog.derive(outer.select(F.concat("path", F.lit("/Contents/Helper.app")).alias("path"), F.lit(True).alias("is_directory")))
    return apps.bundles(outer.unionByName(inner)).select("path")


# --- diagnostics ---------------------------------------------------------------------------------


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = base._t(spark, d, "events")
    value = F.concat(F.lit("/Users/Ann/"), "event_type", F.lit("-"), F.col("event_id").cast("string"))
    fields = F.create_map(F.lit("path"), F.struct(F.lit("path").alias("privacy"), value.alias("value")))
    level = F.when(F.col("event_id") % 3 == 0, "debug").when(F.col("event_id") % 3 == 1, "info").otherwise("error")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 10)
    return e.select(F.lit(1).alias("schemaVersion"), at.alias("timestamp"), level.alias("level"), F.lit("search").alias("category"), F.col("event_type").alias("event"), fields.alias("fields"), "event_id")


def diagnostics_shape(spark: SparkSession, d: str) -> DataFrame:
    """The shape of anonymised texts, and whether they differ from the originals."""
    rows = _log(spark, d)
    old = rows.select("event_id", F.col("fields")["path"]["value"].alias("old"))
    new = diagnostics.anonymise(rows, "salt").select("event_id", F.col("fields")["path"]["value"].alias("new")).join(old, "event_id")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("new", "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return new.select("event_id", shape.alias("shape"), (F.col("new") != F.col("old")).alias("hidden"))


def diagnostics_recorded(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.summary(diagnostics.recorded(_log(spark, d), "info")).select("category", "level", "n_events")


def diagnostics_capped(spark: SparkSession, d: str) -> DataFrame:
    out = diagnostics.capped(_log(spark, d), 16)
    field = F.col("fields")["path"]
    return out.select("event_id", field["value"].alias("value"), field["originalLength"].alias("original_length"), F.size("truncated").alias("n_truncated"))


def diagnostics_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d)
    known = rows.where("event_id % 4 = 0").drop("event_id").withColumn("persisted", F.col("fields"))
    fuller = F.map_concat("fields", F.create_map(F.lit("more"), F.col("fields")["path"]))
    late = F.col("timestamp") + F.expr("interval 1 second")
    context = known.withColumn("fields", fuller).withColumn("timestamp", late).unionByName(known.withColumn("timestamp", F.col("timestamp") + F.expr("interval 2 second")))
    told = diagnostics.with_context(rows, context)
    return told.select("event_id", F.size("context_fields").alias("n_fields"))


# --- catalog -------------------------------------------------------------------------------------


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_virtual(base.customer_files(spark, d))


def catalog_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = _tree(spark, d).select("file_extension", "is_directory").unionByName(_apps(spark, d).select("file_extension", "is_directory"))
    return rows.groupBy(catalog.kind_name().alias("kind")).agg(F.count("*").alias("n"))


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return insights.counts(catalog.with_visibility(_tree(spark, d)))


def catalog_lookup(spark: SparkSession, d: str) -> DataFrame:
    return catalog.point_lookup(_tree(spark, d), "/AFRICA").select("path", "is_virtual")


def tree_interval(spark: SparkSession, d: str) -> DataFrame:
    return catalog.subtree(catalog.with_order(_tree(spark, d)), "/AFRICA").select("path")


def tree_visible_through(spark: SparkSession, d: str) -> DataFrame:
    return catalog.visible_before(catalog.with_visibility(catalog.with_order(_tree(spark, d)))).select("path", "visible_through")


def path_lengths(spark: SparkSession, d: str) -> DataFrame:
    return insights.path_lengths(base.part_files(spark, d))


def rollup_updated(spark: SparkSession, d: str) -> DataFrame:
    roots, _ = base._customer_roots(spark, d)
    rows = catalog.with_root(base.customer_files(spark, d), roots)
    roll = insights.root_rollup
    return insights.updated_rollup(roll(rows), roll(rows.where("name like '%7'")), roll(rows.where("name like '%5'")))


# --- exclusion -----------------------------------------------------------------------------------


def exclusion_descend(spark: SparkSession, d: str) -> DataFrame:
    return exclusion.with_decision(_tree(spark, d), ["/"], ("/AFRICA/", "!/AFRICA/NATION_0/**")).select("path", "decision")


#: A file in each of several places that the default patterns name.
PLACES = ("Library/Caches/x", ".Trash/x", "a/.cache/x", "node_modules/x/y.js", "src/x.O", ".git/objects/x", ".git/config", "src/x.swift")


def exclusion_defaults(spark: SparkSession, d: str) -> DataFrame:
    place = F.element_at(F.array(*map(F.lit, PLACES)), (F.col("p_partkey") % len(PLACES) + 1).cast("int"))
    rows = base._t(spark, d, "part").select(F.concat(F.lit("/p"), F.col("p_partkey").cast("string"), F.lit("/"), place).alias("path"), F.lit(False).alias("is_directory"))
    return exclusion.with_decision(rows, ["/"], exclusion.DEFAULT_PATTERNS).select("path", "decision")


# --- usage and presentation ----------------------------------------------------------------------


def _work(spark: SparkSession, d: str) -> DataFrame:
    e = base._t(spark, d, "events")
    return e.select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("failed"), (F.col("value") - 5).alias("seconds"), F.timestamp_seconds(F.col("event_id")).alias("ts"), (F.col("user_id") % 5).cast("string").alias("version"))


def usage_actions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return insights.action_counts(base._t(spark, d, "events").select(F.when(kind == "view", "open").when(kind == "click", "reveal").otherwise("copyPath").alias("action")))


def usage_health(spark: SparkSession, d: str) -> DataFrame:
    return insights.health(_work(spark, d)).withColumn("total_seconds", F.round("total_seconds", 4))


def usage_launches(spark: SparkSession, d: str) -> DataFrame:
    out = insights.launches(_work(spark, d))
    return out.select("version", F.unix_seconds("first_seen").alias("first_seen"), "n_launches", F.unix_seconds("first_launch").alias("first_launch"))


def usage_storage(spark: SparkSession, d: str) -> DataFrame:
    return insights.storage(base.part_files(spark, d).select(F.col("directory_path").alias("location"), F.col("size_bytes").alias("bytes")))


def root_labels(spark: SparkSession, d: str) -> DataFrame:
    n = base._t(spark, d, "nation").join(base._t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return insights.suffix_labels(n.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/src")).alias("root")))


def root_weights(spark: SparkSession, d: str) -> DataFrame:
    p, k = base._t(spark, d, "part"), F.col("p_partkey")
    weight = insights.layout_weight(F.when(k % 3 == 0, k).otherwise(0), F.when(k % 3 == 1, k * 2).otherwise(0), F.col("p_size").cast("long"), F.lit(1))
    return p.select("p_partkey", weight.cast("long").alias("weight"), insights.percent_text(F.col("p_size"), F.lit(50)).alias("percent"))


def root_activity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    phase = F.element_at(F.array(*map(F.lit, ("loading", "scanning", "optimizing", "saving", "idle"))), (k % 5 + 1).cast("int"))
    label = insights.activity_label(phase, k % 2 == 0, k % 7 == 0, k % 3 == 0, k % 11 == 0)
    return base._t(spark, d, "part").select("p_partkey", label.alias("label"))


# --- changes -------------------------------------------------------------------------------------


def changes_latest(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest(base.change_events(spark, d))


def _history(spark: SparkSession, d: str, most: int) -> tuple[str, DataFrame | None]:
    done = spark.createDataFrame([("/", changes.HISTORY_DONE, 0)], "path string, flags long, event_id long")
    return changes.catch_up(base.change_events(spark, d).unionByName(done), catalog.roots_table(spark, ["/data"]), ["/data"], patterns=("click/",), most=most)


def changes_catch_up(spark: SparkSession, d: str) -> DataFrame:
    action, found = _history(spark, d, ALL)
    return found.select("path", F.lit(action).alias("action"))


#: Scopes beyond which a history is given up, in several cases: none is few enough, only their parents are, all are.
LIMITS = (1, 300, 1_000_000)


def changes_overflow(spark: SparkSession, d: str) -> DataFrame:
    """What a history with more or fewer scopes than a limit leads to."""
    out = None
    for most in LIMITS:
        action, found = _history(spark, d, most)
        scopes = base.change_events(spark, d).limit(0).select("path") if found is None else found.select("path")
        row = scopes.agg(F.lit(most).alias("most"), F.lit(action).alias("action"), F.count("*").alias("n_scopes"))
        out = row if out is None else out.unionByName(row)
    return out


def changes_routed(spark: SparkSession, d: str) -> DataFrame:
    """Directories that some events name as such, of a part of the users, and the files outside them."""
    e = base.change_events(spark, d)
    directories = e.where("flags = 131072 and path like '/data/u1%'").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.lit(True).alias("is_directory"))
    return changes.routed(e.select("path", F.lit(False).alias("is_directory")).unionByName(directories))


def changes_pending(spark: SparkSession, d: str) -> DataFrame:
    return changes.pending_after(base.change_events(spark, d).select("path").distinct(), spark.createDataFrame([("/data/u1",), ("/data/u2/click",)], "path string")).select("path")


def changes_rescanned(spark: SparkSession, d: str) -> DataFrame:
    files = base.customer_files(spark, d)
    again = files.where("path like '/AFRICA/%' and name like '%3'").withColumn("size_bytes", F.col("size_bytes") + 5)
    return changes.replace_scopes(files, again, spark.createDataFrame([("/AFRICA",), ("/AFRICA/NATION_0",)], "path string")).select("path", "size_bytes")


QUERIES = [
    search_preview, search_prefix_range, search_applications, apps_bundles, diagnostics_shape, diagnostics_recorded, diagnostics_capped, diagnostics_context,
    catalog_kinds, catalog_counts, catalog_lookup, tree_interval, tree_visible_through, path_lengths, rollup_updated, exclusion_descend, exclusion_defaults,
    usage_actions, usage_health, usage_launches, usage_storage, root_labels, root_weights, root_activity,
    changes_latest, changes_catch_up, changes_overflow, changes_routed, changes_pending, changes_rescanned,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_APPS = "ap as (select '/Applications/' || replace(s_name, '#', ' Studio ') || '.app' as path from supplier)"
_LOG = "lg as (select event_id, '/Users/Ann/' || event_type || '-' || cast(event_id as varchar) as v, case event_id % 3 when 0 then 'debug' when 1 then 'info' else 'error' end as level from events)"
_WORK = "wk as (select event_type as kind, event_id % 3 = 0 as failed, greatest(value - 5, 0.0) as s, event_id, cast(user_id % 5 as varchar) as version from events)"


def oracle_sql() -> dict[str, str]:
    tree = f"with {base.TREE_SQL}, {base._VIRTUAL}"
    literal = base._name_ways("bolt").split("union all select path, 2, 'near'")
    literal = literal[0] + "union all select path, 1, 'weakPath'" + literal[1].split("union all select path, 1, 'weakPath'")[1]
    place = " ".join(f"when {i} then '{p}'" for i, p in enumerate(PLACES))
    taken = "regexp_matches(path, '^/data/u[0-9]+/click/')"
    scope = f"""c as (select path, bit_or(flags) as f from ch group by path),
 s as (select distinct case when f & 131072 <> 0 then path when f & 2560 <> 0 then regexp_extract(path, '^(.*)/', 1) else path end as scope from c where not {taken})"""
    return {
        "search_preview": f"select path, class, score from ({base._wrap(literal)})",
        "search_prefix_range": f"with {base.PARTS_SQL} select path from cat where starts_with(normalized_name, 'large_gear')",
        "search_applications": f"with {_APPS} select path, 7589 as score, 'prefix' as class, true as is_alias from ap where path like '%/Supplier Studio 00000000%'",
        "apps_bundles": f"with {_APPS} select path from ap",
        "diagnostics_shape": f"with {_LOG} select event_id, regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') as shape, true as hidden from lg",
        "diagnostics_recorded": f"with {_LOG} select 'search' as category, level, count(*) as n_events from lg where level <> 'debug' group by level",
        "diagnostics_capped": f"with {_LOG} select event_id, v[1:16] as value, case when length(v) > 16 then length(v) end as original_length, cast(length(v) > 16 as integer) as n_truncated from lg",
        "diagnostics_context": "select event_id, 2 as n_fields from events where event_id % 4 = 0",
        "catalog_kinds": f"{tree}, {_APPS} select case when is_virtual then 'Folder' else 'File' end as kind, count(*) as n from tree group by 1 union all select 'Application', count(*) from ap",
        "catalog_counts": f"{tree} select count(*) as n_results, count(*) filter (where not coalesce(c.is_hidden, false)) as n_visible from tree t left join cat c using (path)",
        "catalog_lookup": f"{tree} select path, is_virtual from tree where path = '/AFRICA'",
        "tree_interval": f"{tree} select path from tree where path = '/AFRICA' or starts_with(path, '/AFRICA/')",
        "tree_visible_through": f"{tree} select t.path, cast(sum(case when coalesce(c.is_hidden, false) then 0 else 1 end) over (order by str_split(t.path, '/')) as bigint) as visible_through from tree t left join cat c using (path)",
        "path_lengths": f"with {base.PARTS_SQL} select count(*) as n_paths, cast(sum(strlen(path)) as bigint) as path_bytes, max(strlen(path)) as longest from cat",
        "rollup_updated": f"""with {base.TREE_SQL}, {base.ROOTS_SQL}, w as (select root, case when path like '%5' then 0 when path like '%7' then 2 else 1 end as n, size_bytes, path, is_hidden from att join cat using (path))
select root, cast(sum(n) as bigint) as n_files, cast(0 as bigint) as n_directories, cast(coalesce(sum(n) filter (where is_hidden), 0) as bigint) as n_hidden, cast(sum(n * size_bytes) as bigint) as content_bytes, cast(sum(n * strlen(path)) as bigint) as path_bytes from w group by root""",
        "exclusion_descend": f"""{tree} select path, case when path in ('/AFRICA', '/AFRICA/NATION_0') then 'skipButDescend' when starts_with(path, '/AFRICA/') and not starts_with(path, '/AFRICA/NATION_0/') then 'prune' else 'index' end as decision from tree""",
        "exclusion_defaults": f"select '/p' || cast(p_partkey as varchar) || '/' || case p_partkey % {len(PLACES)} {place} end as path, case when p_partkey % {len(PLACES)} >= 6 then 'index' else 'prune' end as decision from part",
        "usage_actions": """with a(action) as (values ('open'), ('reveal'), ('copyFile'), ('copyPath'), ('quickLook'), ('rename'), ('moveToTrash'), ('getInfo')),
e as (select case event_type when 'view' then 'open' when 'click' then 'reveal' else 'copyPath' end as action, count(*) as n from events group by 1) select action, coalesce(n, 0) as n from a left join e using (action)""",
        "usage_health": f"with {_WORK} select kind, count(*) as n, count(*) filter (where failed) as n_failed, arg_min(s, event_id) as initial_seconds, arg_max(s, event_id) as last_seconds, round(sum(s), 4) as total_seconds from wk group by kind",
        "usage_launches": f"with {_WORK} select version, min(event_id) as first_seen, count(*) as n_launches, (select min(event_id) from wk) as first_launch from wk group by version",
        "usage_storage": f"with {base.PARTS_SQL} select directory_path as location, count(*) as n_files, cast(sum(size_bytes) as bigint) as allocated_bytes from cat group by 1",
        "root_labels": "select '/' || r_name || '/' || n_name || '/src' as root, n_name || '/src' as label from nation join region on n_regionkey = r_regionkey",
        "root_weights": "select p_partkey, case when p_partkey % 3 = 0 and p_partkey > 0 then p_partkey when p_partkey % 3 = 1 then p_partkey * 2 else p_size + 1 end as weight, case when p_size * 2 < 1 then '<1%' else cast(p_size * 2 as varchar) || '%' end as percent from part",
        "root_activity": """select p_partkey, case when p_partkey % 5 = 0 then 'Loading' when p_partkey % 2 <> 0 then null when p_partkey % 7 = 0 then 'Catching up'
 else case p_partkey % 5 when 1 then case when p_partkey % 3 = 0 then 'Reconciling' when p_partkey % 11 = 0 then 'Updating' else 'Indexing' end when 2 then 'Optimizing' when 3 then 'Saving' end end as label from part""",
        "changes_latest": f"with {base.CHANGES_SQL} select path, cast(arg_max(flags, event_id) as bigint) as flags, max(event_id) as event_id from ch group by path",
        "changes_catch_up": f"with {base.CHANGES_SQL}, {scope} select scope as path, 'scoped' as action from s a where not exists (select 1 from s b where starts_with(a.scope, b.scope || '/'))",
        "changes_overflow": f"""with {base.CHANGES_SQL}, {scope}, ms as (select count(*) as n from s a where not exists (select 1 from s b where starts_with(a.scope, b.scope || '/'))),
p as (select distinct regexp_extract(scope, '^(.*)/', 1) as path from s), mp as (select count(*) as n from p a where not exists (select 1 from p b where starts_with(a.path, b.path || '/'))),
l(most) as (values {', '.join(f'({n})' for n in LIMITS)}), k as (select most, (select count(*) from s) >= most as many, (select n from mp) as parents, (select n from ms) as fewest from l)
select most, case when many and parents >= most then 'full' else 'scoped' end as action, cast(case when not many then fewest when parents < most then parents else 0 end as bigint) as n_scopes from k""",
        "changes_routed": f"""with {base.CHANGES_SQL}, dirs as (select distinct regexp_extract(path, '^(.*)/', 1) as path from ch where flags = 131072 and path like '/data/u1%')
select path, 'directory' as kind from dirs union all select distinct path, 'file' from ch where regexp_extract(path, '^(.*)/', 1) not in (select path from dirs)""",
        "changes_pending": f"with {base.CHANGES_SQL} select distinct path from ch where not starts_with(path, '/data/u1/') and not starts_with(path, '/data/u2/click/')",
        "changes_rescanned": f"with {base.TREE_SQL} select path, case when starts_with(path, '/AFRICA/') then size_bytes + 5 else size_bytes end as size_bytes from cat where not starts_with(path, '/AFRICA/') or path like '%3'",
    }
