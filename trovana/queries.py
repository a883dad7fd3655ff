"""The registered catalog queries over views of the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.operators import apps, catalog, changes, diagnostics, exclusion, grams, insights
from trovana.operators.search import SearchRequest, candidates, search

# --- views ---------------------------------------------------------------------------------------

#: A file for each part; brands that end in 5 lie in a directory that a dot hides.
PARTS_SQL = """
raw as (select concat('/parts/', case when p_brand like '%5' then '.' else '' end, p_brand) as directory_path,
               concat(replace(p_name, ' ', '_'), '-', cast(p_partkey as varchar(20)), '.', lower(p_type)) as name,
               lower(p_type) as file_extension, cast(p_size as bigint) * 1024 as size_bytes, p_partkey from part),
cat as (select concat(directory_path, '/', name) as path, name, directory_path, file_extension, size_bytes, p_partkey,
               false as is_directory, directory_path like '/parts/.%' as is_hidden,
               lower(name) as normalized_name, lower(concat(directory_path, '/', name)) as normalized_path, lower(directory_path) as dir from raw)"""
#: A tree of regions, nations, segments and customers, the leaves being files.
TREE_SQL = """
cat as (select concat('/', r_name, '/', n_name, '/', c_mktsegment, '/', c_name) as path, cast(c_custkey as bigint) % 1000 as size_bytes,
               c_custkey % 17 = 0 as is_hidden, c_custkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
anc as (select path, '/' || array_to_string(str_split(substr(path, 2), '/')[1:n], '/') as ancestor, n from cat, unnest([1, 2, 3]) as t(n))"""
#: A search for each event.
PROFILES_SQL = """
prof as (select case when event_type in ('view', 'error') then 'preview' else 'final' end as phase, value / 100.0 as elapsed,
                case event_type when 'view' then 'fullFallbackScan' when 'click' then 'nameComponentIndex' when 'purchase' then 'applicationCatalog'
                     when 'error' then 'emptyQuerySortedOrder' else 'unprofiled' end as execution_path,
                case event_type when 'click' then ['nameGrams', 'visibleBitset'] when 'purchase' then ['applicationCatalog'] when 'error' then ['modifiedOrder'] else [] end as uses,
                event_type = 'view' as fell_back, event_id % 10 <> 0 as completed, event_id % 10 = 0 as cancelled, event_id % 7 = 0 as stale, user_id as candidates, user_id * 2 as scanned,
                ts, event_id from events)"""
#: A change for each event: paths from a small tree, flags from the event's number.
CHANGES_SQL = """
ch as (select concat('/data/u', cast(user_id % 40 as varchar(20)), '/', event_type, '/f', cast(user_id as varchar(20))) as path,
              case event_id % 5 when 0 then 512 when 1 then 2048 when 2 then 131072 else 4096 end as flags, event_id from events)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_files(spark: SparkSession, d: str) -> DataFrame:
    directory = F.concat(F.lit("/parts/"), F.when(F.col("p_brand").endswith("5"), ".").otherwise(""), F.col("p_brand"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_partkey").cast("string"), F.lit("."), F.lower("p_type"))
    raw = _t(spark, d, "part").select(
        F.concat(directory, F.lit("/"), name).alias("path"), F.lit(False).alias("is_directory"), (F.col("p_size").cast("long") * 1024).alias("size_bytes"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey") * 60).alias("modified_time")
    )
    return catalog.derive(catalog.spread(raw))


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/"), "c_mktsegment", F.lit("/"), "c_name")
    raw = c.select(path.alias("path"), F.lit(False).alias("is_directory"), (F.col("c_custkey") % 1000).cast("long").alias("size_bytes"), (F.col("c_custkey") % 17 == 0).alias("os_hidden"))
    return catalog.derive(catalog.spread(raw))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    e, t = _t(spark, d, "events"), F.col("event_type")
    uses = F.when(t == "click", F.array(F.lit("nameGrams"), F.lit("visibleBitset"))).when(t == "purchase", F.array(F.lit("applicationCatalog"))).when(t == "error", F.array(F.lit("modifiedOrder"))).otherwise(F.array().cast("array<string>"))
    path = F.when(t == "view", "fullFallbackScan").when(t == "click", "nameComponentIndex").when(t == "purchase", "applicationCatalog").when(t == "error", "emptyQuerySortedOrder").otherwise("unprofiled")
    return e.select(
        F.when(t.isin("view", "error"), "preview").otherwise("final").alias("phase"), (F.col("value") / 100.0).alias("elapsed"), path.alias("execution_path"), uses.alias("indexes_used"),
        (t == "view").alias("fell_back"), (F.col("event_id") % 10 != 0).alias("completed"), (F.col("event_id") % 10 == 0).alias("cancelled"), (F.col("event_id") % 7 == 0).alias("stale"),
        F.col("user_id").alias("candidates"), (F.col("user_id") * 2).alias("scanned"), "ts", "event_id",
    )


def change_events(spark: SparkSession, d: str) -> DataFrame:
    u, k = F.col("user_id"), F.col("event_id") % 5
    path = F.concat(F.lit("/data/u"), (u % 40).cast("string"), F.lit("/"), F.col("event_type"), F.lit("/f"), u.cast("string"))
    flags = F.when(k == 0, 512).when(k == 1, 2048).when(k == 2, 131072).otherwise(4096)
    return _t(spark, d, "events").select(path.alias("path"), flags.cast("long").alias("flags"), "event_id")


# --- search --------------------------------------------------------------------------------------

PENALTY = "- least(120, 4 * (length(path) - length(replace(path, '/', '')))) - case when is_hidden then 35 else 0 end"
BOUNDARY = r"'[/\\\-_. ]'"


def _matches(df: DataFrame, text: str) -> DataFrame:
    found = candidates(df, SearchRequest(text))
    return found.select("path", F.col("match.class").alias("class"), F.col("match.bin").alias("bin"), "score", F.col("match.field").alias("field"), F.col("match.reason").alias("reason"))


def _wrap(ways: str, with_: str = PARTS_SQL) -> str:
    """ways: a select of path, rank, class, s, field, reason for each way in which a term matches."""
    return f"""with {with_}, ways as ({ways}),
best as (select path, arg_max(struct_pack(c := class, s := s, f := field, r := reason), rank * 1000000 + s) as b from ways group by path)
select path, b.c as class, greatest(0, least(4, cast(trunc((b.s {PENALTY}) / 2000.0) as integer))) as bin, cast(b.s {PENALTY} as integer) as score, b.f as field, b.r as reason
from best join cat using (path)"""


def _name_ways(token: str) -> str:
    n = len(token)
    return f"""
select path, 6 as rank, 'exact' as class, 10000 as s, 'name' as field, 'Name exactly matched "{token}"' as reason from cat where normalized_name = '{token}'
union all select path, 5, 'prefix', 9200 - least(length(normalized_name), 300), 'name', 'Name starts with "{token}"' from cat where starts_with(normalized_name, '{token}') and normalized_name <> '{token}'
union all select path, 3, 'substring', 7700 + case when regexp_matches(substr(normalized_name, instr(normalized_name, '{token}') - 1, 1), {BOUNDARY}) then 650 else 0 end
                 - least(12 * (instr(normalized_name, '{token}') - 1), 900), 'name', 'Name contains "{token}"' from cat where contains(normalized_name, '{token}') and not starts_with(normalized_name, '{token}')
union all select path, 2, 'near', s, 'name', 'Name nearly matched "{token}"' from (
   select path, max(4500 - 500 * damerau_levenshtein(c, '{token}') - least(length(c), 100)) as s from cat, unnest(regexp_split_to_array(normalized_name, {BOUNDARY})) as t(c)
   where not contains(normalized_name, '{token}') and c <> '' and abs(length(c) - {n}) <= 1 and damerau_levenshtein(c, '{token}') <= 1 group by path)
union all select path, 1, 'weakPath', 4000 + case when instr(dir, '{token}') = 1 or regexp_matches(substr(dir, instr(dir, '{token}') - 1, 1), {BOUNDARY}) then 500 else 0 end
                 - least(10 * (instr(dir, '{token}') - 1), 900) - 400, 'ancestorPath', 'Path ancestor matched "{token}"' from cat where contains(dir, '{token}')"""


def _exact_ways(token: str) -> str:
    def way(column: str, base: int, field: str, verbs: tuple[str, str, str]) -> str:
        at = f"instr({column}, '{token}')"
        pick = lambda a, b, c: f"case when {column} = '{token}' then {a} when {at} = 1 then {b} else {c} end"
        said = [f"'{v} \"{token}\"'" for v in verbs]
        return f"""select path, {pick(6, 5, 3)} as rank, {pick("'exact'", "'prefix'", "'substring'")} as class,
            {base} + case when {at} = 1 or regexp_matches(substr({column}, {at} - 1, 1), {BOUNDARY}) then 500 else 0 end - least(10 * ({at} - 1), 900) as s, '{field}' as field, {pick(*said)} as reason from cat where contains({column}, '{token}')"""

    p = "Path matched"
    return way("normalized_name", 5200, "name", ("Name exactly matched", "Name starts with", "Name contains")) + " union all " + way("dir", 3700, "path", (p, p, p))


def search_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "bolt")


def search_exact(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), '"brand#1"')


def search_wildcard(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "[hr]?[td]*.s*")


def search_structured_path(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "/parts/**/red*")


def search_literal_path(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "brand#1/sm")


def search_extension(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "ext:small,promo;[ml]edium")


def search_clauses(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), '"ring"|"bolt" kind:fi !ext:large !path:"brand#2"')


def search_negative_only(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "!bolt")


def search_short_token(spark: SparkSession, d: str) -> DataFrame:
    return _matches(part_files(spark, d), "rwe")


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return search(part_files(spark, d), SearchRequest('"gear"', "size", False, True, 50)).select("path", "size_bytes", "score")


def search_empty_newest(spark: SparkSession, d: str) -> DataFrame:
    return search(part_files(spark, d), SearchRequest("", limit=25)).select("path")


def search_visible_only(spark: SparkSession, d: str) -> DataFrame:
    return candidates(part_files(spark, d), SearchRequest('"ring"', include_hidden=False)).select("path", "score")


# --- catalog -------------------------------------------------------------------------------------


def catalog_derive(spark: SparkSession, d: str) -> DataFrame:
    c = part_files(spark, d)
    return c.select(F.col("id").cast("string").alias("id"), "path", "name", "directory_path", "file_extension", "size_bytes", "is_hidden", "normalized_name")


def tree_virtual(spark: SparkSession, d: str) -> DataFrame:
    return catalog.virtual_rows(customer_files(spark, d)).select("path", "name", "directory_path", "is_directory")


def tree_order(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_order(catalog.with_virtual(customer_files(spark, d))).select("path", "row_id", "subtree_end", "depth", "is_virtual")


def tree_parent(spark: SparkSession, d: str) -> DataFrame:
    tree = catalog.with_virtual(customer_files(spark, d))
    up = tree.select(F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return catalog.with_parent(tree).join(up, "parent_id", "left").select("path", "parent")


def tree_children(spark: SparkSession, d: str) -> DataFrame:
    return catalog.children(catalog.with_virtual(customer_files(spark, d)))


def tree_visibility(spark: SparkSession, d: str) -> DataFrame:
    files = customer_files(spark, d)
    tree = catalog.with_virtual(files).withColumn("is_hidden", F.col("is_hidden") | (F.col("is_directory") & F.col("path").endswith("/BUILDING")))
    return catalog.with_visibility(tree).select("path", "is_visible")


def tree_expand(spark: SparkSession, d: str) -> DataFrame:
    tree = catalog.with_virtual(customer_files(spark, d))
    return catalog.expand_hits(tree, tree.where("is_directory and name like 'NATION_1%'")).select("path")


def _customer_roots(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    names = [r["r_name"] for r in _t(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # a handful of configured roots
    nation = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.min(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name"))).first()[0]
    roots = [f"/{n}" for n in names[:-1]] + [nation]
    return catalog.roots_table(spark, roots), roots


ROOTS_SQL = """
rt as (select '/' || r_name as root from region where r_name <> (select max(r_name) from region)
       union select min('/' || r_name || '/' || n_name) from nation join region on n_regionkey = r_regionkey),
att as (select path, arg_max(root, length(root)) as root from cat join rt on starts_with(path, root || '/') group by path),
roll as (select root, count(*) as n_files, cast(0 as bigint) as n_directories, count(*) filter (where is_hidden) as n_hidden, cast(sum(size_bytes) as bigint) as content_bytes, cast(sum(strlen(path)) as bigint) as path_bytes
         from att join cat using (path) group by root)"""


def root_attribution(spark: SparkSession, d: str) -> DataFrame:
    roots, _ = _customer_roots(spark, d)
    return catalog.with_root(customer_files(spark, d), roots).select("path", "root")


def root_rollup(spark: SparkSession, d: str) -> DataFrame:
    roots, _ = _customer_roots(spark, d)
    roll = insights.root_rollup(catalog.with_root(customer_files(spark, d), roots))
    return insights.allocate(roll, 1_000_000)


def root_configured(spark: SparkSession, d: str) -> DataFrame:
    roots, names = _customer_roots(spark, d)
    roll = insights.root_rollup(catalog.with_root(customer_files(spark, d), roots))
    return insights.root_status(insights.configured_roots(spark, roll, ["/nowhere", *names[:2]])).drop("position")


def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    return insights.extension_histogram(part_files(spark, d))


def gram_lookup(spark: SparkSession, d: str) -> DataFrame:
    files = part_files(spark, d)
    return grams.containing(files, grams.postings(files), "dget").select("path")


# --- exclusion -----------------------------------------------------------------------------------

PATTERNS = ("BUILDING/", "/AFRICA/", "Customer#*1", "!Customer#*11", "NATION_1?/MACHINERY/", "!**/Customer#00000000[0-4]*")


def exclusion_decisions(spark: SparkSession, d: str) -> DataFrame:
    return exclusion.with_decision(customer_files(spark, d), ["/"], PATTERNS).select("path", "decision", "rule")


# --- telemetry -----------------------------------------------------------------------------------


def telemetry_counters(spark: SparkSession, d: str) -> DataFrame:
    c = insights.search_counters(profiles(spark, d))
    return c.select(*[F.round(x, 6).alias(x) if x.endswith("latency") else F.col(x) for x in c.columns])


def telemetry_latency(spark: SparkSession, d: str) -> DataFrame:
    return insights.latency_histogram(profiles(spark, d))


def telemetry_routes(spark: SparkSession, d: str) -> DataFrame:
    r = insights.route_mix(profiles(spark, d))
    return r.select("phase", "route", "n_searches", *[F.round(x, 6).alias(x) for x in ("total_latency", "average_latency", "share")])


def telemetry_index_uses(spark: SparkSession, d: str) -> DataFrame:
    return insights.index_uses(profiles(spark, d))


def telemetry_daily(spark: SparkSession, d: str) -> DataFrame:
    return insights.daily(_t(spark, d, "events").select("ts", F.col("event_type").alias("action")), 10)


def telemetry_memory(spark: SparkSession, d: str) -> DataFrame:
    return insights.memory_by_day(_t(spark, d, "events").select("ts", (F.col("value") * 100 - 500).cast("long").alias("bytes")))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "orders").select((F.col("o_orderkey") % 20).alias("k"), (F.col("o_orderkey") * 7919 % 100_003).alias("start"))
    rows = rows.withColumn("end", F.col("start") + F.col("start") % 13)
    return insights.interval_union(rows, ["k"])


# --- changes -------------------------------------------------------------------------------------


def changes_coalesced(spark: SparkSession, d: str) -> DataFrame:
    return changes.coalesced(change_events(spark, d))


def changes_cursors(spark: SparkSession, d: str) -> DataFrame:
    return changes.cursors(change_events(spark, d), catalog.roots_table(spark, ["/data/u1", "/data/u2", "/data", "/other"]))


def changes_scopes(spark: SparkSession, d: str) -> DataFrame:
    kept = changes.indexable(change_events(spark, d), ["/data"], ("click/",))
    rooted = changes.with_event_root(kept, catalog.roots_table(spark, ["/data"]))
    return changes.scopes(rooted).select("path", "scope", "decision")


def changes_minimal(spark: SparkSession, d: str) -> DataFrame:
    e = change_events(spark, d)
    some = e.where("event_id % 50 = 0").select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    return changes.minimal(e.select("path").unionByName(some))


def changes_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = customer_files(spark, d)
    gone = base.where("name like '%5'").select(F.col("path"))
    gone = gone.unionByName(spark.createDataFrame([("/AFRICA/NATION_0",)], "path string"))
    new = base.where("name like '%7'").withColumn("size_bytes", F.col("size_bytes") + 1)
    return changes.overlay(base, new, gone).select("path", "size_bytes")


def changes_metadata(spark: SparkSession, d: str) -> DataFrame:
    base = customer_files(spark, d)
    delta = base.where("name like '%3'").withColumn("size_bytes", F.col("size_bytes") * 2)
    return changes.replace_metadata(base, delta).select("path", "size_bytes")


# --- applications and diagnostics -----------------------------------------------------------------


def _apps(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/Applications/"), F.replace("s_name", F.lit("#"), F.lit(" Studio ")), F.lit(".app"))
    return apps.with_aliases(apps.bundles(catalog.derive(_t(spark, d, "supplier").select(path.alias("path"), F.lit(True).alias("is_directory")))))


def apps_search(spark: SparkSession, d: str) -> DataFrame:
    found = apps.search_apps(_apps(spark, d), "ss0", "name", limit=100_000)
    return found.select("path", "score", F.col("match.class").alias("class"), "is_alias")


def diagnostics_anonymised(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    fields = F.create_map(F.lit("path"), F.struct(F.lit("path").alias("privacy"), F.concat(F.lit("/Users/Ann/"), "event_type", F.lit("-"), F.col("event_id").cast("string")).alias("value")))
    rows = e.select(F.lit(1).alias("schemaVersion"), F.col("ts").cast("timestamp").alias("timestamp"), F.lit("info").alias("level"), F.lit("search").alias("category"), F.col("event_type").alias("event"), fields.alias("fields"), "event_id")
    out = diagnostics.anonymise(diagnostics.recorded(rows, "info"), "salt")
    return out.select("event_id", F.col("fields")["path"]["value"].alias("value"))


_LOCAL = [
    search_fuzzy, search_exact, search_wildcard, search_structured_path, search_literal_path, search_extension, search_clauses, search_negative_only, search_short_token, search_topk, search_empty_newest, search_visible_only,
    catalog_derive, tree_virtual, tree_order, tree_parent, tree_children, tree_visibility, tree_expand, root_attribution, root_rollup, root_configured, extension_histogram, gram_lookup, exclusion_decisions,
    telemetry_counters, telemetry_latency, telemetry_routes, telemetry_index_uses, telemetry_daily, telemetry_memory, intervals,
    changes_coalesced, changes_cursors, changes_scopes, changes_minimal, changes_overlay, changes_metadata, apps_search, diagnostics_anonymised,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _LOCAL}


_ROUTE = "case when fell_back or execution_path = 'fullFallbackScan' then 'fullScan' when execution_path = 'applicationCatalog' or list_contains(uses, 'applicationCatalog') then 'applicationCatalog' when list_has_any(uses, ['nameGrams', 'componentGrams', 'pathGrams']) then 'mappedIndex' when execution_path in ('emptyQuerySortedOrder', 'extensionCandidateIntersection', 'optimizedSortedFastPath') then 'sidecar' when execution_path in ('nameComponentIndex', 'pathGramIndex', 'indexedCandidateIntersection', 'unprofiledIndexed') then 'mappedIndex' else 'other' end"
_BUCKET = "case when elapsed < 0.01 then '<10ms' when elapsed < 0.05 then '10-50ms' when elapsed < 0.1 then '50-100ms' when elapsed < 0.25 then '100-250ms' when elapsed < 1.0 then '250ms-1s' else '>1s' end"
_VIRTUAL = "virt as (select distinct ancestor as path, n from anc), tree as (select path, 4 as n, false as is_virtual from cat union all select path, n, true from virt)"


def _rule_sql() -> str:
    """The patterns as regular expressions, in order, the last that fits first."""
    tests = [
        (5, r"regexp_matches(rel, '^(.*/)?.*/Customer#00000000[0-4][^/]*$', 'i')", "index"),
        (4, r"regexp_matches(rel, '^(.*/)?NATION_1[^/]/MACHINERY/.+$', 'i')", "prune"),
        (3, r"regexp_matches(rel, '(^|/)Customer#[^/]*11(/|$)', 'i')", "index"),
        (2, r"regexp_matches(rel, '(^|/)Customer#[^/]*1(/|$)', 'i')", "prune"),
        (1, r"regexp_matches(rel, '^AFRICA/.+$', 'i')", "prune"),
        (0, r"regexp_matches(rel, '(^|/)BUILDING/', 'i')", "prune"),
    ]
    decision = " ".join(f"when {t} then '{v}'" for _, t, v in tests)
    rule = " ".join(f"when {t} then '{PATTERNS[i]}'" for i, t, _ in tests)
    return f"with {TREE_SQL}, r as (select path, substr(path, 2) as rel from cat) select path, case {decision} else 'index' end as decision, case {rule} end as rule from r"


def oracle_sql() -> dict[str, str]:
    glob = r"'^[hr].[td].*\.s.*$'"
    red = r"'^/*(parts[^/]*/+(([^/]+/+)*?)red[^/]*)(/|$)'"
    lit = r"'(^|/)brand#1[^/]*/+sm[^/]*'"
    taken = "case when regexp_matches(path, '^/data/u[0-9]+/click/') then 'prune' else 'index' end"
    return {
        "search_fuzzy": _wrap(_name_ways("bolt")),
        "search_exact": _wrap(_exact_ways("brand#1")),
        "search_wildcard": _wrap(
            f"""select path, 3 as rank, 'substring' as class, 5100 - least(length(name), 300) as s, 'name' as field, 'Name contains "[hr]?[td]*.s*"' as reason from cat where regexp_matches(normalized_name, {glob})"""
        ),
        "search_structured_path": _wrap(f"""select path, 1 as rank, 'weakPath' as class, 3900 + 450 + 240 as s, 'path' as field, 'Path matched "/parts/**/red*"' as reason from cat where regexp_matches(normalized_path, {red})"""),
        "search_literal_path": _wrap(f"""select path, 1 as rank, 'weakPath' as class, 4100 + 180 - 80 as s, 'path' as field, 'Path matched "brand#1/sm"' as reason from cat where regexp_matches(normalized_path, {lit})"""),
        "search_extension": _wrap(
            """select path, 6 as rank, 'exact' as class, 4900 as s, 'fileExtension' as field, 'Extension exactly matched "' || file_extension || '"' as reason from cat where file_extension in ('small', 'promo')
            union all select path, 3, 'substring', 4700, 'fileExtension', 'Extension matched wildcard "[ml]edium"' from cat where file_extension in ('medium', 'ledium')"""
        ),
        "search_clauses": f"""with {PARTS_SQL},
w as (select path, greatest(case when contains(normalized_name, 'ring') then 3000000 + 5200 + case when instr(normalized_name, 'ring') = 1 or regexp_matches(substr(normalized_name, instr(normalized_name, 'ring') - 1, 1), {BOUNDARY}) then 500 else 0 end - least(900, 10 * (instr(normalized_name, 'ring') - 1)) else 0 end,
      case when contains(normalized_name, 'bolt') then 3000000 + 5200 + case when regexp_matches(substr(normalized_name, instr(normalized_name, 'bolt') - 1, 1), {BOUNDARY}) then 500 else 0 end - least(900, 10 * (instr(normalized_name, 'bolt') - 1)) else 0 end) as s
      from cat where file_extension <> 'large' and not contains(dir, 'brand#2') and (contains(normalized_path, 'ring') or contains(normalized_path, 'bolt')))
select path, 'substring' as class, cast(least(4, trunc((s - 3000000 + 4400 {PENALTY}) / 2000.0)) as integer) as bin, cast(s - 3000000 + 4400 {PENALTY} as integer) as score, 'name' as field, 'Matched all query terms' as reason from w join cat using (path)""",
        "search_negative_only": f"with {PARTS_SQL} select path, '' as class, 0 as bin, 0 as score, '' as field, '' as reason from cat where false",
        "search_topk": f"""with {PARTS_SQL}, w as (select path, size_bytes, normalized_name, cast(5200 + case when instr(normalized_name, 'gear') = 1 or regexp_matches(substr(normalized_name, instr(normalized_name, 'gear') - 1, 1), {BOUNDARY}) then 500 else 0 end - least(900, 10 * (instr(normalized_name, 'gear') - 1)) {PENALTY} as integer) as score,
 case when instr(normalized_name, 'gear') = 1 then 5 else 3 end as rank from cat where contains(normalized_name, 'gear'))
select path, size_bytes, score from w order by rank desc, least(4, trunc(score / 2000.0)) desc, size_bytes desc, normalized_name, path limit 50""",
        "search_empty_newest": f"with {PARTS_SQL} select path from cat order by p_partkey desc limit 25",
        "search_visible_only": f"""with {PARTS_SQL} select path, cast(5200 + case when instr(normalized_name, 'ring') = 1 or regexp_matches(substr(normalized_name, instr(normalized_name, 'ring') - 1, 1), {BOUNDARY}) then 500 else 0 end - least(900, 10 * (instr(normalized_name, 'ring') - 1)) {PENALTY} as integer) as score
 from cat where contains(normalized_name, 'ring') and not is_hidden""",
        "catalog_derive": f"""with {PARTS_SQL} select cast(list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(str_split(path, ''), lambda c: unicode(c)::hugeint)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) as varchar) as id,
 path, name, directory_path, file_extension, size_bytes, is_hidden, normalized_name from cat""",
        "tree_virtual": f"with {TREE_SQL}, {_VIRTUAL} select path, regexp_extract(path, '[^/]+$') as name, case when n = 1 then '/' else regexp_extract(path, '^(.*)/', 1) end as directory_path, true as is_directory from virt",
        "tree_order": f"""with {TREE_SQL}, {_VIRTUAL}, o as (select path, n, is_virtual, row_number() over (order by str_split(path, '/')) - 1 as row_id from tree)
select a.path, a.row_id, (select max(b.row_id) + 1 from o b where b.path = a.path or starts_with(b.path, a.path || '/')) as subtree_end, a.n as depth, a.is_virtual from o a""",
        "tree_parent": f"with {TREE_SQL}, {_VIRTUAL} select path, case when n > 1 then regexp_extract(path, '^(.*)/', 1) end as parent from tree",
        "tree_children": f"with {TREE_SQL}, {_VIRTUAL} select case when n = 1 then '/' else regexp_extract(path, '^(.*)/', 1) end as directory_path, count(*) as n_children, count(*) filter (where is_virtual) as n_directories from tree group by 1",
        "tree_visibility": f"with {TREE_SQL}, {_VIRTUAL} select t.path, not coalesce(c.is_hidden, false) and not contains(t.path || '/', '/BUILDING/') as is_visible from tree t left join cat c using (path)",
        "tree_expand": f"with {TREE_SQL}, {_VIRTUAL} select path from tree where regexp_matches(path, '^/[^/]+/NATION_1[^/]*/')",
        "root_attribution": f"with {TREE_SQL}, {ROOTS_SQL} select path, root from cat left join att using (path)",
        "root_rollup": f"with {TREE_SQL}, {ROOTS_SQL} select *, cast(round(path_bytes / sum(path_bytes) over () * 1000000) as bigint) as estimated_bytes from roll",
        "root_configured": f"""with {TREE_SQL}, {ROOTS_SQL}, cfg as (select '/nowhere' as root union all select root from (select '/' || r_name as root from region order by 1 limit 2))
select root, c.root is not null as is_configured, coalesce(n_files, 0) as n_files, coalesce(n_directories, 0)::bigint as n_directories, coalesce(n_hidden, 0) as n_hidden, coalesce(content_bytes, 0) as content_bytes, coalesce(path_bytes, 0) as path_bytes,
 case when n_files is null then 'unrepresented' else 'indexed' end as status from (select root from cfg) c full join roll using (root)""",
        "extension_histogram": f"with {PARTS_SQL} select file_extension, count(*) as n_files, cast(sum(size_bytes) as bigint) as content_bytes from cat group by 1",
        "gram_lookup": f"with {PARTS_SQL} select path from cat where contains(normalized_name, 'dget')",
        "exclusion_decisions": _rule_sql(),
        "telemetry_counters": f"""with {PROFILES_SQL} select phase, count(*) as n_started, count(*) filter (where completed) as n_completed, count(*) filter (where cancelled) as n_cancelled, count(*) filter (where stale) as n_stale,
 count(*) filter (where len(uses) > 0) as n_indexed, count(*) filter (where fell_back) as n_fallback, cast(sum(candidates) as bigint) as candidate_rows, cast(sum(scanned) as bigint) as scanned_rows,
 round(sum(elapsed), 6) as total_latency, round(max(elapsed), 6) as max_latency, round(sum(elapsed) / count(*), 6) as average_latency from prof group by phase""",
        "telemetry_latency": f"with {PROFILES_SQL} select phase, {_BUCKET} as bucket, count(*) as n_searches from prof group by 1, 2",
        "telemetry_routes": f"""with {PROFILES_SQL}, r as (select *, {_ROUTE} as route from prof), k as (select phase, route, count(*) as n, sum(elapsed) as t from r where not (phase = 'preview' and route = 'applicationCatalog') group by 1, 2)
select phase, route, n as n_searches, round(t, 6) as total_latency, round(t / n, 6) as average_latency, round(n / sum(n) over (partition by phase), 6) as share from k""",
        "telemetry_index_uses": f"with {PROFILES_SQL} select phase, u as index_use, count(*) as n_searches from prof, unnest(uses) as t(u) group by 1, 2",
        "telemetry_daily": "with p as (select strftime(ts, '%Y-%m-%d') as day, event_type as action, count(*) as n from events group by 1, 2) select * from p where day in (select distinct day from p order by day desc limit 10)",
        "telemetry_memory": "with s as (select ts, cast(trunc(value * 100 - 500) as bigint) as bytes from events) select strftime(ts, '%Y-%m-%d') as day, arg_max(bytes, ts) as latest_bytes, min(bytes) as least_bytes, max(bytes) as most_bytes from s where bytes > 0 group by 1",
        "intervals": """with r as (select o_orderkey % 20 as k, o_orderkey * 7919 % 100003 as s, o_orderkey * 7919 % 100003 + (o_orderkey * 7919 % 100003) % 13 as e from orders),
 n as (select *, case when max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as fresh from r where s < e),
 g as (select *, sum(fresh) over (partition by k order by s, e rows unbounded preceding) as g from n) select k, min(s) as start, max(e) as "end" from g group by k, g""",
        "changes_coalesced": f"with {CHANGES_SQL} select path, bit_or(flags)::bigint as flags, max(event_id) as event_id, min(event_id) as first_event_id from ch group by path",
        "changes_cursors": f"with {CHANGES_SQL} select case when starts_with(path, '/data/u1/') then '/data/u1' when starts_with(path, '/data/u2/') then '/data/u2' else '/data' end as root, max(event_id) as event_id from ch group by 1",
        "changes_scopes": f"""with {CHANGES_SQL}, c as (select path, bit_or(flags) as f from ch group by path) select path, case when f & 131072 <> 0 then path when f & 2560 <> 0 then regexp_extract(path, '^(.*)/', 1) else path end as scope, {taken} as decision from c where {taken} = 'index'""",
        "changes_minimal": f"""with {CHANGES_SQL}, p as (select distinct path from ch), u as (select path from p union select regexp_extract(path, '^(.*)/', 1) from ch where event_id % 50 = 0)
select path from u a where not exists (select 1 from u b where starts_with(a.path, b.path || '/'))""",
        "changes_overlay": f"""with {TREE_SQL}, k as (select * from cat where path not like '%5' and not starts_with(path, '/AFRICA/NATION_0/'))
select path, size_bytes from k where path not like '%7' union all select path, size_bytes + 1 from cat where path like '%7'""",
        "changes_metadata": f"with {TREE_SQL} select path, case when path like '%3' then size_bytes * 2 else size_bytes end as size_bytes from cat",
    }
