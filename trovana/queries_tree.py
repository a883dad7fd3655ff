"""Registered queries over subtree intervals, compiled rules and what later rounds have added, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana import queries as base
from trovana.operators import catalog, exclusion, intervals

# --- subtrees ------------------------------------------------------------------------------------


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_order(catalog.with_virtual(base.customer_files(spark, d)))


def tree_below_many(spark: SparkSession, d: str) -> DataFrame:
    """All below the nations whose names begin alike, and below a segment of every nation: intervals within others."""
    tree = _ordered(spark, d)
    return intervals.below(tree, tree.where("is_directory and (name like 'NATION_1%' or name = 'MACHINERY')")).select("path")


def tree_hidden_below(spark: SparkSession, d: str) -> DataFrame:
    tree = _ordered(spark, d).withColumn("is_hidden", F.col("is_hidden") | (F.col("is_directory") & F.col("path").endswith("/BUILDING")))
    return intervals.with_visibility(tree).select("path", "is_visible")


def tree_totals(spark: SparkSession, d: str) -> DataFrame:
    tree = _ordered(spark, d)
    return intervals.subtree_totals(tree, "size_bytes").join(tree.select("row_id", "path"), "row_id").select("path", "n_below", "size_bytes_below")


def interval_islands(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping ranges of order keys, merged without a key that could gather them."""
    k = F.col("o_orderkey")
    return intervals.merge_intervals(base._t(spark, d, "orders").select((k * 7919 % 1_000_003).alias("start"), (k * 7919 % 1_000_003 + k % 40).alias("stop")))


# --- rules ---------------------------------------------------------------------------------------


def _place(pattern: str) -> str:
    """A path that a pattern fits, with other letters' case."""
    p = pattern.lstrip("!")
    for sign, text in (("**", "m/n"), ("*", "w")):
        p = p.replace(sign, text)
    return p.rstrip("/").swapcase()


PLACES = tuple(dict.fromkeys(map(_place, exclusion.DEFAULT_PATTERNS)))
#: What is put around a place: directories above it, something below it, or a name that only looks like it.
FORMS = (("", "", False), ("", "", True), ("", "/x.Pyc", False), ("a/", "/sub", True), ("build/q/", "", False), (".git/hooks/", "/y", False), ("not", "", True))


def exclusion_compiled(spark: SparkSession, d: str) -> DataFrame:
    """Every default pattern's place, in several surroundings, as files and directories."""
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    form = F.floor(k / len(PLACES))
    before, behind, directory = (pick([f[i] for f in FORMS], form) for i in range(3))
    rows = base._t(spark, d, "part").select(F.concat(F.lit("/p"), k.cast("string"), F.lit("/"), before, pick(PLACES, k), behind).alias("path"), directory.alias("is_directory"))
    return exclusion.with_decision(rows, ["/"], exclusion.DEFAULT_PATTERNS).select("path", "is_directory", "decision", "rule")


def _compiled_sql() -> str:
    """Each rule as an expression of its own, tried on each path: what a dictionary must not change."""
    quoted = lambda s: "null" if s is None else "'" + s.replace("'", "''") + "'"
    rules = ",\n".join(
        f"({i}, {quoted(r.raw)}, {r.negated}, {r.traversal}, {quoted(r.literal_prefix)}, {quoted(r.for_file)}, {quoted(r.for_directory)})" for i, r in enumerate(exclusion.compile_rules())
    )
    pick = lambda values, n: f"([{', '.join(str(v).lower() if isinstance(v, bool) else quoted(v) for v in values)}])[{n} % {len(values)} + 1]"
    form = f"(p_partkey // {len(PLACES)})"
    before, behind, directory = (pick([f[i] for f in FORMS], form) for i in range(3))
    return f"""with rules(i, raw, negated, traversal, lead, for_file, for_directory) as (values {rules}),
p as (select 'p' || p_partkey || '/' || {before} || {pick(PLACES, 'p_partkey')} || {behind} as rel, {directory} as is_directory from part),
l as (select rel, is_directory, max(i) as i from p join rules on regexp_matches(rel, case when is_directory then for_directory else for_file end) group by all),
b as (select distinct rel from l join rules r on r.i > l.i and r.negated and not r.traversal and r.lead <> '' where rel = lead or starts_with(rel, lead || '/') or starts_with(lead, rel || '/'))
select '/' || p.rel as path, p.is_directory, case when raw is null or (negated and not (traversal and p.is_directory)) then 'index' when not p.is_directory then 'prune'
       when traversal or b.rel is not null then 'skipButDescend' else 'prune' end as decision, raw as rule
from p left join l using (rel, is_directory) left join rules using (i) left join b on b.rel = p.rel"""


QUERIES = [tree_below_many, tree_hidden_below, tree_totals, interval_islands, exclusion_compiled]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    tree = f"with {base.TREE_SQL}, {base._VIRTUAL}"
    return {
        "tree_below_many": f"{tree} select path from tree where regexp_matches(path, '^/[^/]+/NATION_1[^/]*/') or contains(path, '/MACHINERY/')",
        "tree_hidden_below": f"{tree} select t.path, not coalesce(c.is_hidden, false) and not contains(t.path || '/', '/BUILDING/') as is_visible from tree t left join cat c using (path)",
        "tree_totals": f"""{tree}, below as (select ancestor as path, count(*) as n, sum(size_bytes) as s from (select ancestor, path, size_bytes from anc join cat using (path)
 union all select distinct a.ancestor, b.ancestor, 0 from anc a join anc b on a.path = b.path and a.n < b.n) group by 1)
select path, cast(n as bigint) as n_below, cast(s as bigint) as size_bytes_below from below""",
        "interval_islands": """with r as (select o_orderkey * 7919 % 1000003 as s, o_orderkey * 7919 % 1000003 + o_orderkey % 40 as e from orders),
o as (select *, coalesce(s > max(e) over (order by s, e rows between unbounded preceding and 1 preceding), true) as new from r where s < e),
g as (select *, sum(new::int) over (order by s, e rows unbounded preceding) as island from o)
select cast(min(s) as bigint) as start, cast(max(e) as bigint) as stop from g group by island""",
        "exclusion_compiled": _compiled_sql(),
    }
