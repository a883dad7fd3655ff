"""URL filtering: host and path rules first, then a tree of path templates per host.

Pages are counted by host and masked path before anything else, so a url with a third
of all pages is one row from there on. The tree is built level by level from the host
down: a node with many children, most of them rare, is a variable field, and its children
become one wildcard before their own children are looked at. Then branches are merged from
the leaves up: at each node, the children whose labelled share doesn't differ significantly
from that of all of them become one with the node, the others stay branches of their own.
A branch is rejected if its share of bad labelled pages, smoothed by the host's share,
which is itself smoothed by the share of all hosts, reaches ``purity``. Pages that a
rule judges are the labelled ones.

The tree has ``levels`` segments; what a path has beyond them is one last segment.

Defined results: a null url, or one without ``://``, has an empty host and path; of rules
of equal length the first that fits wins; pages without labelled neighbours are allowed;
repeated rows are judged alike and counted as often as they occur; an empty table gives no
rows; urls of any length are read whole; extra columns are ignored unless named in
``keep``, and a kept column that has a result's name comes under ``kept_`` and its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import col, discard, heavy_join, kept_names, materialise
from trovana.llm.decontaminate import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest rule wins, then the first."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: Segments that are ids whatever their host: digits, long hexadecimal numbers, UUIDs; an ending is kept.
ID = r"(?<=/)(?:[0-9]+|[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?=[./]|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    ascii_low = F.when(F.octet_length(host) == F.length(host), F.lower(host)).otherwise(F.translate(host, UPPER, LOWER))
    return ascii_low, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``ruled`` and ``masked``."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last that fits is the longest, and of these the first
        fits = r.fits(F.col("host"), F.col("path"))
        which, verdict = F.when(fits, r.name).otherwise(which), F.when(fits, r.verdict).otherwise(verdict)
    return out.withColumns({"rule": which, "ruled": verdict, "masked": F.regexp_replace("path", ID, "*")})


def node(segs: Column, depth: Column) -> Column:
    """The node that the first ``depth`` segments lead to."""
    return F.xxhash64("host", depth, F.slice(segs, F.lit(1), depth))


def generalised(counts: DataFrame, levels: int, max_children: int, rare: float) -> DataFrame:
    """``counts`` (``host``, ``masked``, ``n``) with ``t``, the segments of its template."""
    whole = F.split("masked", "/")
    segs = F.when(F.size(whole) <= levels, whole).otherwise(F.concat(F.slice(whole, 1, levels - 1), F.array(F.array_join(F.slice(whole, F.lit(levels), F.size(whole)), "/"))))
    rows = materialise(counts.withColumn("t", segs), "url-paths")
    total, deepest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("t")), F.lit(0))).first()
    for d in range(deepest):
        here = rows.where(F.size("t") > d).select(node(F.col("t"), F.lit(d)).alias("at"), F.get("t", F.lit(d)).alias("seg"), "n")
        # so many rows, and so many children, has a node
        children = here.groupBy("at", "seg").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        variable = children.groupBy("at").agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("rows").alias("rows"))
        variable = variable.where((F.col("children") > max_children) & (F.col("n") < rare * F.col("children"))).select("at", "rows", F.lit(True).alias("open"))
        keyed = rows.withColumn("at", F.when(F.size("t") > d, node(F.col("t"), F.lit(d))))
        opened = heavy_join(keyed, materialise(variable, "url-variable"), "at", "rows", total, "left")
        t = F.when(F.col("open"), F.transform("t", lambda x, i: F.when(i == d, F.lit("*")).otherwise(x))).otherwise(F.col("t"))
        new = materialise(opened.withColumn("t", t).drop("at", "open"), "url-paths")
        discard(rows)
        rows = new
    return rows


def branches(templates: DataFrame, z: float) -> DataFrame:
    """``templates`` (``host``, ``t``, ``labelled``, ``bad``) with ``branch``: the node that each is merged into.

    ``up`` is the depth of the node that a template has come to, ``done`` the step at which it became a branch of its own.
    """
    rows = materialise(templates.withColumns({"up": F.size("t"), "done": F.lit(0)}), "url-templates")
    total, deepest = rows.agg(F.count("*"), F.coalesce(F.max("up"), F.lit(0))).first()
    for d in range(deepest, 0, -1):
        # children of nodes at depth d - 1, and those nodes as templates themselves
        here = (F.col("done") == 0) & F.col("up").isin(d, d - 1)
        child = rows.where(here).groupBy("host", F.slice("t", 1, d).alias("c")).agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
        child = child.withColumn("at", node(F.col("c"), F.lit(d - 1)))
        parent = child.groupBy("at").agg(F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"), F.count("*").alias("children"))
        rate = F.col("all_bad") / F.col("all")
        apart = F.abs(F.col("bad") - F.col("labelled") * rate) > z * F.sqrt(F.col("labelled") * rate * (1 - rate))
        judged = heavy_join(child, parent.where("all > 0"), "at", "children", total).where((F.col("labelled") > 0) & apart)
        judged = materialise(judged.select(node(F.col("c"), F.size("c")).alias("own"), "rows", F.lit(True).alias("apart")), "url-apart")
        mine = F.when(here, node(F.col("t"), F.least(F.size("t"), F.lit(d))))
        new = heavy_join(rows.withColumn("own", mine), judged, "own", "rows", total, "left")
        up = F.when(F.col("apart").isNull() & (F.col("done") == 0) & (F.col("up") == d), d - 1).otherwise(F.col("up"))
        new = materialise(new.withColumns({"up": up, "done": F.when(F.col("apart"), d).otherwise(F.col("done"))}).drop("own", "apart"), "url-templates")
        discard(rows)
        rows = new
    return rows.select("host", "t", "labelled", "bad", F.xxhash64(node(F.col("t"), F.col("up")), "done").alias("branch"))


def template_verdicts(judged: DataFrame, max_children: int = 20, rare: float = 3.0, z: float = 1.96, weight: float = 5.0, purity: float = 0.8, levels: int = 12) -> DataFrame:
    """(host, masked, n, template, share, rejected) for each host and masked path."""
    counts = judged.groupBy("host", "masked").agg(
        F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    named = generalised(counts, levels, max_children, rare)
    per = named.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
    placed = branches(per, z)
    hosts = per.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    total = per.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    overall = (total["b"] + 1) / (total["n"] + 2)
    base = (F.col("h_bad") + weight * overall) / (F.col("h_labelled") + weight)
    share = (F.col("b_bad") + weight * base) / (F.col("b_labelled") + weight)
    merged = placed.groupBy("host", "branch").agg(F.sum("labelled").alias("b_labelled"), F.sum("bad").alias("b_bad"), F.count("*").alias("templates")).join(hosts, "host")
    merged = merged.select("branch", "templates", share.alias("share"), ((share >= purity) & (F.col("b_labelled") > 0)).alias("rejected"))
    told = heavy_join(placed, merged, "branch", "templates", placed.count())
    key = F.xxhash64("host", "t").alias("key")
    told = told.select(key, "share", "rejected").join(per.select(key, "rows"), "key")
    return heavy_join(named.select("host", "masked", "n", "t", key), told, "key", "rows", named.count()).select("host", "masked", "n", F.array_join("t", "/").alias("template"), "share", "rejected")


RESULTS = ("host", "path", "rule", "verdict", "template", "share")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...], keep: tuple[str, ...] = ("page_id",), **tree: float) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``share`` of every page."""
    # kept columns travel under numbers, so that none can clash
    judged = ruled(pages.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col("url").alias("url")), rules).drop("url")
    found = materialise(template_verdicts(judged, **tree), "url-verdicts")
    found = found.select(F.struct("host", "masked").alias("key"), "n", "template", "share", "rejected")
    rows = judged.withColumn("key", F.struct("host", "masked")).drop("masked")
    out = heavy_join(rows, found, "key", "n", judged.count(), "left")
    by_method = F.when(F.col("rejected"), "block").otherwise("allow")
    names = kept_names(keep, RESULTS)
    return out.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "template", "share")
