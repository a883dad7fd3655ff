"""Applications: bundles found in the catalog, their aliases, and searching them."""

from __future__ import annotations

import plistlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.functions.text import fold_text
from trovana.operators import catalog, search
from trovana.plans import compiler
from trovana.plans.query import parse

#: Parts of a bundle identifier that say nothing.
IGNORED = frozenset(("com", "org", "net", "io", "app", "apps"))
#: The keys of a property list that name an application.
NAME_KEYS = ("CFBundleDisplayName", "CFBundleName", "CFBundleExecutable")

ALIASES = "array<struct<value:string,source:string>>"


def bundles(df: DataFrame) -> DataFrame:
    """Application directories that lie in no other one and aren't hidden."""
    apps = df.where("is_directory and file_extension = 'app' and not is_hidden")
    inner = catalog.exploded(apps).join(apps.select(F.col("path").alias("ancestor")), "ancestor", "left_semi").select("path").distinct()
    return apps.join(inner, "path", "left_anti").dropDuplicates(["path"])


def compact(text: str) -> str:
    return "".join(c for c in fold_text(text) if c.isalnum())


def words(text: str) -> list[str]:
    """Parts of a name: runs of letters and digits, also cut where a capital follows a small letter or digit."""
    return [w.lower() for run in re.findall(r"[^\W_]+", text) for w in re.sub(r"(?<=[^\W\d_A-Z])(?=[A-Z])|(?<=\d)(?=[A-Z])", " ", run).split()]


def name_aliases(text: str) -> list[str]:
    """The words in one, their initials, and the initials of all but the last with the last."""
    w = words(text)
    out = [text, "".join(w)] if w else [text]
    if len(w) > 1:
        out.append("".join(x[0] for x in w))
    if len(w) > 2:
        out.append("".join(x[0] for x in w[:-1]) + w[-1])
    return out


def aliases(name: str, plist: bytes | None) -> list[tuple[str, str]]:
    """(alias, source), each alias once, two characters at least."""
    out: dict[str, str] = {}

    def add(text: str, source: str) -> None:
        value = compact(text)
        if len(value) >= 2:
            out.setdefault(value, source)

    for a in name_aliases(re.sub(r"(?i)\.app$", "", name)):
        add(a, "app name")
    try:
        info = plistlib.loads(plist) if plist else {}
    except Exception:
        info = {}
    if not isinstance(info, dict):
        info = {}
    identifier = info.get("CFBundleIdentifier")
    if isinstance(identifier, str):
        for part in re.findall(r"[^\W_]+", identifier):
            if compact(part) not in IGNORED:
                add(part, "bundle identifier")
    for key in NAME_KEYS:
        if isinstance(info.get(key), str) and info[key].strip():
            for a in name_aliases(info[key].strip()):
                add(a, key)
    for kind in info.get("CFBundleURLTypes") or []:
        if not isinstance(kind, dict):
            continue
        if isinstance(kind.get("CFBundleURLName"), str):
            for a in name_aliases(kind["CFBundleURLName"]):
                add(a, "URL name")
        for scheme in kind.get("CFBundleURLSchemes") or []:
            if isinstance(scheme, str):
                add(scheme, "URL scheme")
    return list(out.items())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("source", T.StringType())])))
def _aliases(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for names, plists in parts:
        yield pd.Series([[{"value": v, "source": s} for v, s in aliases(n, p)] for n, p in zip(names, plists, strict=True)])


def with_aliases(apps: DataFrame, plists: DataFrame | None = None) -> DataFrame:
    """``aliases`` from the name and, where ``plists`` (path, content) has one, the bundle's property list."""
    if plists is None:
        return apps.withColumn("aliases", _aliases(F.col("name"), F.lit(None).cast("binary")))
    own = plists.select(F.regexp_replace("path", r"^file:|/Contents/Info\.plist$", "").alias("_app"), F.col("content").alias("_plist"))
    joined = apps.join(own, apps["path"] == own["_app"], "left")
    return joined.withColumn("aliases", _aliases(F.col("name"), F.col("_plist"))).drop("_app", "_plist")


def _ranked(kind: str, score: Column, reason: Column, alias: bool) -> Column:
    none = F.array().cast(f"array<{compiler.SPAN}>")
    return F.struct(F.lit(compiler.RANK[kind]).alias("rank"), compiler.score_bin(score).alias("bin"), score.cast("int").alias("score"), F.lit(kind).alias("class"), F.lit("name").alias("field"), reason.alias("reason"), none.alias("spans"), F.lit(alias).alias("alias"))


def name_match(text: str) -> Column:
    """The name without its ending: equal or beginning."""
    folded, quoted = fold_text(text.strip()), text
    name = F.trim(F.regexp_replace(F.col("normalized_name"), r"\.app$", ""))
    if not folded:
        return F.lit(None)
    return F.when(name == folded, _ranked("exact", F.lit(11_800), F.lit(f'App name exactly matched "{quoted}"'), False)).when(
        name.startswith(folded), _ranked("prefix", F.lit(9_700), F.lit(f'App name starts with "{quoted}"'), False)
    )


def alias_match(text: str) -> Column:
    """The best alias: equal before beginning, shorter before longer, earlier before later."""
    token = compact(text)
    if not token:
        return F.lit(None)
    fits = F.filter("aliases", lambda a: a["value"].startswith(token))
    score = lambda a: F.when(a["value"] == token, 9_600).otherwise(7_600 - F.least(F.length(a["value"]), F.lit(300)))
    best = F.array_max(F.transform(fits, lambda a, i: F.struct((a["value"] == token).alias("exact"), score(a).alias("score"), (-i).alias("turn"), a["source"].alias("source"))))
    reason = lambda verb: F.concat(F.lit("App alias from "), best["source"], F.lit(f' {verb} "{text}"'))
    return F.when(best["exact"], _ranked("exact", best["score"], reason("exactly matched"), True)).when(best.isNotNull(), _ranked("prefix", best["score"], reason("starts with"), True))


def app_matches(apps: DataFrame, text: str) -> DataFrame:
    """Applications by name, by the query language, or by alias, unordered; the best of the three counts."""
    text = text.strip()
    if not text:
        return apps.withColumn("match", F.lit(None).cast(compiler.MATCH)).withColumn("score", F.lit(0)).withColumn("is_alias", F.lit(False))
    plain = search.explained(apps, parse(text)).select("path", F.col("match").alias("_m"))
    rows = apps.join(plain, "path", "left")
    by_query = F.when(F.col("_m").isNotNull(), F.struct(*[F.col(f"_m.{c}").alias(c) for c in ("rank", "bin", "score", "class", "field", "reason", "spans")], F.lit(False).alias("alias")))
    turns = [name_match(text), by_query, alias_match(text)]
    shape = "struct<rank:int,bin:int,score:int,turn:int,class:string,field:string,reason:string,spans:array<" + compiler.SPAN + ">,alias:boolean>"
    ranked = [F.when(m.isNotNull(), F.struct(m["rank"].alias("rank"), m["bin"].alias("bin"), m["score"].alias("score"), F.lit(-i).alias("turn"), *[m[c].alias(c) for c in ("class", "field", "reason", "spans", "alias")]).cast(shape)) for i, m in enumerate(turns) if i == 1 or fold_text(text)]
    rows = rows.withColumn("_best", F.greatest(*ranked)).where("_best is not null")
    match = F.struct(*[F.col(f"_best.{c}").alias(c) for c in ("rank", "bin", "score", "class", "field", "reason", "spans")]).cast(compiler.MATCH)
    return rows.withColumn("match", match).withColumn("score", F.col("_best.score")).withColumn("is_alias", F.col("_best.alias")).drop("_best", "_m")


def search_apps(apps: DataFrame, text: str = "", sort: str = "relevance", ascending: bool = True, limit: int = search.LIMIT) -> DataFrame:
    """The first applications in order."""
    found = app_matches(apps, text)
    return found.orderBy(*search.ordering(found, sort, ascending, not text.strip(), direction_counts=True)).limit(limit)
