"""Search: filter, explain, order, cut.

The one plan is a scan: stored columns are filtered with built-in expressions, what is
left is explained, and ``orderBy().limit()`` becomes a bounded top-k per task. Quality
comes before the chosen column for every query that isn't empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.functions.text import fold_text
from trovana.operators import catalog
from trovana.plans import compiler
from trovana.plans.query import Query, apps_query, literal, parse

SORTS = ("relevance", "name", "path", "modified", "created", "size", "extension", "kind", "volume", "root")
LIMIT = 2000


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    sort: str = "relevance"
    ascending: bool = True
    include_hidden: bool = True
    limit: int = LIMIT


def sort_key(name: str) -> Column:
    return {
        "name": F.col("normalized_name"),
        "path": F.col("normalized_path"),
        "modified": F.col("modified_time"),
        "created": F.coalesce("created_time", F.lit("2001-01-01 00:00:00").cast("timestamp")),
        "size": F.col("size_bytes"),
        "extension": F.col("file_extension"),
        "kind": catalog.kind_name(),
        "volume": F.col("volume_name"),
    }[name]


def ordering(df: DataFrame, sort: str, ascending: bool, query_empty: bool, direction_counts: bool = False) -> list[Column]:
    """Quality, then the column, then folded name and path: a total order, as paths are unique.

    Relevance is quality alone, or for an empty query the newest first; only the application catalog
    (``direction_counts``) lets the direction turn that.
    """
    keys = [] if query_empty else [F.col("match.rank").desc(), F.col("match.bin").desc()]
    if sort == "relevance":
        if query_empty:
            newest = F.col("modified_time")
            keys.append(newest.asc() if direction_counts and ascending else newest.desc())
    else:
        if sort == "root":
            key = F.coalesce(F.col("root"), F.lit("")) if "root" in df.columns else F.lit("")
        else:
            key = sort_key(sort)
        keys.append(key.asc() if ascending else key.desc())
    return [*keys, F.col("normalized_name").asc(), F.col("path").asc()]


def explained(df: DataFrame, query: Query) -> DataFrame:
    """Rows that match, with ``match``. A query without positive clauses matches nothing."""
    if not query.positive:
        return df.withColumn("match", F.lit(None).cast(compiler.MATCH)).where(F.lit(False))
    rows = compiler.with_directory(df).where(compiler.possible(query))
    near, clauses = compiler.near_columns(query), compiler.clause_columns(query)
    rows = compiler.fenced(rows.select("*", *(c.alias(n) for n, c in near.items())), clauses)
    rows = rows.where(compiler.clauses_hold(query)).withColumn("_top", compiler.top_clause(query))
    return rows.withColumn("match", compiler.combined(query, F.col("_top"))).drop("_dir", "_top", *near, *clauses)


def candidates(df: DataFrame, request: SearchRequest, query: Query | None = None) -> DataFrame:
    """All matching rows, unordered, with ``match`` and ``score``; ``count()`` of it is the total.

    ``query`` stands for the request's text, if given.
    """
    if "is_virtual" in df.columns:
        df = df.where("not is_virtual")
    if not request.include_hidden:
        if "is_visible" not in df.columns:
            df = catalog.with_visibility(df)
        df = df.where("is_visible")
    query = parse(request.query) if query is None else query
    if query.empty:
        return df.withColumn("match", F.lit(None).cast(compiler.MATCH)).withColumn("score", F.lit(0))
    return explained(df, query).withColumn("score", F.col("match.score"))


def search(df: DataFrame, request: SearchRequest) -> DataFrame:
    """The first ``limit`` rows in order; 0 gives none, as for a request that only counts."""
    return found_rows(df, request, parse(request.query))


def found_rows(df: DataFrame, request: SearchRequest, query: Query) -> DataFrame:
    found = candidates(df, request, query)
    return found.orderBy(*ordering(found, request.sort, request.ascending, query.empty)).limit(request.limit)


def search_late(stored: DataFrame, request: SearchRequest) -> DataFrame:
    """``search`` over rows read from files, which reads the other columns of the winners only.

    The order is decided over the columns that the query and the order need, which is all that the first scan
    reads; it yields where the first ``limit`` rows lie, a list of that length at most. The second scan opens these
    rows' files and no others.
    """
    spark = stored.sparkSession
    placed = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    found = found_rows(placed, request, parse(request.query)).select("_file", "_at", "match", "score")
    winners = found.collect()
    schema = found.schema.add("_turn", "integer")
    turns = spark.createDataFrame([(*w, i) for i, w in enumerate(winners)], schema)
    files = sorted({w["_file"] for w in winners})
    near = stored.where(F.col("_metadata.file_path").isin(files) if files else F.lit(False)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    if "is_virtual" in near.columns:
        near = near.drop("is_virtual")
    # no more rows than the limit
    return near.join(F.broadcast(turns), ["_file", "_at"]).orderBy("_turn").drop("_file", "_at", "_turn")


def total(df: DataFrame, request: SearchRequest) -> int:
    return candidates(df, request).count()


class Catalog:
    """A catalog to query: rows of ``trovana.operators.catalog.SCHEMA``."""

    def __init__(self, rows: DataFrame, roots: DataFrame | None = None):
        self.rows = catalog.with_root(rows, roots) if roots is not None else rows

    def applications(self, plists: DataFrame | None = None) -> DataFrame:
        """The application bundles among the rows, with their aliases."""
        from trovana.operators import apps

        return apps.with_aliases(apps.bundles(self.rows), plists)

    def search(self, text: str = "", sort: str = "relevance", ascending: bool = True, include_hidden: bool = True, limit: int = LIMIT) -> DataFrame:
        """A query that begins with ``app:`` searches the applications by what follows."""
        wanted = apps_query(text)
        if wanted is not None:
            from trovana.operators import apps

            return apps.search_apps(self.applications(), wanted, sort, ascending, limit)
        return search(self.rows, SearchRequest(text, sort, ascending, include_hidden, limit))

    def total(self, text: str = "", include_hidden: bool = True) -> int:
        wanted = apps_query(text)
        if wanted is not None:
            from trovana.operators import apps

            return apps.app_matches(self.applications(), wanted).count()
        return total(self.rows, SearchRequest(text, include_hidden=include_hidden))

    def preview(self, text: str, sort: str = "relevance", ascending: bool = True, include_hidden: bool = True, limit: int = LIMIT) -> DataFrame:
        """Only what built-in expressions decide: the query without near matches, so its rows are among the search's."""
        return found_rows(self.rows, SearchRequest(text, sort, ascending, include_hidden, limit), literal(parse(text)))


#: The columns by which a preview can be sorted, and why one is skipped.
PREVIEW_SORTS = ("relevance", "name", "modified")


def preview_skip_reason(text: str, sort: str, displayed: bool = False) -> str | None:
    """Why no preview is run ahead of a search; None if one is."""
    if apps_query(text) is not None:
        return "applicationSearch"
    if not text.strip():
        return "emptyQuery"
    if sort not in PREVIEW_SORTS:
        return "unsupportedSort"
    return "alreadyDisplayed" if displayed else None


def retry_stale(used_candidates: bool, answered: int | None, current: int, scheduled: bool, n_rows: int, n_total: int, indexing: bool) -> bool:
    """Is a search run again whose answer is of an older snapshot revision? Not while indexing, if it has rows to show."""
    outdated = used_candidates and scheduled and answered is not None and answered < current
    return outdated and not (indexing and n_rows > 0 and n_total > 0)


def prefix_range(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose folded name begins with a folded prefix, as a range that a copy sorted by name is pruned with."""
    folded = fold_text(prefix)
    name = F.col("normalized_name")
    return df.where((name >= folded) & name.startswith(folded))
