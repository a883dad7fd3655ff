"""Queries to Catalyst columns.

A term becomes one expression over the catalog's stored columns that yields a match or
null. A match is a struct that orders by quality and score, so the best of several is
``greatest``. Equality, prefix, substring, wildcards and structured paths are built-in
expressions; only rows that these leave undecided, and that a superset test lets
through, carry a value into the Arrow function for near matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.functions import fuzzy
from trovana.functions.text import SEPARATOR_CLASS, depth_penalty, utf16_length
from trovana.plans import glob
from trovana.plans.query import Query, Term

#: The order of the classes of a match, best first is highest.
RANK = {"metadata": 0, "weakPath": 1, "near": 2, "substring": 3, "alias": 4, "prefix": 5, "exact": 6}

SPAN = "struct<field:string,location:int,length:int,style:string>"
#: What a query yields.
MATCH = f"struct<rank:int,bin:int,score:int,class:string,field:string,reason:string,spans:array<{SPAN}>>"
#: What a term yields: rank, score and turn decide, which is the order of qualities as well, since a bin
#: never falls as the score rises; the rest explains.
FOUND = f"struct<rank:int,score:int,turn:int,field:string,reason:string,spans:array<{SPAN}>>"

_NEAR = T.StructType(
    [
        T.StructField("score", T.IntegerType()),
        T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("n", T.ArrayType(T.IntegerType())),
        T.StructField("style", T.StringType()),
    ]
)


def _rows(found: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "score": pd.array([f[0] if f else None for f in found], dtype="Int32"),
            "at": [[s[0] for s in f[1]] if f else None for f in found],
            "n": [[s[1] for s in f[1]] if f else None for f in found],
            "style": [f[1][0][2] if f else None for f in found],
        }
    )


def _near_udf(token: str, path: bool):
    @F.pandas_udf(_NEAR)
    def near(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for source, folded in parts:
            yield _rows([None if not s else fuzzy.near_path(s, token) if path else fuzzy.near_name(s, f or "", token) for s, f in zip(source, folded, strict=True)])

    return near.asNondeterministic()  # so that the optimizer doesn't run it twice


def score_bin(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), (score / 2000).cast("int")))


def match(rank: str | Column, score: Column, field: str, reason: Column, spans: Column | None = None, turn: int = 0) -> Column:
    return F.struct(
        (F.lit(RANK[rank]) if isinstance(rank, str) else rank).cast("int").alias("rank"),
        score.cast("int").alias("score"),
        F.lit(-turn).alias("turn"),
        F.lit(field).alias("field"),
        reason.alias("reason"),
        (F.array().cast(f"array<{SPAN}>") if spans is None else spans).alias("spans"),
    )


def best(found: list[Column]) -> Column:
    """The best match by quality, then score, then turn; null if there is none."""
    return found[0] if len(found) == 1 else F.greatest(*found)


def span(field: str, source: Column, start: Column, length: Column, style: str = "contiguous") -> Column:
    """One span; offsets count UTF-16 units of the source."""
    ascii_source = F.octet_length(source) == F.length(source)
    at = F.when(ascii_source, start).otherwise(utf16_length(F.substring(source, F.lit(1), start)))
    n = F.when(ascii_source, length).otherwise(utf16_length(F.substring(source, start + 1, length)))
    return F.array(F.struct(F.lit(field).alias("field"), at.cast("int").alias("location"), n.cast("int").alias("length"), F.lit(style).alias("style")))


def _quoted(verb: str, token: str) -> Column:
    return F.lit(f'{verb} "{token}"')


NAME_REASON = {"exact": "Name exactly matched", "prefix": "Name starts with", "substring": "Name contains", "near": "Name nearly matched"}


class _Fields:
    """The stored columns of a catalog that queries read."""

    _names = {"name": "name", "folded_name": "normalized_name", "folded_path": "normalized_path", "path": "path", "directory": "directory_path", "extension": "file_extension", "is_directory": "is_directory", "hidden": "is_hidden"}

    def __getattr__(self, name: str) -> Column:
        return F.col(self._names[name])

    @staticmethod
    def folded_directory() -> Column:
        """Made once per query by ``with_directory``."""
        return F.col("_dir")


Fields = _Fields()


def fenced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with some columns made once: neither projections nor filters move their expressions past this point.

    Without it the optimizer copies a clause's expression to each of its uses, and the generated code outgrows
    what Java compiles.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return df.select("*", made).select("*", *[F.col(f"_made.{n}").alias(n) for n in columns]).drop("_made")


def with_directory(df: DataFrame) -> DataFrame:
    """Adds the folded path without its last part: folding never touches slashes."""
    p = F.col("normalized_path")
    cut = F.regexp_replace(p, "/+[^/]*$", "")
    return df.withColumn("_dir", F.when((cut == "") & p.startswith("/"), "/").otherwise(cut))


def _boundary(text: Column, start: Column) -> Column:
    return (start == 0) | F.substring(text, start, F.lit(1)).rlike(f"^{SEPARATOR_CLASS}$")


def contiguous_name(token: str, turn: int) -> Column:
    """Equality, prefix or substring of the folded name."""
    f = Fields
    start = F.instr(f.folded_name, token) - 1
    size = F.length(f.folded_name)
    n = F.lit(len(token))
    inside = 7700 + F.when(_boundary(f.folded_name, start), 650).otherwise(0) - F.least(start * 12, F.lit(900))
    return (
        F.when(f.folded_name == token, match("exact", F.lit(10_000), "name", _quoted(NAME_REASON["exact"], token), span("name", f.name, F.lit(0), size), turn))
        .when(f.folded_name.startswith(token), match("prefix", 9200 - F.least(size, F.lit(300)), "name", _quoted(NAME_REASON["prefix"], token), span("name", f.name, F.lit(0), n), turn))
        .when(f.folded_name.contains(token), match("substring", inside, "name", _quoted(NAME_REASON["substring"], token), span("name", f.name, start, n), turn))
    )


def _near_match(found: Column, kind: str, field: str, reason: Column, delta: int, turn: int) -> Column:
    spans = F.transform(F.arrays_zip(found["at"].alias("at"), found["n"].alias("n")), lambda x: F.struct(F.lit(field).alias("field"), x["at"].alias("location"), x["n"].alias("length"), found["style"].alias("style")))
    return F.when(found["score"].isNotNull(), match(kind, found["score"] + delta, field, reason, spans, turn))


def may_be_near(text: Column, token: str) -> Column:
    """True wherever a near match is possible: the letters in order, or a component within twice the edits."""
    in_order = text.rlike("(?s)" + ".*".join(glob.escape(c) for c in token))
    if len(token) < 3:
        return in_order
    if len(token) == 3:
        return in_order | F.exists(F.split(text, SEPARATOR_CLASS), lambda c: F.length(c) >= 2)
    limit = 1 if len(token) <= 5 else 2
    return in_order | F.exists(F.split(text, SEPARATOR_CLASS), lambda c: F.levenshtein(c, F.lit(token), 2 * limit) >= 0)


def _contained(text: Column, token: str, base: int) -> tuple[Column, Column]:
    """Start and score of the first place of a token."""
    start = F.instr(text, token) - 1
    return start, base + F.when(_boundary(text, start), 500).otherwise(0) - F.least(start * 10, F.lit(900))


def exact_name(token: str, turn: int) -> Column:
    text = Fields.folded_name
    start, score = _contained(text, token, 5200)
    choose = lambda *v: F.when(text == token, v[0]).when(text.startswith(token), v[1]).otherwise(v[2])
    kinds = ("exact", "prefix", "substring")
    reason = choose(*(f'{NAME_REASON[k]} "{token}"' for k in kinds))
    return F.when(text.contains(token), match(choose(*(RANK[k] for k in kinds)), score, "name", reason, span("name", Fields.name, start, F.lit(len(token))), turn))


def exact_path(token: str, base: int, turn: int) -> Column:
    text = Fields.folded_directory()
    start, score = _contained(text, token, base)
    rank = F.when(text == token, RANK["exact"]).when(text.startswith(token), RANK["prefix"]).otherwise(RANK["substring"])
    return F.when(text.contains(token), match(rank, score, "path", _quoted("Path matched", token), span("path", Fields.directory, start, F.lit(len(token))), turn))


def near_alias(token: str, path: bool) -> str:
    return f"_near_{'path' if path else 'name'}_{token.encode().hex()}"


def near_columns(q: Query) -> dict[str, Column]:
    """The Arrow calls of a query, each once: near matches of names, and of paths for short tokens.

    Only rows that hold the token nowhere in one piece, and pass the superset test, carry a value into them.
    """
    out = {}
    for t in (t for terms in (*q.positive, *q.negative) for t in terms):
        if t.field not in ("any", "name", "path") or t.mode != "fuzzy" or "/" in t.token or "\\" in t.token:
            continue
        sides = [(False, Fields.name, Fields.folded_name)] if t.field != "path" else []
        if t.field != "name" and len(t.token) <= 3:
            sides.append((True, Fields.directory, Fields.folded_directory()))
        for path, source, text in sides:
            open_ = ~text.contains(t.token) & may_be_near(text, t.token)
            out[near_alias(t.token, path)] = _near_udf(t.token, path)(F.when(open_, source), F.when(open_, text))
    return out


def fuzzy_path(token: str, delta: int, turn: int, near: bool = True) -> Column:
    """A token in the directory, weak whatever it is; short tokens also nearly in one of its components."""
    text = Fields.folded_directory()
    start, score = _contained(text, token, 4000)
    reason = _quoted("Path ancestor matched", token)
    plain = F.when(text.contains(token), match("weakPath", score + delta, "ancestorPath", reason, span("ancestorPath", Fields.directory, start, F.lit(len(token))), turn))
    if len(token) > 3 or not near:
        return plain
    return F.coalesce(plain, _near_match(F.col(near_alias(token, True)), "weakPath", "ancestorPath", reason, delta, turn))


def fuzzy_name(token: str, turn: int) -> Column:
    found = _near_match(F.col(near_alias(token, False)), "near", "name", _quoted(NAME_REASON["near"], token), 0, turn)
    return F.coalesce(contiguous_name(token, turn), found)


def structured(pattern: str, base: int, per: int, most: int, step: int, far: int, turn: int) -> Column | None:
    """Consecutive path segments: more of them, nearer to the root, score higher."""
    expression = glob.path_regex(pattern)
    if expression is None:
        return None
    path = F.replace(Fields.folded_path, F.lit("\\"), F.lit("/"))
    count = lambda g: F.size(F.filter(F.split(F.regexp_extract(path, expression, g), "/"), lambda x: x != ""))
    rooted = F.when(path.startswith("/"), 450).otherwise(0) if pattern.replace("\\", "/").startswith("/") else F.lit(0)
    score = base + rooted + F.least(count(2) * per, F.lit(most)) - F.least(count(1) * step, F.lit(far))
    required = [F.lit(True)] + [path.contains(s) for s in glob.segments(pattern) if not glob.is_glob(s)]  # cheap tests before the expression
    test = required[0]
    for r in required[1:]:
        test = test & r
    return F.when(test & path.rlike(expression) & (F.length(path) > 0), match("weakPath", score, "path", _quoted("Path matched", pattern), turn=turn))


def wildcard_path(pattern: str, base: int, turn: int) -> Column | None:
    if "/" in pattern or "\\" in pattern or "**" in pattern:
        return structured(pattern, base, 80, 640, 70, 700, turn)
    path = Fields.folded_path
    return F.when(path.rlike(glob.whole(pattern)), match("weakPath", base - F.least(F.length(path), F.lit(300)), "path", _quoted("Path matched wildcard", pattern), turn=turn))


def matches_glob(text: Column, pattern: str) -> Column:
    """A glob of sets only is a list of values, which the scan can use."""
    values = glob.literals(pattern)
    return text.isin(values) if values else text.rlike(glob.whole(pattern))


def wildcard_name(pattern: str, turn: int) -> Column | None:
    if "/" in pattern or "\\" in pattern:
        return None
    name = Fields.folded_name
    return F.when(matches_glob(name, pattern), match("substring", 5100 - F.least(F.length(name), F.lit(300)), "name", _quoted(NAME_REASON["substring"], pattern), turn=turn))


def extension_term(token: str, mode: str, turn: int) -> Column:
    e = Fields.extension
    full = span("fileExtension", e, F.lit(0), F.length(e))
    if mode == "wildcard":
        return F.when(matches_glob(e, token), match("substring", F.lit(4700), "fileExtension", _quoted("Extension matched wildcard", token), turn=turn))
    exact = lambda score: match("exact", F.lit(score), "fileExtension", _quoted("Extension exactly matched", token), full, turn)
    if mode == "exact":
        return F.when(e == token, exact(4900))
    begins = match("prefix", F.lit(3600), "fileExtension", _quoted("Extension starts with", token), span("fileExtension", e, F.lit(0), F.lit(len(token))), turn)
    return F.when(e == token, exact(4800)).when(e.startswith(token), begins)


#: The names of the kinds.
KINDS = {"folder": ("folder", "directory", "dir"), "file": ("file",), "app": ("app", "application", "folder", "directory", "dir")}


def kind_test(token: str) -> Column:
    """Folded to a constant or one column, whatever the query can mean."""
    fits = {k: any(v.startswith(token) for v in names) for k, names in KINDS.items()}
    d, app = Fields.is_directory, Fields.extension == "app"
    test = F.lit(False)
    if fits["file"]:
        test = test | ~d
    if fits["folder"]:
        return test | d  # an application is a folder as well
    return test | (d & app) if fits["app"] else test


def kind_term(token: str, turn: int) -> Column:
    return F.when(kind_test(token), match("metadata", F.lit(4400), "kind", _quoted("Kind matched", token), turn=turn))


def term_matches(t: Term, turn: int) -> list[Column]:
    """The ways in which a term can match, each null where it doesn't; none if it never can."""
    token = t.token
    if t.field == "ext":
        return [extension_term(token, t.mode, turn)]
    if t.field == "kind":
        return [kind_term(token, turn)]
    later = turn + 1
    if t.mode == "exact":
        found = {"any": lambda: [exact_name(token, turn), exact_path(token, 3700, later)], "name": lambda: [exact_name(token, turn)], "path": lambda: [exact_path(token, 4000, turn)]}
    elif t.mode == "wildcard":
        found = {"any": lambda: [wildcard_name(token, turn), wildcard_path(token, 3900, later)], "name": lambda: [wildcard_name(token, turn)], "path": lambda: [wildcard_path(token, 4100, turn)]}
    elif "/" in token or "\\" in token:
        segments = lambda base: [structured(token, base, 90, 720, 80, 800, turn)]
        found = {"any": lambda: segments(4100), "name": list, "path": lambda: segments(4500)}
    else:
        near = t.mode == "fuzzy"
        name = fuzzy_name if near else contiguous_name
        found = {"any": lambda: [name(token, turn), fuzzy_path(token, -400, later, near)], "name": lambda: [name(token, turn)], "path": lambda: [fuzzy_path(token, 0, turn, near)]}
    return [m for m in found[t.field]() if m is not None]


def term_possible(t: Term) -> Column:
    """A test with built-in expressions that every match of the term passes; it prunes before any Arrow call."""
    f = Fields
    token = t.token
    if t.field == "kind":
        return kind_test(token)
    if t.field == "ext":
        return matches_glob(f.extension, token) if t.mode == "wildcard" else f.extension == token if t.mode == "exact" else f.extension.startswith(token)
    if t.mode == "exact":
        in_name, in_path = f.folded_name.contains(token), f.folded_directory().contains(token)
        return {"any": in_name | in_path, "name": in_name, "path": in_path}[t.field]
    if t.mode == "wildcard" or "/" in token or "\\" in token:
        found = term_matches(t, 0)
        return any_of([m.isNotNull() for m in found]) if found else F.lit(False)
    name, path = f.folded_name.contains(token), f.folded_directory().contains(token)
    if t.mode == "literal":
        return {"any": name | path, "name": name, "path": path}[t.field]
    name = name | may_be_near(f.folded_name, token)
    if len(token) <= 3:
        path = path | may_be_near(f.folded_directory(), token)
    return {"any": name | path, "name": name, "path": path}[t.field]


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def possible(q: Query) -> Column:
    """The conjunction of what every positive clause needs."""
    out = F.lit(True)
    for terms in q.positive:
        out = out & any_of([term_possible(t) for t in terms])
    return out


def clause_columns(q: Query) -> dict[str, Column]:
    """A column for each clause: its best term, earlier ones first among equals."""
    named = [*((f"_p{i}", c) for i, c in enumerate(q.positive)), *((f"_n{i}", c) for i, c in enumerate(q.negative))]
    out = {}
    for name, terms in named:
        found = [m for k, t in enumerate(terms) for m in term_matches(t, 2 * k)]
        out[name] = best(found) if found else F.lit(None).cast(FOUND)
    return out


def clauses_hold(q: Query) -> Column:
    """All positive clauses match, no negative one does."""
    test = F.lit(True)
    for i in range(len(q.positive)):
        test = test & F.col(f"_p{i}").isNotNull()
    for i in range(len(q.negative)):
        test = test & F.col(f"_n{i}").isNull()
    return test


def top_clause(q: Query) -> Column:
    """The best of the positive clauses, the first among equals."""
    positive = [F.col(f"_p{i}") for i in range(len(q.positive))]
    ranked = [F.struct(m["rank"].alias("rank"), score_bin(m["score"]).alias("bin"), m["score"].alias("score"), F.lit(-i).alias("turn"), m["field"].alias("field"), m["reason"].alias("reason")) for i, m in enumerate(positive)]
    return best(ranked)


def combined(q: Query, top: Column) -> Column:
    """The match of the whole query, from its clauses' columns and the best of them."""
    positive = [F.col(f"_p{i}") for i in range(len(q.positive))]
    total = sum((m["score"] for m in positive[1:]), positive[0]["score"])
    total = (total - depth_penalty(Fields.path) - F.when(Fields.hidden, 35).otherwise(0)).cast("int")
    reason = top["reason"] if len(positive) == 1 else F.lit("Matched all query terms")
    name = F.lit(None).cast("string")
    for k, rank in RANK.items():
        name = F.when(top["rank"] == rank, k).otherwise(name)
    spans = F.flatten(F.array(*[m["spans"] for m in positive]))
    return F.struct(top["rank"].alias("rank"), score_bin(total).alias("bin"), total.alias("score"), name.alias("class"), top["field"].alias("field"), reason.alias("reason"), spans.alias("spans")).cast(MATCH)
