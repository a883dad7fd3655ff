"""Exclusion rules: ordered, gitignore-like patterns as one column.

Each rule becomes a regular expression over the path below its root; the last rule that
fits decides. A file is indexed or pruned; an excluded directory may still have to be
entered, when a later rule takes something in it back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.plans.compiler import fenced

INDEX, DESCEND, PRUNE = "index", "skipButDescend", "prune"

#: Fewer plain rules than this are tried one by one, which costs less than joining directories.
LEAST_PLAIN = 16

#: The default patterns, in order.
DEFAULT_PATTERNS = (
    ".git/*",
    "!.git/config",
    "!.git/HEAD",
    "!.git/description",
    "!.git/hooks/**",
    "!.git/info/**",
    ".hg/store/",
    ".svn/pristine/",
    "node_modules/",
    "DerivedData/",
    ".gradle/caches/",
    ".dart_tool/",
    ".next/cache/",
    ".parcel-cache/",
    ".turbo/",
    "*.app/Contents/_CodeSignature/",
    "Xcode.app/Contents/Developer/Platforms/",
    "Xcode.app/Contents/Developer/Toolchains/",
    "Engine/Binaries/ThirdParty/DotNet/",
    "Engine/Binaries/ThirdParty/Python3/",
    "Engine/DerivedDataCache/",
    "Engine/Intermediate/",
    "Engine/Saved/",
    "CMakeFiles/",
    "Testing/Temporary/",
    ".build/**/index/store/",
    ".build/debug/",
    ".build/release/",
    ".build/*/debug/",
    ".build/*/release/",
    ".build/*/index/",
    ".build/*/ModuleCache/",
    ".build/plugins/",
    ".build/artifacts/",
    "buck-out/",
    "bazel-out/",
    ".buckd/",
    "build/.cmake/api/",
    "build/_deps/",
    "build/**/_deps/",
    "build/**/*.tmp*",
    "*.o",
    "*.pyc",
    "*.pyo",
    "*.dSYM/",
    "*.gcda",
    "*.gcno",
    "*.profraw",
    "*.profdata",
    ".venv/",
    "venv/",
    ".tox/",
    "__pycache__/",
    ".pytest_cache/",
    ".mypy_cache/",
    ".ruff_cache/",
    ".cache/",
    "Library/Caches/",
    ".Trash/",
)


def _glob(pattern: str, one_segment: bool) -> str:
    """The pattern's expression; inside a single segment even ``**`` takes no slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out += "[^/]*" if one_segment else ".*"
            i += 2
            continue
        if c == "[" and (found := re.match(r"\[([!^]?)([^/\]][^/\]]*|\][^/\]]*)\]", pattern[i:])):
            inner = found[2].replace("\\", "\\\\").replace("]", "\\]").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += f"[{'^' if found[1] else ''}{inner}]"
            i += found.end()
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.sub(r"([^0-9A-Za-z_\u0080-\U0010ffff])", r"\\\1", c)
        i += 1
    return out


@dataclass(frozen=True)
class Rule:
    """``for_file`` and ``for_directory`` are searched in the path below the root, without regard to case."""

    raw: str
    negated: bool
    for_file: str | None
    for_directory: str | None
    traversal: bool
    literal_prefix: str
    #: The pattern without its marks, and what these say.
    body: str = ""
    anchored: bool = False
    only_directories: bool = False

    def may_take_back(self, rel: Column) -> Column:
        """Could something below the directory be what this rule takes back?"""
        p = self.literal_prefix
        if not self.negated or self.traversal or not p:
            return F.lit(False)
        return (rel == p) | rel.startswith(p + "/") | F.lit(p).startswith(F.concat(rel, F.lit("/"))) | (rel == "")


def compile_rule(raw: str) -> Rule | None:
    p = raw.strip()
    if not p or p.startswith("#"):
        return None
    if p.startswith("\\#"):
        p = p[1:]
    negated = p.startswith("!")
    if p.startswith("\\!") or negated:
        p = p[1:]
    p = p.strip()
    only_directories = p.endswith("/")
    p = p.rstrip("/")
    anchored = p.startswith("/")
    p = p[1:] if anchored else p
    while p.startswith("./"):
        p = p[2:]
    if not p:
        return None
    slash = "/" in p
    body = _glob(p, one_segment=not slash)
    if not slash and not anchored:
        # any component; of a file, only those above it if the rule is for directories
        anywhere, above = f"(^|/){body}(/|$)", f"(^|/){body}/"
        file = (None if negated else above) if only_directories else anywhere
        directory = anywhere
    else:
        start = "^" if anchored else "^(.*/)?"
        at_or_below, at, below = f"{start}{body}(/.*)?$", f"{start}{body}$", f"{start}{body}/.+$"
        if only_directories:
            file, directory = (None if negated else below), at_or_below
        else:
            # what a rule excludes takes along all below it; a negation counts for itself only
            file = directory = at if negated else at_or_below
    literal = re.match(r"[^*?\[]*", p)[0].strip("/") if slash else ""
    flag = "(?is)"
    return Rule(raw, negated, file and flag + file, directory and flag + directory, negated and only_directories and p == "*", literal, p, anchored, only_directories)


def compile_rules(patterns: tuple[str, ...] | list[str] = DEFAULT_PATTERNS) -> list[Rule]:
    return [r for p in patterns if (r := compile_rule(p))]


def relative_paths(path: Column, roots: list[str]) -> Column:
    """The path below each root that holds it, longest root first; without any, the path itself."""
    parts = [F.when(path == r, F.lit("")).when(path.startswith(r.rstrip("/") + "/"), F.substring(path, len(r.rstrip("/")) + 2, 1 << 20)) for r in sorted(roots, key=len, reverse=True)]
    below = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<string>")
    return F.when(F.size(below) > 0, below).otherwise(F.array(F.trim(path, F.lit("/"))))


def met_by(rels: Column, expression: str | None) -> Column:
    return F.lit(False) if expression is None else F.exists(rels, lambda r: (r != "") & r.rlike(expression))


def last_rule(rules: list[Rule], rels: Column, is_directory: Column) -> Column:
    """The index of the last rule that fits, or -1: a reversed CASE, so the first test that holds decides."""
    out = None
    for i in reversed(range(len(rules))):
        r = rules[i]
        test = met_by(rels, r.for_file) if r.for_file == r.for_directory else F.when(is_directory, met_by(rels, r.for_directory)).otherwise(met_by(rels, r.for_file))
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(-1) if out is None else out.otherwise(-1)


def with_decision(df: DataFrame, roots: list[str], patterns: tuple[str, ...] | list[str] = DEFAULT_PATTERNS) -> DataFrame:
    """``decision`` (index, skipButDescend, prune) and ``rule`` (the deciding pattern, or null) of each row.

    Plain rules are looked up in a dictionary, once per directory (``compiled_rules``), which reads the rows' paths twice;
    where there are few of them, or in a stream, whose directories can't be gathered first, expressions are tried row by row.
    """
    return with_decisions(df, roots, patterns, {"": F.col("is_directory")})


def with_decisions(df: DataFrame, roots: list[str], patterns: tuple[str, ...] | list[str], kinds: dict[str, Column]) -> DataFrame:
    """``decision`` and ``rule`` under several names: what is decided if rows are directories as a column says, for each suffix of ``kinds``."""
    from trovana.operators.compiled_rules import compiled, with_last_rule

    kinds = {f"_rule{suffix}": is_directory for suffix, is_directory in kinds.items()}
    if df.isStreaming or compiled(patterns).n_plain < LEAST_PLAIN:
        rules = compile_rules(patterns)
        df = fenced(df, {"_rels": relative_paths(F.col("path"), roots)})
        df = fenced(df, {name: last_rule(rules, F.col("_rels"), is_directory) for name, is_directory in kinds.items()})
    else:
        df, rules = with_last_rule(df, roots, patterns, kinds)
    chosen = [i for i, r in enumerate(rules) if not r.negated]
    traversal = [i for i, r in enumerate(rules) if r.traversal]
    names = F.array(*[F.lit(r.raw) for r in rules]) if rules else F.array().cast("array<string>")
    made = {}
    for name, is_directory in kinds.items():
        last = F.col(name)
        excluded = last.isin(chosen) if chosen else F.lit(False)
        back = F.lit(False)
        for i, r in enumerate(rules):
            if r.negated and r.literal_prefix and not r.traversal:
                back = back | ((last < i) & _may(r))
        directory = F.when(last.isin(traversal), DESCEND) if traversal else F.when(F.lit(False), DESCEND)
        directory = directory.when(~excluded, INDEX).when(back, DESCEND).otherwise(PRUNE)
        suffix = name.removeprefix("_rule")
        made[f"decision{suffix}"] = F.when(is_directory, directory).otherwise(F.when(excluded, PRUNE).otherwise(INDEX))
        made[f"rule{suffix}"] = F.when(last >= 0, F.element_at(names, F.greatest(last + 1, F.lit(1)))) if rules else F.lit(None).cast("string")
    return fenced(df, made).drop("_rels", *kinds)


def _may(r: Rule) -> Column:
    return F.exists("_rels", lambda rel: r.may_take_back(rel))


def indexable(df: DataFrame, roots: list[str], patterns: tuple[str, ...] | list[str] = DEFAULT_PATTERNS) -> DataFrame:
    """Rows that the rules leave in the catalog."""
    return with_decision(df, roots, patterns).where(F.col("decision") == INDEX).drop("decision", "rule")


def event_prefilter(path: Column, patterns: tuple[str, ...] | list[str] = DEFAULT_PATTERNS) -> Column:
    """True where a configured, plain directory pattern surely excludes an event's path: cheap substring tests.

    Like the rules' own fast path it looks at single patterns only, so it ignores what later rules take back.
    """
    low = F.concat(F.lower(path), F.lit("/"))
    test = F.lit(False)
    for p in patterns:
        if not p.startswith("!") and p.endswith("/") and not re.search(r"[*?\[]", p):
            test = test | low.contains(f"/{p.strip('/').lower()}/")
        elif p.startswith("*.") and not re.search(r"[*?\[/]", p[2:]):
            test = test | F.lower(path).endswith(p[1:].lower())
    if ".git/*" in patterns:
        kept = F.lower(path).rlike(r"/\.git(/config|/head|/description|/hooks(/.*)?|/info(/.*)?)?$")
        test = test | (low.contains("/.git/") & ~kept)
    return test


def migrate_defaults(current: list[str], retired: set[str], defaults: tuple[str, ...] = DEFAULT_PATTERNS) -> list[str]:
    """A user's patterns under a new version: retired ones go, new defaults that are missing come last."""
    kept = [p for p in current if p not in retired]
    return kept + [d for d in defaults if d not in kept]


def rule_costs(df: DataFrame, roots: list[str], patterns: tuple[str, ...] | list[str] = DEFAULT_PATTERNS) -> DataFrame:
    """Decisions by kind and deciding rule, with how many rows each took."""
    return with_decision(df, roots, patterns).groupBy("decision", "rule").agg(F.count("*").alias("n_rows"))
