"""Exclusion rules compiled to a dictionary of components, decided once per directory.

Rules without wildcards, and those for an extension, become entries of a dictionary by the last components they
name: one lookup tells which of them a component meets. What lies below a directory inherits the last rule that it
or a directory above it meets; this is found once for each distinct directory and joined to its rows. A row
itself only looks up its own name, and tries the few remaining expressions if its path holds a component that one of
them requires.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.functions import text
from trovana.operators import catalog
from trovana.operators.exclusion import Rule, compile_rules, met_by, relative_paths
from trovana.plans.compiler import fenced

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a rule that meets a path counts for: the file or directory itself, files and directories below it.
SCOPES = ("own_file", "own_directory", "below_file", "below_directory")


def low(c: Column) -> Column:
    """Rules don't regard the case of these letters."""
    return F.translate(c, _UPPER, _LOWER)


def _low(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


@dataclass
class Compiled:
    """``lookup`` by the number of components (0: an extension) and key; ``rest`` needs its expressions, and one component of ``required`` each."""

    rules: list[Rule]
    lookup: dict[int, dict[str, dict[str, int]]] = field(default_factory=dict)
    rest: list[tuple[int, str | None]] = field(default_factory=list)

    @property
    def n_plain(self) -> int:
        return len(self.rules) - len(self.rest)

    @property
    def required(self) -> list[str] | None:
        """None if some rule can be met anywhere."""
        found = [r for _, r in self.rest]
        return None if None in found else sorted(set(found))


def scopes(rule: Rule, slash: bool) -> tuple[str, ...]:
    """What a rule counts for once a path's last components are those it names."""
    if rule.only_directories:
        return ("own_directory", "below_directory") if rule.negated else ("own_directory", "below_file", "below_directory")
    return ("own_file", "own_directory") if rule.negated and slash else SCOPES


def compiled(patterns) -> Compiled:
    rules = compile_rules(patterns)
    out = Compiled(rules)
    for i, rule in enumerate(rules):
        body, parts = rule.body, rule.body.split("/")
        plain = not re.search(r"[*?\[\\]", body) and not rule.anchored and "" not in parts
        extension = len(parts) == 1 and not rule.anchored and re.fullmatch(r"\*\.([^*?\[\\.]+)", body)
        if plain or extension:
            key = _low(extension[1] if extension else body)
            entry = out.lookup.setdefault(0 if extension else len(parts), {}).setdefault(key, {})
            entry.update(dict.fromkeys(scopes(rule, len(parts) > 1), i))  # the last one counts
        else:
            fixed = [s for s in parts if s and not re.search(r"[*?\[\\]", s)]
            out.rest.append((i, _low(max(fixed, key=len)) if fixed else None))
    return out


def _entries(table: dict[str, dict[str, int]]) -> Column:
    """The dictionary as a map of constants, said at once: it has as many entries as there are rules."""
    quoted = lambda k: "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
    each = (f"{quoted(key)}, named_struct({', '.join(f'{scope!r}, {e.get(scope, -1)}' for scope in SCOPES)})" for key, e in table.items())
    return F.expr(f"map({', '.join(each)})")


def _met(c: Compiled, parts: Column, at: Column) -> Column:
    """Entries that the component at a place (from 1), with those before it, meets; nulls among them."""
    out = []
    last = F.element_at(parts, at)
    for n, table in sorted(c.lookup.items()):
        if n == 0:
            key = F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1))
        else:
            key = last if n == 1 else F.when(at >= n, F.array_join(F.slice(parts, at - (n - 1), n), "/"))
        out.append(F.try_element_at(_entries(table), F.coalesce(key, F.lit("/"))))
    return F.array(*out) if out else F.array().cast(f"array<struct<{', '.join(f'{x}:int' for x in SCOPES)}>>")


def _most(met: str, scope: str) -> Column:
    return F.coalesce(F.array_max(F.transform(met, lambda x: x[scope])), F.lit(-1))


def _under_root(path: Column, tops: list[str]) -> Column:
    """The path below the root that holds it (of roots that lie in one another the highest); without any, the path itself."""
    out = None
    for r in tops:
        r = r.rstrip("/")
        inside = F.substring(path, len(r) + 2, 1 << 20)
        test = (path == (r or "/")) | path.startswith(r + "/")
        out = F.when(test, inside) if out is None else out.when(test, inside)
    bare = F.trim(path, F.lit("/"))
    return bare if out is None else out.otherwise(bare)


def inherited(directories: DataFrame, roots: list[str], c: Compiled) -> DataFrame:
    """For each distinct ``directory_path``: its lower-case components below the root, the last rule that files and
    directories below it inherit, and whether it holds a component that one of the remaining rules requires."""
    tops = [r for r in roots if not any(r != o and (r.rstrip("/") + "/").startswith(o.rstrip("/") + "/") for o in roots)]
    each = directories.select("directory_path").distinct().withColumn("_parts", F.filter(F.split(low(_under_root(F.col("directory_path"), tops)), "/"), lambda x: x != ""))
    size = F.size("_parts")
    along = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: _met(c, F.col("_parts"), i)))
    each = fenced(each, {"_met": F.when(size > 0, along).otherwise(_met(c, F.array(F.lit("/")), F.lit(1))), "_rels": relative_paths(F.col("directory_path"), roots)})
    required = c.required
    need = F.lit(required is None) if not required else F.arrays_overlap("_parts", F.array(*map(F.lit, required)))
    each = each.withColumn("_need", need)
    rels = F.col("_rels")
    file, directory = [_most("_met", "below_file")], [_most("_met", "below_directory")]
    for i, _ in c.rest:
        r = c.rules[i]
        if r.negated and not r.only_directories and (r.anchored or "/" in r.body):  # counts for itself only
            continue
        hit = F.when(F.col("_need") & met_by(rels, r.for_directory), i).otherwise(-1)
        directory.append(hit)
        if not (r.negated and r.only_directories):
            file.append(hit)
    top = lambda xs: xs[0] if len(xs) == 1 else F.greatest(*xs)
    return each.select("directory_path", "_parts", "_need", top(file).alias("_below_file"), top(directory).alias("_below_directory"))


def with_last_rule(df: DataFrame, roots: list[str], patterns, kinds: dict[str, Column]) -> tuple[DataFrame, list[Rule]]:
    """For each of ``kinds``, a name and whether rows are directories: the index of the last rule that a row meets, or -1.

    ``_rels`` comes along: the path below each root that holds it. The rows' directories are joined by their path, once for all kinds.
    """
    c = compiled(patterns)
    roots = [r if r == "/" else r.rstrip("/") for r in roots]
    rows = df.withColumn("_up", text.parent_path(F.col("path")))
    found = inherited(rows.select(F.col("_up").alias("directory_path")), roots, c).withColumnRenamed("directory_path", "_up")
    # rows of one large directory, or of a file that one task reads, don't stay together for the dear part
    rows = catalog.spread(rows.join(found, "_up", "left"))
    name = low(text.last_component(F.col("path")))
    parts = F.concat(F.coalesce("_parts", F.array().cast("array<string>")), F.array(name))
    rows = fenced(rows, {"_met": _met(c, parts, F.size(parts)), "_rels": relative_paths(F.col("path"), roots)})
    rels = F.col("_rels")
    required = c.required
    need = F.coalesce("_need", F.lit(required is None)) | (name.isin(required) if required else F.lit(False))
    # a root itself is judged by the roots above it, if any; rules don't apply to it otherwise
    outermost = [r for r in roots if not any(r != o and (r + "/").startswith(o.rstrip("/") + "/") for o in roots)]

    def tried(which: str) -> Column:
        out = None
        for i, _ in reversed(c.rest):
            e = getattr(c.rules[i], which)
            if e:
                test = met_by(rels, e)
                out = F.when(test, i) if out is None else out.when(test, i)
        return F.lit(-1) if out is None else F.when(need, out.otherwise(-1)).otherwise(-1)

    def last(is_directory: Column) -> Column:
        below = F.coalesce(F.when(is_directory, F.col("_below_directory")).otherwise(F.col("_below_file")), F.lit(-1))
        own = F.when(is_directory, _most("_met", "own_directory")).otherwise(_most("_met", "own_file"))
        rest = F.when(is_directory, tried("for_directory")).otherwise(tried("for_file"))
        rule = F.greatest(below, own, rest)
        return F.when(F.col("path").isin(outermost), -1).otherwise(rule) if outermost else rule

    out = fenced(rows, {name: last(is_directory) for name, is_directory in kinds.items()})
    return out.select(*[F.col(f"`{x}`") for x in df.columns], "_rels", *kinds), c.rules
