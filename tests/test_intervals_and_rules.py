"""Subtrees by row intervals, and rules by a dictionary, against plain computations."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trovana.operators import catalog, compiled_rules, exclusion, intervals
from trovana.sources.crawl import Walker

# --- intervals


def merged(pairs):
    out = []
    for a, b in sorted(p for p in pairs if p[0] is not None and p[1] is not None and p[0] < p[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("lot", [1, 7, 65_536])
def test_intervals_merge_over_lots(spark, monkeypatch, lot):
    monkeypatch.setattr(intervals, "LOT", lot)
    rnd = random.Random(lot)
    pairs = [(a := rnd.randint(-50, 900), a + rnd.choice([0, 1, 1, 2, 5, 40])) for _ in range(150)] + [(3, None), (None, 4), (10, 5), (100, 260)]
    df = spark.createDataFrame(pairs, "start long, stop long")
    assert sorted(tuple(r) for r in intervals.merge_intervals(df).collect()) == merged(pairs)
    assert sorted((r["start"], r["stop"]) for r in intervals.merge_intervals(intervals.pieces(intervals.merge_intervals(df))).collect()) == merged(pairs)
    rows = spark.range(-60, 960).select(F.col("id").alias("row_id"), F.lit("x").alias("stop"), F.lit(1).alias("start"))
    got = {r["row_id"]: r["covered"] for r in intervals.with_covered(rows, df).collect()}
    assert got == {i: any(a <= i < b for a, b in merged(pairs)) for i in range(-60, 960)}
    only = intervals.with_covered(rows, df, only=True)
    assert only.columns == rows.columns and {r["row_id"] for r in only.collect()} == {i for i, x in got.items() if x}
    assert intervals.merge_intervals(df.limit(0)).count() == 0 and intervals.with_covered(rows, df.limit(0), only=True).count() == 0


@pytest.fixture(scope="module")
def forest(spark, tmp_path_factory):
    rnd = random.Random(5)
    paths = {"/" + "/".join(rnd.choice("abc") + rnd.choice("12") for _ in range(rnd.randint(1, 6))) for _ in range(160)}
    paths |= {"/a1-x/y", "/a1.z/y", "/a1/.h/z", "/big"} | {f"/big/f{i}" for i in range(300)}
    every = sorted({p.rsplit("/", n)[0] for p in paths for n in range(p.count("/"))} | paths)
    has = {p.rsplit("/", 1)[0] for p in every}
    df = catalog.derive(spark.createDataFrame([(p, p in has, 10, "/." in p or p.endswith("b2")) for p in every], "path string, is_directory boolean, size_bytes long, os_hidden boolean"))
    place = str(tmp_path_factory.mktemp("forest") / "tree")
    catalog.with_order(df).write.parquet(place)
    return spark.read.parquet(place), every


def test_rows_below_many_directories(spark, monkeypatch, forest):
    tree, every = forest
    monkeypatch.setattr(intervals, "LOT", 16)
    for test in ("name like 'a%'", "name = 'big' or name like '%1'", "false"):
        tops = tree.where(f"is_directory and ({test})")
        names = [r["path"] for r in tops.select("path").collect()]
        want = {p for p in every if any(p.startswith(t + "/") for t in names)}
        got = intervals.below(tree, tops)
        assert got.columns == tree.columns and {r["path"] for r in got.collect()} == want
        assert {r["path"] for r in intervals.below(tree, tops, itself=True).collect()} == want | set(names)
        assert {r["path"] for r in catalog.expand_hits(tree, tops).collect()} == want
    seen = {r["path"]: r["is_visible"] for r in intervals.with_visibility(tree).collect()}
    assert seen == {r["path"]: r["is_visible"] for r in catalog.with_visibility(tree).collect()}
    sizes = {r["path"]: r["size_bytes"] for r in tree.collect()}
    got = {r["path"]: (r["n_below"], r["size_bytes_below"]) for r in intervals.subtree_totals(tree, "size_bytes").join(tree, "row_id").collect()}
    below = {t: [p for p in every if p.startswith(t + "/")] for t in got}
    assert got == {t: (len(x), sum(sizes[p] for p in x)) for t, x in below.items()} and "/big" in got


def test_plan_of_many_directories(spark, forest):
    tree, _ = forest
    plan = intervals.below(tree, tree.where("is_directory and name like 'a%'"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # only intervals are cut into pieces, rows aren't multiplied
    assert all("sequence" in line for line in plan.splitlines() if "Generate explode" in line)


def test_a_directory_with_most_rows_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "LOT", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).withColumnRenamed("id", "row_id")
        top = spark.createDataFrame([(1, 19_000)], "start long, stop long")
        sizes = [r["n"] for r in intervals.with_covered(rows, top).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


# --- rules


def by_expressions(df, roots, patterns):
    """The same decisions by trying each rule's expression on each row."""
    rules = exclusion.compile_rules(patterns)
    rels = exclusion.relative_paths(F.col("path"), roots)
    return df.select("path", "is_directory", exclusion.last_rule(rules, rels, F.col("is_directory")).alias("_rule"))


WORDS = [".git", "config", "HEAD", "hooks", ".build", "debug", "Debug", "index", "store", "x.o", "a.b.pyc", ".o", "Foo.app", "Contents", "_CodeSignature", "node_modules", "Engine", "Saved", "build", "_deps", "q.tmp1", ".cache", "api", ".cmake", "src", "Library", "caches", "Caches", "É", "x y"]
OWN = [
    ["a/", "!a/b", "c", "!c/", "*.o", "!keep.o", "/top/", "x/y", "!x/y/", "x/y/z/", "!a/b/c/", "d/**/e", "!src", "b"],
    ["*", "!*/", "!src/a", "*.tar.gz", "[ab]", "\\!a", "\\#a", "./a", "a b/", "É/", "?"],
    ["a/**", "!a/x/", "!/a/b", "/a/b/c", "**/y", "y/**/z/"],
    [],
]


def test_dictionary_decides_as_expressions_do(spark):
    rnd = random.Random(9)
    roots = ["/r", "/r/src/a", "/other"]
    letters = ["a", "b", "c", "x", "y", "z", "d", "e", "top", "src", "keep.o", "q.o", "A", "B", "!a", "#a", "é", "É", "a b", "v.tar.gz"]
    for patterns, words in ((list(exclusion.DEFAULT_PATTERNS), WORDS), *((p, letters) for p in OWN)):
        rows = {(rnd.choice(["/r", "/r/src/a", "/other", "/else", ""]) + "/" + "/".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))), rnd.random() < 0.5) for _ in range(400)}
        rows |= {("/r", True), ("/r/src/a", True), ("/other", True), ("/", True)}
        df = spark.createDataFrame(sorted(rows), "path string, is_directory boolean")
        want = {(r["path"], r["is_directory"]): r["_rule"] for r in by_expressions(df, roots, patterns).collect()}
        got, rules = compiled_rules.with_last_rule(df, roots, patterns, {"_rule": F.col("is_directory")})
        got = {(r["path"], r["is_directory"]): r["_rule"] for r in got.collect()}
        different = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
        assert not different, (patterns, list(different.items())[:5])
        decided = {(r["path"], r["is_directory"]): r["decision"] for r in exclusion.with_decision(df, roots, patterns).collect()}
        walker = Walker(roots, patterns)
        assert decided == {k: walker.decision(*k) for k in decided}
        assert len(set(want.values())) > min(len(rules), 4) - 1


def test_dictionary_takes_all_plain_rules(spark):
    c = compiled_rules.compiled(exclusion.DEFAULT_PATTERNS)
    plain = [p for p in exclusion.DEFAULT_PATTERNS if "*" not in p or p.startswith("*.") and "/" not in p.rstrip("/")]
    held = {i for table in c.lookup.values() for e in table.values() for i in e.values()}
    assert {c.rules[i].raw for i in held} == set(plain) and len(c.rest) == 59 - len(plain)
    assert set(c.required) == {".git", ".build", "build", "_codesignature", "debug", "release", "index", "modulecache", "hooks", "info", "store", "_deps"} & set(c.required)
    df = spark.createDataFrame([("/r/a", False)], "path string, is_directory boolean")
    plan = exclusion.with_decision(df, ["/r"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Join" in plan  # once per directory


def test_several_kinds_at_once(spark):
    df = spark.createDataFrame([("/r/a/.git", False), ("/r/.git/config", False), ("/r/x", False)], "path string, is_directory boolean")
    got = exclusion.with_decisions(df, ["/r"], exclusion.DEFAULT_PATTERNS, {"": F.lit(False), "_2": F.lit(True)})
    assert {(r["path"], r["decision"], r["decision_2"]) for r in got.collect()} == {("/r/a/.git", "index", "index"), ("/r/.git/config", "index", "index"), ("/r/x", "index", "index")}
    one = {k: [r[0] for r in exclusion.with_decision(df.withColumn("is_directory", F.lit(k)), ["/r"]).orderBy("path").select("decision").collect()] for k in (False, True)}
    both = got.orderBy("path").select("decision", "decision_2").collect()
    assert one == {False: [r[0] for r in both], True: [r[1] for r in both]}


def test_odd_rows_keep_their_place(spark):
    df = spark.createDataFrame([(None, False), ("", True), ("/", True), ("a", False), ("/r/a/", True)], "path string, is_directory boolean")
    assert exclusion.with_decision(df, ["/r"]).count() == 5
    assert list(itertools.chain.from_iterable(exclusion.with_decision(df.limit(0), ["/r"]).collect())) == []
