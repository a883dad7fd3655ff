import pytest

from trovana.functions.text import fold_text
from trovana.operators import catalog, exclusion, insights
from trovana.sources.crawl import Walker, crawl, preflight


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def fnv(path):
    h = 14695981039346656037
    for b in path.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h or 1


def test_derived_columns(spark):
    raw = spark.createDataFrame([("/a/B.TXT", False, -5), ("/", True, 9), ("/é/.x", False, 3), ("/a/noext", False, 1), ("/a/.bashrc", False, 1), ("/a/x.", False, 1), ("/a/b/", True, 7)], "path string, is_directory boolean, size_bytes long")
    got = {r["path"]: r for r in catalog.derive(raw).collect()}
    assert {p: int(r["id"]) for p, r in got.items()} == {p: fnv(p) for p in ("/a/B.TXT", "/", "/é/.x", "/a/noext", "/a/.bashrc", "/a/x.", "/a/b")}
    assert (got["/a/B.TXT"]["file_extension"], got["/a/B.TXT"]["size_bytes"], got["/a/B.TXT"]["directory_path"]) == ("txt", 0, "/a")
    assert got["/"]["name"] == "/" and got["/é/.x"]["is_hidden"] and got["/é/.x"]["normalized_path"] == "/e/.x"
    assert [got[p]["file_extension"] for p in ("/a/noext", "/a/.bashrc", "/a/x.")] == ["", "", ""] and got["/a/b"]["size_bytes"] == 0
    assert fold_text("ＡÉ") == "ae"


def test_tree(spark):
    df = catalog.derive(spark.createDataFrame([(p, False) for p in ("/a/b/c", "/a/b.x", "/a-z", "/q/r/s/t")], "path string, is_directory boolean"))
    tree = catalog.with_virtual(df).cache()
    assert paths(catalog.virtual_rows(df)) == ["/a", "/a/b", "/q", "/q/r", "/q/r/s"]
    o = {r["path"]: r for r in catalog.with_order(tree).collect()}
    ordered = sorted(o, key=lambda p: o[p]["row_id"])
    assert ordered == sorted(o, key=lambda p: p[1:].split("/"))
    for p in o:
        inside = [q for q in o if q == p or q.startswith(p + "/")]
        assert o[p]["subtree_end"] - o[p]["row_id"] == len(inside)
    assert paths(catalog.subtree(catalog.with_order(tree), "/a")) == ["/a", "/a/b", "/a/b.x", "/a/b/c"]
    assert paths(catalog.results_only(tree)) == paths(df)
    v = catalog.visible_before(catalog.with_visibility(catalog.with_order(tree))).orderBy("row_id").collect()
    assert [r["visible_through"] for r in v] == list(range(1, len(v) + 1))


def test_roots_deepest_wins(spark):
    df = catalog.derive(spark.createDataFrame([(p, False) for p in ("/r/a", "/r/s/b", "/rs/c", "/x", "/r/s")], "path string, is_directory boolean"))
    roots = catalog.roots_table(spark, ["/r/", "/r/s", "/r", "", "."])
    got = {r["path"]: r["root"] for r in catalog.with_root(df, roots).collect()}
    assert got == {"/r/a": "/r", "/r/s/b": "/r/s", "/rs/c": None, "/x": None, "/r/s": "/r/s"}
    everything = catalog.with_root(df, catalog.roots_table(spark, ["/", "/r"]))
    assert {r["path"]: r["root"] for r in everything.collect()}["/x"] == "/"


CASES = [
    (["node_modules/"], "node_modules", True, "prune"),
    (["node_modules/"], "a/node_modules/b/c.js", False, "prune"),
    (["node_modules/"], "a/node_modules", False, "index"),
    (["*.o"], "x/y.O", False, "prune"),
    (["*.o"], "x.o/y", False, "prune"),
    (["/build"], "build/x", False, "prune"),
    (["/build"], "a/build", True, "index"),
    (["a/b/"], "x/a/b/c", False, "prune"),
    (["a/**/z"], "a/b/c/z", False, "prune"),
    (["a/**/z"], "a/z", False, "index"),
    (["*.log", "!keep.log"], "d/keep.log", False, "index"),
    (["out/", "!out/keep/**"], "out", True, "skipButDescend"),
    (["out/", "!out/keep/**"], "out/keep/x", False, "index"),
    (["out/", "!out/keep/**"], "out/other/x", False, "prune"),
    (["out/", "!out/keep/**"], "out/other", True, "prune"),
    (["*", "!*/"], "any", True, "skipButDescend"),
    (["*", "!*/"], "any", False, "prune"),
    (["[ab].txt"], "b.txt", False, "prune"),
    (["[!ab].txt"], "b.txt", False, "index"),
    (["\\#x"], "#x", False, "prune"),
    (["\\!x"], "!x", False, "prune"),
    (["# c", " ", "./q"], "q", False, "prune"),
    (list(exclusion.DEFAULT_PATTERNS), ".git", True, "index"),
    (list(exclusion.DEFAULT_PATTERNS), "p/.git/config", False, "index"),
    (list(exclusion.DEFAULT_PATTERNS), "p/.git/objects/aa", False, "prune"),
    (list(exclusion.DEFAULT_PATTERNS), "p/build/x/y.tmp1", False, "prune"),
    (list(exclusion.DEFAULT_PATTERNS), "src/main.swift", False, "index"),
    (list(exclusion.DEFAULT_PATTERNS), "Library/Caches/x/y", False, "prune"),
    (list(exclusion.DEFAULT_PATTERNS), ".Trash/old", False, "prune"),
    (list(exclusion.DEFAULT_PATTERNS), "me/.cache", True, "prune"),
]


@pytest.mark.parametrize("patterns,rel,is_directory,want", CASES)
def test_rules(spark, patterns, rel, is_directory, want):
    df = spark.createDataFrame([(f"/root/{rel}", is_directory)], "path string, is_directory boolean")
    assert exclusion.with_decision(df, ["/root"], patterns).first()["decision"] == want
    assert Walker(["/root"], patterns).decision(f"/root/{rel}", is_directory) == want


def test_fifty_nine_defaults_and_migration():
    assert len(exclusion.compile_rules()) == len(exclusion.DEFAULT_PATTERNS) == 59
    assert exclusion.migrate_defaults(["x", "old/"], {"old/"}, ("x", "new/")) == ["x", "new/"]


def test_crawl(spark, tmp_path):
    for p in ("a/b/c.txt", "a/node_modules/x.js", ".git/config", ".git/objects/1", "d/e/f/g.o", "d/e/h"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("12345")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    root = str(tmp_path)
    got = {r["path"][len(root) :]: r for r in crawl(spark, [root, root + "/a"], partitions=3).collect()}
    assert set(got) == {"", "/a", "/a/b", "/a/b/c.txt", "/.git", "/.git/config", "/d", "/d/e", "/d/e/f", "/d/e/h", "/link"}
    assert got["/a/b/c.txt"]["size_bytes"] == 5 and not got["/link"]["is_directory"]
    assert preflight([root, root + "/none", root + "/d/e/h"]) == {root: "readable", root + "/none": "missing", root + "/d/e/h": "notDirectory"}
    assert {r["path"][len(root) :] for r in crawl(spark, [root], shallow=True).collect()} == {"", "/a", "/.git", "/d", "/link"}


def test_presentation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 10), (1, 1000), (5, 100), (1, 3), (1, 20000), (5, 0)], "a long, b long")
    got = df.select(insights.percent_text(F.col("a"), F.col("b")), insights.share_text(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("0%", "0.0%"), ("<1%", "0.1%"), ("5%", "5.0%"), ("33%", "33%"), ("<1%", "<0.1%"), ("0%", "0%")]
    roots = spark.createDataFrame([("/a/x/src",), ("/b/x/src",), ("/c/doc",)], "root string")
    assert {r["root"]: r["label"] for r in insights.suffix_labels(roots).collect()} == {"/a/x/src": "a/x/src", "/b/x/src": "b/x/src", "/c/doc": "c/doc"}
    assert insights.treemap([3, 0, 1], 0, 0, 8, 4) == [(0, 0, 0, 6, 4), (2, 6, 0, 2, 4)]
    areas = [w * h for _, _, _, w, h in insights.treemap([60, 20, 20], 0, 0, 100, 50)]
    assert areas == [3000, 1000, 1000]
    thirds = insights.treemap([1, 1, 1], 0, 0, 300, 100)
    assert [c[3] for c in thirds] == [100, 100, 100] and thirds[-1][1] == 200
    tiny = insights.treemap([9017, 959, 22, 2], 0, 0, 100, 50)
    assert len(tiny) == 4 and min(c[3] for c in tiny) >= 1 and tiny[-1][1] + tiny[-1][3] == 100
    assert insights.treemap([1], 0, 0, 0, 5) == []
    merged = insights.interval_union(spark.createDataFrame([(1, 3), (3, 5), (7, 7), (6, 8), (2, 4)], "start long, end long"))
    assert sorted(tuple(r) for r in merged.collect()) == [(1, 5), (6, 8)]
