import random

import pytest
from matcher import explain

from trovana.functions.fuzzy import boundary, osa
from trovana.operators import catalog
from trovana.operators.search import Catalog, SearchRequest, candidates, preview_skip_reason, retry_stale, search, total
from trovana.plans import glob
from trovana.plans.query import apps_query, highlight, parse

NAMES = [
    "FuzzyMatcher.swift", "fuzzy_matcher_tests.py", "log.txt", "catalog.json", "lgo.md", "Logger.cpp", "my-log-file", "README", "Makefile", "app.log", "x.hpp", "x.ipp", "xy.cpp", "Foo Bar.app", "HTMLParser.java",
    "data2023Report.csv", "a.b.c.tar.gz", ".hidden", "Äpfel.txt", "ＦＵＬＬ.txt", "naïve café.md", "L", "lo", "lOg", "blog", "dialog.ui", "mylogs.zip", "a[b].txt", "emoji😀log.txt",
]
DIRECTORIES = ["/", "/src", "/src/main/java", "/Users/ann/Library/Logs", "/data/log-2023/raw", "/a/b/c/d/e/f", "/.git/hooks", "/Über/straße", "/src/test", "/opt/my app/bin", "/x_y/fuzzy.match"]
QUERIES = [
    "log", "fm", "ftm", "swift", "ext:swift,txt", "*.cpp", ".hpp", "!log txt", "log|cat", "kind:folder", "kind:fi", "kind:app", "type:application", '"log"', 'name:"lo', "path:src", "folder:src log", "src/", "/src/ma", "src/**/j*", "/**/raw/*", "*.[hi]pp", "[!f]*.txt",
    "l?g*", "name:l*", "path:*main*", "fuzymatcher", "matchre", "lgo", "rpo", "dtr", "hp", "cafe", "full", "ext:t*", "ext:ta", "log !ext:txt !path:data", "nosuchthing", "a|b|c", "*", "**", "**/log*", "a[b]", "[", "foo:bar", "readme make", "log log", "2023", "lo", "x",
]


@pytest.fixture(scope="module")
def files(spark):
    rows = []
    for i, d in enumerate(DIRECTORIES):
        for j, n in enumerate(NAMES):
            rows.append((f"{d.rstrip('/')}/{n}", n.endswith(".app") or (i + j) % 11 == 0))
    df = catalog.derive(spark.createDataFrame(rows, "path string, is_directory boolean")).cache()
    return df, [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("text", QUERIES)
def test_columns_equal_the_matcher(files, text):
    df, rows = files
    want = {r["path"]: m for r in rows if (m := explain(r, text))}
    got = {r["path"]: (r["match"]["class"], r["match"]["bin"], r["match"]["score"], r["match"]["field"]) for r in candidates(df, SearchRequest(text)).collect()}
    assert got == want


def test_order_and_limits(files):
    df, rows = files
    found = search(df, SearchRequest("log", "name", limit=50)).collect()
    keys = [(-r["match"]["rank"], -r["match"]["bin"], r["normalized_name"], r["path"]) for r in found]
    assert keys == sorted(keys) and len(found) == 50
    assert total(df, SearchRequest("log")) > 50 and search(df, SearchRequest("log", limit=0)).count() == 0
    assert search(df, SearchRequest("", limit=5)).count() == 5
    c = Catalog(df)
    assert c.total("!log") == 0
    for text in ("log", 'log path:"a"', "path:src log", "!cat log|app", "lo", "src/ma"):
        seen, every = ({r["path"] for r in x.collect()} for x in (c.preview(text, "name"), c.search(text, limit=10**6)))
        parts = [r for r in rows if r["path"] in every]
        assert seen <= every and (text != 'log path:"a"' or seen == {r["path"] for r in parts if "log" in r["normalized_name"] or "log" in r["normalized_path"].rsplit("/", 1)[0]})
    assert c.preview("").count() == len(rows)


def test_preview_rules():
    assert [preview_skip_reason(*a) for a in (("app:x", "name"), (" ", "name"), ("x", "size"), ("x", "name", True), ("x", "modified"))] == ["applicationSearch", "emptyQuery", "unsupportedSort", "alreadyDisplayed", None]
    assert retry_stale(True, 1, 2, True, 0, 0, True) and not retry_stale(True, 1, 2, True, 3, 9, True) and retry_stale(True, 1, 2, True, 3, 9, False)
    assert not retry_stale(True, 2, 2, True, 0, 0, False) and not retry_stale(False, 1, 2, True, 0, 0, False) and not retry_stale(True, None, 2, True, 0, 0, False) and not retry_stale(True, 1, 2, False, 0, 0, False)


def test_hidden_ancestors(files, spark):
    df, rows = files
    rows = [("/a/.h", True), ("/a/.h/b", False), ("/a/c", False), ("/a/.h/d/e", False)]
    df = catalog.derive(spark.createDataFrame(rows, "path string, is_directory boolean"))
    seen = [r["path"] for r in search(df, SearchRequest("", include_hidden=False)).collect()]
    assert seen == ["/a/c"]
    os_hidden = catalog.derive(spark.createDataFrame([("/p", True, True), ("/p/q", False, False)], "path string, is_directory boolean, os_hidden boolean"))
    assert search(os_hidden, SearchRequest("", include_hidden=False)).count() == 0


def test_spans(spark):
    df = catalog.derive(spark.createDataFrame([("/é😀/x😀Logé.txt", False)], "path string, is_directory boolean"))
    m = search(df, SearchRequest("log")).first()["match"]
    assert [tuple(s) for s in m["spans"]] == [("name", 3, 3, "contiguous")]


def test_parser():
    q = parse('a "b c" !d|e ext:x,y;z name:"q" -f - ! "" kind:')
    assert [len(c) for c in q.positive] == [1, 1, 3, 1, 1, 1] and [len(c) for c in q.negative] == [2, 1]
    assert apps_query("apps: foo") == "foo" and apps_query("log") is None
    assert highlight("kind:x a*b") == "ab"
    assert glob.literals("[ab][cd]x") == ["acx", "adx", "bcx", "bdx"] and glob.literals("a*") is None


def test_distances():
    assert osa("ca", "abc", 3) == 3 and osa("log", "lgo", 1) == 1 and osa("abcd", "xyzw", 2) is None
    assert boundary("fuzzymatcher", "FuzzyMatcher", 5) and not boundary("fuzzymatcher", "FuzzyMatcher", 6)
    rnd = random.Random(1)

    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(2))
        want = slow(a, b)
        assert osa(a, b, 2) == (want if want <= 2 else None)
