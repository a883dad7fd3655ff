import json
import plistlib

import pytest
from pyspark.sql import functions as F

from trovana.operators import apps, catalog, changes, diagnostics
from trovana.operators.search import Catalog, SearchRequest, prefix_range, search
from trovana.sources import logs
from trovana.sources.snapshot import PublishRule, Store, checkpoint_rule
from trovana.streaming.upkeep import ScopeQueue, Upkeep, cursors, read_changes


def rows(spark, items):
    return catalog.derive(spark.createDataFrame([(p, d, s) for p, d, s in items], "path string, is_directory boolean, size_bytes long"))


def state(df):
    return sorted((r["path"], r["size_bytes"]) for r in df.select("path", "size_bytes").collect())


BASE = [("/r", True, 0), ("/r/a", True, 0), ("/r/a/x.txt", False, 1), ("/r/a/y.txt", False, 2), ("/r/b", True, 0), ("/r/b/z", False, 3)]


def events(spark, items):
    return spark.createDataFrame(items, logs.EVENTS_SCHEMA)


def test_flags_and_scopes(spark):
    roots = catalog.roots_table(spark, ["/r"])
    e = events(spark, [("/r/a/x.txt", changes.REMOVED, 1), ("/r/a", changes.IS_DIR, 2), ("/r/n.o", 4096, 3), ("/r/b/z", 4096, 4), ("/r/a/x.txt", 4096, 5), ("/elsewhere", 4096, 6)])
    kept = changes.with_event_root(changes.indexable(e, ["/r"]), roots)
    got = {r["path"]: r["scope"] for r in changes.scopes(kept).collect()}
    assert got == {"/r/a/x.txt": "/r/a", "/r/a": "/r/a", "/r/b/z": "/r/b/z"}
    done = events(spark, [("/", changes.HISTORY_DONE, 9)])
    action, found = changes.catch_up(e.unionByName(done), roots, ["/r"])
    assert action == "scoped" and sorted(r["path"] for r in found.collect()) == ["/r/a", "/r/b/z"]
    assert changes.catch_up(e, roots, ["/r"])[0] == "full"
    assert changes.catch_up(done, roots, ["/r"])[0] == "upToDate"
    unsafe = events(spark, [("/r/a", changes.KERNEL_DROPPED, 7)])
    action, found = changes.catch_up(e.unionByName(done).unionByName(unsafe), roots, ["/r"])
    assert action == "full" and [r["path"] for r in found.collect()] == ["/r"]
    assert changes.catch_up(e.unionByName(done), roots, ["/r"], most=1)[0] == "full"
    assert {r["root"]: r["event_id"] for r in cursors(e, roots, events(spark, [("x", 0, 99)]).select(F.lit("/r").alias("root"), "event_id")).collect()} == {"/r": 99}


def test_merges(spark):
    df = rows(spark, BASE)
    new = rows(spark, [("/r/a/x.txt", False, 10), ("/r/c", False, 4)])
    assert state(changes.upsert(df, new)) == sorted([(p, s) for p, _, s in BASE if p != "/r/a/x.txt"] + [("/r/a/x.txt", 10), ("/r/c", 4)])
    same, other = changes.split_changes(df, new)
    assert state(same) == [("/r/a/x.txt", 10)] and state(other) == [("/r/c", 4)]
    assert state(changes.replace_metadata(df, same))[2] == ("/r/a/x.txt", 10)
    gone = spark.createDataFrame([("/r/a",)], "path string")
    assert state(changes.without_subtrees(df, gone)) == [("/r", 0), ("/r/b", 0), ("/r/b/z", 3)]
    assert state(changes.replace_scopes(df, rows(spark, [("/r/a", True, 0), ("/r/a/q", False, 5)]), gone)) == [("/r", 0), ("/r/a", 0), ("/r/a/q", 5), ("/r/b", 0), ("/r/b/z", 3)]
    found = spark.createDataFrame([("/r/a", True), ("/r/a/x", False), ("/r/b/z", False)], "path string, is_directory boolean")
    assert sorted(tuple(r) for r in changes.routed(found).collect()) == [("/r/a", "directory"), ("/r/b/z", "file")]
    batch = events(spark, [("/r/a", changes.REMOVED, 1), ("/r/c", 4096, 2)])
    current = rows(spark, [("/r/c", False, 4), ("/r/b/z", False, 3)])
    once = changes.apply_batch(df, batch, current, ["/r"])
    assert state(once) == [("/r", 0), ("/r/b", 0), ("/r/b/z", 3), ("/r/c", 4)] == state(changes.apply_batch(once, batch, current, ["/r"]))


def test_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.manifest() is None and store.rows() is None
    m = store.write(catalog.with_virtual(rows(spark, BASE)), ["/r"], ["*.o"])
    assert (m.version, m.n_rows) == (1, 6) and state(store.rows()) == sorted((p, s) for p, _, s in BASE)
    store.append_delta(rows(spark, [("/r/b/z", False, 30)]), 0)
    store.append_delta(rows(spark, [("/r/b/z", False, 31)]), 1)
    store.append_delta(rows(spark, [("/r/b/z", False, 31)]), 1)
    assert dict(state(store.rows()))["/r/b/z"] == 31
    assert store.compact().version == 2 and dict(state(store.rows()))["/r/b/z"] == 31
    try:
        store.write(rows(spark, BASE), [], [], expected=1)
        raise AssertionError("an outdated writer must be refused")
    except RuntimeError:
        assert store.versions() == [1, 2]
    store.write(rows(spark, BASE), [], [], expected=2)
    assert store.clean(kept=1) == [1] and store.versions() == [2, 3]
    assert [n for n, _ in store.storage()] == ["rows"]
    store.checkpoint(rows(spark, BASE[:2]), ["/r"], [], ["/r/a"])
    assert store.resumable(["/r"], [], 0) and not store.resumable(["/q"], [], 0)
    assert store.resume()[0].count() == 2
    (tmp_path / "s/manifests/000000000003.json").write_text("{broken")
    (tmp_path / "s/manifests/.000000000003.json.crc").unlink(missing_ok=True)
    assert store.manifest().version == 2


def test_two_writers_and_orders(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    tree = catalog.with_virtual(rows(spark, BASE))
    store.write(tree, ["/r"], [], orders=("normalized_name",))
    assert other._claim(2)
    with pytest.raises(RuntimeError):
        store.write(tree, [], [], expected=1)
    found = prefix_range(store.ordered("normalized_name"), "X")
    assert [r["path"] for r in found.collect()] == ["/r/a/x.txt"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(normalized_name,x)" in plan
    paths = [r["path"] for r in store.tree().select("path").collect()]
    assert paths == sorted(paths, key=lambda p: p[1:].split("/"))


def test_row_deltas(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write(catalog.with_virtual(rows(spark, BASE)), ["/r"], [])
    gone = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    store.append_rows(rows(spark, [("/r/c/n", False, 4), ("/r/a/x.txt", False, 5)]), gone("/r/b"), 0)
    store.append_delta(rows(spark, [("/r/a/x.txt", False, 6), ("/r/b/z", False, 9)]), 1)
    want = [("/r", 0), ("/r/a", 0), ("/r/a/x.txt", 6), ("/r/a/y.txt", 2), ("/r/c/n", 4)]
    assert state(store.rows()) == want and store.pending() == 5
    store.append_rows(rows(spark, [("/r/b/z", False, 1), ("/r/a/x.txt", False, 7)]), gone("/r/c"), 2)
    want = [("/r", 0), ("/r/a", 0), ("/r/a/x.txt", 7), ("/r/a/y.txt", 2), ("/r/b/z", 1)]
    assert state(store.rows()) == want
    assert sorted(r["path"] for r in store.tree().where("is_virtual").collect()) == ["/r/b"]
    assert store.compact().version == 2 and state(store.rows()) == want and store.pending() == 0


def test_scans_are_published_in_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    parts = [rows(spark, BASE[:2]), rows(spark, BASE[2:4]), rows(spark, BASE[4:])]
    found = store.publish(parts, ["/r"], [], PublishRule(4, 1000))
    assert [m.version for m in found] == [1, 2] and state(store.rows()) == sorted((p, s) for p, _, s in BASE)
    rule = checkpoint_rule(True)
    assert not rule.due(24_999) and rule.due(1) and not checkpoint_rule(False).due(99_999)


def test_stream_equals_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write(catalog.with_virtual(rows(spark, BASE)), ["/r"], [])
    after = rows(spark, [("/r", True, 0), ("/r/a", True, 0), ("/r/a/x.txt", False, 7), ("/r/b", True, 0), ("/r/b/new", False, 8)])
    feed = tmp_path / "feed"
    feed.mkdir()
    lines = [("/r/a/x.txt", 4096, 1), ("/r/a/y.txt", changes.REMOVED, 2), ("/r/b/new", 4096, 3), ("/r/b/z", changes.REMOVED, 4), ("/r/a/x.txt", 4096, 5)]
    for i, e in enumerate(lines):
        (feed / f"{i}.json").write_text(json.dumps(dict(zip(("path", "flags", "event_id"), e, strict=True))) + "\n")
    asked = []
    upkeep = Upkeep(store, ["/r"], lambda paths: asked.append(1) or after, [], large=3)
    upkeep.start(read_changes(spark, str(feed), files=2), str(tmp_path / "cp"), None).awaitTermination()
    whole = changes.apply_batch(rows(spark, BASE), events(spark, lines), after, ["/r"], [])
    assert state(store.rows()) == state(whole)
    assert upkeep.last_batch == 2 and len(asked) == 3
    upkeep(events(spark, lines), 2)
    assert state(store.rows()) == state(whole) and store.manifest().version > 1


def test_queue():
    q = ScopeQueue()
    assert [q.add("/a/b"), q.add("/a/b/c"), q.add("/d"), q.add("/d/e"), q.add("/")] == ["started", "coveredByActive", "queued", "ignored", "queued"]
    assert q.waiting == ["/"] and not q.finish(0) and q.finish(1) and q.active == ["/"]


def test_apps(spark):
    raw = [("/Applications/Visual Studio Code.app", True), ("/Applications/Xcode.app", True), ("/Applications/Xcode.app/Contents/Apps/Inner.app", True), ("/Applications/x.app", False), ("/Applications/.h.app", True)]
    df = catalog.derive(spark.createDataFrame(raw, "path string, is_directory boolean"))
    plist = plistlib.dumps({"CFBundleIdentifier": "com.acme.Vsc-Editor", "CFBundleName": "Code", "CFBundleURLTypes": [{"CFBundleURLSchemes": ["vscode"]}]})
    lists = spark.createDataFrame([("file:/Applications/Visual Studio Code.app/Contents/Info.plist", bytearray(plist))], "path string, content binary")
    found = apps.with_aliases(apps.bundles(df), lists).cache()
    assert sorted(r["name"] for r in found.collect()) == ["Visual Studio Code.app", "Xcode.app"]
    values = {a["value"]: a["source"] for r in found.where("name like 'Visual%'").collect() for a in r["aliases"]}
    assert values["vsc"] == "app name" and values["vscode"] == "app name" and values["acme"] == "bundle identifier" and values["code"] == "CFBundleName" and "com" not in values
    top = lambda q: [(r["name"], r["match"]["class"], r["score"], r["is_alias"]) for r in apps.search_apps(found, q).collect()][:1]
    assert top("xcode") == [("Xcode.app", "exact", 11800, False)] and top("xco") == [("Xcode.app", "prefix", 9700, False)]
    assert top("vsc") == [("Visual Studio Code.app", "exact", 9600, True)] and top("acm") == [("Visual Studio Code.app", "prefix", 7596, True)]
    assert apps.words("HTMLParser2Go foo_bar") == ["htmlparser2", "go", "foo", "bar"]
    assert apps.search_apps(found, "").count() == 2
    whole = Catalog(df)
    assert [r["name"] for r in whole.search(" App : xco").collect()] == ["Xcode.app"] and whole.total("apps:") == 2 and whole.total("apps:vsc") == 1
    assert "is_alias" not in whole.search("xcode app:").columns


def test_diagnostics(spark, tmp_path):
    lines = [
        {"schemaVersion": 1, "timestamp": "2024-01-01T00:00:00Z", "level": level, "category": "search", "event": "e", "fields": {"p": {"privacy": "path", "value": "/Users/Ann-1/x.TXT"}, "n": {"privacy": "public", "value": "7"}}}
        for level in ("debug", "info", "warning", "error")
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = logs.read_events(spark, str(tmp_path / "a.jsonl")).cache()
    assert logs.malformed(got).first()["n_malformed"] == 1
    good = got.where("_malformed is null").drop("_malformed")
    assert diagnostics.recorded(good, "error").count() == 2 and diagnostics.recorded(good, "info").count() == 3
    hidden = [r["fields"]["p"]["value"] for r in diagnostics.anonymise(good, "s").collect()]
    assert len(set(hidden)) == 1 and hidden[0] != "/Users/Ann-1/x.TXT" and len(hidden[0]) == 18
    assert [c for c in hidden[0] if c in "/-."] == list("//-/.") and hidden[0][11].isdigit() and hidden[0][1].isupper() and hidden[0][2].islower()
    assert {r["fields"]["n"]["value"] for r in diagnostics.anonymise(good, "s").collect()} == {"7"}
    assert diagnostics.capped(good, 3).first()["fields"]["p"]["value"] == "/Us"
    text = diagnostics.report(good, ["/secret"], "2024-01-02", 14)
    assert "/secret" not in text and "| search | error | 1 |" in text
    logs.write_events(got, str(tmp_path / "out"))
    assert logs.read_events(spark, str(tmp_path / "out")).count() == 4
    fuller = F.map_concat("fields", F.create_map(F.lit("more"), F.col("fields")["n"]))
    context = good.where("level = 'info'").withColumn("persisted", F.col("fields")).withColumn("fields", fuller)
    told = diagnostics.with_context(good, context.unionByName(context.withColumn("timestamp", F.expr("timestamp + interval 1 second"))))
    assert [(r["level"], sorted(r["context_fields"])) for r in told.collect()] == [("info", ["more", "n", "p"])]
    out = diagnostics.export(good, context, "s").collect()
    assert len(out) == 4 and [r["level"] for r in out if "more" in r["fields"]] == ["info"] and "Ann" not in str(out)
    arrays = spark.createDataFrame([(["/a/B", "xyz"] * 60,)], "values array<string>").select(F.create_map(F.lit("f"), F.struct(F.lit("pathArray").alias("privacy"), F.lit(None).cast("string").alias("value"), "values")).alias("fields"))
    field = diagnostics.anonymise(diagnostics.capped(arrays, 3, 5), "s").first()["fields"]["f"]
    assert field["truncated"] and field["totalCount"] == 120 and len(field["values"]) == 5 and [c for c in field["values"][0] if c == "/"] == ["/", "/"] and len(field["values"][0]) == 3
    (tmp_path / "m.json").write_text('{"started": 3, "routeCounts": {"fullScan": 2}}')
    m = logs.read_metrics(spark, str(tmp_path / "m.json")).first()
    assert (m["started"], m["completed"], m["version"], m["routeCounts"], m["days"]) == (3, 0, 2, {"fullScan": 2}, [])


def test_search_over_a_snapshot_pushes_filters(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write(catalog.with_virtual(rows(spark, BASE)), ["/r"], [])
    plan = search(store.rows(), SearchRequest("ext:txt"))._jdf.queryExecution().executedPlan().toString()
    assert "file_extension" in plan.split("PushedFilters: [")[1].split("]")[0] and "TakeOrderedAndProject" in plan, plan
