"""What trees cost as they grow: rows dealt out before dear work, ids without an interpreted loop, one order, ancestors by directory."""

from pyspark.sql import functions as F

from trovana import queries as base
from trovana.functions import text
from trovana.operators import catalog, exclusion


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def fnv(value):
    h = 14695981039346656037
    for b in value.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h or 1


def test_ids_are_made_in_batches(spark):
    values = ["", "/", "/a", "/ä/€/😀", "x" * 5000, "\x00", None, *[f"/p{i}/{'y' * (i % 37)}" for i in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "path string").select("path", text.stable_id(F.col("path")).alias("id"))
    assert {r["path"]: int(r["id"]) for r in df.collect()} == {v: fnv(v or "") for v in values}
    assert df.schema["id"].dataType.simpleString() == "decimal(20,0)"
    assert "aggregate(" not in _plan(df)


def test_rows_of_one_file_are_dealt_out(spark, testdata):
    for view in (base.customer_files, base.part_files):
        assert "RepartitionByExpression [path" in _plan(view(spark, f"{testdata}/sf0.001"))


def test_only_directories_meet_their_ancestors(spark):
    """600 rows in six directories: what is multiplied by ancestors is grouped before."""
    rows = [(f"/a/b{i % 3}/c{i % 2}/f{i}", False, i % 50 == 0) for i in range(600)] + [("/a/b1", True, True)]
    df = catalog.derive(spark.createDataFrame(rows, "path string, is_directory boolean, os_hidden boolean"))
    tree = catalog.with_virtual(df)
    for made in (catalog.virtual_rows(df), catalog.with_visibility(df)):
        plan = _plan(made)
        assert "Aggregate" in plan[plan.index("Generate explode") :].split("Join")[0]
    hidden = {r["path"]: r["is_visible"] for r in catalog.with_visibility(tree).collect()}
    assert hidden == {p: not h and not p.startswith("/a/b1/") for p, _, h in rows} | {p: not p.startswith("/a/b1/") for p in hidden if p not in {x[0] for x in rows}}
    o = {r["path"]: r for r in catalog.with_order(tree).collect()}
    order = sorted(o, key=lambda p: p.split("/"))
    assert [o[p]["row_id"] for p in order] == list(range(len(order)))
    for p in order:
        assert o[p]["subtree_end"] == 1 + max(o[q]["row_id"] for q in order if q == p or q.startswith(p + "/"))


def test_paths_that_stand_twice_end_together(spark):
    rows = [("/a/f", False), ("/a/f", False), ("/a/g", False), ("/a", True)]
    df = spark.createDataFrame(rows, "path string, is_directory boolean")
    got = sorted((r["row_id"], r["path"], r["subtree_end"]) for r in catalog.with_order(df).collect())
    assert got == [(0, "/a", 4), (1, "/a/f", 3), (2, "/a/f", 3), (3, "/a/g", 4)]


def test_filters_stay_behind_the_dealing(spark, testdata):
    plan = _plan(base.search_exact(spark, f"{testdata}/sf0.001"))
    assert "Python" not in plan[plan.index("RepartitionByExpression [path") :]


def test_rules_are_tried_on_rows_that_are_dealt_out(spark):
    rows = spark.range(0, 400, 1, 1).select(F.concat(F.lit("/a/node_modules/f"), "id").alias("path"), F.lit(False).alias("is_directory"))
    made = exclusion.with_decision(rows, ["/"])
    assert "RepartitionByExpression [path" in _plan(made)
    assert {r["decision"] for r in made.collect()} == {"prune"} and made.count() == 400
