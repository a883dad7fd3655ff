"""Kept aggregates: a stream of batches equals the roll-up from scratch, whatever is repeated or compacted."""

import json
import random

from pyspark.sql import functions as F

from trovana.operators import catalog, insights
from trovana.operators.kept import action_part, kept_actions, kept_rollup, kept_searches, search_part
from trovana.sources.snapshot import Store
from trovana.streaming.upkeep import Upkeep, read_changes


def test_batches_equal_one_pass(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"2024-03-{rnd.randint(1, 9):02d} {rnd.randint(0, 23):02d}:00:00", rnd.choice(["open", "open", "copy", None])) for _ in range(300)] + [(None, "open")]
    events = spark.createDataFrame(rows, "ts string, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [events.where(F.pmod(F.xxhash64("ts", "action"), F.lit(4)) == i) for i in range(4)]
    kept = kept_actions(spark, f"file://{tmp_path}/actions")
    assert kept.read() is None and kept.compact() == 0
    want = sorted(map(tuple, action_part(events).collect()))
    for n, b in enumerate(batches):
        assert kept.add(action_part(b), n)
        assert not kept.add(action_part(events), n)  # run again, even with other rows
        if n == 1:
            assert kept.compact() == 2 and kept.upto == 1
            assert not kept.add(action_part(b), 0) and not kept.add(action_part(b), 1)
    assert sorted(map(tuple, kept.read().collect())) == want
    assert kept.compact() == 2 and sorted(map(tuple, kept_actions(spark, f"file://{tmp_path}/actions").read().collect())) == want
    assert kept.add(action_part(events.limit(0)), 4) and kept.compact("day >= '2024-03-05'") == 1
    assert sorted(map(tuple, kept.read().collect())) == [r for r in want if r[0] >= "2024-03-05"]
    # one base is left of all that was written
    assert len([p for p in (tmp_path / "actions").iterdir() if p.name.startswith(("base-", "part-"))]) == 1


def test_searches(spark, tmp_path):
    p = spark.createDataFrame([("full", True, 1.0), ("full", False, 9.0), ("grams", False, 2.0)], "execution_path string, completed boolean, elapsed double")
    kept = kept_searches(spark, f"file://{tmp_path}/s")
    kept.add(search_part(p), 0)
    kept.add(search_part(p), 1)
    assert {tuple(r) for r in kept.read().collect()} == {("full", 4, 2, 2.0, 9.0), ("grams", 2, 0, 0.0, 2.0)}


def test_upkeep_keeps_a_rollup(spark, tmp_path):
    make = lambda rows: catalog.derive(spark.createDataFrame(rows, "path string, is_directory boolean, size_bytes long"))
    base = [("/r", True, 0), ("/r/a", True, 0), ("/r/a/x", False, 5), ("/r/a/y", False, 6), ("/r/b", True, 0), ("/r/b/.z", False, 7)]
    after = [("/r", True, 0), ("/r/a", True, 0), ("/r/a/x", False, 50), ("/r/b", True, 0), ("/r/b/.z", False, 7), ("/r/b/new", False, 8)]
    store, rollup = Store(spark, f"file://{tmp_path}/s"), kept_rollup(spark, f"file://{tmp_path}/k")
    upkeep = Upkeep(store, ["/r"], lambda paths: catalog.under(make(base if not store.manifest() else after), paths), [], rollup=rollup)
    feed = tmp_path / "feed"
    feed.mkdir()
    lines = [[("/r", 1 | 0x20000, 1)], [("/r/a/x", 4096, 2), ("/r/a/y", 512, 3)], [("/r/b/new", 4096, 4), ("/r/a/x", 4096, 5)]]
    for i, e in enumerate(lines):
        (feed / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("path", "flags", "event_id"), x, strict=True))) for x in e))
    upkeep.start(read_changes(spark, str(feed), files=1), str(tmp_path / "cp"), None).awaitTermination()
    roots = catalog.roots_table(spark, ["/r"])
    want = insights.root_rollup(catalog.with_root(store.rows(), roots)).collect()
    assert [tuple(r) for r in rollup.read().select(want[0].__fields__).collect()] == [tuple(r) for r in want]
    assert want[0]["content_bytes"] == 65 and want[0]["n_files"] == 3
    rollup.compact()
    assert [tuple(r) for r in rollup.read().select(want[0].__fields__).collect()] == [tuple(r) for r in want]
