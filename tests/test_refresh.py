"""Pending paths as keyed state: sequences of events and the batches that come of them."""

import json

import pytest

from trovana.streaming import refresh


@pytest.fixture
def feed(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in (*refresh.STATE, "spark.sql.shuffle.partitions")}
    for k, v in (refresh.STATE | {"spark.sql.shuffle.partitions": "1"}).items():
        spark.conf.set(k, v)

    class Feed:
        """Each call of ``step`` is a run of the query over what came since; times are seconds of the rows' own clock."""

        n = 0

        def put(self, at, *paths, applied=None, large=None, reconciled=None, root="/r"):
            rows = [{"root": root, "shard": 0, "at": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "path": p, "event_id": 1000 * at + k} for k, p in enumerate(paths)]
            if applied is not None:
                rows.append({"root": root, "shard": 0, "at": f"2024-01-01T00:{at // 60:02d}:{at % 60:02d}Z", "applied": applied, "large": large, "reconciled": reconciled})
            (tmp_path / "in").mkdir(exist_ok=True)
            Feed.n += 1
            (tmp_path / "in" / f"{Feed.n:05d}.json").write_text("\n".join(map(json.dumps, rows)))

        def step(self):
            got = {}

            def keep(df, n):
                for r in df.collect():
                    got.setdefault((r["root"], r["batch"]), []).append(r["path"])

            stream = spark.readStream.schema(refresh.INPUT).json(str(tmp_path / "in"))
            out = refresh.batches(stream, debounce=2000, back_off=30_000, most=3, lease=600_000, late="0 seconds")
            out.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
            return {k: sorted(v) for k, v in got.items()}

        def tick(self, at):
            """Another root's event moves the clock."""
            self.put(at, "/clock/x", root="/clock")
            return {k: v for k, v in self.step().items() if k[0] == "/r"}

    yield Feed()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_debounce_carry_over_back_off_and_pruning(feed):
    # each run restarts the query: state lies in its checkpoint
    feed.put(10, "/r/a", "/r/b", "/r/a")
    assert feed.step() == {}
    feed.put(11, "/r/c", "/r/d/1", "/r/d/2")
    assert feed.tick(11) == {}
    # due two seconds after the first: three of five paths leave, once each
    assert feed.tick(13) == {("/r", 0): ["/r/a", "/r/b", "/r/c"]}
    feed.put(14, "/r/a")
    # the rest waits for the report, whatever the clock says
    assert feed.tick(60) == {}
    feed.put(61, applied=0, large=False)
    assert feed.tick(62) == {("/r", 1): ["/r/a", "/r/d/1", "/r/d/2"]}
    feed.put(63, "/r/e/1", "/r/e/2", "/r/ex", "/r/f")
    assert feed.tick(64) == {}
    # a large overlay: back-off, and what was reconciled needs no refresh
    feed.put(65, applied=1, large=True, reconciled=["/r/e"])
    assert feed.tick(80) == {}
    assert feed.tick(100) == {("/r", 2): ["/r/ex", "/r/f"]}
    # a report of another batch changes nothing; nothing is left
    feed.put(101, applied=7, large=False)
    assert feed.tick(110) == {}
    feed.put(111, applied=2, large=False)
    assert feed.tick(115) == {}
    feed.put(120, "/r/g")
    assert feed.tick(121) == {}
    assert feed.tick(123) == {("/r", 3): ["/r/g"]}


def test_a_missing_report_holds_up_no_longer_than_its_lease(feed):
    feed.put(10, "/r/a", "/r/b", "/r/c", "/r/d")
    assert feed.tick(10) == {}
    assert feed.tick(13) == {("/r", 0): ["/r/a", "/r/b", "/r/c"]}
    assert feed.tick(500) == {}
    assert feed.tick(700) == {("/r", 1): ["/r/d"]}


def test_rows_in_and_reports(spark):
    e = spark.createDataFrame([("/r", f"/r/{i}", i) for i in range(200)] + [(None, "/x", 1), ("/r", None, 2)], "root string, path string, event_id long")
    rows = refresh.events_in(e, shards=4)
    assert [f"{n} {t}" for n, t in rows.dtypes] == [x.replace("long", "bigint") for x in refresh.INPUT.split(", ")]
    assert rows.count() == 200 and {r["shard"] for r in rows.collect()} == {0, 1, 2, 3}
    out = spark.createDataFrame([("/r", 1, 5, "/r/a", 1), ("/r", 1, 5, "/r/b", 2), ("/r", 2, 9, "/r/c", 3)], refresh.OUTPUT)
    told = refresh.reports(out, True, ["/r/d"])
    assert told.dtypes == rows.dtypes and {(r["shard"], r["applied"], r["large"], tuple(r["reconciled"])) for r in told.collect()} == {(1, 5, True, ("/r/d",)), (2, 9, True, ("/r/d",))}
