"""The rotating log: lines of bounded length, parts of bounded size, all or nothing of a write."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trovana.operators import diagnostics
from trovana.sources.log_sink import LINE_BYTES, LogWriter, Written, lines, prune, write_rotating
from trovana.sources.logs import malformed, read_events


def events(spark, rows):
    """(event, {field: value or list of values})"""
    made = [(1, None, "info", "search", e, {k: ("privateString", "array" if isinstance(v, list) else "string", None if isinstance(v, list) else v, v if isinstance(v, list) else None, None, None, None) for k, v in f.items()}) for e, f in rows]
    return spark.createDataFrame(made, diagnostics.EVENT_SCHEMA).withColumn("timestamp", F.timestamp_seconds(F.lit(1_700_000_000)))


def test_lines_by_size(spark):
    rows = [
        ("small", {"q": "x", "é": "ü" * 10}),
        ("long text", {"q": "y" * 10_000}),
        # 50 texts of 4,096 don't fit, 10 of 1,024 do
        ("many", {"paths": ["/p/" + "z" * 4000] * 80}),
        # too many fields even when they are cut
        ("huge", {f"f{i}": "w" * 5000 for i in range(90)}),
        ("none", {}),
    ]
    got = [(r["form"], json.loads(r["line"]), len(r["line"].encode()) + 1) for r in lines(events(spark, rows)).collect()]
    assert [f for f, _, _ in got] == ["whole", "whole", "reduced", "tooLarge", "whole"] and max(n for _, _, n in got) <= LINE_BYTES
    assert got[1][1]["fields"]["q"]["originalLength"] == 10_000 and len(got[1][1]["fields"]["q"]["value"]) == 4096
    cut = got[2][1]["fields"]["paths"]
    assert len(cut["values"]) == 10 and {len(v) for v in cut["values"]} == {1024} and cut["totalCount"] == 80 and cut["truncated"]
    told = got[3][1]
    assert told["event"] == "diagnosticLog.eventTooLarge" and told["category"] == "diagnosticLog" and told["level"] == "info"
    assert {k: v["value"] for k, v in told["fields"].items()} == {"originalCategory": "search", "originalEvent": "huge", "fieldCount": "90"}


def test_round_trip_and_rotation(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [(f"e{i}", {"q": f"text {i} " + "x" * 500}) for i in range(400)]
    write_rotating(events(spark, rows).repartition(3), folder, part_bytes=20_000)
    parts = sorted(os.listdir(folder))
    assert len(parts) >= 400 * 500 // 20_000 and all(os.path.getsize(f"{folder}/{p}") <= 20_000 for p in parts) and not [p for p in parts if p.startswith(".")]
    back = read_events(spark, folder)
    assert {r["event"]: r["fields"]["q"]["value"] for r in back.collect()} == {e: f["q"] for e, f in rows}
    assert malformed(back).first()[0] == 0
    # appending rotates by the size of all: the oldest parts go
    write_rotating(events(spark, [("new", {"q": "n"})]), folder, part_bytes=20_000, total_bytes=50_000)
    left = sorted(os.listdir(folder))
    assert sum(os.path.getsize(f"{folder}/{p}") for p in left) <= 50_000 and set(left) - set(parts)
    assert "new" in {r["event"] for r in read_events(spark, folder).collect()}
    write_rotating(events(spark, [("e", {})]).limit(0), folder)
    assert sorted(os.listdir(folder)) == left


def test_prune_by_age(tmp_path):
    for k in range(4):
        (tmp_path / f"events-{k}.jsonl").write_text("x" * 10)
        os.utime(tmp_path / f"events-{k}.jsonl", (1000 + k, 1000 + k))
    (tmp_path / "other.txt").write_text("y" * 1000)
    assert prune(str(tmp_path), 100, 50, now=1052.5) == ["events-0.jsonl", "events-1.jsonl", "events-2.jsonl"]
    assert sorted(os.listdir(tmp_path)) == ["events-3.jsonl", "other.txt"]
    assert prune(str(tmp_path), 9, 5000, now=1052.5) == ["events-3.jsonl"]


def test_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "log")
    bad = events(spark, [(f"e{i}", {"q": "x"}) for i in range(50)]).repartition(2).withColumn("event", F.when(F.col("event") == "e49", F.raise_error(F.lit("broken"))).otherwise(F.col("event")))
    with pytest.raises(Exception, match="broken"):
        write_rotating(bad, folder)
    assert not os.path.isdir(folder) or os.listdir(folder) == []
    w = LogWriter({"path": folder, "partBytes": "10"})
    w.write(iter([]))
    w.commit([Written([]), None])
    assert os.listdir(folder) == []
