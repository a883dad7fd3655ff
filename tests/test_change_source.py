"""The change feed with event ids as offsets: restarts, cursors, history."""

import threading
import time

import pytest

from trovana.operators import changes
from trovana.sources.changes import ChangeLog, ChangeStreamReader, catch_up, history, listed, read_changes, replay, wait_for_history

DONE = changes.HISTORY_DONE


@pytest.fixture
def log(tmp_path):
    log = ChangeLog(str(tmp_path / "feed"))
    # out of order within a file, repeated, and a file that overlaps another
    log.append([("/r/a", 0x1000, 3), ("/r/b", 0x1000, 1), ("/r/a", 0x200, 2)])
    log.append([("/r/c", 0x1000, 4), ("/r/a", 0x1000, 3)])
    log.append([("/q/x", 0x1000, 7), ("/r/d", 0x800, 5)])
    return log


def run(spark, feed, checkpoint):
    got = []
    feed.writeStream.foreachBatch(lambda df, n: got.append((n, sorted(map(tuple, df.collect()))))).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    return [x for x in got if x[1]]  # a first batch may be empty


def test_restart_goes_on_behind_the_offset(spark, log, tmp_path):
    feed = lambda after="beginning": read_changes(spark, log.folder, after)
    first = run(spark, feed(), tmp_path / "cp")
    assert [n for n, _ in first] == [0] and len(first[0][1]) == 7
    assert run(spark, feed(), tmp_path / "cp") == []
    log.append([("/r/e", 0x1000, 8)])
    log.append([("/r/f", 0x1000, 10), ("/r/e", 0x1000, 9)])
    second = run(spark, feed(), tmp_path / "cp")
    assert [n for n, _ in second] == [1] and [r[2] for r in second[0][1]] == [8, 9, 10]
    # together they are what a batch reads
    whole = sorted(map(tuple, history(spark, log.folder).collect()))
    assert sorted(first[0][1] + second[0][1]) == whole
    assert [r[2] for _, rows in run(spark, feed(7), tmp_path / "cp2") for r in sorted(rows, key=lambda r: r[2])] == [8, 9, 10]
    assert run(spark, feed("now"), tmp_path / "cp3") == [] and run(spark, feed(99), tmp_path / "cp4") == []


def test_history_prunes_files_and_shares_tasks(spark, log):
    assert sorted(r["event_id"] for r in history(spark, log.folder, 2, 5).collect()) == [3, 3, 4, 5]
    reader = ChangeStreamReader({"path": log.folder, "perTask": "4"})
    parts = reader.partitions({"event_id": 0}, {"event_id": 9})
    assert [len(p.paths) for p in parts] == [1, 2] and len(reader.partitions({"event_id": 4}, {"event_id": 9})[0].paths) == 1
    with open(f"{log.folder}/{'0' * 19}9-{'0' * 19}9-000000002-1.jsonl", "w") as f:
        f.write('{"path": "/r/z", "flags": 1, "event_id": 9}\nnot json\n{"path": "/r/y", "fl')
    open(f"{log.folder}/notes.txt", "w").close()
    assert [r["path"] for r in history(spark, log.folder, 8).collect()] == ["/r/z"] and len(listed(log.folder)) == 4
    assert history(spark, log.folder + "/none").count() == 0


def test_cursors(log):
    assert log.cursors() == {} and log.since(["/r"]) is None and log.latest_id() == 7
    log.update({"/r": 5, "/q": 3})
    log.update({"/r": 4, "/q": 6})  # never back
    assert log.cursors() == {"/r": 5, "/q": 6} and log.since(["/r", "/q"]) == 5 and log.since(["/r", "/new"]) is None
    log.mark_baseline(["/new"])
    assert log.cursors()["/new"] == 7
    log.invalidate(["/r"])
    assert log.since(["/r"]) is None and log.since(["/q"]) == 6
    with open(f"{log.folder}/cursors/{time.time_ns():020d}.json", "w") as f:
        f.write('{"/q": ')  # cut short: the one before counts
    assert ChangeLog(log.folder).cursors() == {"/q": 6, "/new": 7}


def test_catch_up_by_cursors(spark, log):
    assert catch_up(spark, log.folder, ["/r"], (), seconds=0)[0] == "full"  # no cursors
    log.update({"/r": 3, "/q": 6})
    assert catch_up(spark, log.folder, ["/r", "/q"], (), seconds=0)[0] == "full"  # no end of history in time
    log.append([("/", DONE, 8)])
    log.append([("/r/late", 0x1000, 9)])
    action, scopes, cursors = catch_up(spark, log.folder, ["/r", "/q"], (), seconds=5)
    # /r/c and /r/d lie behind the cursor of /r (the parent of what was renamed); /r/late comes after the end of history
    assert action == "scoped" and {r["path"] for r in scopes.collect()} == {"/r", "/q/x"} and cursors == {"/r": 8, "/q": 8}
    log.update({"/r": 7, "/q": 7})
    assert catch_up(spark, log.folder, ["/r", "/q"], (), seconds=5)[0] == "upToDate"
    log.append([("/q", changes.KERNEL_DROPPED, 10), ("/", DONE, 11)])
    log.update({"/r": 9, "/q": 9})
    action, scopes, _ = catch_up(spark, log.folder, ["/r", "/q"], (), seconds=5)
    assert action == "full" and {r["path"] for r in scopes.collect()} == {"/q"}


def test_history_is_waited_for(spark, log):
    later = threading.Timer(1.0, lambda: log.append([("/", DONE, 12)]))
    later.start()
    assert wait_for_history(spark, log.folder, 3, seconds=30) == 12
    later.join()
    assert wait_for_history(spark, log.folder, 12, seconds=0.3) is None


def test_replay_moves_cursors(spark, log, tmp_path):
    log.update({"/r": 3})
    seen = []
    replay(spark, log.folder, ["/r"], lambda df, n: seen.append(sorted(r["event_id"] for r in df.collect())), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [[4, 5, 7]] and log.cursors() == {"/r": 7}
    log.append([("/r/n", 0x1000, 8)])
    replay(spark, log.folder, ["/r"], lambda df, n: seen.append(sorted(r["event_id"] for r in df.collect())), str(tmp_path / "cp")).awaitTermination(120)
    assert seen[1:] == [[8]] and log.cursors() == {"/r": 8}
