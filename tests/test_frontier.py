"""A crawl in rounds: the rows of one walk, stopped and taken up, spread over tasks."""

import os
import shutil

import pytest

from trovana.operators import exclusion
from trovana.sources.crawl import crawl, preflight
from trovana.sources.frontier import FrontierCrawl
from trovana.sources.snapshot import Store


@pytest.fixture
def disk(tmp_path):
    top = tmp_path / "disk"
    for p in ("a/b/c.txt", "a/node_modules/x.js", ".git/config", ".git/objects/1", "d/e/f/g.o", "d/e/h", "deep/" + "/".join("n" * 1 for _ in range(12)) + "/end.txt"):
        (top / p).parent.mkdir(parents=True, exist_ok=True)
        (top / p).write_text("12345")
    for i in range(40):
        (top / f"wide/inner/k{i}").mkdir(parents=True)
        (top / f"wide/inner/k{i}/file").write_text("x")
    (top / "link").symlink_to(top / "a")
    return str(top)


def rows(df):
    return sorted(map(tuple, df.select("path", "is_directory", "size_bytes", "modified_time").collect()))


def test_rounds_find_what_a_walk_finds(spark, tmp_path, disk):
    roots = [disk, disk + "/a", disk + "/none"]
    c = FrontierCrawl(Store(spark, f"file://{tmp_path}/store"), roots)
    assert c.run() and c.finished and c.skipped == {disk + "/none": "missing"}
    assert rows(c.rows()) == rows(crawl(spark, roots[:2])) and c.rows().count() == c.rows().select("path").distinct().count()
    states = {r["path"]: r["state"] for r in c.frontier().collect()}
    assert set(states.values()) == {"completed"} and states[disk + "/wide/inner/k3"] == "completed" and disk + "/a/node_modules" not in states
    last = c.rounds[-1]
    assert last.total_rows == c.rows().count() and last.total_listed == len(states) and last.most_pending == max(r.n_pending for r in c.rounds) >= 40
    assert len(c.rounds) == 15 and c.rounds[1].n_listed == 2  # as many as the tree is deep, the roots first
    assert c.publish().n_rows == c.store.tree().count() and rows(c.store.rows()) == rows(crawl(spark, roots[:2])) and not [f for f in os.listdir(tmp_path / "store") if f.startswith("crawl-")]


def test_one_subtree_is_spread_over_tasks(spark, tmp_path, disk):
    c = FrontierCrawl(Store(spark, f"file://{tmp_path}/store"), [disk + "/wide"], per_task=8)
    c.run()
    listed = c._lines().where(f"kind = 'done' and path like '%/inner/k%'").groupBy("task").count().collect()
    assert sum(r["count"] for r in listed) == 40 and len(listed) >= 4 and max(r["count"] for r in listed) < 20


def test_killed_and_taken_up(spark, tmp_path, disk, monkeypatch):
    place = f"file://{tmp_path}/store"
    first = FrontierCrawl(Store(spark, place), [disk])
    assert not first.run(most_rounds=3)
    pending = {r["path"] for r in first.frontier().where("state = 'pending'").collect()}
    assert disk + "/wide/inner" in pending
    # a round that is cut off: its lines are written, its checkpoint isn't
    with monkeypatch.context() as m:
        m.setattr(Store, "note_checkpoint", lambda *a: (_ for _ in ()).throw(OSError("cut off")))
        with pytest.raises(OSError):
            first.step()
    again = FrontierCrawl(Store(spark, place), [disk])
    assert len(again.rounds) == 3 and {r["path"] for r in again.pending().collect()} == pending
    assert again.run()
    assert rows(again.rows()) == rows(crawl(spark, [disk]))
    # other roots or patterns begin anew, and so does a crawl after its rows were published
    assert not FrontierCrawl(Store(spark, place), [disk + "/a"]).rounds and not FrontierCrawl(Store(spark, place), [disk], ("x/",)).rounds
    again.publish()
    assert not FrontierCrawl(Store(spark, place), [disk]).rounds


def test_failures_are_told(spark, tmp_path, disk):
    c = FrontierCrawl(Store(spark, f"file://{tmp_path}/store"), [disk])
    c.run(most_rounds=3)
    shutil.rmtree(disk + "/wide/inner")
    assert c.run() and sum(r.n_failed for r in c.rounds) == 1
    assert [tuple(r) for r in c.failures().collect()] == [(disk + "/wide/inner", "No such file or directory")]
    assert c.frontier().where("state = 'failed'").count() == 1


def test_a_root_that_another_ones_rules_exclude(disk):
    assert preflight([disk, disk + "/a/node_modules", disk + "/a"], exclusion.DEFAULT_PATTERNS) == {disk: "readable", disk + "/a/node_modules": "excluded", disk + "/a": "readable"}


def test_empty(spark, tmp_path):
    c = FrontierCrawl(Store(spark, f"file://{tmp_path}/store"), [str(tmp_path / "none")])
    assert c.run() and c.rows().count() == 0 and c.frontier().count() == 0 and c.rounds[0].n_pending == 0
