"""Late materialisation: the same rows in the same order, from the winners' files."""

import pytest

from trovana.operators import catalog
from trovana.operators.search import SearchRequest, search, search_late


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("late") / "rows")
    rows = [(f"/d{i % 7}/file-{i:03d}-{'bolt' if i % 37 == 0 else 'nut'}.txt", False, i) for i in range(400)] + [("/d1/bolt", True, 0)]
    df = catalog.derive(spark.createDataFrame(rows, "path string, is_directory boolean, size_bytes long"))
    df.repartitionByRange(20, "size_bytes").write.parquet(place)
    return spark.read.parquet(place)


def scans(df):
    """(columns read, files read) of each scan of a plan that has run."""
    out = []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            out.append((set(p.requiredSchema().fieldNames()), p.metrics().apply("numFiles").value()))
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


@pytest.mark.parametrize("request_", [SearchRequest("bolt", limit=5), SearchRequest("", "size", False, limit=3), SearchRequest("nut", "name", limit=50), SearchRequest("nothing-like-it"), SearchRequest("bolt", limit=0)])
def test_same_rows(stored, request_):
    want = search(stored, request_)
    got = search_late(stored, request_)
    assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_only_the_winners_files_are_read(stored):
    out = search_late(stored, SearchRequest("", "size", False, limit=10))
    out._jdf.queryExecution().toRdd().count()
    (columns, files), *rest = scans(out)
    assert {"id", "volume_name", "created_time"} <= columns and files <= 2 and not rest
