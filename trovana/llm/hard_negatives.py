"""Hard negatives: a distributed join of anchors with the vectors of highest inner product, over Voronoi cells.

Inner products become angles: with M the largest norm, a vector x gets one more component, sqrt(M^2 - |x|^2), so
that all have norm M, and an anchor a gets a zero. Then a.x = |a| M cos(angle), and more is nearer. Pivots are fitted
on a bounded sample of anchors; each anchor belongs to the group of its nearest pivot. A first join, of anchors
with the vectors nearest to the same pivot, yields scores that the k-th best can't be below. From these, and
from the highest scores wanted, follows the range of angles to the pivot in which a vector can serve one of a group's
anchors (by the triangle inequality on the sphere): a vector goes to just those groups. There, blocks of vectors
meet blocks of anchors, and exact integer products decide.

Anchors of one label and vector are searched for once; what they share is joined back by a number. Groups are cut
both ways, so that no task holds more than some blocks, whatever a cell or a label has.

Defined results: rows whose id, label or vector is null, or whose vector is empty or holds null or non-finite
components, take no part, nor do those of another length than the anchor with the smallest id; rows equal in id, label
and vector count once, rows that share the id alone are rows of their own, but for an anchor with which they have the
same score they count once; an anchor without other rows of its label
has no rows in the result; a zero vector has the score 0 with all; an empty table gives no rows; extra columns are
ignored. A component of 2^18 or more in size is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import heavy_join, lean, materialise
from trovana.llm.embedding_dedup import spherical_kmeans
from trovana.llm.vector_codes import as_integers

#: Pivots, and bytes of the sample they are fitted on.
PIVOTS, SAMPLE_BYTES = 32, 8 << 20
#: Bytes of a block of vectors; vectors and anchors that meet in one task, about; products held at once.
BLOCK_BYTES, VECTORS, ANCHORS, PRODUCTS = 1 << 18, 16_384, 1024, 1 << 21
#: Most buckets of labels: rows of one label are in one.
BUCKETS = 256
#: A score beyond all.
FAR = 1 << 62
#: Slack of angles, for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


class Cells:
    """The pivots, as unit vectors, and the largest norm."""

    def __init__(self, pivots: np.ndarray, norm: float, buckets: int):
        self.pivots, self.norm, self.buckets = pivots, norm, buckets

    def angles(self, x: np.ndarray, anchor: bool) -> np.ndarray:
        """Angles of vectors to all pivots; pivots have no part in the added component, as anchors have none."""
        size = np.sqrt((x * x).sum(axis=1, keepdims=True)) if anchor else self.norm
        return np.arccos(np.clip(x / np.where(size > 0, size, 1) @ self.pivots.T, -1, 1))


def top(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each row's best, second and so on; the first of equal ones comes first. ``scores`` is used up."""
    row = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores[row].argmax(axis=1)
        there = scores[row, at] > -np.inf
        row, at = row[there], at[there]
        if not len(row):
            return
        yield row, at
        scores[row, at] = -np.inf


def _meet(same: bool, k: int, dim: int):
    """The join of some anchors (a, label, q, lo, hi) with blocks (ids, labels, v): the first ``k`` for each range of scores."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and blocks.num_rows:
            flat = lambda name: blocks[name].combine_chunks().flatten().to_numpy()
            ids, labels, v = flat("ids"), flat("labels"), flat("v").reshape(-1, dim)
            # by id, so that the first of equal scores has the smallest; equal rows once
            order = np.lexsort((*v.T[::-1], labels, ids))
            ids, labels, v = ids[order], labels[order], v[order]
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (v[1:] != v[:-1]).any(axis=1)])
            ids, labels, x = ids[new], labels[new], v[new].astype(np.float64)
            q = _matrix(anchors["q"].combine_chunks(), dim)
            own, number = anchors["label"].to_numpy(), anchors["a"].to_numpy()
            lo, hi = anchors["lo"].to_pylist(), anchors["hi"].to_pylist()
            step = max(1, PRODUCTS // len(ids))
            for b in range(0, len(q), step):
                s = q[b : b + step] @ x.T  # exact: integers below 2^53
                s[(own[b : b + step, None] == labels) != same] = -np.inf
                most = max(map(len, lo[b : b + step]))
                for slot in range(most):
                    low = np.array([r[slot] if slot < len(r) else np.inf for r in lo[b : b + step]], np.float64)
                    high = np.array([r[slot] if slot < len(r) else -np.inf for r in hi[b : b + step]], np.float64)
                    picked = np.where((s >= low[:, None]) & (s <= high[:, None]), s, -np.inf)
                    for row, at in top(picked, k):
                        out.append((number[b + row], np.full(len(row), slot, np.int32), ids[at], s[row, at].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return pa.table(dict(zip(("a", "slot", "vec_id", "score"), columns, strict=True)))

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` by score and id, of each anchor and range."""
    from pyspark.sql import Window

    order = Window.partitionBy("a", "slot").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["a", "slot", "vec_id", "score"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _join(vectors: DataFrame, anchors: DataFrame, cells: Cells, dim: int, same: bool, k: int, at_home: bool) -> DataFrame:
    """(a, slot, vec_id, score, rank): the first ``k`` of each anchor and range; ``at_home``: among vectors of its own cell."""
    many, buckets = len(cells.pivots), cells.buckets if same else 1
    h = F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int")
    asked = anchors.withColumn("h", h)
    # the range of angles to the pivot in which a vector can serve one of the group; all of these tables have as many rows as groups
    reach = F.col("norm") * cells.norm
    far = F.when(F.col("norm") > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.array_min("lo") / reach)))).otherwise(4.0)
    near = F.when(F.col("norm") > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.array_max("hi") / reach)))).otherwise(0.0)
    groups = asked.groupBy("g", "h").agg(F.count("*").alias("n"), F.max(F.col("angle") + far).alias("upto"), F.min(near - F.col("angle")).alias("start")).collect()
    start, upto, asks = np.full((many, buckets), np.inf), np.full((many, buckets), -np.inf), np.zeros((many, buckets), np.int64)
    for r in groups:
        start[r["g"], r["h"]], upto[r["g"], r["h"]], asks[r["g"], r["h"]] = r["start"] - SLACK, r["upto"] + SLACK, r["n"]

    def going(x: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the groups they go to."""
        angle = cells.angles(x, anchor=False)
        if at_home:
            g = angle.argmin(axis=1)
            return np.flatnonzero(asks[g, bucket] > 0), g[asks[g, bucket] > 0]
        return np.nonzero((angle >= start.T[bucket]) & (angle <= upto.T[bucket]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many, buckets), np.int64)
        for b in batches:
            bucket = b.column(1).to_numpy()
            row, g = going(_matrix(b.column(0), dim), bucket)
            np.add.at(total, (g, bucket[row]), 1)
        g, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[g, at])], names=["g", "h", "n"])

    per = max(1, BLOCK_BYTES // (4 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of vectors by group: a group's vectors are held until a block is full, or all held have the size of several."""
        held: dict[tuple[int, int], list] = {}
        sizes: dict[tuple[int, int], int] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            n = sizes.pop(key)
            lists = [pa.ListArray.from_arrays(pa.array([0, n * w], pa.int32()), pa.array(c)) for c, w in ((ids, 1), (labels, 1), (v.ravel(), dim))]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *lists], names=["g", "h", "ids", "labels", "v"])

        for b in batches:
            bucket, ids, labels = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            whole = b.column(0).flatten().to_numpy().astype(np.int32).reshape(-1, dim)
            row, g = going(whole.astype(np.float64), bucket)
            key = g * buckets + bucket[row]
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            for a, e in zip(cut, [*cut[1:], len(key)], strict=True):
                name = (int(key[a]) // buckets, int(key[a]) % buckets)
                for c in range(a, e, per):
                    some = row[c : min(e, c + per)]
                    held.setdefault(name, []).append((ids[some], labels[some], whole[some]))
                    sizes[name] = sizes.get(name, 0) + len(some)
                    if sizes[name] >= per:
                        yield block(name)
            while sum(sizes.values()) > 32 * per:
                yield block(max(sizes, key=sizes.get))
        for name in list(sizes):
            yield block(name)

    ours = vectors.select("q", h.alias("h"), "vec_id", "label")
    numbers = np.zeros((many, buckets), np.int64)
    for r in ours.select("q", "h").mapInArrow(lean(count), "g int, h int, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).collect():
        numbers[r["g"], r["h"]] = r["n"]
    # so many parts a group has of its vectors (s) and of its anchors (t)
    cuts = vectors.sparkSession.createDataFrame(
        [(g, b, int(-(-numbers[g, b] // VECTORS)), int(-(-asks[g, b] // ANCHORS))) for g, b in np.argwhere((numbers > 0) & (asks > 0)).tolist()], "g int, h int, ns int, nt int"
    )

    def spread(part: str, other: str, by: Column) -> list[Column]:
        """A row's own part, and all parts of the other side."""
        return [F.pmod(by, F.col(f"n{part}")).cast("int").alias(part), F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other)]

    blocks = ours.mapInArrow(lean(pack), "g int, h int, ids array<long>, labels array<long>, v array<int>").join(F.broadcast(cuts), ["g", "h"])
    blocks = blocks.select("g", "h", "ids", "labels", "v", *spread("s", "t", F.xxhash64("ids")))
    queries = asked.join(F.broadcast(cuts), ["g", "h"]).select("g", "h", "a", "label", "q", "lo", "hi", *spread("t", "s", F.xxhash64("a")))
    key = ("g", "h", "s", "t")
    found = queries.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(_meet(same, k, dim), "a long, slot int, vec_id long, score long")
    return _first(found, k)


def _search(vectors: DataFrame, anchors: DataFrame, cells: Cells, dim: int, same: bool, k: int, label: str) -> DataFrame:
    """``_join`` with all vectors that can be among the first ``k``, by what the own cell has."""
    home = _join(vectors, anchors, cells, dim, same, k, True).where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("least"))
    # no more than a few ranges each
    raised = anchors.join(home, "a", "left").withColumn("lo", F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.col("least")[i.cast("int")], x))))
    raised = materialise(raised.drop("least"), f"negatives-{label}")
    return materialise(_join(vectors, raised, cells, dim, same, k, False), f"negatives-{label}-found")


def mine_hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS) -> DataFrame:
    """For anchors and each of their first ``positives``: the first ``negatives`` with scores from ``low`` to ``high`` per cent of the positive's.

    ``embeddings`` has vec_id, label (integers) and embedding. Returns anchor_id, positive_id, rank, negative_id,
    positive_score and negative_score. Pivots are fitted on ``SAMPLE_BYTES`` of anchors at most; all rows take part.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), as_integers(F.col("embedding")).alias("q"), is_anchor.alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null and q is not null and size(q) > 0")
    squares = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    rows = materialise(rows.withColumn("norm", F.sqrt(squares.cast("double"))), "negatives-rows")
    first = rows.where("anchor").orderBy("vec_id", "q").select("q").first()
    dim = len(first["q"]) if first else 1
    vectors = rows.where(F.size("q") == dim)
    # anchors of one label and vector are asked for once
    classes = materialise(vectors.where("anchor").groupBy("label", "q", "norm").agg(F.count("*").alias("n")).withColumn("a", F.monotonically_increasing_id()), "negatives-classes")
    facts = vectors.agg(F.max("norm").alias("norm"), F.approx_count_distinct("label").alias("labels")).first()
    norm = max(facts["norm"] or 0, 1) * (1 + 1e-12)
    if norm * norm >= 2**53:
        raise ValueError("inner products may not be exact")
    sample = classes.where("norm > 0").orderBy(F.xxhash64("q", "label")).select("q").limit(max(2, SAMPLE_BYTES // (8 * dim))).toArrow()
    x = _matrix(sample["q"].combine_chunks(), dim) if len(sample) else np.ones((1, dim))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    cells = Cells(spherical_kmeans(x, pivots), norm, min(BUCKETS, max(1, facts["labels"] or 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            angle = cells.angles(_matrix(b.column(2), dim), anchor=True)
            g = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g.astype(np.int32)), pa.array(angle[np.arange(len(g)), g])], names=["a", "label", "q", "norm", "g", "angle"])

    placed = materialise(classes.select("a", "label", "q", "norm").mapInArrow(lean(place), "a long, label long, q array<int>, norm double, g int, angle double"), "negatives-anchors")
    every = placed.withColumns({"lo": F.array(F.lit(-FAR)), "hi": F.array(F.lit(FAR))})
    # one more than wanted, as an anchor finds itself
    near = _search(vectors, every, cells, dim, True, positives + 1, "positives").select("a", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    wanted = near.withColumns({"lo": F.expr(f"-((-{low} * positive_score) div 100)"), "hi": F.expr(f"({high} * positive_score) div 100")}).where("positive_score >= 0 and lo <= hi")
    ranges = wanted.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("positive_score", "lo", "hi"))).alias("ranges"))
    asking = placed.join(ranges, "a").withColumns({"scores": F.col("ranges.positive_score"), "lo": F.col("ranges.lo"), "hi": F.col("ranges.hi")}).drop("ranges")
    asking = materialise(asking, "negatives-asking")
    found = _search(vectors, asking.drop("scores"), cells, dim, False, negatives, "negatives")
    found = found.join(asking.select("a", F.posexplode("scores").alias("slot", "positive_score")), ["a", "slot"])
    listed = found.groupBy("a", "positive_score").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))
    order = F.struct((-F.col("positive_score")).alias("o"), "positive_id", "positive_score", "negatives")
    per = near.join(listed, ["a", "positive_score"], "left").groupBy("a").agg(F.array_sort(F.collect_list(order)).alias("found"))
    per = materialise(classes.select("a", "label", "q", "n").join(per, "a").select(F.struct("label", "q").alias("class"), "n", "found"), "negatives-per-class")
    asks = vectors.where("anchor").select("vec_id", F.struct("label", "q").alias("class"), (F.col("norm") * F.col("norm")).alias("own")).distinct()
    out = heavy_join(asks, per, "class", "n", vectors.where("anchor").count())
    itself = lambda x: (x["positive_id"] == F.col("vec_id")) & (x["positive_score"] == F.round("own").cast("long"))
    kept = F.slice(F.filter("found", lambda x: ~itself(x)), 1, positives)
    out = out.select(F.col("vec_id").alias("anchor_id"), F.explode(kept).alias("p"))
    out = out.select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.negatives").alias("x"))
    return out.select("anchor_id", "positive_id", F.col("x.rank").alias("rank"), "x.negative_id", "positive_score", "x.negative_score")
