"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors of a label become one class before anything else, so a vector with a third
of all rows is one row from there on. Cells are fitted on a bounded sample; every class
is assigned. Two unit vectors whose cosine is ``threshold`` lie at most r apart, so one
of them can have its partner in a foreign cell only if it is nearer to that cell's
centroid than its own one by no less than -r * (distance of the two centroids): exactly
those cells are visited as well, and no pair is lost. Cells of any size are cut into
blocks, and each pair of blocks is one small task, which returns link counts and a
spanning forest rather than pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those with a null label, link with nothing; vectors of different lengths
don't link; a null id gives a row that links with nothing, with a null component and not
kept; repeated rows are vectors of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import components, heavy_join, lean, materialise

#: Classes of a block; at most so many centroids are fitted over all labels, from so many rows.
BLOCK, MAX_CELLS, SAMPLE = 1024, 4096, 40_000
#: A vector is hot if it has more than this share of all rows.
HOT = 2000


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, embedding as doubles, ok."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    # zeros of either sign are one value
    return rows.select("vec_id", "label", F.transform("v", lambda x: x + 0.0).alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))


def unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids; empty cells go, so there may be fewer than ``k``."""
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums**2).sum(axis=1))
        c = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return c


def fit_cells(classes: DataFrame, target: int) -> dict[tuple[str, int], np.ndarray]:
    """Centroids by (label, dimensions), for those with more than two cells' worth of classes."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = max(2 * target, -(-total // MAX_CELLS))
    large = sizes.where(F.col("n") > least)  # fewer than MAX_CELLS
    picked = large.collect()
    if not picked:
        return {}
    every = sum(r["n"] for r in picked)
    share = min(1.0, SAMPLE / every)
    h = F.pmod(F.xxhash64("cls"), F.lit(1_000_003)) / 1_000_003
    sample = classes.join(F.broadcast(large.select("label", "dim")), ["label", "dim"]).where(h < share).orderBy(F.xxhash64("cls")).limit(2 * SAMPLE)
    by: dict[tuple[str, int], list] = {}
    for r in sample.select("label", "dim", "v").toLocalIterator():
        by.setdefault((r["label"], r["dim"]), []).append(np.array(r["v"]))
    out = {}
    for r in picked:
        rows = by.get((r["label"], r["dim"]))
        k = max(1, min(r["n"] // target, MAX_CELLS * r["n"] // total))
        if rows and k > 1:
            out[r["label"], r["dim"]] = spherical_kmeans(unit(rows), k)
    return out


def assign(classes: DataFrame, cells: dict, threshold: float) -> DataFrame:
    """A row for each class and cell: its own (visitor false), and higher ones that can hold a partner."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, dims = b.column(1).to_pylist(), b.column(2).to_pylist()
            values = b.column(4)
            flat, offsets = values.flatten().to_numpy(), values.offsets.to_numpy() - values.offsets[0].as_py()
            take, cell, visitor = [], [], []
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                c = shared.value.get(key)
                if c is None:
                    take += rows
                    cell += [0] * len(rows)
                    visitor += [False] * len(rows)
                    continue
                near = unit([flat[offsets[i] : offsets[i + 1]] for i in rows]) @ c.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                visits = near[np.arange(len(rows)), home][:, None] - near <= reach * apart[home] + 1e-9
                visits &= np.arange(len(c))[None, :] > home[:, None]
                i, j = np.nonzero(visits)
                take += [*rows, *(rows[x] for x in i)]
                cell += [*home.tolist(), *j.tolist()]
                visitor += [False] * len(rows) + [True] * len(i)
            picked = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cell, pa.int32()), pa.array(visitor, pa.bool_())], names=["cls", "label", "dim", "n", "v", "cell", "visitor"])

    return classes.select("cls", "label", "dim", "n", "v").mapInArrow(lean(run), "cls long, label string, dim int, n long, v array<double>, cell int, visitor boolean")


def linked(a: np.ndarray, b: np.ndarray | None, na: np.ndarray, nb: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Links of each row of ``a`` and then ``b``, weighted by copies, and the place of the first row of its component."""
    within = b is None
    hit = (a @ (a if within else b).T) >= threshold
    if within:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return None
    if within:
        links, size = hit @ na, len(a)
    else:
        links, size = np.concatenate([hit @ nb, na @ hit]), len(a) + len(b)
    root = np.arange(size)
    while True:
        left, right = root[: len(a)], root if within else root[len(a) :]
        low = np.minimum(left, np.where(hit, right[None, :], size).min(axis=1))
        if within:
            new = low
        else:
            new = np.concatenate([low, np.minimum(right, np.where(hit, low[:, None], size).min(axis=0))])
        if (new == root).all():
            return links, root
        root = new


def block_links(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cls, links, root) of all pairs of blocks in a cell."""
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(
        F.ceil(F.count_if(~F.col("visitor")) / block).cast("int").alias("nm"), F.ceil(F.count_if(F.col("visitor")) / block).cast("int").alias("nv")
    ).where("nm > 0")
    side = F.when(F.col("visitor"), F.col("nv")).otherwise(F.col("nm"))
    cut = placed.join(sizes, key).withColumn("at", F.pmod(F.xxhash64("cls"), side).cast("int"))
    packed = cut.groupBy(*key, "nm", "nv", "visitor", "at").agg(F.collect_list(F.struct("cls", "n", "v")).alias("rows"))
    own = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: F.struct(F.lit(False).alias("vs"), F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
    seen = F.when(F.col("nv") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("nv") - 1, F.lit(0))), lambda j: F.struct(F.lit(True).alias("vs"), F.col("at").alias("i"), j.alias("j")))).otherwise(
        F.array().cast("array<struct<vs:boolean,i:int,j:int>>")
    )
    guest = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda j: F.struct(F.lit(True).alias("vs"), j.alias("i"), F.col("at").alias("j")))
    tasks = packed.withColumn("pair", F.explode(F.when(F.col("visitor"), guest).otherwise(F.concat(own, seen))))
    pairs = tasks.groupBy(*key, "pair").agg(F.collect_list(F.struct("visitor", "at", "rows")).alias("blocks"))  # one or two blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blocks in b.column(0):
                parts = []
                for x in sorted(blocks.values, key=lambda x: x["visitor"].as_py()):
                    rows = x["rows"].values
                    ids, n = rows.field("cls").to_numpy(), rows.field("n").to_numpy()
                    v = rows.field("v").flatten().to_numpy().reshape(len(ids), -1)
                    parts.append((ids, n.astype(np.int64), unit(list(v))))
                (ids, n, x), rest = parts[0], parts[1:]
                got = linked(x, rest[0][2] if rest else None, n, rest[0][1] if rest else None, threshold)
                if got:
                    links, root = got
                    every = np.concatenate([ids, rest[0][0]]) if rest else ids
                    some = links > 0
                    yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(links[some].astype(np.int64)), pa.array(every[root][some])], names=["cls", "links", "root"])

    return pairs.select("blocks").mapInArrow(lean(run), "cls long, links long, root long")


def dedup_embeddings(embeddings: DataFrame, threshold: float = 0.98, target: int = 512, block: int = BLOCK) -> DataFrame:
    """vec_id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest vec_id reachable) and ``kept``."""
    rows = materialise(usable(embeddings), "embeddings")
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")).withColumn("dim", F.size("v"))
    classes = materialise(classes, "embedding-classes")
    placed = materialise(assign(classes, fit_cells(classes, target), threshold), "embedding-cells")
    found = materialise(block_links(placed, threshold, block), "embedding-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "embedding-components")
    per = classes.join(links, "cls", "left").join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left")
    vector = F.struct("label", "v").alias("vector")
    per = per.select(vector, "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    # a vector that many rows have is broadcast, so that its rows stay where they are
    good = heavy_join(rows.where("ok").select("vec_id", vector), materialise(per, "embedding-classes"), "vector", "n", rows.count(), hot=HOT).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
