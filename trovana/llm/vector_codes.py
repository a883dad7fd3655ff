"""Vectors as short codes: codebooks per part, the nearest entry found over segment means.

A vector becomes integers and is cut into equal parts; each part is coded by its codebook's nearest
entry. To find it, block means are compared from coarse to fine: with the blocks' sums and the norm of
what the means leave over (the residual), a distance is at least the sum of the means' distances and the
square of the residual norms' difference. An entry whose bound exceeds the distance of the best guess is
out; those left get exact integer distances, so the result is the one of comparing all.

Each round is one scan: a task holds sums of the entries it has met, which are added up by entry and
position, and the codebooks alone (entries x dimensions integers) reach the driver.

Defined results: vectors that are null, empty, hold null or non-finite components or can't be cut into
equal parts are left out, as are those of another length than the one with the smallest id; null ids come
last in that order, and rows of one id by their components; with fewer rows than entries there are fewer
entries; repeated rows are rows of their own; null labels are one label; an empty table gives no rows;
extra columns are ignored. A component of 2^18 or more in size is refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import heavy_join, lean, materialise

#: Integers of this size and more are refused: squares and sums of them might not be exact.
LARGEST = 1 << 26


def as_integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null if the vector is, or holds a component that is null or not finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    small = F.forall(v, lambda x: F.abs(x) * scale < LARGEST)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    return F.when(~bad, F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is {LARGEST // scale} or more in size"))))


def levels(width: int) -> list[list[tuple[int, int]]]:
    """Blocks of positions from coarse to fine: the whole, halves, quarters, as long as blocks have more than one."""
    out, blocks = [], [(0, width)]
    while blocks and max(b - a for a, b in blocks) > 1:
        out.append(blocks)
        blocks = [(x, y) for a, b in blocks for x, y in ((a, (a + b) // 2), ((a + b) // 2, b)) if y > x]
    return out


def _means(x: np.ndarray, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Means of the blocks times the roots of their widths, and the norm of what is left."""
    means = np.stack([x[:, a:b].mean(axis=1) for a, b in blocks], axis=1)
    wide = np.array([b - a for a, b in blocks])
    left = x - np.repeat(means, wide, axis=1)
    return means * np.sqrt(wide), np.sqrt((left * left).sum(axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` (the first of equally near ones) and the squared distance, for each row of ``x``."""
    exact = lambda i, k: ((x[i] - entries[k]) ** 2).sum(axis=1)
    steps = levels(x.shape[1])
    every = np.arange(len(x))
    if not steps:
        i, k = np.repeat(every, len(entries)), np.tile(np.arange(len(entries)), len(x))
    else:
        (mx, rx), (mc, rc) = _means(x, steps[0]), _means(entries, steps[0])
        bound = (mx - mc.T) ** 2 + (rx[:, None] - rc) ** 2
        guess = exact(every, bound.argmin(axis=1))
        # rounding of the bounds must not cost an entry
        most = guess + 1e-9 * (guess + (x * x).sum(axis=1) + (entries * entries).sum(axis=1).max()) + 1e-6
        i, k = np.nonzero(bound <= most[:, None])
        for blocks in steps[1:]:
            (mx, rx), (mc, rc) = _means(x, blocks), _means(entries, blocks)
            stay = ((mx[i] - mc[k]) ** 2).sum(axis=1) + (rx[i] - rc[k]) ** 2 <= most[i]
            i, k = i[stay], k[stay]
    d = exact(i, k)
    first = np.searchsorted(i, every)
    least = np.minimum.reduceat(d, first)
    hit = np.flatnonzero(d == least[i])
    hit = hit[np.searchsorted(i[hit], every)]
    return k[hit], least


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def update(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (part, entry, position) after a round: entries are the floors of their parts' means; unused ones stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            x = _integers(b.column(0), parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, books[p])
                np.add.at(sums[p], at, own)
                counts[p] += np.bincount(at, minlength=entries)
        slot = np.flatnonzero(np.repeat(counts.ravel() > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.repeat(counts.ravel(), width)[slot]), pa.array(sums.ravel()[slot])], names=["slot", "n", "s"])

    found = rows.select("q").mapInArrow(lean(run), "slot long, n long, s long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    new = books.ravel().copy()
    new[found["slot"].to_numpy()] = found["s"].to_numpy() // found["n"].to_numpy()
    return new.reshape(books.shape)


def code_vectors(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, ``code`` (two hex digits a part), ``error`` (squared distance), ``label_error`` (the label's sum) and ``codebooks_sha256``.

    ``entries`` is 256 at most. Codebooks start as the parts of the smallest ids' vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = embeddings.select("vec_id", "label", as_integers(F.col("embedding")).alias("q")).where(f"q is not null and size(q) > 0 and size(q) % {parts} = 0")
    rows = materialise(rows, "vector-integers")
    order = (F.asc_nulls_last("vec_id"), F.asc("q"))
    first = rows.orderBy(*order).select("q").first()
    dim = len(first["q"]) if first else parts
    rows = rows.where(F.size("q") == dim)
    seeds = np.array([r["q"] for r in rows.orderBy(*order).select("q").limit(entries).collect()], np.int64).reshape(-1, parts, dim // parts)
    books = np.ascontiguousarray(seeds.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = update(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dim // parts
        for b in batches:
            x = _integers(b.column(2), dim)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], far = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += far
            shown = [c.tobytes().hex() for c in code]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shown, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in embeddings.select("vec_id", "label").schema}
    coded = materialise(rows.mapInArrow(lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "vector-codes")
    # a null label is a label here, so it is a struct's field; a label that many rows have is broadcast with its sum
    coded = coded.select("vec_id", "code", "error", F.struct("label").alias("of"))
    sums = materialise(coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "vector-labels")
    out = heavy_join(coded, sums, "of", "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
