"""Toxicity scores from non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; every other document of the training
folds, labelled or not, is unlabelled text. A linear numpy model is fitted with the
class-prior-corrected, non-negative risk estimator, the prior being the share of
toxic documents among labelled ones of the training folds. A quarter of the labelled
rows of these folds only sets the cut, where F1 on them is best. Features are the distinct
words of a whole text and their beginnings, hashed to a fixed number of slots; labels,
language, source and id are never features.

Defined results: null and empty texts score by the model's intercept; without any
confirmed toxic document every score is 0; repeated rows score alike; very long texts
are read whole, in blocks; an empty table gives no rows; an id that labels name twice is
toxic if either says so; extra columns are ignored unless named in ``keep``, and a kept
column that has a result's name comes under ``kept_`` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.llm.common import col, give_back, kept_names, lean, materialise
from trovana.llm.hashing import Rolling, forget, pieces, runs, scramble

#: Slots for hashed features.
SLOTS = 1 << 20
#: A word's beginnings that are features, in bytes, beside the whole word.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Bytes of text hashed at once.
BLOCK = 500_000
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: a-z and characters beyond ASCII, less U+0080 to U+00BF, general and ideographic punctuation."""
    out = _LETTER[data]
    two = np.flatnonzero(data == 0xC2)
    out[two] = False
    out[np.minimum(two + 1, len(data) - 1)] = False
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80)) if len(data) > 2 else two[:0]
    for k in range(3):
        out[three + k] = False
    return out


def hashed(parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(part, slot) of the words in lower case and of their beginnings, one kind of feature after the other."""
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    begin, end = runs(letters(data))
    roll = Rolling(data)
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), begin, side="right").astype(np.int32)
    mask = np.uint64(SLOTS - 1)
    yield part, (scramble(roll.of(begin, end) + np.uint64(1)) & mask).astype(np.int32)
    for n in BEGINNINGS:
        some = end - begin >= n
        yield part[some], (roll.of(begin[some], begin[some] + n) & mask).astype(np.int32)


def lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def features(text: str | None) -> np.ndarray:
    """The distinct slots of a whole text."""
    found = [slot for _, parts in pieces(lower([text]), BLOCK) for _, slot in hashed(parts)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class LinearModel:
    """score = logistic(scale * (sum of weights + bias - cut) + logit(level))."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float = 0.0
    scale: float = 1.0
    level: float = 0.5

    def dense(self) -> np.ndarray:
        out = np.zeros(SLOTS, np.float32)
        out[self.slots] = self.weights
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        z = self.scale * (margin - self.cut) + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose_slots(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, least: int = 3, most: int = 400) -> np.ndarray:
    """The ``most`` slots whose shares among positive and unlabelled documents lie furthest apart in standard errors, if in ``least`` documents."""
    counts = in_p + in_u
    share = (counts + 0.5) / (n_p + n_u + 1)
    apart = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    apart[counts < least] = 0
    slots = np.sort(np.argsort(-apart, kind="stable")[:most])
    return slots[apart[slots] > 0].astype(np.int32)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, slots: np.ndarray, epochs: int = 200, rate: float = 0.5, l2: float = 5e-4) -> LinearModel:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    Documents are given by the places in ``slots`` of the slots that they have. Where the corrected negative risk falls below
    zero the step goes against it, as the non-negative estimator asks.
    """
    docs = [*positive, *unlabelled]
    n_p, n = len(positive), len(docs)
    cols, rows = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(n, dtype=np.int32), [len(p) for p in docs])
    # a slot's step is scaled by how often it occurs, so that slots of a few documents stay near zero
    w, b = np.zeros(len(slots)), float(np.log(prior / (1 - prior)))
    vel, vb = np.zeros_like(w), 0.0
    is_p = np.arange(n) < n_p
    for _ in range(epochs):
        g = np.clip(np.bincount(rows, w[cols], n) + b, -30, 30)
        p = 1 / (1 + np.exp(-g))
        minus = np.logaddexp(0, g)
        corrected = minus[~is_p].mean() - prior * minus[is_p].mean()
        d = np.zeros(n)
        if corrected >= 0:
            d[is_p] = prior * (p[is_p] - 1) / n_p - prior * p[is_p] / n_p
            d[~is_p] = p[~is_p] / (n - n_p)
        else:
            d[is_p] = prior * p[is_p] / n_p
            d[~is_p] = -p[~is_p] / (n - n_p)
        gw, gb = np.bincount(cols, d[rows], len(slots)) + l2 * w, d.sum()
        vel, vb = 0.9 * vel - rate * gw, 0.9 * vb - rate * gb
        w, b = w + vel, b + vb
    return LinearModel(slots, w.astype(np.float32), float(b))


def margins(model: LinearModel, docs: list[np.ndarray]) -> np.ndarray:
    """Of documents given by places in the model's slots."""
    return np.array([model.weights[d].sum(dtype=float) for d in docs]) + model.bias


def text_margins(model: LinearModel, dense: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Of whole texts: each slot counts once for a text, however often and in whatever part it stands."""
    pairs = [np.zeros(0, np.int64)]
    for owner, parts in pieces(lower(texts), BLOCK):
        own = np.array(owner, np.int64)
        for part, slot in hashed(parts):
            some = dense[slot] != 0
            pairs.append(np.unique(own[part[some]] * SLOTS + slot[some]))
    pair = np.unique(np.concatenate(pairs))
    return np.bincount(pair // SLOTS, dense[pair % SLOTS], len(texts)) + model.bias


def calibrate(model: LinearModel, margin: np.ndarray, toxic: np.ndarray, level: float) -> LinearModel:
    """Put the score ``level`` at the margin with the best F1 on labelled rows that the fit hasn't seen."""
    model.level = level
    order = np.argsort(-margin, kind="stable")
    m, t = margin[order], toxic[order].astype(float)
    if not len(m) or not t.any() or t.all():
        return model
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(m) + 1) + t.sum())
    f1[:-1][m[:-1] == m[1:]] = 0
    k = int(np.argmax(f1))
    below = m[k + 1] if k + 1 < len(m) else m[k] - 1
    model.cut = float((m[k] + below) / 2)
    model.scale = float(2 / max(np.std(m[t == 0]), 1e-6))
    return model


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, level: float = 0.7, max_positive: int = 4000, max_unlabelled: int = 8000, max_calibration: int = 6000) -> LinearModel | None:
    """Fit on bounded samples: the rows with the smallest hashes of their ids, in the training folds.

    The bounds are on rows that a linear model is fitted from, not on what is counted or scored:
    ``max_positive`` confirmed toxic rows, ``max_unlabelled`` other rows and ``max_calibration``
    labelled rows that only set the cut. None if there are no confirmed toxic rows. Of these rows, the driver gets
    a count for each slot and then the few slots chosen of each row: bounded in bytes too, however long the texts are.
    """
    ours = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id") != 1)
    shares = ours.agg(F.avg("toxic").alias("prior"), F.sum("toxic").alias("n")).first()
    if not shares["n"]:
        return None
    ids = docs.where("doc_id is not null").where(fold("doc_id") != 1).select("doc_id")
    h = F.xxhash64("doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))  # a quarter only sets the cut
    known = ids.join(ours, "doc_id")
    take = lambda rows, n, kind: rows.distinct().orderBy(h, "doc_id").limit(n).withColumn("kind", F.lit(kind))
    chosen = (
        take(known.where("toxic = 1").where(part != 0).select("doc_id"), max_positive, "p")
        .unionByName(take(ids.join(ours.where("toxic = 1"), "doc_id", "left_anti").where(part != 0).select("doc_id"), max_unlabelled, "u"))
        .unionByName(take(known.where(part == 0).select("doc_id"), max_calibration, "c"))
        .join(ours, "doc_id", "left")
    )
    # at most max_positive + max_unlabelled + max_calibration ids; of several texts with one id the smallest counts
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"), F.coalesce(F.max("toxic"), F.lit(0)).cast("int").alias("toxic"))
    sample = materialise(sample.select("kind", "toxic", "text"), "toxicity-sample")
    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    if not sizes.get("p") or not sizes.get("u"):
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, SLOTS), np.int32)
        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[int(kind == "u"), features(text)] += 1
        some = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[0, some]), pa.array(found[1, some])], names=["slot", "p", "u"])

    counts = sample.where("kind <> 'c'").select("kind", "text").mapInArrow(lean(count, forget), "slot long, p int, u int")
    counts = counts.groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u > 2").toArrow()  # SLOTS rows at most
    in_p, in_u = np.zeros(SLOTS), np.zeros(SLOTS)
    in_p[counts["slot"].to_numpy()], in_u[counts["slot"].to_numpy()] = counts["p"].to_numpy(), counts["u"].to_numpy()
    slots = choose_slots(in_p, in_u, sizes["p"], sizes["u"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [np.flatnonzero(np.isin(slots, features(t), assume_unique=True)).astype(np.int16).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.binary())], names=["kind", "toxic", "places"])

    rows = sample.mapInArrow(lean(pick, forget), "kind string, toxic int, places binary").toArrow()
    kinds, toxic = np.array(rows["kind"].to_pylist()), np.array(rows["toxic"].to_pylist())
    found = [np.frombuffer(x, np.int16) for x in rows["places"].to_pylist()]
    of = lambda k: [found[i] for i in np.flatnonzero(kinds == k)]
    prior = min(max(float(shares["prior"]), 1e-3), 0.999)
    model = fit_nnpu(of("p"), of("u"), prior, slots)
    model = calibrate(model, margins(model, of("c")), toxic[kinds == "c"], level)
    give_back()
    return model


RESULTS = ("held_out", "score", "predicted")


def toxicity_scores(docs: DataFrame, labels: DataFrame, level: float = 0.7, keep: tuple[str, ...] = ("doc_id",), **bounds: int) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score >= level) for every document."""
    model = train(docs, labels, level, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as many weights as slots were chosen
    names = kept_names(keep, RESULTS)
    at = keep.index("text") if "text" in keep else len(keep)
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    # kept columns travel under numbers, so that none can clash
    ours = docs.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("t")]), held.alias("h"))
    own = [*(f"k{i}" for i in range(len(keep))), "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense() if m else None
        for b in batches:
            scores = m.score(text_margins(m, dense, b.column(at).to_pylist())) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in own), pa.array(scores, pa.float64())], names=[*own, "score"])

    schema = T.StructType([*(ours.schema[k] for k in own), T.StructField("score", T.DoubleType())])
    scored = ours.mapInArrow(lean(run, forget), schema)
    return scored.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.col("h").alias("held_out"), "score", (F.col("score") >= level).cast("int").alias("predicted"))
