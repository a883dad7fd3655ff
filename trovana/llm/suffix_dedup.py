"""Removal of byte strings that also start in an earlier document.

A byte goes if a string of ``length`` bytes covers it that starts in a document with a
smaller id too. Every such string holds an anchor: the smallest hash among the ``w``
substrings of ``gram`` bytes within it, gram + w - 1 = length, which is the same wherever
the string stands. Anchors meet by hash, with a digest of all bytes that a string around
them can have (the context):

* equal contexts are one entry of the suffix array: all but those of the smallest document
  lose the whole context, which needs no order. Contexts are equal if 96 bits of two hashes
  and the lengths are;
* where contexts differ, one of each kind goes on, with its bytes. An enhanced suffix
  array (suffixes in order, lengths of common prefixes) is built of them, and a stack
  scan of its common-prefix intervals yields the maximal repeats: intervals whose
  suffixes are preceded by different bytes, with all occurrences rather than neighbours.
  Occurrences outside an interval's smallest document lose the repeat.

Equal contexts are reduced inside each task before anything is sent, so a passage that a
third of all documents share is a row per task. Anchors are dealt to buckets whose number
follows the size of the texts, a task to each, so that a task's share doesn't grow with them.
Contexts come to the suffix arrays in order of their anchor's hash, and a task holds some
``CHUNK`` suffixes at a time. An anchor with more than ``CROWD`` contexts is dealt by
suffix instead: those that begin with the same ``length`` bytes meet, smallest document
first, and if they are too many for one array, that first one goes into each. Texts move once.

Defined results: a null text is empty; null ids come after all others, and their rows
don't match each other; rows of one id are not earlier than each other, whatever their
texts, and rows with one id and text fare alike; texts of any length are whole, cut
for the work only, with overlaps; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import lean, materialise, shuffle_width

#: Bytes hashed at once; anchors held by a task before they are reduced and handed on.
PIECE, HELD = 1 << 20, 400_000
#: Bytes of text that a bucket's anchors stand for, and of texts that a partition joins with their spans.
BUCKET, SHARE = 16 << 20, 64 << 20
#: Suffixes of one array, more or less; contexts of an anchor that come together.
CHUNK, CROWD = 300_000, 20_000
#: Rows of a batch that is handed on.
ROWS = 1 << 16
NULL_ID = 2**63 - 1
_RNG = np.random.default_rng(7)
_TABLE = _RNG.integers(0, 2**63, 257, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1024).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = _powers(size, _R), _powers(size, _RINV)
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1]) if have < w else out


class Anchors:
    """Anchors of one piece: gram hash, context digest, place in the piece, bytes of context to either side."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int, gram: int):
        """``data``: the bytes of several texts one after the other; ``starts``: where each begins, and the end."""
        n, w, side = len(data), length - gram + 1, length - gram
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[:n], out=sums[1:])
        h = _mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]) if n >= gram else np.zeros(0, np.uint64)
        if n < length:
            self.at = np.zeros(0, np.int64)
        else:
            # ties of one hash are the same bytes: any of them will do; every w-th place is preferred, so that runs stay thin
            place = np.arange(len(h), dtype=np.uint64)
            tie = ((place % np.uint64(w) != 0).astype(np.uint64) << np.uint64(6)) | (place & np.uint64(63))
            key = (h & ~np.uint64(127)) | tie
            low = sliding_min(key, w)
            begin = np.arange(len(low))
            text = np.searchsorted(starts, begin, side="right") - 1
            inside = begin + length <= starts[text + 1]
            low, begin = low[inside], begin[inside]
            # the place of each least key: its low bits say which of the w places it is
            base = begin.astype(np.uint64)
            offset = ((low & np.uint64(63)) - base) & np.uint64(63)
            self.at = np.unique((base + offset).astype(np.int64))
        t = np.searchsorted(starts, self.at, side="right") - 1
        self.text = t
        self.left = np.minimum(side, self.at - starts[t])
        self.right = np.minimum(side, starts[t + 1] - self.at - gram)
        a, b = self.at - self.left, self.at + gram + self.right
        context = _mix((sums[b] - sums[a]) * inverse[a])
        self.context = _mix(context + (self.left * 64 + self.right).astype(np.uint64))
        self.hash = h[self.at] if len(self.at) else np.zeros(0, np.uint64)


def anchored(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, context, number of the text, place, left, right) of the anchors of whole texts, in blocks."""
    lap = 2 * length

    def work(parts: list[tuple[int, bytes, int, int, int]]) -> tuple[np.ndarray, ...]:
        """parts: (number of the text, bytes, offset in the text, first and last place to report)."""
        sizes = np.array([len(p[1]) for p in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        a = Anchors(np.frombuffer(b"".join(p[1] for p in parts), np.uint8), starts, length, gram)
        off, lo, hi = (np.array([p[i] for p in parts], np.int64) for i in (2, 3, 4))
        place = a.at - starts[a.text] + off[a.text]
        ok = (place >= lo[a.text]) & (place < hi[a.text])
        doc = np.array([p[0] for p in parts], np.int64)[a.text]
        return a.hash[ok], a.context[ok], doc[ok], place[ok], a.left[ok], a.right[ok]

    held: list[tuple[int, bytes, int, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for s in range(0, len(t), PIECE):
            lo, hi = s, min(len(t), s + PIECE)
            a, b = max(0, lo - lap), min(len(t), hi + lap)
            held.append((i, t[a:b], a, lo, hi))
            size += b - a
            if size >= PIECE:
                yield work(held)
                held, size = [], 0
    if held:
        yield work(held)


def _settle(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by hash, context and id, and which rows of it have a smaller id with the same hash and context."""
    o = np.lexsort((doc, c, h))
    h, c, doc = h[o], c[o], doc[o]
    new = np.ones(len(o), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(o) else doc
    return o, doc > least


_SPAN = "who long, s long, e long"


def find_anchors(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """(bucket, spans, anchors): packed spans that go for sure, in any bucket, and a bucket's anchors."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, c, doc, who, place, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        o, later = _settle(h, c, doc)
        gone = o[later]
        gone = gone[left[gone] + right[gone] >= length - gram]
        rest = o[~later]
        b = (h[rest] >> np.uint64(32)).astype(np.int64) % buckets
        rest = rest[np.argsort(b, kind="stable")]
        b = np.sort(b)
        cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        blobs = []
        for x in np.split(rest, cuts[1:]) if len(b) else []:
            x = x[np.lexsort((place[x], who[x], doc[x]))]
            blobs.append(_pack(h[x], c[x], doc[x], who[x], place[x], left[x], right[x]))
        spans = [None] * len(blobs)
        at = b[cuts].tolist()
        if len(gone):
            gone = gone[np.argsort(who[gone], kind="stable")]
            at.append(int(who[gone[0]] % buckets))
            blobs.append(None)
            spans.append(_pack_spans(who[gone], place[gone] - left[gone], place[gone] + gram + right[gone]))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(spans, pa.binary()), pa.array(blobs, pa.binary())], names=["bucket", "spans", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count = [], 0
        for x in batches:
            ids, keys = (x.column(i).to_numpy() for i in (0, 1))
            for h, c, row, *rest in anchored(x.column(2).to_pylist(), length, gram):
                parts.append((h, c, ids[row], keys[row], *rest))
                count += len(h)
                if count >= HELD:
                    yield from flush(parts)
                    parts, count = [], 0
        if parts:
            yield from flush(parts)

    return docs.select("id", "who", "b").mapInArrow(lean(run, _POWERS.clear), "bucket int, spans binary, anchors binary")


def _pack(h, c, doc, who, place, left, right) -> bytes:
    """Columns one after the other, documents once each; hashes keep 48 of their bits."""
    import zstandard

    six = lambda x: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (who[1:] != who[:-1])])
    runs = np.diff(np.r_[at, len(doc)])
    first = np.concatenate([doc[at][:1], np.diff(doc[at])]).astype("<i8").tobytes() + runs.astype("<i4").tobytes() + place.astype("<i8").tobytes() + left.astype(np.uint8).tobytes() + right.astype(np.uint8).tobytes()
    return len(h).to_bytes(4, "little") + len(at).to_bytes(4, "little") + six(h) + six(c) + who[at].astype("<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(first)


def _pack_spans(who, s, e) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([who, s, e]).astype("<i8").tobytes())


def _unpack_spans(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(3, -1)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    n, docs = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")

    def six(at: int) -> np.ndarray:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
        return wide.view("<u8").ravel()

    rest = zstandard.ZstdDecompressor().decompress(blob[8 + 12 * n + 8 * docs :])
    runs = np.frombuffer(rest, "<i4", docs, 8 * docs)
    doc, who = np.repeat(np.cumsum(np.frombuffer(rest, "<i8", docs)), runs), np.repeat(np.frombuffer(blob, "<i8", docs, 8 + 12 * n), runs)
    place = np.frombuffer(rest, "<i8", n, 12 * docs)
    left, right = np.frombuffer(rest, np.uint8, n, 12 * docs + 8 * n), np.frombuffer(rest, np.uint8, n, 12 * docs + 9 * n)
    return six(8), six(8 + 6 * n), doc, who, place, left.astype(np.int64), right.astype(np.int64)


def meet(found: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """kind 0: spans that go; kind 2: contexts to compare (``h`` is their anchor's hash; ``s`` and ``e`` are their place)."""
    names = ["kind", "h", "who", "s", "e"]

    def rows(kind: int, h: np.ndarray | None, who: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(who), ROWS):
            at = slice(k, k + ROWS)
            n = len(who[at])
            key = np.zeros(n, np.int64) if h is None else h[at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(who[at]), pa.array(s[at]), pa.array(e[at])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for x in batches:
            for known, blob in zip(*(x.column(i).to_pylist() for i in (1, 2)), strict=True):
                if known is not None:
                    yield from rows(0, None, *_unpack_spans(known))
                if blob is not None:
                    blobs.append(blob)
        if not blobs:
            return
        h, c, doc, who, place, left, right = (np.concatenate(p) for p in zip(*map(_unpack, blobs), strict=True))
        blobs.clear()
        o, later = _settle(h, c, doc)
        gone = o[later]
        gone = gone[left[gone] + right[gone] >= length - gram]
        rest = o[~later]
        # hashes that more than one document has, with different contexts
        hs, ds = h[rest], doc[rest]
        new = np.r_[True, hs[1:] != hs[:-1]]
        at = np.flatnonzero(new)
        mixed = np.minimum.reduceat(ds, at) != np.maximum.reduceat(ds, at)
        rest = rest[mixed[np.cumsum(new) - 1]]
        for kind, r in ((0, gone), (2, rest)):
            yield from rows(kind, h[r], who[r], place[r] - left[r], place[r] + gram + right[r])

    return found.repartitionById(buckets, "bucket").mapInArrow(lean(run), "kind int, h long, who long, s long, e long")


def suffix_array(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at``, each up to its own end, in order, and the common prefix of each with the one before."""
    depth = int((ends - at).max(initial=0))
    # an end sorts before every byte; texts are compared 7 bytes of 9 bits at a time
    wide = np.zeros(len(data) + depth + 8, np.int64)
    wide[: len(data)] = data.astype(np.int64) + 1
    keys = []
    for k in range(0, depth, 7):
        key = np.zeros(len(at), np.int64)
        for j in range(k, k + 7):
            key = (key << 9) | np.where(at + j < ends, wide[np.minimum(at + j, len(wide) - 1)], 0)
        keys.append(key)
    order = np.lexsort(keys[::-1]) if keys else np.arange(len(at))
    a, e = at[order], ends[order]
    lcp = np.zeros(len(a), np.int64)
    if len(a) > 1:
        live = np.ones(len(a) - 1, bool)
        for j in range(depth):
            x, y = a[1:] + j, a[:-1] + j
            live &= (x < e[1:]) & (y < e[:-1])
            if not live.any():
                break
            live &= wide[np.minimum(x, len(wide) - 1)] == wide[np.minimum(y, len(wide) - 1)]
            lcp[1:] += live
    return order, lcp


def repeats(lcp: np.ndarray, before: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, length, smallest document) of the maximal repeats of ``least`` bytes or more.

    A stack scan of the common-prefix interval tree; an interval counts if its suffixes are preceded by
    different bytes (``before`` is -1, and differs from all, where a text begins) and it has several documents.
    """
    n = len(lcp)
    stack: list[list] = []  # length, first, byte before (or None if several), smallest and largest document
    some = lcp.tolist()
    left, docs = before.tolist(), doc.tolist()

    def join(x, y):
        return x if x == y and x != -1 else None

    for i in range(1, n + 1):
        cur = some[i] if i < n else 0
        first = i - 1
        one = [cur, first, left[first], docs[first], docs[first]]
        while stack and stack[-1][0] > cur:
            top = stack.pop()
            # the suffix before i belongs to every interval that ends here
            top[2], top[3], top[4] = join(top[2], one[2]), min(top[3], one[3]), max(top[4], one[4])
            if top[0] >= least and top[2] is None and top[3] != top[4]:
                yield top[1], i - 1, top[0], top[3]
            one = [cur, top[1], top[2], top[3], top[4]]
        if cur > 0:
            if stack and stack[-1][0] == cur:
                t = stack[-1]
                t[2], t[3], t[4] = join(t[2], one[2]), min(t[3], one[3]), max(t[4], one[4])
            else:
                stack.append(one)


def compare(contexts: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """Spans that go, from contexts (``key``, ``doc``, ``who``, ``s``, ``b``, ``one``) of which a partition has all of
    a ``key``, in order of it and of documents. With ``one`` only the suffix that begins with the context counts,
    and all of a key begin with the same bytes."""

    def count(x: pa.RecordBatch) -> np.ndarray:
        sizes = pc.binary_length(x.column(4)).to_numpy().astype(np.int64)
        return np.where(x.column(5).to_numpy(zero_copy_only=False), 1, np.maximum(sizes - length + 1, 0))

    def spans(x: pa.RecordBatch) -> Iterator[tuple]:
        doc, who, s = (x.column(k).to_numpy() for k in (1, 2, 3))
        texts = x.column(4).to_pylist()
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = count(x)
        owner = np.repeat(np.arange(len(n)), n)
        at = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        if not len(at):
            return
        # only suffixes whose first bytes occur twice can be in an interval
        power, inverse = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
        h = (sums[at + length] - sums[at]) * inverse[at]
        o = np.argsort(h, kind="stable")
        same = h[o][1:] == h[o][:-1]
        twice = np.zeros(len(at), bool)
        twice[o[1:][same]] = True
        twice[o[:-1][same]] = True
        at, owner = at[twice], owner[twice]
        if not len(at):
            return
        order, lcp = suffix_array(data, at, starts[owner + 1])
        at, owner = at[order], owner[order]
        d = doc[owner]
        before = np.where(at > starts[owner], data[np.maximum(at - 1, 0)].astype(np.int64), -1)
        # a context begins in the middle of a text: what stands before it isn't known, so it counts as different
        for a, z, size, least in repeats(lcp, before, d, length):
            members = np.arange(a, z + 1)
            yield members[d[members] > least], size, s, who, owner, at, starts

    def gone(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        where, ends, last = [], [], None
        for members, size, *last in spans(x):
            where.append(members)
            ends.append(np.full(len(members), size))
        if where:
            s, who, owner, at, starts = last
            m, size = np.concatenate(where), np.concatenate(ends)
            begin = s[owner[m]] + at[m] - starts[owner[m]]
            # nested intervals name a place several times: the longest one covers the others
            o = np.lexsort((-size, begin, who[owner[m]]))
            w, begin, size = who[owner[m]][o], begin[o], size[o]
            new = np.r_[True, (w[1:] != w[:-1]) | (begin[1:] != begin[:-1])] if len(w) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(w[new]), pa.array(begin[new]), pa.array((begin + size)[new])], names=["who", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in batches:
            held.append(x)
            n += int(count(x).sum())
            if n < chunk:
                continue
            every = pa.concat_batches(held)
            key = every.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from gone(every.slice(0, cut))
            rest = every.slice(cut)
            if rest.num_rows >= chunk and rest.column(5)[0].as_py():
                yield from gone(rest)
                rest = rest.slice(0, 1)
            held, n = [rest], int(count(rest).sum())
        if held:
            yield from gone(pa.concat_batches(held))

    return contexts.select("key", "doc", "who", "s", "b", "one").mapInArrow(lean(run, _POWERS.clear), _SPAN)


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20, digests: bool = False, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes that stay; with ``digests`` ``kept_sha256``)."""
    spark = docs.sparkSession
    # a row is told by its id and text
    ours = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("who"), F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = max(shuffle_width(spark), -(-size // SHARE))
    buckets = max(4 * shuffle_width(spark), -(-size // BUCKET))
    met = materialise(meet(find_anchors(ours, length, gram, buckets), length, gram, buckets), "suffix-met")
    # both joins read all of these columns (the first one makes ``doc`` of ``doc_id``), so they share one exchange
    ours = ours.select("doc_id", "who", "b").repartition(width, "who")
    # bytes of the contexts to compare; one row per document and context
    crowds = met.where("kind = 2").groupBy("h").count().where(F.col("count") > crowd).select("h", F.lit(True).alias("one"))
    wanted = met.where("kind = 2").join(F.broadcast(crowds), "h", "left").groupBy(F.col("who").alias("_w")).agg(F.collect_set(F.struct("h", "s", "e", F.coalesce("one", F.lit(False)).alias("one"))).alias("c"))
    cut = ours.join(wanted, F.col("who") == F.col("_w")).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "who", "b", F.explode("c").alias("c"))
    cut = cut.select("c.h", "doc", "who", "c.s", "c.one", F.expr("substring(b, cast(c.s + 1 as int), cast(c.e - c.s as int))").alias("b"))
    # a crowded anchor's contexts as suffixes
    k = F.explode(F.when(F.col("one"), F.when(F.octet_length("b") >= length, F.sequence(F.lit(0), F.octet_length("b") - length)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(F.lit(0)))).alias("k")
    cut = cut.select("*", k).select("h", "doc", "who", (F.col("s") + F.col("k")).alias("s"), "one", F.expr("substring(b, k + 1)").alias("b"))
    key = F.when(F.col("one"), F.xxhash64("h", F.substring("b", 1, length))).otherwise(F.col("h"))
    spans = compare(cut.withColumn("key", key).repartition(buckets, "key").sortWithinPartitions("key", "doc"), length, chunk)
    spans = spans.unionByName(met.where("kind = 0").select("who", "s", "e"))
    by_doc = spans.groupBy(F.col("who").alias("_w")).agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("es"))
    joined = ours.join(by_doc, F.col("who") == F.col("_w"), "left").select("doc_id", "b", "ss", "es")
    last = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            total, removed, n, kept = [], [], [], []
            for b, ss, es in zip(*(x.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                parts, at, gone, k = [], 0, 0, 0
                end = -1
                for s, e in sorted(zip(ss or [], es or [], strict=True)):
                    s, e = min(s, len(b)), min(e, len(b))
                    if e <= s:
                        continue
                    if s > end:
                        k += 1
                        parts.append(b[at:s])
                        gone += e - s
                        at = end = e
                    elif e > end:
                        gone += e - end
                        at = end = e
                parts.append(b[at:])
                out = b"".join(parts)
                total.append(len(b))
                removed.append(gone)
                n.append(k)
                kept.append(hashlib.sha256(out).hexdigest() if digests else out)
            yield pa.RecordBatch.from_arrays(
                [x.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string() if digests else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", last]
            )

    return joined.mapInArrow(lean(run), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}")
