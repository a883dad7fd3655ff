"""Near-duplicate texts: an exact Jaccard join on word shingles by several token orders.

A text is a set of 64-bit shingle hashes. All texts with one set are one node. Under any
total order of tokens, two sets that reach the threshold share a token in their prefixes;
the orders here put frequent tokens last, by counts of all texts in a fixed number of
hash buckets, and differ otherwise. Prefixes under the first order are joined, with
bounds on size and position; a candidate must then share prefix tokens under every other
order too before its sets are intersected.

Groups of near copies are never expanded into all pairs. In a few rounds each list of a
token is compared with pivots only, what links is contracted, and a pivot leaves its list,
as nothing of it is open there; a last round compares, list by list, the rows outside the
largest component with those of other components.
Pairs inside a component need no comparison, all others get one.

Defined results: null and empty texts, and those without words, have empty sets, link
with nothing and are their own component; fewer than ``width`` words are one shingle;
repeated rows are one node's members; rows that share an id are told apart by their texts; a
row with a null id belongs to the texts with its set, links them like any other and never
names a component; an empty table gives no rows; texts of any length are whole; extra
columns are ignored. Set sizes are those of 64-bit hashes, overlaps those of their upper
48 bits: of 3 * 10^6 pairs of sets of 10^4 shingles, one has an overlap that is too large by one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovana.llm.common import bit_filter, bucketed, components, discard, gathered, give_back, heavy_join, in_filter, lean, materialise, shuffle_width
from trovana.llm.hashing import Rolling, forget, runs, scramble

#: Buckets of the frequency table, sent in slabs; four megabytes reach the executors, whatever the corpus.
BITS, SLABS = 22, 256
ORDERS = 3
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text made into sets at once.
BLOCK = 500_000


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of some texts, one after the other, and how many words each has.

    Words are bytes in lower case (A-Z only) between ASCII white space; no word is made as an object.
    """
    joined = b" ".join([t or b"" for t in texts]).lower()
    data = np.frombuffer(joined, np.uint8)
    begin, end = runs(~_SPACE[data])
    h = Rolling(data).of(begin, end)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    upto = np.searchsorted(begin, ends)
    return h, np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingle hashes of some texts, one after the other, and where each begins."""
    h, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    full = counts >= width
    total = np.zeros(int(n.sum()), np.uint64)
    at = np.cumsum(n) - n
    if full.any():
        begin = np.repeat(starts[full], n[full]) + np.arange(int(n[full].sum())) - np.repeat(np.cumsum(n[full]) - n[full], n[full])
        x = np.full(len(begin), np.uint64(width))
        for k in range(width):
            x = scramble(x + h[begin + k] * _MIX[k % 5])
        total[np.repeat(full, n)] = x
    for i in np.flatnonzero((counts > 0) & ~full):
        x = np.full(1, np.uint64(counts[i]))
        for k in range(counts[i]):
            x = scramble(x + h[starts[i] + k : starts[i] + k + 1] * _MIX[k % 5])
        total[at[i]] = x[0]
    for a, z in zip(at.tolist(), (at + n).tolist(), strict=True):
        total[a:z].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[at[n > 0]] = True
    sums = np.concatenate([[0], np.cumsum(new)])
    return total[new], np.concatenate([sums[at], sums[-1:]])


def blocks(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """A binary column as lists of about ``BLOCK`` bytes, with the place of the first of each; no more is held."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        n = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + BLOCK, side="right")))
        yield k, column.slice(k, n - k).to_pylist()
        k = n


def node_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - BITS)).astype(np.int64)


def order_keys(tokens: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Keys of a global order: rare classes first, then by a hash of the order's own.

    The first order takes the classes as they are; the others only tell apart what is several times as
    frequent as the mean, so that they differ where it matters.
    """
    rank = scramble(tokens + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64))
    rare = classes[_bucket(tokens)]
    if order > 1:
        rare = np.maximum(rare, 140) >> 2
    return (rare.astype(np.uint64) << np.uint64(56)) | (rank >> np.uint64(8))


def in_order(tokens: np.ndarray, classes: np.ndarray, order: int, length: int) -> np.ndarray:
    """The first ``length`` tokens of a set under an order."""
    return tokens[np.argsort(order_keys(tokens, classes, order), kind="stable")[:length]]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def overlap(nx, ny, num: int, den: int):
    """The least intersection with which two sets of these sizes link."""
    return -(-num * (nx + ny) // (num + den))


#: Buckets of a slab.
SLAB = (1 << BITS) // SLABS


def counts_packed(counts: np.ndarray) -> bytes:
    """The counts of a slab, or only those that aren't 0 and where they are, if that is shorter.

    So what tasks send grows with the texts, not with the number of tasks.
    """
    some = np.flatnonzero(counts)
    return counts.tobytes() if 6 * len(some) >= 4 * SLAB else counts[some].tobytes() + some.astype(np.uint16).tobytes()


def counts_added(blobs: Iterable[bytes]) -> np.ndarray:
    """The sum of slabs of int32, whole or packed, or of sums (int64) of such."""
    out = np.zeros(SLAB, np.int64)
    for b in blobs:
        if len(b) in (4 * SLAB, 8 * SLAB):
            out += np.frombuffer(b, np.int32 if len(b) == 4 * SLAB else np.int64)
        else:
            n = len(b) // 6
            out[np.frombuffer(b, np.uint16, n, 4 * n)] += np.frombuffer(b, np.int32, n)
    return out


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (``doc_id``, ``th``: the text's hash, ``n``, ``node``) and of bucket counts (``slab``, ``part``, ``counts``)."""
    names = ["doc_id", "th", "n", "node", "slab", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int32)
        for b in batches:
            n, node = [], []
            for _, texts in blocks(b.column(2)):
                tokens, at = shingle_sets(texts, width)
                np.add.at(counts, _bucket(tokens), 1)
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n.append(y - x)
                    node.append(node_id(tokens[x:y]) if y > x else None)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        slabs = [(k, p) for k, p in enumerate(counts.reshape(SLABS, -1)) if p.any()]
        if slabs:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(slabs), pa.int64())] * 4, pa.array([k for k, _ in slabs], pa.int32()), pa.array([counts_packed(p) for _, p in slabs], pa.binary())], names=names)

    out = docs.select("doc_id", F.xxhash64("text"), F.col("text").cast("binary")).mapInArrow(lean(run, forget), "doc_id long, th long, n long, node long, slab int, counts binary")
    return out.withColumn("part", F.spark_partition_id())


def frequency_classes(rows: DataFrame) -> np.ndarray:
    """A class for each bucket, eight to each doubling of its count, 128 being the mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [counts_added(x.as_py() for x in blobs).tobytes() for blobs in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.binary())], names=["slab", "counts"])

    table = rows.where("slab is not null").select("slab", F.floor(F.col("part") / 256).alias("lot"), "counts")
    # in two steps, so that no task holds the counts of all partitions
    tasks = max(SLABS // 4, rows.sparkSession.sparkContext.defaultParallelism)  # there are but so many slabs
    step = table.groupBy("slab", "lot").agg(F.collect_list("counts").alias("c")).coalesce(tasks).select("slab", "c").mapInArrow(lean(add), "slab int, counts binary")
    final = step.groupBy("slab").agg(F.collect_list("counts").alias("c")).coalesce(tasks).select("slab", "c").mapInArrow(lean(add), "slab int, counts binary").collect()
    # slab by slab, as whole tables of numbers would be the driver's peak
    counts = {r["slab"]: np.frombuffer(r["counts"], np.int64) for r in final}
    del final
    mean = max(sum(int(c.sum()) for c in counts.values()) / (1 << BITS), 0.5)
    out = np.empty((SLABS, SLAB), np.uint8)
    for k in range(SLABS):
        c = np.maximum(counts.pop(k, np.zeros(out.shape[1])), 0.5)
        out[k] = np.clip(np.round(8 * np.log2(c / mean)) + 128, 0, 255)
    give_back()
    return out.ravel()


#: Nodes that a task remembers, so as to send each once; what it sends again is dropped later.
KNOWN = 200_000


def postings(docs: DataFrame, classes, width: int, num: int, den: int) -> DataFrame:
    """(token, node, n, pos): the prefix of each distinct set of a partition under the first order."""
    names = ["token", "node", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            for _, texts in blocks(b.column(0)):
                tokens, at = shingle_sets(texts, width)
                keys = order_keys(tokens, classes.value, 1)
                some, nodes, sizes, lengths = [], [], [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    node = node_id(tokens[x:y]) if y > x else None
                    if node is None or node in known:
                        continue
                    if len(known) >= KNOWN:
                        known.clear()
                    known.add(node)
                    p = prefix_length(y - x, num, den)
                    some.append(tokens[x:y][np.argsort(keys[x:y], kind="stable")[:p]])
                    nodes.append(node)
                    sizes.append(y - x)
                    lengths.append(p)
                if some:
                    wide = lambda v, kind: pa.array(np.repeat(np.array(v, kind), lengths))
                    place = np.concatenate([np.arange(p, dtype=np.int32) for p in lengths])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some).view(np.int64)), wide(nodes, np.int64), wide(sizes, np.int32), pa.array(place)], names=names)

    return docs.where("text is not null").select(F.col("text").cast("binary")).mapInArrow(lean(run, forget), "token long, node long, n int, pos int")


def shared_lists(posts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The postings of tokens that several nodes have, as far as the bounds leave them a possible partner.

    A list is summed up by classes of sizes, a few dozen at most: how many sets, the smallest, and the
    most that one can still share, the token at hand included. One exchange by token serves the
    duplicates, the sums and the join.
    """
    p = posts.repartition(width, "token").dropDuplicates(["token", "node"]).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int"))
    rows = p.groupBy("token", "size").agg(F.count("*").alias("c"), F.max(F.col("n") - F.col("pos")).alias("room"), F.min("n").alias("least"))
    many = rows.groupBy("token").agg(F.sum("c").alias("c"), F.collect_list(F.struct("size", "c", "room", "least")).alias("sizes")).where("c > 1").select("token", "sizes")
    return p.join(many, "token").where(_partner(num, den)).drop("sizes", "size")


def _partner(num: int, den: int):
    """Sets that link lie in the same class of sizes or the next one, and share no more than the room of both."""
    need = f"{num} * (n + x.least)"
    return F.expr(f"exists(sizes, x -> abs(x.size - size) <= 1 and (x.size <> size or x.c > 1) and least(n - pos, x.room) * {num + den}L >= {need})")


def _packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of a sorted set, byte by byte; the first bytes are in order and compress."""
    planes = tokens.astype(">u8").view(np.uint8).reshape(-1, 8).T[:6]
    return len(tokens).to_bytes(4, "little") + planes[1:].tobytes() + zlib.compress(np.ascontiguousarray(planes[0]).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[1:6] = np.frombuffer(blob, np.uint8, 5 * n, 4).reshape(5, n)
    planes[0] = np.frombuffer(zlib.decompress(blob[4 + 5 * n :]), np.uint8)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def sets_of(docs: DataFrame, described: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the wanted nodes, made again from one text of each; some others and repeats may be among them.

    A filter of fixed size spares most texts the work; where it is full, all are made, which is right too.
    """
    one = described.where("node is not null").groupBy("node").agg(F.min("th").alias("th")).join(nodes, "node", "left_semi").select("th")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(one, "th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            hit = in_filter(bits.value, b.column(0).to_numpy())
            for _, texts in blocks(b.column(1).filter(pa.array(hit))):
                tokens, at = shingle_sets(texts, width)
                node, blob = [], []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if y > x and (key := node_id(tokens[x:y])) not in known:
                        if len(known) >= KNOWN:
                            known.clear()
                        known.add(key)
                        node.append(key)
                        blob.append(_packed(tokens[x:y]))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(blob, pa.binary())], names=["node", "tokens"])

    texts = docs.where("text is not null").select(F.xxhash64("text"), F.col("text").cast("binary"))
    return texts.mapInArrow(lean(run, forget), "node long, tokens binary")


#: Sets that one task holds while others stream past, and how many of those it gets.
HELD, PASSING = 64, 2000


def verified(pairs: DataFrame, sets: DataFrame, classes, num: int, den: int) -> DataFrame:
    """The pairs (x, y) that link, as (a, b): prefixes shared under every order, then the exact overlap.

    The sets of some dozens of ``x`` are brought together once with each ``y`` that any of them is compared
    with, so a set travels per block of comparisons, not per pair. Both sides of a task are bounded.
    """
    blocks = max(shuffle_width(pairs.sparkSession), -(-pairs.select("x").distinct().count() // HELD))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("x"), F.lit(blocks)).cast("int"))
    rows = dealt.groupBy("block", "y").agg(F.collect_set("x").alias("xs"))
    return compared(rows, dealt.select("block", "x").distinct(), sets, classes, num, den)


def compared(rows: DataFrame, members: DataFrame, sets: DataFrame, classes, num: int, den: int) -> DataFrame:
    """The links (a, b) among comparisons given as (block, y, xs); ``members``: (block, x)."""
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / PASSING).cast("int").alias("parts"))
    rows = rows.join(sizes, "block").select("block", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"), "y", "xs")
    passing = rows.join(sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty")), "y").select("block", "part", "y", "xs", "ty")
    held = members.join(sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx")), "x").join(sizes, "block")
    held = held.select(F.col("block").alias("hblock"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("hpart"), F.col("x").alias("hx"), F.col("tx").alias("htokens"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        def prefixes(s: np.ndarray) -> list[np.ndarray]:
            return [in_order(s, classes.value, o, prefix_length(len(s), num, den)) for o in range(2, ORDERS + 1)]

        known = {x: (s := _unpacked(t), prefixes(s)) for x, t in zip(right["hx"].to_pylist(), right["htokens"].to_pylist(), strict=True)}
        found: list[tuple[int, int]] = []
        for y, xs, blob in zip(left["y"].to_pylist(), left["xs"].to_pylist(), left["ty"].to_pylist(), strict=True):
            t = _unpacked(blob)
            own = prefixes(t)
            for x in xs:
                if x not in known:
                    continue
                s, others = known[x]
                if all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(own, others, strict=True)):
                    if len(np.intersect1d(s, t, assume_unique=True)) >= overlap(len(s), len(t), num, den):
                        found.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return passing.groupBy("block", "part").cogroup(held.groupBy("hblock", "hpart")).applyInArrow(compare, "a long, b long")


def _near(x: str, y: str, num: int, den: int):
    """Bounds on size and position for two postings of a token."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    # ceil(num * (nx + ny) / (num + den))
    least = F.expr(f"(({num}L * ({x}.n + {y}.n) + {num + den - 1}L) div {num + den}L)")
    return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (F.least(nx - px, ny - py) >= least)


#: Rounds against pivots after the first.
ROUNDS = 3
#: Members of a list that travel together; longer lists are dealt by the members' hashes.
PART = 512
#: Shares into which the lists that a block of seekers meets are dealt.
LISTS = 16


def _posting():
    return F.struct("node", "n", "pos")


def mixed_lists(lists: DataFrame, groups: DataFrame, seed: int) -> DataFrame:
    """Lists with several components: ``comp`` of each row, ``out`` if it isn't the list's largest, the list's ``size``, and ``p``, a pivot of the largest.

    The pivot is another one in each list and with each ``seed``.
    """
    placed = lists.join(groups, lists["node"] == groups["node"], "left").select(lists["*"], F.coalesce("component", lists["node"]).alias("comp"))
    placed = materialise(placed, "ngram-placed")
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min_by(_posting(), F.xxhash64("node", "token", F.lit(seed))).alias("p"))
    main = sizes.groupBy("token").agg(F.max_by(F.struct("comp", "p"), F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("size")).where("comps > 1")
    main = main.select("token", "size", F.col("main.comp").alias("main"), "main.p")
    mixed = placed.join(main, "token").withColumn("out", F.col("comp") != F.col("main")).drop("main")
    mixed = materialise(gathered(mixed, placed.count()), "ngram-mixed")
    discard(placed)
    return mixed


def pivot_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y): the pivot ``p`` of a list with each of its rows, as far as the bounds allow."""
    own = rows.select("p", _posting().alias("r")).where((F.col("r.node") != F.col("p.node")) & _near("r", "p", num, den))
    return own.select(F.col("p.node").alias("x"), F.col("r.node").alias("y")).distinct()


def settled(rows: DataFrame) -> DataFrame:
    """Lists less their pivots, once those have been compared: a list of two is done then, and one of few after some rounds.

    Two sets that link meet within the bounds in the list of the first token that they share, so what
    the bounds leave out in another list needs no comparison there.
    """
    return rows.where("node <> p.node")


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """(node, block): nodes of lists in blocks of about ``HELD``, each with the others of its longest list."""
    home = rows.groupBy("node").agg(F.max_by("token", F.struct("size", "token")).alias("home"))
    nodes = rows.select("node").distinct().count()
    sizes = home.groupBy("home").agg(F.count("*").alias("rows"), F.count("*").alias("c"))
    # lists of few rows share blocks; should a block get two numbers' rows by chance, it is only larger
    many = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / HELD)))
    few = F.pmod(F.xxhash64("home"), F.lit(max(1, -(-nodes // HELD))))
    return heavy_join(home, sizes, "home", "rows", nodes).select("node", F.when(F.col("c") >= HELD, many).otherwise(few).alias("block"))


def cross_blocks(mixed: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(block, y, xs) and (block, x): in each list, the rows outside its largest component, in blocks, with those of other components.

    Lists travel as arrays to the blocks that they are compared with, and what several lists give is
    made once; no row is made for a pair. Rows whose longest list is the same are of the same blocks, so
    that a list goes to a block for each ``HELD`` of its rows, not to one for each row. The lists that a block
    meets are dealt by their tokens.
    """
    placed = materialise(dealt_blocks(mixed.where("out")), "ngram-blocks")
    mixed = mixed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / PART)))
    lists = mixed.groupBy("token", "part").agg(F.collect_list(F.struct("node", "n", "pos", "comp", "out")).alias("members"))
    seekers = mixed.where("out").join(placed, "node").groupBy("token", "block").agg(F.collect_list(F.struct("node", "n", "pos", "comp")).alias("seekers"))
    slab = F.pmod(F.xxhash64("token"), F.lit(LISTS)).alias("slab")
    met = seekers.join(lists, "token").groupBy("block", "part", slab).agg(F.collect_list(F.struct("seekers", "members")).alias("lists"))
    fields = ("node", "n", "pos", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lists in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found: dict[int, set[int]] = {}
                values = lists.values
                for i in range(len(values)):
                    s, m = (values.field(k)[i].values for k in ("seekers", "members"))
                    x, xn, xpos, xcomp = (s.field(k).to_numpy() for k in fields)
                    y, n, pos, comp = (m.field(k).to_numpy() for k in fields)
                    out = m.field("out").to_numpy(zero_copy_only=False)
                    for k in range(len(x)):
                        ok = (comp != xcomp[k]) & (~out | (x[k] < y)) & (den * np.minimum(n, xn[k]) >= num * np.maximum(n, xn[k]))
                        ok &= np.minimum(n - pos, xn[k] - xpos[k]) >= overlap(int(xn[k]), n.astype(np.int64), num, den)
                        for node in y[ok].tolist():
                            found.setdefault(node, set()).add(int(x[k]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array([sorted(v) for v in found.values()], pa.list_(pa.int64()))], names=["block", "y", "xs"])

    rows = met.select("block", "lists").mapInArrow(lean(run), "block long, y long, xs array<long>")
    rows = rows.groupBy("block", "y").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("xs"))
    return rows, placed.select("block", F.col("node").alias("x"))


def unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs that haven't been compared, in either order."""
    both = seen.unionByName(seen.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return pairs.join(both, ["x", "y"], "left_anti")


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components after some more links; those before are flat, so they settle in fewer rounds than all links would."""
    flat = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(flat.unionByName(links), "ngram-components", rows=groups.count() + links.count())


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id reachable by links) of every row."""
    spark: SparkSession = docs.sparkSession
    described = materialise(describe(docs, width), "ngram-described")
    classes = spark.sparkContext.broadcast(frequency_classes(described))
    lists = materialise(shared_lists(postings(docs, classes, width, num, den), shuffle_width(spark), num, den), "ngram-lists")
    sets = bucketed(sets_of(docs, described, lists.select("node").distinct(), width), "node", shuffle_width(spark), "ngram-sets", unique=True)

    # first round: each list against one pivot, mostly the same in all lists of a group
    pivots = lists.groupBy("token").agg(F.min_by(_posting(), F.xxhash64("node")).alias("p"))
    first = materialise(lists.join(pivots, "token"), "ngram-first")
    discard(lists)
    seen = materialise(gathered(pivot_pairs(first, num, den), first.count()), "ngram-pairs")
    links = materialise(verified(seen, sets, classes, num, den), "ngram-links")
    groups = materialise(components(links, "ngram-components", rows=links.count()), "ngram-groups")

    # further rounds: rows outside the largest component of a list against a pivot in it, another in each list and round
    mixed = mixed_lists(settled(first).drop("p"), groups, 0)
    discard(first)
    left = mixed
    for seed in range(ROUNDS):
        pairs = unseen(pivot_pairs(mixed.where("out"), num, den), seen)
        pairs = materialise(gathered(pairs, mixed.count()), "ngram-pairs")
        more = materialise(verified(pairs, sets, classes, num, den), "ngram-links")
        seen = seen.unionByName(pairs)
        left = settled(mixed)
        if not more.limit(1).count():
            break
        old = groups, mixed
        groups = materialise(joined_groups(groups, more), "ngram-groups")
        left = mixed = mixed_lists(left.select("token", "node", "n", "pos"), groups, seed + 1)
        discard(*old)

    # last round: all pairs that are left
    rows, members = cross_blocks(left, num, den)
    cross = materialise(rows, "ngram-cross")
    more = materialise(compared(cross, members, sets, classes, num, den), "ngram-more")
    groups = materialise(joined_groups(groups, more), "ngram-groups")
    discard(cross, mixed, sets)

    rows = described.where("slab is null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    per_node = rows.groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")).where("node is not null")
    placed = per_node.join(groups, "node", "left").select("node", "rows", "least", F.coalesce("component", "node").alias("comp"))
    placed = materialise(placed, "ngram-members")
    # a component is one lookup row for each of its nodes, and a node one for all of its rows
    first = placed.groupBy("comp").agg(F.min("least").alias("first"), F.count("*").alias("nodes"))
    named = materialise(heavy_join(placed, first, "comp", "nodes", placed.count()).select("node", "rows", "first"), "ngram-firsts")
    out = heavy_join(rows, named, "node", "rows", described.count(), "left")
    # texts without words are their own component
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
