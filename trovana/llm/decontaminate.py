"""Benchmark decontamination with DataFrame functions only.

A window is ``width`` consecutive words of an item (an item with fewer words is one
window). The shingles of a window are ordered by rarity over all documents; a document can
hold the window only where its rarest shingle, the prefix of the containment join, occurs.
The places of the documents' shingles are joined with these prefixes; position and length
bound what is left, and each candidate is then compared word for word with the window.

A document's shingles are hashed within its row. A filter of bounded size, whatever the
benchmark, tells which places can matter; only these become rows, with the words around
them, and are joined exactly. Texts are told apart by two 64-bit hashes, so equal texts
fare alike and are found once.

Defined results: null and empty texts have no words, hits or items; items without
words are never found; null item ids are left out; items with equal texts all count;
each row of the documents gives one row, repeated ones too; an empty benchmark hits
nothing; item ids of any characters are told as they are; texts of any length are whole;
extra columns are ignored unless named in ``keep``, and a kept column that has a result's
name comes under ``kept_`` and its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import col, heavy_join, kept_names, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; windows of fewer words are their own shingle.
SHINGLE = 3
#: Longs of the filter at most: half a megabyte, whatever the benchmark. Where it is full, it spares nothing, which is right too.
FILTER = 1 << 16


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, cut at ASCII characters other than letters and digits."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(low, SEPARATORS, -1)


def _trimmed(raw: Column) -> Column:
    """Only the first and the last piece of a split can be empty."""
    first, last = (F.element_at(raw, 1) == "").cast("int"), (F.element_at(raw, -1) == "").cast("int")
    return F.when((F.size(raw) == 1) & (first == 1), F.array().cast("array<string>")).otherwise(F.slice(raw, first + 1, F.size(raw) - first - last))


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words`` in place of the text."""
    return df.withColumn("_raw", words(F.col(text))).withColumn("_words", _trimmed(F.col("_raw"))).drop("_raw", text)


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda x: F.xxhash64(x))


def _hashes(one: Column, q: int) -> Column:
    """The hash of the shingle of ``q`` words at each place, from a column of the words' hashes; null where it doesn't fit any more."""
    out = one
    for k in range(2, q + 1):
        out = F.zip_with(out, F.slice(one, F.lit(k), F.greatest(F.size(one) - (k - 1), F.lit(0))), lambda h, x: F.when(x.isNotNull(), F.xxhash64(h, x)))
    return out


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """One row per distinct window: ``w`` (its words joined by a space), ``len``, ``items``, the words ``q`` of a shingle and its shingles ``hs``."""
    b = with_words(benchmark.select("item_id", "text")).where("size(_words) > 0 and item_id is not null")
    n = F.size("_words")
    b = b.withColumn("len", F.least(F.lit(width), n)).withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("len") + 1)))
    b = b.withColumn("ws", F.slice("_words", F.col("at"), F.col("len")))
    one = b.groupBy("ws", "len").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    one = one.withColumn("wh", word_hashes(F.col("ws")))
    hs = F.when(F.col("len") >= SHINGLE, F.filter(_hashes(F.col("wh"), SHINGLE), lambda h: h.isNotNull()))
    for q in range(1, SHINGLE):
        hs = hs.when(F.col("len") == q, F.filter(_hashes(F.col("wh"), q), lambda h: h.isNotNull()))
    return one.select(F.array_join("ws", " ").alias("w"), "len", "items", F.least(F.lit(SHINGLE), F.col("len")).alias("q"), hs.alias("hs"))


def _filter(hashes: DataFrame):
    """A test that all values of ``h`` pass, and few others: bits of a constant array that Spark folds once.

    The array has a power of two of longs, some 32 bits for each hash as long as it is below ``FILTER``. A hash's upper
    bits say which long, its lower ones which bit.
    """
    n, size = hashes.count(), 1
    while 1 << size < min(FILTER, n // 2):
        size += 1
    held = hashes.select(F.shiftrightunsigned("h", 64 - size).cast("int").alias("w"), F.expr("cast(h & 63 as int)").alias("b"))
    words = [0] * (1 << size)
    for r in held.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).collect():  # as many rows as longs
        words[r["w"]] = r["v"]
    bits = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda h: F.call_function("getbit", F.get(bits, F.shiftrightunsigned(h, 64 - size).cast("int")), h.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def places(docs: DataFrame, hashes: DataFrame, widths: list[int], around: int, *carried: str) -> DataFrame:
    """(pos, h, near, lead) of the places that can have one of ``hashes``: ``near`` has up to ``around`` words before
    and after, ``lead`` of them before; with some columns of ``docs``."""
    test = _filter(hashes)
    # in steps, so that what several expressions read is made once
    parts = docs.select(*carried, "_words", word_hashes(F.col("_words")).alias("_w"))
    parts = parts.select(*carried, "_words", *[_hashes(F.col("_w"), q).alias(f"_h{q}") for q in widths])
    found = []
    for q in widths:
        lead = lambda i: F.least(i, F.lit(around))
        row = lambda h, i: F.struct(i.alias("pos"), h.alias("h"), F.slice("_words", i - lead(i) + 1, lead(i) + around).alias("near"), lead(i).alias("lead"))
        found.append(F.filter(F.transform(F.col(f"_h{q}"), lambda h, i: F.when(test(h), row(h, i))), lambda x: x.isNotNull()))
    return parts.select(*carried, F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("_p")).select(*carried, "_p.*")


def _covered(spans: Column) -> Column:
    """How many words a sorted array of (start, len) covers."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["start"] + x["len"]).alias("end")
        ),
        lambda s: s["n"],
    )


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """(_key, rows, n_hit, items) of the texts that hold windows; ``docs`` has ``_key`` and ``_words``."""
    w = materialise(windows(benchmark, width), "decontaminate-windows")
    widths = sorted(r["q"] for r in w.select("q").distinct().collect()) or [SHINGLE]  # SHINGLE values at most
    shingles = w.select("w", F.size("hs").alias("n"), F.posexplode("hs").alias("offset", "h"))
    # rarity: in how many places of all documents each shingle of the benchmark stands
    distinct = materialise(shingles.select("h").distinct(), "decontaminate-shingles")
    counted = places(docs, distinct, widths, 0).groupBy("h").agg(F.count("*").alias("places"))
    rarity = materialise(counted.join(distinct, "h"), "decontaminate-rarity")
    # a window with a shingle that stands nowhere can't occur
    first = shingles.join(rarity, "h").groupBy("w", "n").agg(F.min(F.struct("places", "h", "offset")).alias("r"), F.count("*").alias("known")).where("known = n")
    prefix = materialise(first.select("w", F.col("r.h").alias("h"), F.col("r.offset").alias("offset")).join(w.select("w", "len", "items"), "w"), "decontaminate-prefixes")

    met = places(docs, prefix.select("h").distinct(), widths, width, "_key").join(prefix, "h")
    begin = F.col("lead") - F.col("offset")
    fits = (begin >= 0) & (begin + F.col("len") <= F.size("near"))
    found = met.where(fits).where(F.array_join(F.slice("near", begin + 1, F.col("len")), " ") == F.col("w"))
    spans = found.groupBy("_key", (F.col("pos") - F.col("offset")).alias("start"), "len", "items").agg(F.count("*").alias("rows"))
    per = spans.groupBy("_key").agg(F.max("rows").alias("rows"), F.array_sort(F.collect_set(F.struct("start", "len"))).alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return materialise(per.select("_key", "rows", _covered(F.col("at")).alias("n_hit"), "items"), "decontaminate-found")


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` for every row of ``docs``."""
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    text = docs.select(key.alias("_key"), F.col("text").alias("_text"))
    found = occurrences(with_words(text, "_text"), benchmark, width)
    names = kept_names(keep, RESULTS)
    # kept columns travel under numbers, so that none can clash
    rows = docs.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], key.alias("_text"), F.size(_trimmed(words(F.col("text")))).alias("_n"))
    total = found.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = heavy_join(rows, found.withColumnRenamed("_key", "_text"), "_text", "rows", total, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    result = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
    # a row of its own for each row: a caller's filter stays above it, instead of taking copies of all expressions down to the scan
    out = out.select(*[F.col(f"k{i}") for i in range(len(keep))], F.explode(F.array(result)).alias("_found"))
    return out.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], "_found.*")
