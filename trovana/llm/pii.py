"""Personal data: fixed patterns, and terms that reveal whom a text is about.

The patterns give the protected entities. Corpus co-occurrence then tells how strongly
a word discloses an entity: of all texts with the word, the share that also holds this
entity, wherever in the text, and the bits by which that share exceeds the entity's own.
Words over both thresholds are reported, to be generalised, at all their places in all
texts that hold the entity, beside the base spans, which always stay.

One pass over the texts yields entities, the texts that hold any, and document
frequencies counted per partition. Only entities and words whose counts alone don't rule
out both thresholds are paired. Texts are counted, so that exact
copies count once: a second pass over one row of each repeated text takes its further
copies off the words' counts. Offsets are code points, the end exclusive.

Defined results: null and empty texts have no spans; whole texts of any length are read
in linear time; each row gives one row, repeated ones too; an empty table gives none;
extra columns are ignored unless named in ``keep``, and a kept column that has a result's
name comes under ``kept_`` and its name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.llm.common import col, heavy_join, kept_names, lean, materialise

#: The base kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards and forwards: linear also in texts without spaces."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind as listed, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    """Spellings of one entity: case and separators don't count."""
    return f"{kind}:{value.lower() if kind == 0 else ''.join(c for c in value if c not in ' ().-') if kind > 1 else value}"


def _long(data: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data.encode()), "little", signed=True)


def free_words(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The words that touch no base span, in one walk over both."""
    spans = sorted(taken)
    far, i = 0, 0
    for m in WORD.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            far = max(far, spans[i][1])
            i += 1
        if far <= m.start():
            yield m.span()


#: Words counted by a task before it hands the counts on.
COUNTED = 300_000


def extract(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows of documents (``base``: kind, start, end; ``holds``: entities; ``held``: the text, if it has any) and of word counts (``counts``)."""
    base = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("k", "s", "z")]))
    counts = T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("n", T.LongType())]))
    own = [f"k{i}" for i in range(len(keep))]
    fields = [T.StructField(n, docs.schema[k].dataType) for n, k in zip(own, keep, strict=True)]
    schema = T.StructType([*fields, T.StructField("th", T.LongType()), T.StructField("base", base), T.StructField("holds", T.ArrayType(T.LongType())), T.StructField("held", T.StringType()), T.StructField("counts", counts)])
    kinds = (
        pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("z", pa.int32())])),
        pa.list_(pa.int64()),
        pa.string(),
        pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int64())])),
    )
    names = [*own, "th", "base", "holds", "held", "counts"]

    def flush(c: Counter, kept: list) -> pa.RecordBatch:
        pairs = [{"t": _long(w), "n": n} for w, n in c.items()]
        parts = [pairs[i : i + 20_000] for i in range(0, len(pairs), 20_000)]
        empty = [pa.nulls(len(parts), k) for k in kept]
        c.clear()
        return pa.RecordBatch.from_arrays([*empty, pa.nulls(len(parts), pa.int64()), *(pa.nulls(len(parts), k) for k in kinds[:3]), pa.array(parts, kinds[3])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        kept = None
        for b in batches:
            kept = [b.column(i).type for i in range(len(keep))]
            hashes, bases, holds, held = [], [], [], []
            for t, th in zip(*(b.column(len(keep) + i).to_pylist() for i in range(2)), strict=True):
                t = t or ""
                found = base_spans(t)
                words.update(set(WORD.findall(t.lower())))
                hashes.append(th)
                bases.append([{"k": k, "s": a, "z": z} for k, a, z in found])
                holds.append(list({_long(entity(k, t[a:z])) for k, a, z in found}))
                held.append(t if found else None)
                if len(words) > COUNTED:
                    yield flush(words, kept)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(hashes, pa.int64()), pa.array(bases, kinds[0]), pa.array(holds, kinds[1]), pa.array(held, kinds[2]), pa.nulls(len(hashes), kinds[3])], names=names
            )
        if words:
            yield flush(words, kept)

    return docs.select(*[col(k).alias(n) for n, k in zip(own, keep, strict=True)], col(text).alias("text"), _hash(text)).mapInArrow(lean(run), schema)


def _hash(text: str):
    return F.xxhash64(F.coalesce(col(text), F.lit(""))).alias("th")


def further_copies(docs: DataFrame, text: str, rows: DataFrame) -> DataFrame:
    """(t, n): how often ``counts`` has a word beyond once for each different text."""
    more = materialise(rows.where("base is not null").groupBy("th").agg((F.count("*") - 1).alias("more")).where("more > 0"), "pii-copies")
    once = docs.select(_hash(text), col(text).alias("text")).join(more, "th").groupBy("th", "more").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: Counter = Counter()
            for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in set(WORD.findall((t or "").lower())):
                    words[w] += n
            yield pa.RecordBatch.from_arrays([pa.array([_long(w) for w in words], pa.int64()), pa.array(words.values(), pa.int64())], names=["t", "n"])

    return once.select("text", "more").mapInArrow(lean(run), "t long, n long")


def word_texts(docs: DataFrame, text: str, rows: DataFrame) -> DataFrame:
    """(t, n_t): the number of different texts with each word."""
    counted = rows.where("counts is not null").select(F.explode("counts").alias("x")).select("x.t", "x.n")
    return counted.unionByName(further_copies(docs, text, rows).select("t", (-F.col("n")).alias("n"))).groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosing(rows: DataFrame, of_t: DataFrame, min_texts: int, min_share: float, min_bits: float) -> DataFrame:
    """(e, t): the terms that reveal an entity, from counts over all texts."""
    docs = rows.where("base is not null")
    n = docs.select("th").distinct().count()
    held = docs.where("held is not null")
    # no share of an entity's texts is over min_bits if it stands in more of them
    of_e = held.select("th", F.explode("holds").alias("e")).distinct().groupBy("e").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= min_texts) & (F.col("n_e") <= n * 2.0**-min_bits))
    kept = materialise(held.select("th", F.explode("holds").alias("e")).distinct().join(of_e, "e"), "pii-entities")
    texts = held.groupBy("th").agg(F.first("held").alias("held"), F.first("base").alias("base")).join(kept.groupBy("th").agg(F.max("n_e").alias("most")), "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for th, t, base, most in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = list({_long(t[x:y].lower()) for x, y in free_words(t, [(x["s"], x["z"]) for x in base])})
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(words), pa.int64()) for v in (th, most)] + [pa.array(words, pa.int64())], names=["th", "most", "t"])

    # nor is a share over min_share if the word stands in more texts than that
    # and the words of a two-hundredth of all texts are broadcast: no more than two hundred times a text's words
    words = texts.select("th", "held", "base", "most").mapInArrow(lean(run), "th long, most long, t long")
    words = heavy_join(words, of_t.withColumn("texts", F.col("n_t")), "t", "texts", n, hot=200).where(F.col("n_t") * min_share <= F.col("most"))
    both = words.select("th", "t", "n_t").join(kept, "th").where(F.col("n_t") * min_share <= F.col("n_e"))
    pairs = both.groupBy("e", "t", "n_e", "n_t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_texts)
    share = F.col("n_et") / F.greatest("n_t", "n_et")
    bits = F.log2(share * F.lit(float(max(n, 1))) / F.col("n_e"))
    return pairs.where((share >= min_share) & (bits >= min_bits)).select("e", "t")


def places(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(_row, terms, sanitised): all places of the terms that reveal an entity of the row's text, and the text without them."""
    held = rows.where("held is not null")
    holds = held.select("_row", F.explode("holds").alias("e"))
    counts = holds.groupBy("e").agg(F.count("*").alias("rows"))
    terms = told.groupBy("e").agg(F.collect_list("t").alias("ts")).join(counts, "e")
    of_row = heavy_join(holds, materialise(terms, "pii-terms"), "e", "rows", rows.count()).groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("z", pa.int32())]))
        for b in batches:
            found, clean = [], []
            for t, base, ts in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                wanted = set(ts or ())
                found.append([{"s": x, "z": y} for x, y in free_words(t, [(x["s"], x["z"]) for x in base]) if _long(t[x:y].lower()) in wanted] if wanted else [])
                clean.append(sanitised(t, base, found[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(clean, pa.string())], names=["_row", "terms", "sanitised"])

    return held.select("_row", "held", "base").join(of_row, "_row", "left").select("_row", "held", "base", "ts").mapInArrow(lean(run), "_row long, terms array<struct<s:int,z:int>>, sanitised string")


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_texts: int = 3, min_share: float = 0.5, min_bits: float = 6.0) -> DataFrame:
    """``keep`` columns, ``base`` (k, s, z: kind as listed, start, end), ``terms`` (s, z) and ``sanitised`` of every row.

    ``sanitised`` is the text with entities named by their kind and revealing terms generalised; null where there are none,
    and the text stays as it is.
    """
    rows = materialise(extract(docs, text, keep).withColumn("_row", F.monotonically_increasing_id()), "pii")
    told = disclosing(rows, word_texts(docs, text, rows), min_texts, min_share, min_bits)
    own = [f"k{i}" for i in range(len(keep))]
    out = rows.where("base is not null").select("_row", *own, "base").join(places(rows, told), "_row", "left")
    names = kept_names(keep, ("base", "terms", "sanitised"))
    return out.select(*[F.col(k).alias(n) for k, n in zip(own, names, strict=True)], "base", F.coalesce("terms", F.array().cast("array<struct<s:int,z:int>>")).alias("terms"), "sanitised")


def pii_digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts per base kind, the digest of the base spans, all spans as text, and a digest of the sanitised text."""
    names = F.array(*map(F.lit, KINDS))
    line = F.array_join(F.transform("base", lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["z"])), ",")
    terms = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["z"])), ",")
    both = F.concat_ws(",", F.nullif(line, F.lit("")), F.nullif(terms, F.lit("")))
    return found.select(
        *keep,
        *(_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(line.cast("binary"), 256).alias("base_sha256"),
        both.alias("spans"),
        F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"),
    )


def _count(kind: int):
    return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")


def sanitised(text: str | None, base: list, terms: list) -> str | None:
    """A text with its base spans named by kind and its revealing terms generalised; of overlapping spans the first, then longest, counts."""
    if text is None:
        return None
    spans = sorted([(x["s"], -x["z"], f"<{KINDS[x['k']].upper()}>") for x in base] + [(x["s"], -x["z"], "<TERM>") for x in terms])
    out, at = [], 0
    for s, z, name in spans:
        if s >= at:
            out += [text[at:s], name]
            at = -z
        at = max(at, -z)
    return "".join([*out, text[at:]])

