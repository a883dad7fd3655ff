"""Line deduplication over a log-template tree of fixed depth.

A line goes down the tree by its token count and its ``depth`` leading tokens, each of
which may take the wildcard branch of its node instead, one on each way: so a line comes
to ``depth`` leaves. Tokens with digits are wildcards at once. In a leaf, lines that
differ in fields meet by their constant tokens. A token counts as often as different lines
of the leaf have it at its place. The constant tokens of a template are about equally
frequent, those of its fields are rarer: half or more of the places that the way to the
leaf doesn't fix must reach the line's typical count, and a place with less than ``ratio``
of it is a field. All fields of a line are found at once, however many they are. The
typical count must be ``min_values``, and so many lines of the leaf must share the template.
Two fields of words among the leading tokens keep lines apart: that is the fixed depth.

A line or template that stands in ``min_docs`` different texts is recurring: its lines go
from every document but the first (the smallest id) that has it, however much of a
document such lines are. Two texts are enough by default, so that nothing that repeats
stays and a line fares alike in any size of table. Exact copies count as one text.

Texts that lose lines are moved once, to where these are dropped, the others not at all;
filters of fixed size tell a task which of its texts those can be, which of its lines can
be in a leaf of several lines, and which tokens of these can be constant.

Defined results: null and empty texts stay as they are; lines without tokens are never
templates; repeated rows (same id, same text) are treated alike; a null id comes after
all others, and a template that only rows without an id have stays; documents of an empty
table give no rows; lines and texts of any length are read whole, in linear time; other
columns pass through, those with a result's name under ``kept_`` and their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import bit_filter, discard, heavy_join, in_filter, kept_names, lean, materialise, packed

DIGIT = re.compile(r"\d")
STAR = "<*>"
#: Lines of wide leaves that a task remembers, so as to send each once.
SEEN = 200_000


def _long(data: str) -> int:
    x = xxhash.xxh3_64_intdigest(data.encode())
    return x - (1 << 64) if x >> 63 else x


def masked(line: str) -> list[str]:
    """The tokens of a line, those with digits as wildcards."""
    tokens = line.split()
    return [STAR if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def leaves_of(tokens: list[str], depth: int) -> list[int]:
    """The leaf that a masked line comes to with the wildcard branch at each of its leading tokens."""
    lead = tokens[:depth]
    return [_long(f"{len(tokens)} {k}\n" + "\n".join([*lead[:k], *lead[k + 1 :]])) for k in range(len(lead))]


def lines(docs: DataFrame, depth: int) -> DataFrame:
    """A row for each form (a line with its masks) in a document: id, text's hash, leaves, form and its line numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc_id, th, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen: dict[int, list] = {}
                for n, line in enumerate(text.split("\n")):
                    if tokens := masked(line):
                        form = _long("\n".join(tokens))
                        if form in seen:
                            seen[form][4].append(n)
                        else:
                            seen[form] = [doc_id, th, leaves_of(tokens, depth), form, [n]]
                for row in seen.values():
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "th", "leaves", "form", "at"])

    return docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), "doc_id long, th long, leaves array<long>, form long, at array<int>")


def shapes(docs: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """(form, leaf, places): the forms of some leaves, each place that the leaf leaves open as a hash of leaf, place and token."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(leaves, "leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows: list[tuple[int, int, list[int]]] = []
            split = [tokens for text in b.column(0).to_pylist() for line in text.split("\n") if len(tokens := masked(line)) > depth]
            leaf = np.array([leaves_of(t, depth) for t in split], np.int64).reshape(len(split), depth)
            hit = in_filter(bits.value, leaf)
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                tokens = split[k]
                form = _long("\n".join(tokens))
                if form not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(form)
                    for way in np.flatnonzero(hit[k]).tolist():
                        at = int(leaf[k, way])
                        rows.append((form, at, [_long(f"{at} {i} {t}") for i, t in enumerate(tokens) if i == way or i >= depth]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["form", "leaf", "places"])

    return docs.where("text <> ''").select("text").mapInArrow(lean(run), "form long, leaf long, places array<long>").dropDuplicates(["form", "leaf"])


def frequent(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(form, leaf, size, places): ``found`` with the number of its places, and those of them that may have a count.

    A filter of fixed size leaves out the others, and forms of which fewer than half of the places are left, as they
    have no typical count. Where it is full, it lets all places through, which is right too.
    """
    bits = found.sparkSession.sparkContext.broadcast(bit_filter(counts, "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column(2)).to_numpy().astype(np.int64)
            flat = b.column(2).flatten().to_numpy()
            hit = in_filter(bits.value, flat)
            upto = np.concatenate([[0], np.cumsum(hit)])
            end = np.cumsum(size)
            left = upto[end] - upto[end - size]
            ok = left >= (size + 1) // 2
            offsets = np.concatenate([[0], np.cumsum(left[ok])]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[hit & np.repeat(ok, size)]))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(size[ok].astype(np.int32)), places], names=["form", "leaf", "size", "places"])

    return found.select("form", "leaf", "places").mapInArrow(lean(run), "form long, leaf long, size int, places array<long>")


def fields(found: DataFrame, min_values: int, ratio: float) -> DataFrame:
    """(form, template): the forms with fields, from the places of all forms of their leaves.

    A place names its leaf, so the constant places alone tell a template. Tokens that are too rare to be constant
    anywhere need no lookup, and most of them don't travel to one.
    """
    counts = found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") >= ratio * min_values)
    counts = materialise(counts, "line-places")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    places = frequent(found, counts).select("form", "leaf", "size", F.explode("places").alias("place"))
    known = heavy_join(places, counts.withColumn("n", F.col("c")), "place", "n", total)
    row = known.groupBy("form", "leaf", "size").agg(F.sort_array(F.collect_list(F.struct("c", "place")), asc=False).alias("ps"))
    # the count that half of the places or more reach
    row = row.withColumn("m", F.get("ps", ((F.col("size") + 1) / 2).cast("int") - 1)["c"]).where(F.col("m") >= min_values)
    constant = F.transform(F.filter("ps", lambda p: p["c"] >= ratio * F.col("m")), lambda p: p["place"])
    row = row.withColumn("constant", F.array_sort(constant)).where(F.size("constant") < F.col("size"))
    return row.select("form", F.xxhash64("leaf", "constant").alias("template"))


def templates(docs: DataFrame, parsed: DataFrame, depth: int, min_docs: int, min_values: int, ratio: float) -> DataFrame:
    """(form, n, first): the forms that belong to a recurring line or template, their rows, and the first document of it."""
    # texts are counted, not rows, so that copies count once
    per_text = parsed.groupBy("form", "th").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("leaves").alias("leaves"))
    forms = materialise(per_text.groupBy("form").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first"), F.first("leaves").alias("leaves")), "line-forms")
    alone = forms.where(F.col("texts") >= min_docs).select("form", "n", "first")
    wide = forms.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("forms")).where(F.col("forms") >= min_values).select("leaf")
    found = materialise(shapes(docs, wide, depth), "line-shapes")
    member = materialise(fields(found, min_values, ratio).join(forms.select("form", "texts", "n", "first"), "form"), "line-members")
    upper = member.groupBy("template").agg(F.count("*").alias("values"), F.sum("texts").alias("most"), F.min("first").alias("first")).where((F.col("values") >= min_values) & (F.col("most") >= min_docs))
    # a text with several lines of a template counts once
    wanted = materialise(heavy_join(member.select("form", "n", "template"), upper.select("template", "first", "values"), "template", "values", member.count()), "line-wanted")
    texts = heavy_join(parsed.select("form", "th"), wanted.select("form", "template", "n"), "form", "n", parsed.count()).select("template", "th").distinct().groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs)
    sizes = wanted.groupBy("template").agg(F.count("*").alias("values")).join(texts, "template").select("template", "values")
    joint = heavy_join(wanted, sizes, "template", "values", wanted.count()).select("form", "n", "first")
    out = materialise(alone.unionByName(joint).groupBy("form").agg(F.max("n").alias("n"), F.min("first").alias("first")).where("first is not null"), "line-recurring")
    discard(forms, found, member, wanted)
    return out


RESULTS = ("_n_lines", "_n_dropped")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, depth: int = 3, min_values: int = 5, ratio: float = 0.5) -> DataFrame:
    """``docs`` with ``text`` less the lines of recurring templates, and ``_n_lines``, ``_n_dropped``."""
    ours = docs.select("doc_id", "text")
    parsed = materialise(lines(ours, depth), "line-parsed")
    found = templates(ours, parsed, depth, min_docs, min_values, ratio)
    later = heavy_join(parsed.select("doc_id", "th", "form", "at"), found, "form", "n", parsed.count()).where("doc_id is null or doc_id <> first")
    # written before the texts move, so that the lines' shuffles don't lie beside the texts'
    drops = materialise(later.groupBy(F.xxhash64("doc_id", "th").alias("key")).agg(F.flatten(F.collect_list("at")).alias("at")), "line-drops")
    discard(parsed, found)
    texts = docs.select("doc_id", "text", packed(docs, "doc_id", "text").alias("rest"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"))
    # only texts that can lose a line move
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(drops, "key"))
    loses = F.arrow_udf(lambda key: pa.array(in_filter(bits.value, key.to_numpy())), "boolean")
    # the drops of a task are few: hashed, so that texts needn't be sorted
    moved = texts.where(loses("key")).join(drops.hint("shuffle_hash"), "key", "left")
    t = moved.unionByName(texts.where(~loses("key")).withColumn("at", F.lit(None).cast("array<int>")))
    parts = F.split("text", "\n")
    # the parts are bound once: within the inner function, the text would be split again for each line
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "at")
    kept = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n"))[0]
    text = F.when(F.col("at").isNull(), F.col("text")).otherwise(kept)
    names = kept_names(tuple(docs.columns), RESULTS)
    own = {"doc_id": F.col("doc_id"), "text": text}
    return t.select(
        *[own.get(c, F.col("rest").getField(c)).alias(n) for c, n in zip(docs.columns, names, strict=True)],
        F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(parts)).cast("long").alias("_n_lines"),
        F.size(F.coalesce("at", F.array().cast("array<int>"))).cast("long").alias("_n_dropped"),
    )
