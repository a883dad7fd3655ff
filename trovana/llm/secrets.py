"""Secret scanning with DataFrame functions only.

Three patterns give the base spans. Beside them, candidate strings are scanned with a
sliding window whose Shannon entropy is kept by incremental counts, for each character
class by itself. What an allow-list explains is taken out of a candidate first; it is
reported if a window of what is left is dense. Base spans are never suppressed. A text is
handled in its own row: nothing is shuffled.

Offsets are code points, the end exclusive. Defined results: null and empty texts have
no spans; texts and candidates of any length are scanned whole, each character at a cost
that doesn't grow with them; repeated rows give equal rows; an empty table gives none; extra
columns are ignored unless named in ``keep``, and a kept column that has a result's name
comes under ``kept_`` and its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovana.llm.common import col, kept_names

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
#: Cheap tests that every assignment passes, on the lower-cased text.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: runs of ``window`` characters or more, reported from ``bits`` of entropy on."""

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float


#: Candidates need a digit and a letter of every case that the class has.
CLASSES = (
    CharacterClass("entropy_hex", "(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}(?![A-Za-z0-9])", "0123456789abcdef", 16, 3.0),
    CharacterClass(
        "entropy_base64",
        "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9a-z+/_=-]*[A-Z])(?=[0-9A-Z+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        20,
        3.7,
    ),
    CharacterClass("entropy_lower", "(?<![A-Za-z0-9+/_=-])(?=[a-f0-9]*[g-z])(?=[a-z]*[0-9])[a-z0-9]{20,}(?![A-Za-z0-9+/_=-])", "abcdefghijklmnopqrstuvwxyz0123456789", 20, 3.7),
    CharacterClass("entropy_upper", "(?<![A-Za-z0-9+/_=-])(?=[0-9]*[A-Z])(?=[A-Z]*[0-9])[A-Z0-9]{20,}(?![A-Za-z0-9+/_=-])", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20, 3.5),
)
#: What is no secret although it varies: placeholders, alphabets in order, paths and addresses, runs of one character.
ALLOW = r"(?i)(example|sample|placeholder|dummy|changeme|xxxx|your[_-]?|0123456789|abcdefgh|qwerty|https?|www|/[a-z]{2,}/[a-z]{2,}/|(.)\2{5})"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda around it would compute an expression for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str, test: Column, group: int = 0) -> Column:
    """array<struct<start, end, w, g>> of the leftmost non-overlapping matches, from the pieces between them.

    ``test`` must hold wherever the pattern matches. Places are summed up in blocks of about the root of
    the number of matches, as each step of a sum copies what it has gathered.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), whole, lambda gap, w: F.struct(F.length(gap).alias("gap"), w.alias("w"))),
        part,
        lambda x, g: F.struct(x["gap"].alias("gap"), x["w"].alias("w"), g.alias("g")),
    )
    kind = "array<struct<start:int,end:int,w:string,g:string>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["w"])
        return F.struct(
            F.coalesce(end, s["at"]).alias("at"),
            F.when(x["w"].isNull(), s["out"])
            .otherwise(F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["w"].alias("w"), x["g"].alias("g")))))
            .alias("out"),
        )

    def moved(s: Column, block: Column) -> Column:
        there = F.transform(block["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["w"].alias("w"), x["g"].alias("g")))
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["out"], F.array(there)).alias("out"))

    def summed(all_steps: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(all_steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_steps) - 1) / side).cast("int")), lambda b: F.aggregate(F.slice(all_steps, b * side + 1, side), state, step))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), moved, lambda s: s["out"]))

    return F.when(test & text.rlike(pattern), let(steps, summed)).otherwise(F.array().cast(kind))


#: Bits of a count in a state, which bounds a window to 31 characters; counts of a long.
COUNT_BITS, PER_LONG = 5, 12


def max_entropy(word: Column, c: CharacterClass) -> Column:
    """The largest Shannon entropy of a window over a word, in bits; 0 if the word is shorter.

    Each step adds one character and, once the window is full, takes one away; the counts, a few bits
    each in some longs, and the sum of count * log2(count) change by these two alone.
    """
    w, longs = c.window, -(-len(c.alphabet) // PER_LONG)
    if w >= 1 << COUNT_BITS:
        raise ValueError("a window has at most 31 characters")
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])

    def term(n: Column) -> Column:
        return F.get(terms, n)

    def count(s: Column, k: Column) -> Column:
        held = s["c0"]
        for j in range(1, longs):
            held = F.when(F.floor(k / PER_LONG) == j, s[f"c{j}"]).otherwise(held)
        return F.call_function("shiftrightunsigned", held, (k % PER_LONG * COUNT_BITS).cast("int")).bitwiseAND(F.lit(31)).cast("int")

    def changed(s: Column, k: Column, by: int) -> list[Column]:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (k % PER_LONG * COUNT_BITS).cast("int"))
        return [F.when(F.floor(k / PER_LONG) == j, s[f"c{j}"] + by * one).otherwise(s[f"c{j}"]).alias(f"c{j}") for j in range(longs)]

    state = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(longs)], F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def scan(places: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            gone, new = F.get(places, i - w), F.get(places, i)
            taken = let(
                s,
                lambda s: F.when(i < w, s).otherwise(
                    let(count(s, gone), lambda n: F.struct(*changed(s, gone, -1), (s["sum"] + term(n - 1) - term(n)).alias("sum"), s["best"].alias("best")))
                ),
            )
            return let(
                taken,
                lambda s: let(
                    s["sum"] + let(count(s, new), lambda n: term(n + 1) - term(n)),
                    lambda total: F.struct(*changed(s, new, 1), total.alias("sum"), F.when(i >= w - 1, F.greatest(s["best"], F.lit(math.log2(w)) - total / w)).otherwise(s["best"]).alias("best")),
                ),
            )

        return F.when(F.size(places) >= w, F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), state, step, lambda s: s["best"])).otherwise(F.lit(0.0))

    # one character after the other, as its place in the alphabet; the last piece of the split is empty
    return let(F.filter(F.transform(F.split(word, ""), lambda ch: F.when(ch == "", -1).otherwise(F.instr(F.lit(c.alphabet), ch) - 1)), lambda k: k >= 0), scan)


def _spans(found: Column, kind: str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), classes: tuple[CharacterClass, ...] = CLASSES, allow: str = ALLOW) -> DataFrame:
    """``keep`` columns, ``base`` and ``found``: arrays of (start, order, end, kind), by start, then kind as listed.

    ``base`` has the kinds assign, access and hex; ``found`` has them and the entropy kinds, where no
    base span lies.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = kept_names(keep, ("base", "found", "_t", "_base", *(f"_c{k}" for k in range(len(classes)))))
    ours = docs.select(*[col(k).alias(n) for k, n in zip(keep, own, strict=True)], t.alias("_t"))
    t, low = F.col("_t"), F.lower("_t")
    test = low.contains(WORDS[0])
    for w in WORDS[1:]:
        test = test | low.contains(w)
    assign = F.filter(_matches(t, ASSIGN, test, 2), lambda x: F.length(x["g"]) >= 8)
    ours = ours.withColumn("_base", F.array_sort(F.concat(_spans(assign, "assign", 0), _spans(_matches(t, ACCESS, t.contains("AKIA")), "access", 1), _spans(_matches(t, HEX, F.lit(True)), "hex", 2))))
    more = []
    for k, c in enumerate(classes):
        ours = ours.withColumn(f"_c{k}", _matches(t, c.pattern, F.lit(True)))
        free = F.filter(F.col(f"_c{k}"), lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        more.append(_spans(F.filter(free, _dense(c, allow)), c.kind, 3 + k))
    return ours.select(*own, F.col("_base").alias("base"), F.array_sort(F.concat(F.col("_base"), *more)).alias("found"))


def _dense(c: CharacterClass, allow: str):
    """Whether a piece of a candidate between what the allow-list explains has a dense window."""
    return lambda x: F.exists(F.split(x["w"], allow, -1), lambda piece: (F.length(piece) >= c.window) & (max_entropy(piece, c) >= c.bits - 1e-9))


def secret_digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        *keep,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("found")).alias("spans"),
    )
