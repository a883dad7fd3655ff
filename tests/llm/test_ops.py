"""Small tables with every odd case, held against brute force."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trovana.llm.bpe import BpeModel, bpe_codec
from trovana.llm.common import components
from trovana.llm.decontaminate import decontaminate
from trovana.llm.embedding_dedup import dedup_embeddings
from trovana.llm.line_dedup import drop_recurring_lines
from trovana.llm.ngram_join import near_duplicates
from trovana.llm.toxicity import SLOTS, calibrate, choose_slots, features, fit_nnpu, margins, text_margins, toxicity_scores
from trovana.llm.url_filter import Rule, filter_urls

PATH = public_tokenizers.path("word_bpe_49k.json")


def reach(nodes, links):
    """The smallest node reachable from each."""
    low = {n: n for n in nodes}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] is not None and x[0] != x[1]]
    want = reach({n for x in real for n in x}, real)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from trovana.llm.common import heavy_join

    rows = spark.range(40_000).select(F.when(F.col("id") % 10 < 6, 7).when(F.col("id") % 10 == 9, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how, n in (("left", 40_000), ("inner", 36_000)):
            out = heavy_join(rows, lookup, "k", "n", 40_000, how, hot=100)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(_key" in plan and all("_salt" in line for line in plan.splitlines() if "hashpartitioning(_key" in line)
            sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(sizes) == n and max(sizes) < 2 * n / 4
            assert {(r["k"], r["most"]) for r in out.where("k = 7 or k is null").distinct().collect()} == {(7, 39_995)} | ({(None, None)} if how == "left" else set())
            assert out.where("k <> 7 and most <> v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- vectors


def test_vectors(spark):
    rnd = np.random.default_rng(1)
    rows, k = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = rnd.normal(size=8)
            for _ in range(rnd.integers(1, 9)):
                noise = rnd.normal(size=8) * rnd.choice([0, 0.02, 0.05, 0.08])
                rows.append((k, [float(np.float32(x)) for x in base + noise * np.linalg.norm(base) / 3], label))
                k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 8, 1), (k + 2, [float("nan")] + [1.0] * 7, 1), (k + 3, [None, 1.0], 1), (k + 4, [], 1), (k + 5, [1.0, 2.0], 1), (k + 6, rows[0][1], 1), (k + 7, [float("inf")] * 8, 2), (None, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, n long, links long")

    def usable(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [r for r in rows if usable(r)]
    unit = {r[0]: np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) for r in good}
    links = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] >= 0.98]
    low = reach([r[0] for r in good], links)
    want = {(r[0], sum(r[0] in x for x in links) if usable(r) else 0, low.get(r[0], r[0]), r[0] is not None and low.get(r[0], r[0]) == r[0]) for r in rows}
    for target, block in ((512, 1024), (4, 3)):  # one cell; many cells of many blocks
        assert {tuple(r) for r in dedup_embeddings(df, target=target, block=block).collect()} == want
    assert len(links) > 30
    assert dedup_embeddings(df.limit(0)).count() == 0


# --- near duplicates


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_near_duplicates(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, 12)):
            copy = [word() if rnd.random() < rnd.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((k, " ".join(copy)))
            k += 1
    hub = [word() for _ in range(200)]
    for _ in range(80):  # many copies, some beyond the threshold
        rows.append((k, " \n".join(word() if rnd.random() < 0.02 else w for w in hub)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t"), (k + 3, "One two"), (k + 4, "one\x0btwo"), (k + 5, "É a b c d"), (k + 6, "é a b c d"), (k + 7, "x " * 3000), rows[3], (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, n int, node int")
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = reach(ids, links)
    got = [tuple(r) for r in near_duplicates(df).collect()]
    assert len(got) == len(rows)
    assert {r for r in got if r[0] is not None} == {(i, len(sets[i]), low[i]) for i in ids}
    assert [r[2] for r in got if r[0] is None] == [low[3]]
    assert near_duplicates(df.limit(0)).count() == 0


def test_rows_of_a_list_share_blocks(spark):
    """A list goes to a block for each 64 of its rows; the pairs to compare are those of brute force."""
    from collections import Counter

    from pyspark.sql import functions as F

    from trovana.llm.ngram_join import _near, cross_blocks

    rows = [(1, k, 9, 0, k // 2, k >= 2, 600) for k in range(600)]
    rows += [(10 + k // 2, 1000 + k, 9, 0, k, bool(k % 2), 2) for k in range(6000)]
    rows += [(2, k, 9, 0, k // 2, k >= 2, 40) for k in range(40)]
    mixed = spark.createDataFrame(rows, "token long, node long, n int, pos int, comp long, out boolean, size long").cache()
    found, members = cross_blocks(mixed, 80, 100)
    pairs = sorted((min(x, r["y"]), max(x, r["y"])) for r in found.collect() for x in r["xs"])
    x, y = mixed.alias("x"), mixed.alias("y")
    both = x.join(y, F.col("x.token") == F.col("y.token")).where("x.node < y.node and x.comp <> y.comp and (x.out or y.out)").where(_near("x", "y", 80, 100))
    assert pairs == sorted((r[0], r[1]) for r in both.select("x.node", "y.node").distinct().collect())
    blocks = {r["x"]: r["block"] for r in members.collect()}
    assert len(blocks) == 598 + 3000
    assert len({blocks[k] for k in range(2, 600)}) <= 12
    assert max(Counter(blocks.values()).values()) <= 200


def test_what_a_pivot_has_settled_is_not_compared_again(spark, monkeypatch):
    """Two texts that share prefix tokens but don't link leave a list of two after the first round."""
    from trovana.llm import ngram_join

    rest = []
    real = ngram_join.cross_blocks
    monkeypatch.setattr(ngram_join, "cross_blocks", lambda mixed, num, den: (rest.append((mixed.count(), mixed.groupBy("token").count().count())), real(mixed, num, den))[1])
    part = lambda *of: " ".join(f"{p}{k}" for p in of for k in range(60))
    texts = [part(*of) for g in range(12) for of in ((f"a{g}x", f"b{g}x"), (f"b{g}x", f"c{g}x"), (f"c{g}x", f"a{g}x"))]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(k, 116, k) for k in range(36)]
    assert rest == [(0, 0)]


def test_few_edges_are_not_dealt_over_hundreds_of_files(spark, monkeypatch):
    """A session's shuffle partitions don't make each round of components as many tasks and files."""
    from trovana.llm import common

    files, real = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda *a: (out := real(*a), files.append(len(out.inputFiles())))[0])
    links = [(k, k + 1) for k in range(0, 900) if k % 30 != 29]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = common.components(spark.createDataFrame(links, "a long, b long"), rows=len(links)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert {(r["node"], r["component"]) for r in got} == {(k, k // 30 * 30) for k in range(900)}
    assert len(got) == 900
    assert max(files) <= spark.sparkContext.defaultParallelism


def test_groups_and_more_links(spark):
    from trovana.llm.common import components, materialise
    from trovana.llm.ngram_join import joined_groups

    old, new = [(5, 9), (9, 7), (20, 21), (-3, 40)], [(7, 21), (50, 51), (40, -8)]
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    groups = materialise(components(edges(old)), "test-groups")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(joined_groups(groups, edges(new))) == rows(components(edges(old + new)))
    assert rows(joined_groups(groups.limit(0), edges(new))) == rows(components(edges(new)))
    assert rows(joined_groups(groups, edges([]))) == rows(groups)


def test_counts_of_few_texts_are_short():
    """What a task sends of its counts grows with its texts; sums are those of whole tables."""
    from trovana.llm.ngram_join import SLAB, counts_added, counts_packed

    rnd = np.random.default_rng(5)
    tables = [np.where(rnd.random(SLAB) < share, rnd.integers(1, 90_000, SLAB), 0).astype(np.int32) for share in (0, 0.001, 0.1, 0.66, 0.67, 1)]
    blobs = [counts_packed(t) for t in tables]
    assert len(blobs[1]) < 300
    assert max(map(len, blobs)) == 4 * SLAB
    assert all((counts_added([b]) == t).all() for b, t in zip(blobs, tables, strict=True))
    total = sum(t.astype(np.int64) for t in tables)
    assert (counts_added(blobs) == total).all()
    assert (counts_added([total.tobytes(), *blobs]) == 2 * total).all()


def test_shuffles_of_a_written_table_go(spark):
    from trovana.llm.common import bucketed, discard, materialise

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}

    before = held()
    rows = spark.range(1000).selectExpr("id % 70 as node", "id").groupBy("node").count()
    made = materialise(rows, "test-shuffles"), bucketed(rows, "node", 4, "test-shuffles")
    assert not held() - before
    assert all(m.count() == 70 for m in made)
    discard(*made)


def test_one_row_of_a_key_in_buckets(spark):
    from trovana.llm.common import bucketed, discard

    out = bucketed(spark.range(1000).selectExpr("id % 70 as node", "'x' as tokens"), "node", 4, "test-unique", unique=True)
    assert sorted(r["node"] for r in out.collect()) == list(range(70))
    discard(out)


def test_a_row_without_an_id_links_others(spark):
    base = [f"w{i}" for i in range(104)]
    change = lambda ws, at: " ".join("zz" if i in at else w for i, w in enumerate(ws))
    a, m, z = change(base, {2}), change(base, {2, 50}), change(base, {2, 50, 99, 70})
    sets = [shingle_set(t) for t in (a, m, z)]
    like = lambda x, y: len(x & y) / len(x | y)
    assert like(sets[0], sets[1]) >= 0.8 <= like(sets[1], sets[2]) and like(sets[0], sets[2]) < 0.8
    got = near_duplicates(spark.createDataFrame([(1, a), (None, m), (3, z), (3, "something else"), (4, "something else")], "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, 100, 1), (None, 100, 1), (3, 100, 1), (3, 1, 3), (4, 1, 3)], key=str)


# --- encoding


def test_encoding_is_the_librarys(spark):
    texts = [None, "", "Hello  WORLD don't", "<|endoftext|>x<|startoftext|>", "aaaaaaaaaaaa", "ΑΣ Σ ß İ 日本 ½ 😀\x1c", "a" * 50_000, "x \n" * 2000, "naïve café"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as n_tokens")
    t = Tokenizer.from_file(PATH)
    for r in bpe_codec(df, PATH).collect():
        e = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False))
    assert BpeModel(open(PATH, encoding="utf-8").read()).decode(e.ids) == t.decode(e.ids, skip_special_tokens=False)
    assert bpe_codec(df.limit(0), PATH, digests=True).count() == 0


# --- decontamination


def test_words_that_come_again_are_merged_once(monkeypatch):
    from trovana.llm import bpe

    monkeypatch.setattr(bpe, "MEMORY", 30)
    model = BpeModel(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    merged, plain = [], model.merge
    monkeypatch.setattr(model, "merge", lambda words: merged.extend(words) or plain(words))
    for k in range(20):
        text = "the same words " + " ".join(f"w{k}x{i}" for i in range(10))
        assert list(model.encode([text]))[0][0] == " ".join(map(str, model.library.encode(text, add_special_tokens=False).ids))
        assert len(model.known) + len(model.older) < 200
    words = model.words("the same words")
    assert len(words) == 3 and all(merged.count(w) == 1 for w in words)


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(6)
    words = [w for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa é 12".split()]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 3, 9, 10, 11, 30))] + [(7, None), (8, "..."), (9, None), (10, "")]
    items.append((11, items[6][1]))
    items = [(f"it's \\{i}\" ${{x}}" if i in (2, 6) else str(i), t) for i, t in items] + [(None, items[6][1])]
    docs = [(0, None), (1, ""), (2, "ALPHA, beta!"), (3, items[6][1].upper()), (4, items[5][1] + " . " + items[4][1])]
    docs += [(i, "-".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(5, 40)] + [(41, "zz " * 30_000 + items[6][1]), (3, "other words")]

    def split(t):
        out, cur = [], ""
        for c in t or "":
            c = c.lower() if "A" <= c <= "Z" else c
            if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
                out.append(cur)
                cur = ""
            else:
                cur += c
        return [w for w in [*out, cur] if w]

    def want(text):
        w, hit, found = split(text), set(), set()
        for i, t in items[:-1]:
            x = split(t)
            n = min(10, len(x))
            for k in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(i)
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    bench = spark.createDataFrame(items, "item_id string, text string")
    docs += [(60, docs[3][1])] * 40
    df = spark.createDataFrame([(*d, 0, i) for i, d in enumerate(docs)], "doc_id long, text string, w int, n_words int")
    for longs in (1 << 16, 1):  # a filter that tells, and one that lets everything through
        monkeypatch.setattr("trovana.llm.decontaminate.FILTER", longs)
        got = sorted(tuple(r) for r in decontaminate(df, bench).collect())
        assert got == sorted((i, *want(t)) for i, t in docs)
    kept = decontaminate(df, bench, keep=("doc_id", "n_words", "w"))
    assert kept.columns[:4] == ["doc_id", "kept_n_words", "w", "n_words"]
    assert sorted(r["kept_n_words"] for r in kept.collect()) == list(range(len(docs)))
    assert {r["n_hit"] for r in decontaminate(df, bench.limit(0)).collect()} == {0}
    assert decontaminate(df.limit(0), bench).count() == 0


# --- lines


def test_lines(spark):
    rows = [(i, f"unique {chr(97 + i)} opening {chr(98 + i)} of this text\nServed by node {i} at 10.0.0.{i}\nand a long {chr(97 + i)} line that only {chr(98 + i)} document has in it, really") for i in range(8)]
    rows += [(20 + i, f"user {n} logged in from home\nthe {n} story goes on for quite a while, in words of {n}") for i, n in enumerate(("ann", "bob", "cat", "dan", "eve", "fay"))]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, rows[1][1]), (44, rows[1][1]), (45, "served by node 1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, form int")
    got = {r["doc_id"]: r for r in drop_recurring_lines(df, min_docs=4).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "form", "_n_lines", "_n_dropped"}
    # all three lines of each have fields: one with digits, two with two fields of words
    assert got[0]["text"] == rows[0][1] and got[3]["text"] == "" and got[43]["text"] == got[44]["text"] == ""
    assert got[20]["text"] == rows[8][1] and got[23]["text"] == ""
    assert got[40]["text"] is None and got[41]["text"] == "" and got[42]["text"] == "\n\n" and got[45]["text"] == rows[-1][1]
    assert drop_recurring_lines(df.limit(0)).count() == 0


def brute_lines(rows, min_docs=2, depth=3, min_values=5, ratio=0.5):
    """(id, text) rows -> texts without recurring lines, by dictionaries."""
    star = lambda w: "<*>" if any(c.isdecimal() for c in w) else w
    form = lambda line: tuple(star(w) for w in line.split())
    docs = [(i, t, [form(x) for x in (t or "").split("\n")]) for i, t in rows]
    forms = {f for _, _, fs in docs for f in fs if f}
    texts = {f: set() for f in forms}
    first = {f: math.inf for f in forms}
    for i, t, fs in docs:
        for f in fs:
            if f:
                texts[f].add(t)
                first[f] = min(first[f], math.inf if i is None else i)
    leaves = {}
    for f in forms:
        for way in range(depth if len(f) > depth else 0):
            leaves.setdefault((len(f), way, f[:way], f[way + 1 : depth]), set()).add(f)
    members = {}
    for leaf, fs in leaves.items():
        count = {}
        places = {f: [(k, f[k]) for k in range(len(f)) if k >= depth or k == leaf[1]] for f in fs}
        for ps in places.values():
            for p in ps:
                count[p] = count.get(p, 0) + 1
        for f, ps in places.items():
            m = sorted((count[p] for p in ps), reverse=True)[(len(ps) + 1) // 2 - 1]
            shape = tuple(p if count[p] >= ratio * m else None for p in ps)
            if len(fs) >= min_values and m >= min_values and None in shape:
                members.setdefault((leaf, shape), set()).add(f)
    least = {f: first[f] for f in forms if len(texts[f]) >= min_docs}
    for fs in members.values():
        if len(fs) >= min_values and len(set().union(*(texts[f] for f in fs))) >= min_docs:
            for f in fs:
                least[f] = min(least.get(f, math.inf), min(first[x] for x in fs))
    keep = lambda i, f: f not in least or least[f] in (i, math.inf)
    return sorted(((i, "\n".join(x for x, f in zip(t.split("\n"), fs, strict=True) if keep(i, f)) if t else t) for i, t, fs in docs), key=str)


def test_lines_equal_brute_force(spark, testdata):
    rnd = random.Random(8)
    pick = lambda p: "".join(rnd.choice(p) for _ in range(rnd.randint(2, 9)))
    makers = [
        lambda: f"session opened for {pick('abc')} at gate {pick('rome')} by {pick('xyz')} desk",
        lambda: f"user {pick('abcdef')} logged {pick('ghijkl')} {pick('mnop')} in from {pick('qrst')} this fine day as usual",
        lambda: "the " + " ".join(pick("aeiou") for _ in range(rnd.randint(1, 12))),
        lambda: f"the {rnd.choice(['cat', 'dog'])} sat on mat number {rnd.randint(1, 99)} with {rnd.choice(['ann', 'bob', 'cat', 'dan', 'eve', 'fay', 'gil'])}",
        lambda: rnd.choice(["a line of several documents", "\t another\u00a0one ", "", " ", "x", "7", "Ж１ d"]),
    ]
    rows = [(i, "\n".join(rnd.choice(makers)() for _ in range(rnd.randint(1, 9)))) for i in range(150)]
    rows += [(None, rows[3][1]), (None, "only nameless\nwith two"), (None, "only nameless\nand three"), rows[5], (5, rows[6][1]), (200, None), (201, ""), (202, "x" * 300_000 + "\n" + "y " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id long, text string, th int, _n_lines string")
    got = drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "th", "kept__n_lines", "_n_lines", "_n_dropped"]
    out = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert out == brute_lines(rows)
    holds = lambda x: sum(x in (t or "") for _, t in out)
    assert holds("session opened") == 1 and holds("this fine day") == 1 and holds("only nameless") == 2
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").collect()]
    got = sorted(((r["doc_id"], r["text"]) for r in drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute_lines(docs)


def test_texts_move_without_the_lines(spark):
    out = drop_recurring_lines(spark.createDataFrame([(1, "a b c d\nx"), (2, "a b c d\ny"), (3, None)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["text"], r["_n_dropped"]) for r in out.collect()) == [(1, "a b c d\nx", 0), (2, "y", 1), (3, None, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "leaves" not in plan and "SortMergeJoin" not in plan


def test_texts_that_lose_nothing_stay_where_they_are(spark):
    rows = [(i, f"own{chr(97 + i)} line{chr(97 + i)} here\nother{chr(97 + i)}") for i in range(20)] + [(20, "one line that stands twice\nx"), (21, "one line that stands twice\ny"), (22, None), (23, "")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, at int")
    out = drop_recurring_lines(df)
    want = {i: t for i, t in rows} | {21: "y"}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert sorted((r["doc_id"], r["_n_lines"], r["_n_dropped"], r["at"]) for r in out.collect()) == [(i, 2 if t else 0, int(i == 21), 7) for i, t in rows]
    branches = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[1:]
    assert len(branches) == 1 and branches[0].count("Join") == 1  # one branch has no join, so nothing of it moves


def test_places_that_cannot_be_constant_do_not_travel(spark):
    from collections import Counter

    from trovana.llm.line_dedup import fields, frequent

    rnd = random.Random(8)
    rows = []
    for form in range(400):
        leaf, n = form % 7, rnd.randint(1, 9)
        own = [rnd.getrandbits(62) if rnd.random() < rnd.choice([0.1, 0.4, 0.9]) else 100_000 * leaf + 100 * k + n for k in range(n)]
        rows.append((form, leaf, own))
    found = spark.createDataFrame(rows, "form long, leaf long, places array<long>")
    every = Counter(p for r in rows for p in r[2])
    counts = spark.createDataFrame([(p, c) for p, c in every.items() if c >= 2.5], "place long, c long")
    got = {r["form"]: r for r in frequent(found, counts).collect()}
    for form, leaf, places in rows:
        common = [p for p in places if every[p] >= 2.5]
        assert (form in got) == (2 * len(common) >= len(places)), form  # no other bit is hit by chance here
        if form in got:
            assert (got[form]["leaf"], got[form]["size"], got[form]["places"]) == (leaf, len(places), common)
    want = set()
    for form, leaf, places in rows:
        m = sorted((every[p] for p in places), reverse=True)[(len(places) + 1) // 2 - 1]
        if m >= 5 and any(every[p] < 0.5 * m for p in places):
            want.add(form)
    assert want and {r["form"] for r in fields(found, 5, 0.5).collect()} == want
    assert fields(found.limit(0), 5, 0.5).count() == 0


def test_lines_that_are_most_of_a_document(spark):
    passage = "\n".join(f"{w} passage that every one of these documents carries, word by word" for w in ("this", "that", "such"))
    rows = [(i, f"{passage}\nown {chr(97 + i)}{chr(98 + i)}") for i in range(25)] + [(30, passage)]
    got = {r["doc_id"]: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["_n_dropped"] == 0
    for i, text in rows[1:25]:
        assert got[i]["text"] == text.split("\n")[-1] and got[i]["_n_dropped"] == 3
    assert got[30]["text"] == "" and got[30]["_n_dropped"] == 3


def test_lines_planted_with_the_defaults(spark):
    words = lambda k, n: " ".join(hashlib.md5(f"{k} {j}".encode()).hexdigest().translate({48 + d: 103 + d for d in range(10)})[:7] for j in range(n))
    planted = {n: words(f"planted in {n}", 60) for n in (1, 2, 3, 19)}
    rows = [(i, "\n".join([words(i, 30), *(p for n, p in planted.items() if i < n), words(-i - 1, 30)])) for i in range(19)]
    rows += [(50, rows[0][1])]
    got = {r["doc_id"]: r["text"].split("\n") for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "\n".join(got[0]) == rows[0][1]
    for i, text in rows[1:19]:
        assert got[i] == [text.split("\n")[0], text.split("\n")[-1]]
    # the text that stands once, copies aside, keeps its own line in both
    assert planted[1] in got[50] and not {planted[2], planted[3], planted[19]} & set(got[50])


# --- urls


def test_urls(spark):
    rules = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"))
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "https://a.example.com/en/8#y", "http://xexample.com/en/7", "ftp://com/en/", "http://com", "a://b://c/d?e://f", "http://É.com/en/1"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules).collect()}
    assert [got[i][:2] for i in (0, 1, 2)] == [("", "")] * 3
    assert got[3] == ("example.com", "/en/7", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block") and got[5][2:] == ("com/en/", "block")
    assert got[6] == ("com", "/en/", "com/en/", "block") and got[7][:3] == ("com", "", None) and got[8][:2] == ("b:", "//c/d") and got[9][0] == "É.com"
    many = [(i, f"http://h.com/en/{'abc'[i % 3]}{i:04d}x/p") for i in range(90)] + [(100 + i, f"http://h.com/zz/{i}") for i in range(5)]
    out = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(many, "page_id long, url string"), rules).collect()}
    assert {out[i]["template"] for i in range(90)} == {"/en/*/p"} and out[100]["template"] == "/zz/*"
    assert filter_urls(df.limit(0), rules).count() == 0


def brute_verdicts(pages, max_children=20, rare=3.0, z=1.96, weight=5.0, purity=0.8):
    """(host, segments of the masked path, label) of each page -> {(host, segments): (template, rejected)}."""
    counts = {}
    for host, segs, label in pages:
        n, labelled, bad = counts.get((host, segs), (0, 0, 0))
        counts[host, segs] = n + 1, labelled + (label is not None), bad + (label == "block")
    t = {k: k[1] for k in counts}
    for d in range(max(len(x) for x in t.values())):
        kids = {}
        for (host, segs), x in t.items():
            if len(x) > d:
                c = kids.setdefault((host, x[:d]), {})
                c[x[d]] = c.get(x[d], 0) + counts[host, segs][0]
        wild = {k for k, c in kids.items() if len(c) > max_children and sum(c.values()) < rare * len(c)}
        t = {k: (*x[:d], "*", *x[d + 1 :]) if len(x) > d and (k[0], x[:d]) in wild else x for k, x in t.items()}

    class Node:
        def __init__(self):
            self.kids, self.own = {}, None

    roots, stats = {}, {}
    for k, x in t.items():
        at = roots.setdefault(k[0], Node())
        for seg in x:
            at = at.kids.setdefault(seg, Node())
        at.own = (k[0], x)
        a = stats.get((k[0], x), (0, 0))
        stats[k[0], x] = a[0] + counts[k][1], a[1] + counts[k][2]
    branch, ids = {}, iter(range(10**9))

    def total(ts):
        return sum(stats[x][0] for x in ts), sum(stats[x][1] for x in ts)

    def settle(ts):
        i = next(ids)
        for x in ts:
            branch[x] = i

    def main(at):
        """The templates below a node that are one with it; the others are settled."""
        groups = [main(c) for c in at.kids.values()] + ([[at.own]] if at.own else [])
        n, b = total([x for g in groups for x in g])
        out = []
        for g in groups:
            gn, gb = total(g)
            if n and gn and abs(gb - gn * (b / n)) > z * math.sqrt(gn * (b / n) * (1 - b / n)):
                settle(g)
            else:
                out += g
        return out

    for root in roots.values():
        settle(main(root))
    alln, allb = total(stats)
    out = {}
    for k, x in t.items():
        bn, bb = total([y for y in stats if branch[y] == branch[k[0], x]])
        hn, hb = total([y for y in stats if y[0] == k[0]])
        base = (hb + weight * (allb + 1) / (alln + 2)) / (hn + weight)
        out[k] = "/".join(x), bn > 0 and (bb + weight * base) / (bn + weight) >= purity
    return out


def test_url_tree_equals_brute_force(spark):
    rnd = random.Random(9)
    rules = (Rule("block", "bad.com", "/u/"), Rule("allow", "bad.com", "/ok/"), Rule("block", "h.com", "/x/b"), Rule("allow", "h.com", "/x/a"), Rule("allow", "h.com", "/x/b"), Rule("block", "h.com", "/spam"))
    word = lambda: "".join(rnd.choice("ghijklm") for _ in range(5))
    urls = []
    for host in ("bad.com", "h.com", "x.h.com", "other.org"):
        names = [word() for _ in range(60)]
        for _ in range(250):
            urls.append(f"http://{host}/" + rnd.choice([
                f"u/{rnd.choice(names)}/post/{word()}", f"ok/{rnd.randint(1, 9)}", f"x/{rnd.choice('abc')}{rnd.choice('de')}/{rnd.choice('fgh')}", "x", "x/a",
                f"spam/{rnd.choice('pq')}", f"spam{rnd.randint(0, 2)}/{rnd.choice('pq')}/{rnd.choice('rs')}/t", "", f"{word()}/deep/" + "/".join(word() for _ in range(4)),
            ]))
    urls += [None, "nothing", "http://deep.org/" + "a/" * 3000 + "z"] + [urls[0]] * 50
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r["page_id"]: r for r in filter_urls(df, rules, keep=("page_id", "host"), levels=5).collect()}
    assert len(got) == len(urls) and got[0]["kept_host"] == 1
    label = {r["page_id"]: next((x.verdict for x in sorted(rules, key=lambda x: -len(x.name)) if x.name == r["rule"]), None) for r in got.values()}
    segs = lambda p: tuple("*" if k and s.isdigit() else s for k, s in enumerate(p.split("/")))
    key = {i: (r["host"], s if len(s := segs(r["path"])) <= 5 else (*s[:4], "/".join(s[4:]))) for i, r in got.items()}
    want = brute_verdicts([(*key[i], label[i]) for i in got])
    for i, r in got.items():
        template, rejected = want[key[i]]
        assert r["template"] == template, urls[i]
        assert r["verdict"] == (label[i] or ("block" if rejected else "allow")), urls[i]
    assert got[0]["template"] and any(r["template"] == "/u/*/post/*" for r in got.values())
    assert {label[i] for i, u in enumerate(urls) if u and u.startswith("http://h.com/x/b")} == {"block"}
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got.values())


# --- toxicity


def test_toxicity_held_out(spark, testdata):
    docs, labels = (spark.read.parquet(f"{testdata}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity_scores(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = ([r["score"] for r in rows if truth[r["doc_id"]] == k] for k in (1, 0))
    above = np.searchsorted(np.sort(clean), toxic).sum() / (len(toxic) * len(clean))
    assert above > 0.9  # of a few hundred toxic rows; ten times as many give over 0.99
    assert sum(s >= 0.7 for s in clean) < 0.06 * len(clean)


def test_toxicity_odd_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "bad bad word", "good words here"] * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 2)) for i in range(120)] + [(None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity_scores(docs, labels).collect()}
    assert len(got) == 120 and got[2]["score"] > got[3]["score"] and got[0]["score"] == got[1]["score"]
    assert {r["score"] for r in toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_risk_estimator_beats_naive_labels():
    rnd = random.Random(1)
    text = lambda toxic: " ".join([rnd.choice("abcdefghijklmnop") * 4 for _ in range(30)] + ["vile"] * toxic)
    p = [features(text(1)) for _ in range(60)]
    u = [features(text(rnd.random() < 0.3)) for _ in range(600)]
    count = lambda docs: np.bincount(np.concatenate(docs), minlength=SLOTS)
    slots = choose_slots(count(p), count(u), len(p), len(u))
    places = lambda docs: [np.flatnonzero(np.isin(slots, d)) for d in docs]
    model = fit_nnpu(places(p), places(u), 0.3, slots)
    texts = [text(i % 2) for i in range(200)]
    test = places([features(t) for t in texts])
    model = calibrate(model, margins(model, test), np.arange(200) % 2, 0.7)
    assert ((model.score(margins(model, test)) >= 0.7) == (np.arange(200) % 2)).mean() > 0.99
    assert np.allclose(text_margins(model, model.dense(), [*texts, None]), [*margins(model, test), model.bias])


def test_features_are_words_and_beginnings():
    words = lambda *ws: set().union(*(set(features(w).tolist()) for w in ws))
    assert set(features("Vile, vile\u2014words; naïve\u00a0x1y").tolist()) == words("vile", "words", "naïve", "x", "y")
    long = "ab " * 400_000 + "c" * 1_200_000 + " de"
    assert set(features(long).tolist()) == words("ab", "c" * 1_200_000, "de")
    assert len(features(None)) == len(features("12 _ —")) == 0


# --- pipeline


@pytest.fixture(scope="module")
def small(spark, testdata, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{testdata}/sf0.001/{t}.parquet")
        if t == "documents":
            df = df.unionByName(df.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0)], df.schema))
        df.write.parquet(f"{d}/{t}.parquet")
    return str(d)


def test_pipeline_stage_by_stage(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, small)
        rows = after.collect()
        ids = [r["doc_id"] for r in rows]
        assert set(ids) <= set(before)
        if name != "bpe_encoding":
            assert after.columns == columns and None in ids and 9001 in ids
        if name == "toxicity":
            scored = {r["doc_id"] for r in toxicity_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
            assert set(ids) == set(before) - scored
        if name == "line_dedup":
            assert len(rows) == docs.count() and all((r["n_chars"] or 0) == len(r["text"] or "") for r in rows)
        if name == "ngram_jaccard":
            sets = {i: shingle_set(r["text"]) for i, r in before.items() if i is not None}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            low = reach(sets, links)
            assert sorted(i for i in ids if i is not None) == sorted(i for i in low if low[i] == i)
        if name == "benchmark_decontamination":
            hit = {r["doc_id"] for r in decontaminate(docs, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated").collect()}
            assert set(ids) == set(before) - hit
        if name == "bpe_encoding":
            t = Tokenizer.from_file(PATH)
            for r in rows:
                e = t.encode(before[r["doc_id"]]["text"] or "", add_special_tokens=False)
                assert r["ids"] == e.ids and r["n_tokens"] == len(e.ids)
                assert r["decoded_sha256"] == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
            break
        after.write.parquet(f"{small}/{name}.out")
        docs = spark.read.parquet(f"{small}/{name}.out")


def test_stages_with_odd_tables(spark, small):
    import corpus_pipeline as c

    rows = [(i, f"a text of its own, number {chr(97 + i)}{chr(98 + i)}, with words that {chr(99 + i)} has\nand a line of all", "en", "s", 5) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, "long " * 60_000 + "x" * 300_000, "en", "s", 1), (None, rows[0][1], "en", "s", 5), (3, "another text for an id that stands twice", "en", "s", 3), rows[4]]
    clashing = ("score", "held_out", "n_words", "contaminated", "_at", "th", "key", "rest", "row", "ids", "n_tokens", "node", "_n_dropped", "a`b.c")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"1 as `{x.replace('`', '``')}`" for x in clashing))
    for name, stage in c.STAGES:
        got = stage(spark, docs, small)
        assert name == "bpe_encoding" or got.columns == docs.columns
        ids = sorted((r["doc_id"] for r in got.collect()), key=str)
        if name == "ngram_jaccard":  # one row of each id, and the row without one
            assert ids == sorted([*range(12), 20, 21, 22, None], key=str)
        else:
            assert ids == sorted((r[0] for r in rows), key=str)
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"].count("a line of all") for r in got.where("doc_id < 12 and doc_id <> 3").collect()} == {i: int(i == 0) for i in range(12) if i != 3}
        assert stage(spark, docs.limit(0), small).count() == 0
