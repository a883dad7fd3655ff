import hashlib
import random

import numpy as np

from trovana.llm.suffix_dedup import remove_repeats, repeats, suffix_array


def brute(rows, length=50):
    """rows: (id, text); the contract by dictionaries."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mine(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as b", "1 as s")
    return sorted((tuple(r) for r in remove_repeats(df, digests=True).collect()), key=str)


def test_documents(spark, testdata):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").collect()]
    got = mine(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


def test_hard_texts(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    base = [word(49), word(50), word(51), word(60), word(120), word(400)]
    rows = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 50), (4, "a" * 300), (5, "ab" * 100), (6, "ba" * 60), (7, "abc" * 80)]
    for i in range(10, 90):
        parts = [rnd.choice(base) if rnd.random() < 0.6 else word(rnd.randint(1, 80)) for _ in range(rnd.randint(1, 5))]
        rows.append((i, "".join(parts)))
    rows += [rows[20], (None, rows[30][1]), (None, rows[31][1])]
    assert mine(spark, rows) == brute(rows)


def test_rows_of_one_id_are_told_apart(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, x, y = word(80), word(60), word(200)
    rows = [(1, a), (2, a + x), (2, y), (2, y), (3, y[20:120] + a), (None, a + y), (None, x + y), (None, x + x)]
    got = mine(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got if r[0] == 2) == 80


def test_long_text_is_cut_with_overlaps(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh") for _ in range(2_300_000))
    rows = [(1, long[1_048_500:1_048_650]), (2, long), (3, long[2_097_100:2_097_160])]
    got = {r[0]: r for r in mine(spark, rows)}
    assert got[1][2] == 0 and got[2][2] == 150 and got[2][3] == 1 and got[3][2] == 60


def test_empty_table(spark):
    assert mine(spark, []) == []


def test_maximal_repeats_are_the_branching_ones():
    texts = [b"xbananay", b"zbananaw", b"banan"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.array([0, 8, 16, 21])
    owner = np.repeat([0, 1, 2], [8, 8, 5])
    at = np.arange(21)
    order, lcp = suffix_array(data, at, starts[owner + 1])
    suffixes = [bytes(data[at[o] : starts[owner[o] + 1]]) for o in order]
    assert suffixes == sorted(suffixes)
    before = np.where(at[order] > starts[owner[order]], data[np.maximum(at[order] - 1, 0)].astype(int), -1)
    found = {suffixes[a][:n]: z - a + 1 for a, z, n, _ in repeats(lcp, before, owner[order], 3)}
    assert found == {b"banana": 2, b"banan": 3, b"ana": 5} or found == {b"banana": 2, b"banan": 3, b"ana": 5, b"anan": 3}, found


def test_texts_move_once(spark):
    a = "".join(random.Random(5).choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, a), (2, "x" + a[40:200]), (3, a[100:] + "y")], "doc_id long, text string")
    out = remove_repeats(df, digests=True)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_crowded_anchors_are_compared_by_suffix_and_in_chunks(spark):
    """One 20-byte string in 400 surroundings, and a passage whose places don't fit one array: no array holds them all."""
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    gram, near, passage = word(20), [word(15) for _ in range(6)], word(70)
    rows = [(i, word(9) + rnd.choice(near) + gram + rnd.choice(near) + word(9)) for i in range(400)]
    rows += [(i, word(20) + passage + word(20)) for i in range(400, 700)] + [(None, rows[5][1]), (3, passage), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for crowd, chunk in ((5, 40), (5, 10**6), (10**6, 40)):
        got = sorted((tuple(r) for r in remove_repeats(df, digests=True, crowd=crowd, chunk=chunk).collect()), key=str)
        assert got == want


def test_a_task_has_one_bucket_and_collects_no_lists_of_texts(spark):
    df = spark.createDataFrame([(1, "a" * 90), (2, "b" + "a" * 90)], "doc_id long, text string")
    plan = remove_repeats(df, digests=True)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(struct" not in plan and "collect_list(anchors" not in plan
