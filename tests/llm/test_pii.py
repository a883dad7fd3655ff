import hashlib
import math
import random
import re

from trovana.llm.pii import KINDS, base_spans, entity, find_personal_data, pii_digest, sanitised

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(d[::-1])) % 10 == 0


def fits(k, s):
    d = re.sub("[^0-9]", "", s)
    return (True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else False, 13 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]


def brute(t):
    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if fits(k, m[0])]


TEXTS = [
    None,
    "",
    "a@b.co, x@@y.zz a.b%+c@d-e.f.g.h. @no.pe q@nodot z@a.b@c.d",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000",
    "+1 (456) 555-2186 +49.30.123456 +1 +12 () .-",
    "+1+1234567890 ++44 20 7946 0958é",
    "word" * 20_000,
    "7" * 20_000 + "." + "7" * 300,
]


def test_base_spans_equal_the_patterns(spark, testdata):
    texts = [t or "" for t in TEXTS[:7]] + [r["text"] for r in spark.read.parquet(f"{testdata}/sf0.001/documents.parquet").collect()]
    for t in texts:
        assert base_spans(t) == brute(t), t[:200]
    assert sum(len(base_spans(t)) for t in texts) > 20


def test_rows_and_digests(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None)]
    got = pii_digest(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, base string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        found = base_spans(TEXTS[r["doc_id"]] or "")
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["spans"].startswith(line)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[0] == n for x in found) for n in range(4)]


def test_terms_that_reveal(spark):
    rows = [(i, f"number {'abcdefghij'[i]} the harbourmaster wrote from ann@port.example.com in the morning {i}") for i in range(6)]
    rows += [(100 + i, f"in the morning the people wrote letters {i}") for i in range(600)]
    rows += [(50, rows[0][1])]
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = lambda i: {dict(rows)[i][x["s"] : x["z"]] for x in got[i]["terms"]}
    assert words(0) == {"number", "harbourmaster", "from"} == words(50)
    assert not words(100)
    assert got[100]["sanitised"] is None
    assert got[0]["sanitised"] == sanitised(rows[0][1], got[0]["base"], got[0]["terms"]) == "<TERM> a the <TERM> wrote <TERM> <EMAIL> in the morning 0"


def brute_terms(rows, min_texts=3, min_share=0.5, min_bits=6.0):
    """{id: spans of revealing words}, by sets of texts."""
    word = re.compile(r"[^\W\d_]{3,}")
    texts = {t or "" for _, t in rows}
    of_w, of_e, pairs = {}, {}, {}
    free = {}
    for t in texts:
        spans = brute(t)
        for w in {m[0].lower() for m in word.finditer(t.lower())}:
            of_w.setdefault(w, set()).add(t)
        es = {entity(k, t[a:z]) for k, a, z in spans}
        free[t] = [m.span() for m in word.finditer(t) if not any(a < m.end() and m.start() < z for _, a, z in spans)]
        for e in es:
            of_e.setdefault(e, set()).add(t)
            for w in {t[a:z].lower() for a, z in free[t]}:
                pairs.setdefault((e, w), set()).add(t)
    told = set()
    for (e, w), ts in pairs.items():
        share = len(ts) / max(len(of_w.get(w, ())), len(ts))
        if len(ts) >= min_texts and share >= min_share and math.log2(share * len(texts) / len(of_e[e])) >= min_bits:
            told.add((e, w))
    out = {}
    for i, t in rows:
        es = {entity(k, (t or "")[a:z]) for k, a, z in brute(t or "")}
        out[i] = [(a, z) for a, z in free[t or ""] if any((e, t[a:z].lower()) in told for e in es)]
    return out


def test_terms_equal_brute_force(spark):
    rnd = random.Random(3)
    people = [(f"{n}@mail.example", [f"{n}{x}" for x in ("ville", "works", "son")]) for n in ("anna", "boris", "clara", "dario")]
    common = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(900):
        ws = [rnd.choice(common) for _ in range(rnd.randint(3, 12))]
        if rnd.random() < 0.03:
            address, own = rnd.choice(people)
            ws += [address, *rnd.sample(own, 2), own[0].upper()]
            rnd.shuffle(ws)
        if rnd.random() < 0.01:
            ws.append(rnd.choice(people)[1][1])
        rows.append((i, " ".join(ws)))
    held = [r for r in rows if "@" in r[1]]
    rows += [(1000 + i, held[0][1]) for i in range(50)] + [(2000, None), (2001, "")]
    got = {r["doc_id"]: [(x["s"], x["z"]) for x in r["terms"]] for r in find_personal_data(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, held int"), keep=("doc_id", "held")).collect()}
    want = brute_terms(rows)
    assert got == want and sum(map(len, want.values())) > 50


def test_copies_count_once(spark):
    rows = [(i, f"{w} pilot kestrel ann@port.example.com") for i, w in enumerate(("red", "green", "blue"))]
    rows += [(1000 + i, f"plain words {i}") for i in range(400)]
    rows += [(2000 + i, rows[0][1]) for i in range(2000)]
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    words = lambda i: {dict(rows)[i][x["s"] : x["z"]] for x in got[i]["terms"]}
    assert words(0) == words(1) == words(2) == words(3999) == {"pilot", "kestrel"} and not words(1000)


def test_terms_far_from_the_entity(spark):
    filler = "the people wrote letters in the morning " * 20
    rows = [(i, f"Osprey {w} {filler} ann@port.example.com and later osprey again {filler} osprey") for i, w in enumerate(("red", "green", "blue"))]
    rows += [(1000 + i, f"{filler} and later again {i}") for i in range(400)]
    rows += [(2000, "an osprey without the address")]
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(3):
        text = rows[i][1]
        assert [(x["s"], x["z"]) for x in got[i]["terms"]] == [m.span() for m in re.finditer("[Oo]sprey", text)]
        assert "osprey" not in sanitised(text, got[i]["base"], got[i]["terms"]).lower()
    assert not got[1000]["terms"] and not got[2000]["terms"]


def test_empty_table(spark):
    assert pii_digest(find_personal_data(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
