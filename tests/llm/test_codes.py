"""Operators 11 to 13: small tables with every odd case, held against brute force and the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from trovana.llm import vector_codes
from trovana.llm.hard_negatives import mine_hard_negatives
from trovana.llm.piece_codec import BLANK, CharacterMap, PieceModel, piece_codec
from trovana.llm.vector_codes import code_vectors, levels, nearest

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "é", "▁", "日本", "😀", "\u0000", "<s>", "</s>", "<unk>", "<0x41>", "1", "23", "m²", "½", "ﬁ", "한국어", "​", "�", "$$$", "_", ".\n"]


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as f:
        return PieceModel(f.read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_and_spans_are_the_librarys(pieces):
    model, library = pieces
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(600)] + [" " * n for n in range(40)] + ["x" * 500, "ab " * 400, "word" + "y" * 3000]
    for t, (ids, spans) in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        assert [tuple(s) for s in spans.tolist()] == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_words_by_themselves_equal_whole_texts(pieces):
    model, _ = pieces
    assert model.by_word and model.cuts("▁▁the▁m².\nIn") == [0, 5, 7, 10]
    rnd = random.Random(2)
    for _ in range(50):
        text = BLANK + "".join(rnd.choice(ODD) for _ in range(40)).replace(" ", BLANK)
        cuts = [*model.cuts(text), len(text)]
        words = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        assert model.merge(text)[0] == sum((model.merge(w)[0] for w in words), []) == model.merge_all(words)[0].tolist()


def test_decoding_is_the_librarys(pieces):
    model, library = pieces
    rnd = random.Random(3)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32000), 0, 1, 2, 259, 260]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_compiled_character_maps():
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(normaliser.serialized_model_proto())
    with open(MODEL, "rb") as f:
        blob = f.read()
    model = PieceModel(blob)
    model.map, model.squeeze, model.plain = CharacterMap(spec.normalizer_spec.precompiled_charsmap), True, False
    assert len(model.map.keys) > 1000
    rnd = random.Random(4)
    signs = [*ODD, "Ａ", "ｶﾞ", "①", "㎏", "　", " ", "­", "Å", "ñ", "\r\n", "\x07", "Å"]
    for _ in range(800):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 20)))
        normal, source = model.normalise(text)
        assert normal == normaliser.normalize(text), text
        assert len(source) == len(normal) + 1 and (np.diff(source) >= 0).all() and source[-1] <= len(text)


def test_piece_table(spark, pieces):
    _, library = pieces
    rows = [(1, "Hello  world", 5), (2, None, 6), (3, "", 7), (None, "naïve 日本 😀", 8), (1, "Hello  world", 5), (4, "long " * 100_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = piece_codec(df, MODEL, keep=("doc_id", "n_tokens")).collect()
    assert sorted((str(r["doc_id"]), r["kept_n_tokens"], r["n_tokens"], r["ids"], r["decoded"]) for r in got) == sorted(
        (str(i), n, len(x := library.encode(t or "", add_eos=True)), x, library.decode(x)) for i, t, n in rows
    )
    for r in got:
        text = next((t or "" for i, t, n in rows if n == r["kept_n_tokens"])).encode()
        assert b"".join(text[a:b] for a, b in r["spans"]) == text and r["spans"][-1] == [len(text), len(text)]
    short = {r["kept_n_tokens"]: r for r in piece_codec(df, MODEL, keep=("doc_id", "n_tokens"), digests=True).collect()}
    for r in got:
        assert short[r["kept_n_tokens"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert short[r["kept_n_tokens"]]["spans_sha256"] == hashlib.sha256(np.array(r["spans"], "<i8").tobytes()).hexdigest()
    assert piece_codec(df.limit(0), MODEL).count() == 0


# --- codes


def test_bounds_lose_no_entry():
    rnd = np.random.default_rng(5)
    assert levels(1) == [] and levels(4) == [[(0, 4)], [(0, 2), (2, 4)]]
    for width in (1, 2, 3, 4, 7, 16):
        for spread in (2, 50, 1 << 20):
            x, c = rnd.integers(-spread, spread, (200, width)), rnd.integers(-spread, spread, (64, width))
            c[10] = c[3]
            x[:20] = c[rnd.integers(0, 64, 20)]
            d = ((x[:, None] - c) ** 2).sum(axis=2)
            at, far = nearest(x, c)
            assert (at == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v) and len(v) % parts == 0]
    if not kept:
        return []
    q = [tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, q[k]))
    dim = len(q[order[0]])
    order = [k for k in order if len(q[k]) == dim]
    w = dim // parts
    cut = lambda k, p: np.array(q[k][p * w : p * w + w], np.int64)
    books = [[cut(k, p) for k in order[:entries]] for p in range(parts)]
    find = lambda k, p: min(((int(((cut(k, p) - e) ** 2).sum()), i) for i, e in enumerate(books[p])))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            by = {}
            for k in order:
                by.setdefault(find(k, p)[1], []).append(cut(k, p))
            new.append([np.array([int(s) // len(by[i]) for s in np.sum(by[i], axis=0)]) if i in by else e for i, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(kept[k][0], "".join(f"{find(k, p)[1]:02x}" for p in range(parts)), sum(find(k, p)[0] for p in range(parts)), kept[k][2]) for k in order]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return [(i, c, e, total[label], digest) for i, c, e, label in out]


def test_codes_equal_brute_force(spark):
    rnd = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rnd.normal(size=8) * 0.3], int(rnd.integers(0, 3))) for i in rnd.permutation(150)]
    rows += [(7, rows[0][1], None), (7, rows[0][1], None), (None, rows[1][1], 1), (900, None, 1), (901, [], 1), (902, [float("nan")] * 8, 1), (903, [None] + [0.5] * 7, 1), (904, [1.0, 2.0], 1), (905, [1.0] * 12, 1), (906, [float("inf")] * 8, 0)]
    schema = "vec_id long, embedding array<float>, label int, code int, q int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], schema)
    for parts, entries, rounds in ((4, 6, 2), (2, 200, 1), (8, 4, 3)):
        got = [tuple(r) for r in code_vectors(df, parts, entries, rounds).collect()]
        assert sorted(got, key=repr) == sorted(brute_codes(rows, parts, entries, rounds), key=repr)
    assert code_vectors(df.limit(0)).count() == 0
    assert code_vectors(df.where("vec_id >= 900"), 4).count() == 1  # the one vector of twelve
    with pytest.raises(Exception, match="in size"):
        code_vectors(spark.createDataFrame([(1, [1e9] * 4, 1, 1, 1)], schema), 4)


def test_sums_of_a_round_are_few(spark, monkeypatch):
    """What a round moves is bounded by the codebooks, not by the rows."""
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.rand(1).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    seen = []
    inner = vector_codes.update
    monkeypatch.setattr(vector_codes, "update", lambda rows, books: seen.append(rows.rdd.getNumPartitions()) or inner(rows, books))
    assert code_vectors(df, 4, 8).select("label_error").distinct().count() == 1 and len(seen) == 2


# --- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    good = {(i, label, tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    anchors = sorted((r for r in good if r[0] % 5 == 0), key=lambda r: (r[0], r[2]))
    if not anchors:
        return []
    good = sorted((r for r in good if len(r[2]) == len(anchors[0][2])), key=lambda r: (r[0], r[1], r[2]))
    out = []
    for a in anchors:
        if len(a[2]) != len(anchors[0][2]):
            continue
        dot = [(sum(x * y for x, y in zip(a[2], r[2], strict=True)), r) for r in good if r != a]
        near = sorted({(-s, r[0]) for s, r in dot if r[1] == a[1]})[:positives]
        for s, p in near:
            far = sorted({(-t, r[0]) for t, r in dot if r[1] != a[1] and 50 * -s <= 100 * t <= 95 * -s})[:negatives]
            out += [(a[0], p, k + 1, i, -s, -t) for k, (t, i) in enumerate(far)]
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, clustered):
    from trovana.llm import hard_negatives

    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(4, 6))
    rows = []
    for i in range(260):
        v = centres[rnd.integers(0, 4)] + rnd.normal(size=6) * (0.2 if clustered else 2)
        rows.append((i, [float(np.float32(x)) for x in v * rnd.choice([0.1, 0.5])], int(rnd.integers(0, 3))))
    # copies of one vector, among them anchors; zero vectors; a label of its own; rows of one id; odd rows
    rows += [(i, rows[0][1], 1) for i in range(300, 390)] + [(i, [0.0] * 6, i % 2) for i in (400, 401, 405, 406)] + [(500, rows[3][1], 9), (5, rows[5][1], rows[5][2]), (10, rows[4][1], rows[10][2])]
    rows += [(None, rows[0][1], 1), (505, None, 1), (510, rows[0][1], None), (515, [float("nan")] * 6, 1), (520, [None] + [0.1] * 5, 1), (525, [], 1), (530, [0.5, 0.5], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, q int, a int")
    want = sorted(brute_negatives(rows))
    assert len(want) > 200
    for block, vectors, anchors in ((1 << 18, 16_384, 1024), (200, 40, 7)):
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
        monkeypatch.setattr(hard_negatives, "VECTORS", vectors)
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        assert sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % 5 == 0, pivots=6).collect()) == want
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
