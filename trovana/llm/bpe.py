"""Byte-pair encoding and decoding over a pair occurrence index.

The words new to a partition are laid out in one array of symbols. An index maps
each mergeable pair to all its positions; active ranks are taken in ascending
order, and each merge updates the lists of the pairs to its left and right. A
word's ids are kept for a while, so that frequent words are merged once in a task: when
the words kept become too many, they turn into the older ones, and those of them that
come again are taken over.

Defined results: null and empty texts give no tokens and empty strings; a text of
any length is encoded whole; repeated rows are encoded alike; an empty table gives no
rows; extra columns of the input are ignored unless named in ``keep``, and a kept column
that has a result's name comes under ``kept_`` and its name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.llm.common import col, kept_names, lean

#: Words remembered by a task, in each of two generations, and words merged together in one index.
MEMORY, BLOCK = 150_000, 20_000
#: A lone surrogate, which no text holds.
MARK = "\ud800"
#: Up to this character all Unicode versions agree on letters and cases; a text with others is
#: normalised and split by the library itself, whose version then counts.
AGREED = "\u0557"


class BpeModel:
    """A ``tokenizers`` JSON model: NFC, lower case, split by a pattern, bytes as characters, word ends."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = data["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.byte = byte_characters()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.vocab[a], self.vocab[b]] = (r, self.vocab[a + b])
        self.by_rank = [(*pair, new) for pair, (_, new) in self.rank.items()]
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.library = tokenizers.Tokenizer.from_str(spec)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens stand as themselves after MARK."""
        out: list[str] = []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(MARK + part)
            elif part:
                if max(part) > AGREED:
                    part = self.library.normalizer.normalize_str(part)
                    out += [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
                    continue
                if not part.isascii():
                    # each character is lowered alone: a final sigma is like any other
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.split.findall(part.lower())
        return out

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words merged at once over one pair occurrence index."""
        symbols: list[int] = []
        starts: list[int] = []
        byte, vocab, rank = self.byte, self.vocab, self.rank
        for w in words:
            starts.append(len(symbols))
            chars = [byte[b] for b in w.encode()]
            chars[-1] += self.end
            symbols += [vocab[c] for c in chars]
            symbols.append(-1)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        where: dict[int, list[int]] = {}
        for i in range(len(symbols) - 1):
            found = rank.get((symbols[i], symbols[i + 1]))
            if found:
                where.setdefault(found[0], []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.by_rank[r]
            for i in sorted(where.pop(r)):
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -2
                after[i] = n = after[j]
                before[n] = i
                found = rank.get((new, symbols[n]))
                if found:
                    if found[0] not in where:
                        where[found[0]] = []
                        heapq.heappush(active, found[0])
                    where[found[0]].append(i)
                p = before[i]
                if p >= 0:
                    found = rank.get((symbols[p], new))
                    if found:
                        if found[0] not in where:
                            where[found[0]] = []
                            heapq.heappush(active, found[0])
                        where[found[0]].append(p)
        out = []
        for i in starts:
            ids = []
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out.append(ids)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Keep ids and tokens of words not known yet."""
        unknown = [w for w in words if w not in self.known]
        self.known.update((w, self.older[w]) for w in unknown if w in self.older)
        new = [w for w in unknown if w not in self.known]
        plain = [w for w in new if w[0] != MARK]
        for w in new:
            if w[0] == MARK:
                self.known[w] = (str(self.special[w[1:]]), w[1:])
        for k in range(0, len(plain), BLOCK):
            block = plain[k : k + BLOCK]
            for w, ids in zip(block, self.merge(block), strict=True):
                self.known[w] = (" ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids as decimals, decoded text) of each text, both joined by one space."""
        split, fresh = [], set()
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known = self.known
        for t in texts:
            split.append(w := self.words(t))
            fresh.update(w)
        self.learn(fresh)
        for w in split:
            got = [known[x] for x in w]
            yield " ".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def decode(self, ids: Iterable[int]) -> str:
        """As a model without a decoder does: tokens joined by one space, special ones included."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def byte_characters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


_LOADED: dict[str, BpeModel] = {}


def _model(spec: str) -> BpeModel:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BpeModel(spec)
    return _LOADED[key]


def _forget() -> None:
    for m in _LOADED.values():
        m.known.clear()
        m.older.clear()


#: Characters handed to one pass over a block of texts.
TEXT_BLOCK = 1_000_000


def bpe_codec(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and, per text, ``ids`` (decimal ids joined by a space) and ``decoded``.

    With ``digests`` the two strings are replaced by ``ids_sha256`` and ``decoded_sha256``, made where
    the strings are, so that whole texts don't travel back. The tokenizer file is read on the driver and
    broadcast: its size is that of a vocabulary, whatever the corpus.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    results = kept_names(keep, ("n_tokens", *names))
    # kept columns travel under numbers, so that none can clash
    ours = docs.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], col(text).alias("t"))
    own = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([ours.schema[k] for k in own] + [T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(spec.value)
        for batch in batches:
            column = batch.column(len(keep))
            k = 0
            while k < batch.num_rows:
                texts: list[str] = []
                chars = 0
                while k + len(texts) < batch.num_rows and chars < TEXT_BLOCK:
                    texts.append(column[k + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                counts, first, second = [], [], []
                for ids, decoded in model.encode(texts):
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else ids)
                    second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(k, len(texts)) for i in range(len(keep))), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=[*own, "n_tokens", *names],
                )
                k += len(texts)

    found = ours.mapInArrow(lean(run, _forget), schema)
    return found.select(*[F.col(k).alias(n) for k, n in zip(own, results, strict=True)], "n_tokens", *names)
