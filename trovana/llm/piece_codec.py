"""SentencePiece (BPE) encoding that keeps offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map holds; each
normalised character remembers the source character it comes from. Symbols are merged by score, ties
from the left, and every piece is projected through that alignment to the bytes of the source it stands
for. No piece of such a vocabulary crosses from a word into the blank before the next one (this is
checked as the model is read), so a word's pieces don't depend on its neighbours: words new to a task are
merged once, and a text is the words' pieces put together.

Defined results: null and empty texts have the end id only; a text of any length is encoded whole;
repeated rows are encoded alike; an empty table gives no rows; extra columns of the input are ignored
unless named in ``keep``, and a kept column that has a result's name comes under ``kept_`` and its name.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovana.llm.common import col, kept_names, lean

#: The blank of pieces.
BLANK = "▁"
#: Characters of words a worker remembers, also from task to task, and characters of texts encoded in one go.
MEMORY, TEXT_BLOCK = 8_000_000, 1_000_000
#: Lengths of words that are merged together, row by row of a table, and rows of a table; longer words go over a heap.
LENGTHS, ROWS = (8, 16, 32, 64), 20_000
#: Later than all pairs.
NEVER = 2**31 - 1
#: Kinds of pieces in a model file (fixed values of the format).
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6


def _one_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("trovana-one-byte", _one_byte)


class CharacterMap:
    """The compiled map of a model: a double array of byte strings, and what each is replaced by."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        strings = blob[4 + size :]

        def child(unit: int) -> int:
            return unit >> 10 << ((unit & 512) >> 6)

        self.keys: dict[str, str] = {}
        waiting = [(child(units[0]), b"")]
        while waiting:
            base, key = waiting.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at < len(units) and units[at] & 0x800000FF == byte:
                    below = at ^ child(units[at])
                    if units[at] >> 8 & 1:
                        value = units[below] & 0x7FFFFFFF
                        self.keys[(key + bytes([byte])).decode()] = strings[value : strings.index(b"\0", value)].decode()
                    waiting.append((below, key + bytes([byte])))
        self.longest: dict[str, int] = {}
        for key in self.keys:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        alone = "".join(k for k in self.keys if len(k) == 1)
        first = "".join(sorted({k[0] for k in self.keys if len(k) > 1}))
        second = "".join(sorted({k[1] for k in self.keys if len(k) > 1}))
        forms = [f"[{re.escape(alone)}]"] * bool(alone) + [f"[{re.escape(first)}](?=[{re.escape(second)}])"] * bool(first)
        #: Where a key can begin: a character that is one, or one that begins longer keys before a character that comes second.
        self.may = re.compile("|".join(forms)) if forms else None

    def match(self, text: str, at: int) -> int:
        """The length of the longest key there, or 0."""
        for n in range(min(self.longest.get(text[at], 0), len(text) - at), 0, -1):
            if text[at : at + n] in self.keys:
                return n
        return 0


class PieceModel:
    """A BPE model file of the sentencepiece library."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are read")
        norm = model.normalizer_spec
        self.dummy, self.squeeze, self.suffix, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, model.trainer_spec.treat_whitespace_as_suffix, norm.escape_whitespaces
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.fallback, self.end = model.trainer_spec.byte_fallback, -1
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.unused: set[int] = set()
        self.text: list[bytes] = []
        self.blank_first: list[bool] = []
        users = []
        for i, p in enumerate(model.pieces):
            shown = p.piece.replace(BLANK, " ").encode()
            if p.type == UNKNOWN:
                self.unknown, shown = i, model.trainer_spec.unk_surface.encode()
            elif p.type == CONTROL:
                shown = b""
                if p.piece == model.trainer_spec.eos_piece:
                    self.end = i
            elif p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte[value], shown = i, bytes([value])
            else:
                self.score[p.piece] = (p.score, i)
                if p.type == UNUSED:
                    self.unused.add(i)
                if p.type == USER:
                    users.append(p.piece)
            self.text.append(shown)
            self.blank_first.append(p.type not in (CONTROL, BYTE, UNKNOWN) and p.piece.startswith(BLANK))
        self.users = re.compile("|".join(map(re.escape, sorted(users, key=len, reverse=True)))) if users else None
        # kinds of characters: signs and figures 0, letters 1, the blank 2, by code point
        kind, symbol = np.zeros(0x110000, np.uint8), np.full(0x110000, -1, np.int32)
        for c in sorted({c for p in self.score for c in p}):
            kind[ord(c)] = 2 if c == BLANK else c.isalpha()
            symbol[ord(c)] = self.score.get(c, (0, -1))[1]
        self.kind, self.symbol = kind, symbol
        #: Whether words can be encoded by themselves: no piece has a blank behind something else, or a letter beside a sign.
        self.by_word = self.fallback and not (users or self.suffix or any(len(self.cuts(p)) > 1 for p in self.score))
        self.plain = not (self.map or self.squeeze or self.suffix or self.users) and self.escape
        #: Pairs of pieces that make one, how late they are merged, and that piece; none if not all characters of pieces are pieces.
        self.pairs = None
        if not (users or self.unused) and all(c in self.score for p in self.score for c in p):
            late = {score: n for n, score in enumerate(sorted({score for score, _ in self.score.values()}, reverse=True))}
            found = {self.score[p[:k]][1] << 32 | self.score[p[k:]][1]: (late[score], i) for p, (score, i) in self.score.items() for k in range(1, len(p)) if p[:k] in self.score and p[k:] in self.score}
            self.pairs = pd.Index(np.fromiter(found, np.int64, len(found)))
            # a pair that isn't found has the last place
            self.late, self.whole = np.array([*found.values(), (NEVER, -1)], np.int32).T.copy()
        self.decimal = [str(i) for i in range(len(self.text))]
        self.forget()

    # --- normalising

    def _step(self, text: str, at: int) -> tuple[str, int]:
        """What the text becomes there, and how many characters that takes."""
        if self.users and (found := self.users.match(text, at)):
            return found[0], len(found[0])
        n = self.map.match(text, at) if self.map else 0
        return (self.map.keys[text[at : at + n]], n) if n else (text[at], 1)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the source character it comes from."""
        if self.plain:
            # blanks alone change: all characters keep their places, behind that of the added blank
            if not text:
                return "", np.zeros(1, np.int64)
            at = np.arange(len(text) + 1)
            text = text.replace(" ", BLANK)
            return (BLANK + text, np.concatenate([[0], at])) if self.dummy else (text, at)
        space = BLANK if self.escape else " "
        out, source = [], []
        at = 0
        while self.squeeze and at < len(text):
            new, n = self._step(text, at)
            if new != " ":
                break
            at += n
        if at == len(text):
            return "", np.full(1, at)
        if self.dummy and not self.suffix:
            out.append(space)
            source.append(at)
        after_space = self.squeeze
        while at < len(text):
            if not self.users and self.map and self.map.may and not (self.squeeze and text[at] == " "):
                # characters up to the next place that can be a key, or a blank, stay
                found = self.map.may.search(text, at)
                stop = found.start() if found else len(text)
                if self.squeeze and (blank := text.find(" ", at, stop)) >= 0:
                    stop = blank
                if stop > at:
                    out += [space if c == " " else c for c in text[at:stop]]
                    source += range(at, stop)
                    at, after_space = stop, False
                    continue
            new, n = self._step(text, at)
            if after_space:
                new = new.lstrip(" ")
            if new:
                out += [space if c == " " else c for c in new]
                source += [at] * len(new)
                after_space = self.squeeze and new.endswith(" ")
            at += n
        ends = at
        while self.squeeze and out and out[-1] == space:
            out.pop()
            ends = source.pop()
        if self.dummy and self.suffix:
            out.append(space)
            source.append(ends)
        return "".join(out), np.array([*source, ends], np.int64)

    # --- merging

    def merge(self, word: str) -> tuple[list[int], list[int]]:
        """The ids of a normalised word, and how many of its characters each covers."""
        symbols, frozen = list(word), [False] * len(word)
        if self.users:
            symbols, frozen, at = [], [], 0
            while at < len(word):
                found = self.users.match(word, at)
                symbols.append(found[0] if found else word[at])
                frozen.append(bool(found))
                at += len(symbols[-1])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, parts, heap = self.score, {}, []

        def offer(i: int, j: int) -> None:
            if i < 0 or j >= n or frozen[i] or frozen[j]:
                return
            both = symbols[i] + symbols[j]
            found = score.get(both)
            if found:
                heapq.heappush(heap, (-found[0], i, j, len(both)))
                if found[1] in self.unused:
                    parts[both] = (symbols[i], symbols[j])

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            offer(before[i], i)
            offer(i, k)
        ids, lengths = [], []
        waiting = [s for s in reversed(symbols) if s]
        last_unknown = False
        while waiting:
            s = waiting.pop()
            found = score.get(s)
            if found and found[1] in self.unused and s in parts:
                waiting += reversed(parts[s])
                continue
            if found:
                ids.append(found[1])
                lengths.append(len(s))
            elif self.fallback:
                # the last byte stands for the character
                raw = s.encode()
                ids += [self.byte[b] for b in raw]
                lengths += [0] * (len(raw) - 1) + [len(s)]
            elif last_unknown:
                lengths[-1] += len(s)
            else:
                ids.append(self.unknown)
                lengths.append(len(s))
            last_unknown = not found
        return ids, lengths

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``merge`` of many words, one after another: ids, lengths, and how many ids each word has.

        Words of like length are rows of a table; in each round every row merges its earliest pair.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbols = self.symbol[points]
        starts = np.concatenate([[0], np.cumsum(size)])
        odd = np.zeros(len(words), bool)
        odd[np.repeat(np.arange(len(words)), size)[symbols < 0]] = True
        odd |= (size > LENGTHS[-1]) | (self.pairs is None)
        results: list = [None] * len(words)
        for i in np.flatnonzero(odd):
            results[i] = self.merge(words[i])
        shortest = 0
        for longest in LENGTHS:
            rows = np.flatnonzero(~odd & (size > shortest) & (size <= longest))
            shortest = longest
            for k in range(0, len(rows), ROWS):
                some = rows[k : k + ROWS]
                ids, lengths, count = self._merge_rows(symbols, starts[some], size[some], longest)
                at = np.cumsum(count) - count
                ids, lengths = ids.tolist(), lengths.tolist()
                for i, a, n in zip(some.tolist(), at.tolist(), count.tolist(), strict=True):
                    results[i] = (ids[a : a + n], lengths[a : a + n])
        count = np.fromiter((len(r[0]) for r in results), np.int64, len(results))
        flat = [np.fromiter(itertools.chain.from_iterable(r[k] for r in results), np.int32, count.sum()) for k in (0, 1)]
        return flat[0], flat[1], count

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pairs.get_indexer(a.astype(np.int64) << 32 | b)

    def _merge_rows(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.arange(width)
        inside = place < size[:, None]
        s = np.full((len(start), width + 1), -1, np.int32)
        s[:, :-1][inside] = symbols[(start[:, None] + place)[inside]]
        length = np.pad(inside, ((0, 0), (0, 1))).astype(np.int32)
        after = np.minimum(np.tile(np.arange(1, width + 2), (len(start), 1)), width)
        before = np.tile(np.arange(-1, width), (len(start), 1))
        late, pair = np.full(s.shape, NEVER, np.int32), np.full(s.shape, -1, np.int32)
        both = place + 1 < size[:, None]
        pair[:, :-1][both] = found = self._find(s[:, :-1][both], s[:, 1:][both])
        late[:, :-1][both] = self.late[found]
        row = np.arange(len(start))
        while len(row):
            i = late[row].argmin(axis=1)
            going = late[row, i] < NEVER
            row, i = row[going], i[going]
            j = after[row, i]
            k = after[row, j]
            s[row, i] = self.whole[pair[row, i]]
            length[row, i] += length[row, j]
            length[row, j], late[row, j] = 0, NEVER
            after[row, i], before[row, k] = k, i
            p = before[row, i]
            # the pairs with what is on both sides
            left = p >= 0
            for r, x, y in ((row, i, k), (row[left], p[left], i[left])):
                pair[r, x] = found = np.where(s[r, y] < 0, -1, self._find(s[r, x], s[r, y]))
                late[r, x] = self.late[found]
        there = length > 0
        return s[there], length[there], there.sum(axis=1)

    def cuts(self, normal: str) -> list[int]:
        """Where words begin: blanks begin one, and letters and signs don't share one."""
        kind = self.kind[np.frombuffer(normal.encode("utf-32-le"), np.uint32)]
        new = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def forget(self) -> None:
        """Words known so far, with their pieces one after another."""
        self.known: dict[str, int] = {}
        self.ids, self.lengths, self.starts = array("i"), array("i"), array("q", [0])
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        ids, lengths, count = self.merge_all(words)
        self.starts.frombytes((np.cumsum(count) + len(self.ids)).tobytes())
        self.ids.frombytes(ids.tobytes())
        self.lengths.frombytes(lengths.tobytes())
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.held += sum(map(len, words)) + 8 * len(words)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and [begin, end) in bytes of the source, of each text; the end id is not included."""
        if self.held > MEMORY:
            self.forget()
        made, split = [], []
        for t in texts:
            normal, source = self.normalise(t)
            cuts = self.cuts(normal) if normal and self.by_word else [0] * bool(normal)
            made.append(source)
            split.append([normal[a:b] for a, b in itertools.pairwise([*cuts, len(normal)])])
        get = self.known.get
        numbers = [list(map(get, words)) for words in split]
        new = dict.fromkeys(w for words, found in zip(split, numbers, strict=True) if None in found for w, n in zip(words, found, strict=True) if n is None)
        if new:
            self._learn(list(new))
            numbers = [list(map(get, words)) if None in found else found for words, found in zip(split, numbers, strict=True)]
        # of all texts at once: how many pieces each word has, where they are, and where they end in their text
        every, lengths, starts = (np.array(x) for x in (self.ids, self.lengths, self.starts))
        w = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, sum(map(len, numbers)))
        count = starts[w + 1] - starts[w]
        upto = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(upto[-1]) + np.repeat(starts[w] - upto[:-1], count)
        ids, lengths = every[place], lengths[place]
        stop = np.cumsum(lengths)
        a = k = 0
        for t, source, words in zip(texts, made, numbers, strict=True):
            b, k = upto[k + len(words)], k + len(words)
            end = stop[a:b] - (stop[a - 1] if a else 0)
            spans = np.empty((b - a, 2), np.int64)
            spans[:, 0], spans[:, 1] = source[end - lengths[a:b]], source[end]
            if not t.isascii():
                raw = np.frombuffer(t.encode(), np.uint8)
                spans = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))[spans]
            yield ids[a:b], spans
            a = b

    # --- decoding

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: the blank that stands before the first word goes, bytes that are no UTF-8 become marks."""
        parts = list(map(self.text.__getitem__, ids))
        if self.dummy or self.squeeze:
            for k, i in enumerate(ids):
                if self.blank_first[i]:
                    parts[k] = parts[k][1:]
                    if not self.squeeze:
                        break
                if parts[k]:
                    break
        if b"" in parts[:-1]:
            # bytes on both sides of an id that shows nothing are no one character
            return "".join(b"".join(run).decode(errors="trovana-one-byte") for _, run in itertools.groupby(parts, bool))
        return b"".join(parts).decode(errors="trovana-one-byte")


_LOADED: dict[str, PieceModel] = {}


def _model(blob: bytes) -> PieceModel:
    key = hashlib.sha256(blob).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(blob)
    return _LOADED[key]


def piece_codec(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and per text ``ids`` (with the end id), ``spans`` and ``decoded``.

    ``spans`` has [begin, end) in UTF-8 bytes of the source for each id: of a character that is written as
    bytes the last one holds it, and the end id stands behind the text. ``decoded`` is decoded from the ids.
    With ``digests`` these are replaced by ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256`` and
    ``spans_sha256`` (begins and ends in turn as 8-byte little-endian numbers), made where the strings are. The
    model file is read on the driver and broadcast: it has the size of a vocabulary, whatever the corpus.
    """
    with open(model_path, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ("ids_sha256", "decoded_sha256", "spans_sha256") if digests else ("ids", "decoded", "spans")
    results = kept_names(keep, ("n_tokens", *names))
    # kept columns travel under numbers, so that none can clash
    ours = docs.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keep)], col(text).alias("t"))
    own = [f"k{i}" for i in range(len(keep))]
    pair = T.ArrayType(T.ArrayType(T.LongType()))
    kinds = (T.StringType(),) * 3 if digests else (T.ArrayType(T.IntegerType()), T.StringType(), pair)
    forms = (pa.string(),) * 3 if digests else (pa.list_(pa.int32()), pa.string(), pa.list_(pa.list_(pa.int64())))
    schema = T.StructType([ours.schema[k] for k in own] + [T.StructField("n_tokens", T.LongType()), *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        for batch in batches:
            column, k = batch.column(len(keep)), 0
            while k < batch.num_rows:
                texts: list[str] = []
                chars = 0
                while k + len(texts) < batch.num_rows and chars < TEXT_BLOCK:
                    texts.append(column[k + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                counts, rows = [], ([], [], [])
                for t, (ids, spans) in zip(texts, model.encode(texts), strict=True):
                    ids = [*ids.tolist(), model.end]
                    size = len(t) if t.isascii() else len(t.encode())
                    spans = np.concatenate([spans, [[size, size]]])
                    decoded = model.decode(ids)
                    counts.append(len(ids))
                    if digests:
                        found = (" ".join(map(model.decimal.__getitem__, ids)).encode(), decoded.encode(), spans.astype("<i8").tobytes())
                        found = tuple(hashlib.sha256(x).hexdigest() for x in found)
                    else:
                        found = (ids, decoded, spans.tolist())
                    for out, x in zip(rows, found, strict=True):
                        out.append(x)
                kept = [batch.column(i).slice(k, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), *itertools.starmap(pa.array, zip(rows, forms, strict=True))], names=[*own, "n_tokens", *names])
                k += len(texts)

    found = ours.mapInArrow(lean(run), schema)
    return found.select(*[F.col(k).alias(n) for k, n in zip(own, results, strict=True)], "n_tokens", *names)
