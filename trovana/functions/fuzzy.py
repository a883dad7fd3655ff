"""Near matches, which no built-in expression scores: initials, short subsequences, typos.

Everything here works on one pair of strings; ``trovana.plans.compiler`` calls it in Arrow
batches, on the rows that equality, prefix and substring leave undecided.
"""

from __future__ import annotations

from functools import lru_cache

from trovana.functions.text import SEPARATORS, fold_text

Span = tuple[int, int, str]


def utf16(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def boundary(text: str, source: str, at: int) -> bool:
    """Does a word begin at ``at``: after a separator, or by a change of case in the source?"""
    if at <= 0:
        return True
    if at < len(text) and text[at - 1] in SEPARATORS:
        return True
    if at >= len(source):
        return False
    before, here = source[at - 1], source[at]
    if before in SEPARATORS:
        return True
    if not here.isupper():
        return False
    after = source[at + 1] if at + 1 < len(source) else ""
    return before.islower() or before.isdecimal() or (before.isupper() and after.islower())


def spans_at(source: str, places: list[int]) -> list[Span]:
    return [(utf16(source[:p]), utf16(source[p : p + 1]), "subsequence") for p in places]


def initials(text: str, source: str, token: str) -> tuple[int, list[Span]] | None:
    """The token, letter by letter, at beginnings of words."""
    rest, places = iter(token), []
    want = next(rest)
    for i, c in enumerate(text):
        if want is not None and c == want and boundary(text, source, i):
            places.append(i)
            want = next(rest, None)
    if want is not None:
        return None
    first, last = places[0], places[-1]
    return 6400 - min(first * 8, 600) - min((last - first) * 4, 700), spans_at(source, places)


def subsequence(text: str, source: str, token: str) -> tuple[int, list[Span]] | None:
    """A token of up to three letters in order, close together or at a word's beginning."""
    places, at = [], -1
    for c in token:
        at = text.find(c, at + 1)
        if at < 0:
            return None
        places.append(at)
    first, last = places[0], places[-1]
    begins = boundary(text, source, first)
    if last - first + 1 > len(token) + 1 and not begins and not boundary(text, source, last):
        return None
    run = longest = 1
    gaps = 0
    for a, b in zip(places, places[1:]):
        run = run + 1 if b == a + 1 else 1
        longest = max(longest, run)
        gaps += b - a - 1
    return 5500 + 450 * begins + 70 * longest - min(gaps * 24, 1600) - min(first * 8, 700), spans_at(source, places)


def osa(a: str, b: str, limit: int) -> int | None:
    """Optimal string alignment distance (swaps of neighbours, no edits within them), None beyond ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    older: list[int] = []
    old = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return None
        older, old = old, row
    return old[-1] if old[-1] <= limit else None


def parts(source: str) -> list[tuple[int, str]]:
    """(offset, component) of a name or path, cut at separators; the whole if there is nothing else."""
    out, start = [], None
    for i, c in enumerate(source + "/"):
        if c in SEPARATORS:
            if start is not None:
                out.append((start, source[start:i]))
            start = None
        elif start is None:
            start = i
    return out or ([(0, source)] if source else [])


def typo(source: str, token: str) -> tuple[int, list[Span]] | None:
    """A component that differs by one edit (up to five letters) or two; three letters also inside a component."""
    if len(token) < 3:
        return None
    limit = 1 if len(token) <= 5 else 2
    best = None
    for offset, piece in parts(source):
        folded = fold_text(piece)
        base = utf16(source[:offset])
        if len(token) == 3:
            for at in range(len(folded) - 2):
                if osa(folded[at : at + 3], token, 1) is not None and boundary(folded, piece, at):
                    score = 4300 - min(at * 12, 500)
                    if best is None or _key(score) > _key(best[0]):
                        best = score, [(base + utf16(piece[:at]), utf16(piece[at : at + 3]), "typo")]
        distance = osa(folded, token, limit)
        if distance is not None:
            score = 4500 - 500 * distance - min(len(folded), 100)
            if best is None or _key(score) > _key(best[0]):
                best = score, [(base, utf16(piece), "typo")]
    return best


def _key(score: int) -> tuple[int, int]:
    return max(0, min(int(score / 2000), 4)), score


@lru_cache(maxsize=100_000)
def near_name(source: str, folded: str, token: str) -> tuple[int, tuple[Span, ...]] | None:
    """Score and spans of a name that is no better than near; the first kind that fits counts."""
    found = initials(folded, source, token) or (subsequence(folded, source, token) if len(token) <= 3 else None) or typo(source, token)
    return (found[0], tuple(found[1])) if found else None


@lru_cache(maxsize=100_000)
def near_path(directory: str, token: str) -> tuple[int, tuple[Span, ...]] | None:
    """The best near match of a short token among a directory's components."""
    best = None
    for offset, piece in parts(directory):
        found = near_name(piece, fold_text(piece), token)
        if found and (best is None or _key(found[0]) > _key(best[0])):
            base = utf16(directory[:offset])
            best = found[0], tuple((base + a, n, style) for a, n, style in found[1])
    return best
