"""Hashes of byte strings within a text, all at once: no string is made as an object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd factor of a polynomial over bytes, its inverse, and a number for each byte.
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the factor and of its inverse; one pair of tables is kept."""
    size = 1 << max(n, 1 << 16).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        pair = []
        for base in (_R, _RINV):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            pair.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[size] = tuple(pair)
    return _POWERS[size]


def forget() -> None:
    """Drop the tables; a worker between tasks needs none."""
    _POWERS.clear()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of the strings between any places of some bytes."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def pieces(texts: list[bytes | None], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Some texts as blocks of about ``size`` bytes: which text each part is of, and the parts.

    A longer text is cut at spaces or line ends, so that its words stay whole; only a word longer than
    a block makes a longer part.
    """
    owner: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        t, at = t or b"", 0
        while at < len(t):
            cut = len(t)
            if at + size < len(t):
                cut = max(t.rfind(b" ", at + 1, at + size), t.rfind(b"\n", at + 1, at + size))
                if cut < 0:
                    cut = min((x for x in (t.find(b" ", at + size), t.find(b"\n", at + size)) if x >= 0), default=len(t))
            if held and held + cut - at > size:
                yield owner, parts
                owner, parts, held = [], [], 0
            owner.append(i)
            parts.append(t[at:cut])
            held += cut - at
            at = cut
    if parts:
        yield owner, parts
