"""Whole texts as byte arrays: pieces of bounded size, polynomial prefix hashes, words found without a loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd, so that its powers have inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PIECE = 2 << 20


class Powers:
    """Powers of a base modulo 2**64 and of its inverse, grown as longer buffers come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if self.up.size <= n:
            n = max(n + 1, 2 * self.up.size)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))


_POWERS = [Powers(b) for b in BASES]


class Prefix:
    """Hash of any substring of data (uint8) in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.p = _POWERS[which]
        self.p.upto(data.size)
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self.p.up[: data.size] * (data.astype(np.uint64) + np.uint64(1)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.p.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one stir of 64 bits, as a polynomial's low bits depend on little."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Lower-cased byte of a word, 0 for all others: digits, letters and every byte of a non-ASCII character.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def pieces(sizes: list[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """[from, to) of successive items that together have at most so many bytes; a larger item stands alone."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def as_bytes(text) -> bytes:
    return text.encode() if isinstance(text, str) else b""
