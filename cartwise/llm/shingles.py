"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            size = max(4096, 2 * size)
            base = 0xD1342543DE82EF95
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64))
            )
        return self.up, self.down


_powers = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """Hash of each word, A-Z lower-cased, words being runs without ASCII white space."""
    data = text.encode().lower()
    codes = np.frombuffer(data, np.uint8)
    gap = np.ones(len(codes) + 2, bool)
    gap[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts, stops = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers.upto(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_byte_values()[codes] * up[: len(codes)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; of a shorter text
    the whole sequence is the one shingle; without words there is none."""
    hashes = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    found = np.full(len(hashes) - size + 1, size, np.uint64)
    for place in range(size):
        found = mix(found * _ODD + hashes[place : len(hashes) - size + 1 + place])
    return np.unique(found)
