"""Hashed word shingles of whole texts, computed over a batch's bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool) -> np.ndarray:
    """What each byte adds to a rolling hash; with `lower`, A-Z as a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    if lower:
        values[65:91] = values[97:123]
    return values


class Hasher:
    """Keeps the powers of the rolling hash between slices."""

    def __init__(self, values: np.ndarray | None = None):
        self.values = byte_values(lower=True) if values is None else values
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _reserve(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SLICE_BYTES)
            self.powers = np.cumprod(np.full(size, _BASE))
            self.inverses = np.cumprod(np.full(size, _INVERSE))

    def spans(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans of bytes."""
        n = len(flat)
        self._reserve(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[flat] * self.powers[:n], out=sums[1:])
        at = np.minimum(starts, max(n - 1, 0))
        return mixed((sums[ends] - sums[starts]) * self.inverses[at] + (ends - starts).astype(np.uint64)) if n else np.zeros(len(starts), np.uint64)

    def words(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's words begin (one more at the end)."""
        n = len(flat)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~_BLANK[flat]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(before & (~inside | cut))
        return self.spans(flat, starts, ends), np.searchsorted(starts, offsets)

    def shingles(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, repeats included, and where each text's shingles begin."""
        words, first = self.words(flat, offsets)
        counts = np.diff(first)
        n = max(len(words) - WIDTH + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            rolled = rolled * _BASE + words[k : k + n] if n else rolled
        sizes = np.where(counts >= WIDTH, counts - WIDTH + 1, counts > 0)
        at = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(counts)), sizes)
        places = first[owner] + np.arange(at[-1]) - at[owner]
        out = np.zeros(len(places), np.uint64)
        long = counts[owner] >= WIDTH
        out[long] = rolled[places[long]]
        for k in np.flatnonzero((counts > 0) & (counts < WIDTH)).tolist():
            total = np.uint64(int(counts[k]))  # its length keeps a short sequence apart from all others
            for w in words[first[k] : first[k + 1]]:
                with np.errstate(over="ignore"):
                    total = total * _BASE + w
            out[at[k]] = total
        return mixed(out), at


def text_slices(flat: np.ndarray, offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of ranges of `size` (SLICE_BYTES) at most; a longer text is a range of its own."""
    size = size or SLICE_BYTES
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1, low + 1)
        yield low, high, flat[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
