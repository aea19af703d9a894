"""Words and shingles of texts as numpy arrays of 64-bit hashes; words are what ASCII white space separates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5  # words in a shingle
PART = 1 << 20  # bytes hashed at once

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POSITIONS = _random.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A seeded permutation of 64-bit values whose bits all depend on all bits of the input."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_table(base: np.uint64, size: int) -> np.ndarray:
    table = _powers.get(int(base))
    if table is None or len(table) < size:
        with np.errstate(over="ignore"):
            table = np.cumprod(np.full(max(size, PART + 4096), base, np.uint64))
        _powers[int(base)] = table
    return table[:size]


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of ``raw``."""
    gap = _SPACE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edges[0::2], edges[1::2]


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of ``raw``; at most about PART bytes are held in wide arrays at once."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_edges(raw)
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + PART, side="right")))
            low, high = int(starts[first]), int(ends[last - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[data[low:high]] * _power_table(_BASE, high - low), out=sums[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            shift = np.concatenate((np.ones(1, np.uint64), _power_table(_INVERSE, high - low)))
            hashes[first:last] = mix((sums[b] - sums[a]) * shift[a] + (b - a).astype(np.uint64))
            first = last
    return hashes, starts, ends


class Texts:
    """The words of several texts: ``hashes``, byte offsets ``starts`` and ``ends`` in ``raw``, and ``first`` word per text."""

    def __init__(self, texts: list[str | None]):
        encoded = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
        self.raw = b"\n".join(encoded)
        lengths = np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.hashes, self.starts, self.ends = hash_words(self.raw)
        self.first = np.searchsorted(self.starts, self.offsets)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of five words, and the first of each text; shorter texts have one run of all their words."""
        counts = np.diff(self.first)
        with np.errstate(over="ignore"):
            long = np.zeros(len(self.hashes), np.uint64)
            span = len(self.hashes) - WIDTH + 1
            if span > 0:
                for i in range(WIDTH):
                    long[:span] += self.hashes[i : span + i] * _POSITIONS[i]
            long = mix(long, 1)
            keep = np.ones(len(self.hashes), bool)
            for tail in range(1, WIDTH):
                at = self.first[1:] - tail
                keep[at[at >= self.first[:-1]]] = False
            for text in np.flatnonzero((counts > 0) & (counts < WIDTH)):
                a, b = self.first[text], self.first[text + 1]
                long[a] = mix(np.array([(self.hashes[a:b] * _POSITIONS[: b - a]).sum()]), 2 + int(b - a))[0]
                keep[a] = True
        return long[keep], np.concatenate(([0], np.cumsum(keep)))[self.first]


def in_parts(texts: list[str | None], size: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters together; a longer text stands alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if i > first and total + length > size:
            yield first, i
            first, total = i, 0
        total += length
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in in_parts(texts):
        values, first = Texts(texts[a:b]).shingles()
        for i in range(b - a):
            yield np.unique(values[first[i] : first[i + 1]])
