"""Word shingles of many texts at once, as 64-bit hashes, and minima of universal hashes over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


_BYTE = constants(1, 256)
_WEIGHT = constants(2, 64) | U(1)
_BASE = constants(3, 1)[0] | U(1)


class _Powers:
    """Powers of an odd base and of its inverse, as far as texts have needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        inverse = int(pow(int(_BASE), -1, 1 << 64))
        self.inverse = U(inverse)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, _BASE, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, self.inverse, np.uint64)]))
        return self.up, self.down


_POWERS = _Powers()


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, places where each begins and the last ends); null is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z folded, places of each text's first word and the end)."""
    data, offsets = buffer_of(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True  # a text begins here, so a word can't run on
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | fresh[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | fresh[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _POWERS.upto(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_FOLD[data]] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, places of each text's first and the end). Texts with fewer words give one shingle, without words none."""
    words, at = word_hashes(texts)
    counts = np.diff(at)
    out = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(out)])
    with np.errstate(over="ignore"):
        padded = np.concatenate([words, np.zeros(width, np.uint64)])
        full = np.zeros(len(words), np.uint64)
        for j in range(width):
            full += padded[j : j + len(words)] * _WEIGHT[j]
        hashes = np.zeros(int(places[-1]), np.uint64)
        long = counts >= width
        from lintlake.llm.shared import ragged

        hashes[ragged(places[:-1][long], out[long])] = mix(full[ragged(at[:-1][long], out[long])])
        for i in np.flatnonzero((counts > 0) & ~long):
            own = words[at[i] : at[i + 1]]
            hashes[places[i]] = mix(np.sum(own * _WEIGHT[: len(own)], dtype=np.uint64, keepdims=True) + U(len(own)) * _WEIGHT[63])[0]
    return hashes, places


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    hashes, places = shingle_hashes(texts, width)
    return [np.unique(hashes[a:b]) for a, b in zip(places[:-1], places[1:])]


def minima(sets: list[np.ndarray], factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Per non-empty set the minima of ``factors[k] * x + shifts[k]`` (upper 32 bits): a matrix of uint32."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), len(factors)), np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(factors, shifts)):
            out[:, k] = np.minimum.reduceat(flat * a + b, starts) >> U(32)
    return out
