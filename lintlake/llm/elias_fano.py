"""Elias-Fano sequences and an n-gram trie over them, held in one buffer that can be memory-mapped."""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

U = np.uint64


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high parts in unary.

    Successor search finds the group of equal high parts by selecting zeros in
    the unary bits and compares low bits within the group.
    """

    def __init__(self, n: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.universe, self.width, self.low, self.high, self.zeros = n, universe, width, low, high, zeros

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        """values: uint64, non-decreasing, below ``universe``."""
        n, universe = len(values), max(int(universe), 1)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        top = universe >> width
        bits = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        bits[(values >> U(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        low = np.zeros(-(-n * width // 64) + 1, np.uint64)
        if width and n:
            part = values & U((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * U(width)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U(width) > U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype("<u4" if len(bits) < 1 << 32 else "<u8")
        return cls(n, universe, width, low, high, zeros)

    @cached_property
    def _directory(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the zeros and of the ones among the unary bits, made when a batch of queries is worth it."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        narrow = np.uint32 if len(bits) < 1 << 32 else np.int64
        return np.flatnonzero(bits == 0).astype(narrow), np.flatnonzero(bits).astype(narrow)

    @cached_property
    def _lows(self) -> np.ndarray:
        return self._low(np.arange(self.n))

    def _many(self, queries: int) -> bool:
        return queries > self.n // 8

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * U(self.width)
        word, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        value = self.low[word] >> shift
        over = shift + U(self.width) > U(64)
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & U((1 << self.width) - 1)

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero bit (from 0)."""
        if self._many(len(k)):
            return self._directory[0][k].astype(np.int64)
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest = (k - self.zeros[word]).astype(np.int64)
        bits, place = ~self.high[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            held = np.bitwise_count((bits >> place.astype(np.uint64)) & U((1 << step) - 1)).astype(np.int64)
            skip = held <= rest
            rest -= np.where(skip, held, 0)
            place += np.where(skip, step, 0)
        return word * 64 + place

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values in the sequence, -1 where absent; for equal elements the first."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        inside = np.flatnonzero(values < U(self.universe))
        wanted = values[inside]
        group = (wanted >> U(self.width)).astype(np.int64)
        # The zero that closes group h - 1 has h zeros up to it; ones before it are the elements of lower groups.
        first = np.where(group > 0, self._select_zero(np.maximum(group - 1, 0)) - group + 1, 0)
        last = self._select_zero(group) - group
        end = last.copy()
        low = wanted & U((1 << self.width) - 1)
        low_at = self._lows.__getitem__ if self._many(len(wanted)) else self._low
        while True:
            # Halve each group until one place is left: the first whose low part is not below.
            alive = np.flatnonzero(first < last)
            if not alive.size:
                break
            mid = (first[alive] + last[alive]) // 2
            less = low_at(mid) < low[alive]
            first[alive[less]] = mid[less] + 1
            last[alive[~less]] = mid[~less]
        ok = np.flatnonzero(first < end)
        same = ok[low_at(first[ok]) == low[ok]]
        out[inside[same]] = first[same]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at places: the high part of the i-th element is the number of zeros before its one."""
        if self._many(len(at)):
            return ((self._directory[1][at].astype(np.int64) - at).astype(np.uint64) << U(self.width)) | self._lows[at]
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, at, "right") - 1
        rest = at - ones[word]
        bits, place = self.high[word], np.zeros(len(at), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            held = np.bitwise_count((bits >> place.astype(np.uint64)) & U((1 << step) - 1)).astype(np.int64)
            skip = held <= rest
            rest -= np.where(skip, held, 0)
            place += np.where(skip, step, 0)
        return ((word * 64 + place - at).astype(np.uint64) << U(self.width)) | self._low(at)

    def parts(self) -> tuple[list[int], list[np.ndarray]]:
        return [self.n, self.universe, self.width], [self.low, self.high, self.zeros]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(values)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _by_runs(sequence: EliasFano, values: np.ndarray) -> np.ndarray:
    """Places of values, each run of equal values being looked up once."""
    if not len(values):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return np.repeat(sequence.find(values[first]), np.diff(first, append=len(values)))


#: Quantised probabilities in a byte: 0 stands for 0, codes from 1 for powers of ten from -7 to 0 in equal steps of 7 %.
LEVELS, DECADES = 255, 7.0


def quantise(p: np.ndarray, least: int = 0) -> np.ndarray:
    """Codes of the next lower level, so that sums of probabilities don't grow."""
    with np.errstate(divide="ignore"):
        code = np.floor((np.log10(p) + DECADES) / DECADES * (LEVELS - 1) + 1e-9) + 1
    return np.clip(np.where(code < 1, least, code), 0, LEVELS).astype(np.uint8)


def levels() -> np.ndarray:
    return np.concatenate([[0.0], 10 ** (DECADES * (np.arange(LEVELS) / (LEVELS - 1) - 1))])


def ones_twos(counts: np.ndarray) -> tuple[int, int]:
    return int((counts == 1).sum()), int((counts == 2).sum())


def discount(one: int, two: int) -> float:
    """Absolute discount from the numbers of counts 1 and 2, strictly between 0 and 1."""
    return min(0.95, (one + 1) / (one + 2 * two + 2))


class NgramTrie:
    """Discounted probabilities of w after v, and of w after u v, for the contexts of one shard.

    Levels: contexts v; successors w of v; words u before v; successors w of
    (u, v), each written as its place among the successors of v (relative to
    the shorter context). A level's sequence is made monotone by adding, for
    every parent, the span of ids that its predecessors took, so one successor
    search finds a child of a given parent. Sequences are Elias-Fano coded,
    probabilities and backoff weights are codes of ``levels``.
    """

    NAMES = ("contexts", "successors", "befores", "relatives")
    CODES = ("p2", "back2", "p3", "back3", "sizes")

    def __init__(self, sequences: dict, codes: dict, span: int):
        self.sequences, self.codes, self.span = sequences, codes, span

    @classmethod
    def build(cls, v: np.ndarray, u: np.ndarray, w: np.ndarray, counts: np.ndarray, discounts: tuple[float, float] | None = None, shared: dict | None = None) -> "NgramTrie":
        """From distinct (v, u, w) with training counts above 0, sorted by v, u, w.

        ``discounts``: those of pairs and of trigrams; by default from these counts.
        ``shared``: arrays (context, w, c2, total, kinds) for contexts whose trigrams
        lie in other tries too: a row per pair that may be asked for, with its
        count, the context's count and its number of successors in all tries.
        """
        if shared is None:
            shared = {"context": v[:0], "w": w[:0], **{k: np.zeros(0, np.int64) for k in ("c2", "total", "kinds")}}
        span = int(max(u.max(initial=0), w.max(initial=0), shared["w"].max(initial=0))) + 1
        contexts = distinct(np.concatenate([v, shared["context"]]))
        vi, vs = np.searchsorted(contexts, v), np.searchsorted(contexts, shared["context"])
        key2 = vi.astype(np.uint64) * U(span) + w
        seen = shared["c2"] > 0
        key_s = vs[seen].astype(np.uint64) * U(span) + shared["w"][seen]
        pairs = distinct(np.concatenate([key2, key_s]))
        at2 = np.searchsorted(pairs, key2)
        c2 = np.bincount(at2, counts, len(pairs))
        c2[np.searchsorted(pairs, key_s)] = shared["c2"][seen]
        parent2 = (pairs // U(span)).astype(np.int64)
        held2 = np.bincount(parent2, minlength=len(contexts))
        total2, kinds2 = np.bincount(parent2, c2, len(contexts)), held2.copy()
        total2[vs], kinds2[vs] = shared["total"], shared["kinds"]
        d2, d3 = discounts or (discount(*ones_twos(c2)), discount(*ones_twos(counts)))
        p2 = quantise((c2 - d2) / total2[parent2]) if len(pairs) else np.zeros(0, np.uint8)
        back2 = quantise(d2 * kinds2 / np.maximum(total2, 1), 1)
        first2 = np.searchsorted(parent2, np.arange(len(contexts)))
        key_u = vi.astype(np.uint64) * U(span) + u
        # Trigrams come sorted by v, u.
        new = np.concatenate([[True], key_u[1:] != key_u[:-1]]) if len(key_u) else np.zeros(0, bool)
        befores, at_u = key_u[new], np.cumsum(new) - 1
        total3 = np.bincount(at_u, counts, len(befores))
        kinds3 = np.bincount(at_u, minlength=len(befores))
        p3 = quantise((counts - d3) / total3[at_u]) if len(counts) else np.zeros(0, np.uint8)
        back3 = quantise(d3 * kinds3 / np.maximum(total3, 1), 1)
        # Children of (u, v) take as many ids as v has successors.
        sizes = held2.astype(np.uint64)
        room = sizes[(befores // U(span)).astype(np.int64)]
        base3 = np.cumsum(room) - room
        relative = base3[at_u] + (at2 - first2[vi]).astype(np.uint64)
        sequences = {
            "contexts": EliasFano.encode(contexts, int(contexts[-1]) + 1 if len(contexts) else 1),
            "successors": EliasFano.encode(pairs, len(contexts) * span),
            "befores": EliasFano.encode(befores, len(contexts) * span),
            "relatives": EliasFano.encode(relative, int(room.sum())),
            # Monotone pointers: where each context's successors, and each (u, v)'s children, begin.
            "pointers2": EliasFano.encode(first2.astype(np.uint64), len(pairs) + 1),
            "pointers3": EliasFano.encode(base3, int(room.sum()) + 1),
        }
        return cls(sequences, {"p2": p2, "back2": back2, "p3": p3, "back3": back3}, span)

    def query(self, v: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b) with P(w | u v) = a + b * P(w), for each query."""
        s, c, table = self.sequences, self.codes, levels()
        a, b = np.zeros(len(v)), np.ones(len(v))
        vi = _by_runs(s["contexts"], v)
        known = np.flatnonzero(vi >= 0)
        if not known.size:
            return a, b
        vk = vi[known].astype(np.uint64)
        uk, wk = u[known], w[known]
        inside = wk < U(self.span)
        at2 = np.full(len(known), -1, np.int64)
        at2[inside] = s["successors"].find(vk[inside] * U(self.span) + wk[inside])
        a[known] = np.where(at2 >= 0, table[c["p2"][at2]], 0.0) if len(c["p2"]) else 0.0
        b[known] = table[c["back2"][vi[known]]]
        ui = np.full(len(known), -1, np.int64)
        inside = uk < U(self.span)
        ui[inside] = _by_runs(s["befores"], vk[inside] * U(self.span) + uk[inside])
        deep = np.flatnonzero(ui >= 0)
        if deep.size:
            back = table[c["back3"][ui[deep]]]
            # The word's place among the successors of v, then that place among the children of (u, v).
            both = np.flatnonzero(at2[deep] >= 0)
            own = np.zeros(len(deep))
            if both.size:
                d = deep[both]
                place = at2[d].astype(np.uint64) - s["pointers2"].access(vi[known[d]])
                at3 = s["relatives"].find(s["pointers3"].access(ui[d]) + place)
                own[both] = np.where(at3 >= 0, table[c["p3"][at3]], 0.0)
            k = known[deep]
            a[k] = own + back * a[k]
            b[k] = back * b[k]
        return a, b

    def to_bytes(self) -> bytes:
        """One buffer: a header, then the arrays at multiples of 8 bytes."""
        numbers, arrays = [self.span], []
        for name in (*self.NAMES, "pointers2", "pointers3"):
            n, a = self.sequences[name].parts()
            numbers += n
            arrays += a
        arrays += [self.codes[k] for k in self.CODES[:4]]
        head = struct.pack(f"<{2 + len(numbers) + 2 * len(arrays)}Q", len(numbers), len(arrays), *numbers, *(x for a in arrays for x in (a.nbytes, a.dtype.itemsize)))
        return head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @classmethod
    def from_buffer(cls, buffer) -> "NgramTrie":
        """Levels as views of a buffer or memory map; nothing is copied."""
        raw = np.frombuffer(buffer, np.uint8)
        n, k = struct.unpack_from("<2Q", raw, 0)
        numbers = struct.unpack_from(f"<{n}Q", raw, 16)
        shapes = struct.unpack_from(f"<{2 * k}Q", raw, 16 + 8 * n)
        at, arrays = 16 + 8 * n + 16 * k, []
        for size, item in zip(shapes[::2], shapes[1::2]):
            arrays.append(raw[at : at + size].view(f"<u{item}"))
            at += size + -size % 8
        sequences = {name: EliasFano(*numbers[1 + 3 * i : 4 + 3 * i], *arrays[3 * i : 3 * i + 3]) for i, name in enumerate((*cls.NAMES, "pointers2", "pointers3"))}
        return cls(sequences, dict(zip(cls.CODES[:4], arrays[-4:])), numbers[0])

    @classmethod
    def open(cls, path: str) -> "NgramTrie":
        """A trie in a file, memory-mapped."""
        return cls.from_buffer(np.memmap(path, np.uint8, "r"))
