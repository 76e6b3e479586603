"""Elias-Fano n-gram trie: compact levels that are memory-mapped and searched in batches."""

from __future__ import annotations

import json

import numpy as np

from .packed_ids import pack

#: Queries that are searched together, which bounds the memory of one search.
TOGETHER = 1 << 18


def _gather(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The ``bits``-wide numbers at places ``at`` of packed 32-bit words."""
    if not bits:
        return np.zeros(len(at), "u8")
    place = at // 32 * (32 * bits) + at % 32 * bits
    word, shift = place >> 5, (place & 31).astype("u8")
    low = words[word].astype("u8") >> shift
    high = words[np.minimum(word + 1, len(words) - 1)].astype("u8") << (np.uint64(32) - shift)
    return (low | high) & np.uint64((1 << bits) - 1)


def _nth_one(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place in each 64-bit word of its one number ``rank``, by halving."""
    place = np.zeros(len(words), "i8")
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype("i8")
        beyond = rank >= ones
        rank = rank - np.where(beyond, ones, 0)
        place += np.where(beyond, width, 0)
        words = np.where(beyond, words >> np.uint64(width), words)
    return place


class EliasFano:
    """A nondecreasing sequence: low bits packed, high bits in unary, with a count of ones before each word."""

    PARTS = ("low", "high", "ones")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = 64 * np.arange(len(ones)) - ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = min(32, max(0, (universe // max(1, n)).bit_length() - 1))
        values = values.astype("u8")
        low = np.frombuffer(pack((values & np.uint64((1 << bits) - 1)), bits), "<u4") if bits and n else np.zeros(1, "<u4")
        places = (values >> np.uint64(bits)).astype("i8") + np.arange(n)
        size = -(-(n + (universe >> bits) + 2) // 64) * 64
        unary = np.zeros(size, "u1")
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype="i8")]).astype("<i8"))

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places in the unary part of the k-th ones or zeros, from 0."""
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, k, "right") - 1
        held = self.high[word]
        return word * 64 + _nth_one(~held if zeros else held, k - before[word])

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at places ``at``."""
        if not len(at):
            return np.zeros(0, "i8")
        high = self._select(at, False) - at
        return (high << self.bits) | _gather(self.low, self.bits, at).astype("i8")

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in ``[first, end)`` whose value is at least ``x``, or ``end``: the values that
        share x's high bits lie between two zeros of the unary part, and a bisection of their low bits does the rest."""
        if not len(x):
            return np.zeros(0, "i8")
        high = x >> self.bits
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        stop = self._select(high, True) - high
        lo, hi = np.clip(start, first, end), np.clip(stop, first, end)
        low = (x & ((1 << self.bits) - 1)).astype("u8")
        while len(active := np.flatnonzero(lo < hi)):
            middle = (lo[active] + hi[active]) // 2
            less = _gather(self.low, self.bits, middle) < low[active]
            lo[active], hi[active] = np.where(less, middle + 1, lo[active]), np.where(less, hi[active], middle)
        return lo

    def places(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in ``[first, end)`` of each value ``x``, or -1."""
        out = np.full(len(x), -1)
        for i in range(0, len(x), TOGETHER):
            some = slice(i, i + TOGETHER)
            at = self.successor(x[some], first[some], end[some])
            hit = np.flatnonzero(at < end[some])
            hit = hit[self.access(at[hit]) == x[some][hit]]
            out[some][hit] = at[hit]
        return out


def quantise(values: np.ndarray, levels: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """Codes from 1 and their book: means of bins of equal width, so that no value is off by
    more than a 255th of their range; exact for no more distinct values than levels. Code 0 is for what is absent."""
    if not len(values):
        return np.zeros(0, "u1"), np.zeros(1)
    low, high = values.min(), values.max()
    bins = np.minimum(((values - low) * (levels / max(high - low, 1e-9))).astype("i8"), levels - 1)
    some = np.unique(values[: 64 * levels])
    if len(some) <= levels and len(distinct := np.unique(values)) <= levels:
        bins = np.searchsorted(distinct, values)
    counts = np.bincount(bins, minlength=levels)
    return (bins + 1).astype("u1"), np.concatenate([[0.0], np.bincount(bins, values, levels) / np.maximum(counts, 1)])


class Trie:
    """First words, the words seen after each, and the words seen after each of those pairs.

    Level one: the numbers of first words as one monotone sequence, and monotone pointers to level two.
    Level two: word numbers counted up from their first word, so that they are one monotone sequence;
    quantised discounted probabilities; quantised backoff weights of the pairs; monotone pointers to level three.
    Level three: word numbers counted up from their pair, and quantised discounted probabilities.

    p(c | a, b) = n(abc) / (n(ab) + mu) + mu / (n(ab) + mu) * p(c | b), and likewise for p(b | a): Dirichlet smoothing.
    """

    SEQUENCES = ("firsts", "seconds", "thirds", "to_seconds", "to_thirds")
    PLAIN = ("p2", "p3", "weights", "p2_book", "p3_book", "weight_book")

    def __init__(self, data: np.ndarray):
        size = int.from_bytes(data[:8].tobytes(), "little")
        head = json.loads(data[8 : 8 + size].tobytes())
        parts = {k: data[at : at + n].view(kind) for k, (kind, at, n) in head["parts"].items()}
        self.vocabulary = head["vocabulary"]
        self.p2, self.p3, self.weights, self.p2_book, self.p3_book, self.weight_book = (parts[k] for k in self.PLAIN)
        self.firsts, self.seconds, self.thirds, self.to_seconds, self.to_thirds = (
            EliasFano(*head["sequences"][s], *(parts[f"{s}.{k}"] for k in EliasFano.PARTS)) for s in self.SEQUENCES
        )

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, total_a: np.ndarray, total_ab: np.ndarray, pair: np.ndarray, c: np.ndarray, n: np.ndarray, vocabulary: int, mu: tuple[float, float]) -> bytes:
        """Of distinct pairs (a, b) in order, with how often a and the pair stand before a word, and of distinct
        (pair, c) in order, ``pair`` being a place among the pairs, with their counts ``n``."""
        firsts, starts = np.unique(a, return_index=True)
        first_of = np.repeat(np.arange(len(firsts)), np.diff(np.append(starts, len(a))))
        ends = np.searchsorted(pair, np.arange(len(a) + 1))
        sequences = {
            "firsts": EliasFano.build(firsts, vocabulary + 1),
            "seconds": EliasFano.build(first_of * vocabulary + b, len(firsts) * vocabulary + 1),
            "thirds": EliasFano.build(pair * vocabulary + c, len(a) * vocabulary + 1),
            "to_seconds": EliasFano.build(np.append(starts, len(a)), len(a) + 1),
            "to_thirds": EliasFano.build(ends, len(c) + 1),
        }
        p2, p2_book = quantise(np.log10(total_ab / (total_a + mu[0])))
        p3, p3_book = quantise(np.log10(n / (total_ab[pair] + mu[1])))
        weights, weight_book = quantise(np.log10(mu[1] / (total_ab + mu[1])))
        parts = dict(zip(cls.PLAIN, (p2, p3, weights, p2_book, p3_book, weight_book), strict=True))
        parts |= {f"{s}.{k}": getattr(ef, k) for s, ef in sequences.items() for k in EliasFano.PARTS}
        head: dict = {"vocabulary": vocabulary, "sequences": {s: [ef.n, ef.bits] for s, ef in sequences.items()}, "parts": {}}
        places, at = {}, 0
        for k, v in parts.items():
            places[k] = at
            at += -(-v.nbytes // 8) * 8
        head["parts"] = {k: [v.dtype.str, 0, v.nbytes] for k, v in parts.items()}
        room = -(-(len(json.dumps(head)) + 24 * len(parts)) // 8) * 8
        for k in parts:
            head["parts"][k][1] = 8 + room + places[k]
        body = json.dumps(head).encode().ljust(room)
        return b"".join([room.to_bytes(8, "little"), body, *(v.tobytes().ljust(-(-v.nbytes // 8) * 8, b"\0") for v in parts.values())])

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in level two, or -1."""
        if not self.firsts.n:
            return np.full(len(a), -1)
        firsts, back = np.unique(a, return_inverse=True)
        zero = np.zeros(len(firsts), "i8")
        at = self.firsts.places(firsts, zero, zero + self.firsts.n)
        first, end = (self.to_seconds.access(np.maximum(at, 0) + k) * (at >= 0) for k in (0, 1))
        return self.seconds.places(np.maximum(at, 0)[back] * self.vocabulary + b, first[back], end[back])

    def find_thirds(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The place in level three of each word after a pair's place, or -1; places are sorted."""
        out = np.full(len(node), -1)
        known = np.flatnonzero(node >= 0)
        nodes, back = np.unique(node[known], return_inverse=True)
        first, end = (self.to_thirds.access(nodes + k) for k in (0, 1))
        out[known] = self.thirds.places(node[known] * self.vocabulary + c[known], first[back], end[back])
        return out

    @staticmethod
    def codes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The codes at places, 0 at -1."""
        return np.where(at >= 0, values[np.maximum(at, 0)], 0).astype("u1") if len(values) else np.zeros(len(at), "u1")
