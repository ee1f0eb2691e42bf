"""Elias-Fano sequences and an n-gram trie of two levels over them, in one buffer that can be memory-mapped."""

from __future__ import annotations

import struct

import numpy as np

_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _u64(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64)


def _select_in_words(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The bit position of the nth (from 0) one of each word, by halving."""
    at, left = np.zeros(len(words), dtype=np.uint64), nth.astype(np.uint64).copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = (words >> at) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.uint64)
        right = left >= ones
        left -= np.where(right, ones, 0).astype(np.uint64)
        at += np.where(right, width, 0).astype(np.uint64)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones_before

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = _u64(values)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        high_part = values >> np.uint64(low_bits) if low_bits < 64 else np.zeros(n, dtype=np.uint64)
        # a zero closes each high value, one more than the largest's, so that select of zeros never runs out
        size = int(top >> low_bits) + 2 + n
        high = np.zeros(-(-size // 64) + 1, dtype=np.uint64)
        at = high_part + np.arange(n, dtype=np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), _ONE << (at & np.uint64(63)))
        low = np.zeros(-(-n * low_bits // 64) + 2, dtype=np.uint64)
        if low_bits and n:
            part = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        return cls(n, low_bits, low, high)

    def to_bytes(self) -> bytes:
        return struct.pack("<4q", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buffer, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high = struct.unpack_from("<4q", buffer, at)
        low = np.frombuffer(buffer, dtype=np.uint64, count=n_low, offset=at + 32)
        high = np.frombuffer(buffer, dtype=np.uint64, count=n_high, offset=at + 32 + 8 * n_low)
        return cls(n, low_bits, low, high), at + 32 + 8 * (n_low + n_high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        both = self.low[word] >> off
        spill = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (both | spill) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.high[word]
        return word * 64 + _select_in_words(bits ^ _ALL if flip else bits, k - before[word]).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(self.ones_before, i, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i) if self.low_bits < 64 else self._low(i)

    def _rank_high(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part below ``h``."""
        out = np.zeros(len(h), dtype=np.int64)
        some = h > 0
        k = np.minimum(h[some].astype(np.int64), self.zeros_before[-1] + 0) - 1
        out[some] = np.minimum(self._select(self.zeros_before, k, True) - k, self.n)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Positions of the first value >= x within [lo, hi) (hi where there is none)."""
        x = _u64(x)
        h, want = x >> np.uint64(self.low_bits), x & np.uint64((1 << self.low_bits) - 1)
        h = np.minimum(h, np.uint64(max(0, int(self.zeros_before[-1]) - 2)))
        a = np.maximum(self._rank_high(h), lo)
        b = np.maximum(a, np.minimum(self._rank_high(h + _ONE), hi))
        b = np.where(a > hi, a, b)
        end = b.copy()
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
        return np.minimum(np.where(a < end, a, end), hi)


class BigramTrie:
    """Words with counts and back-off codes; below each word its followers with probability codes.

    Level 1 is the Elias-Fano sequence of word hashes; pointers, monotone too, say where each word's followers
    begin; level 2 holds the followers' short hashes made monotone by their word's rank.
    """

    def __init__(self, words, pointers, followers, counts, backoff, codes):
        self.words, self.pointers, self.followers = words, pointers, followers
        self.counts, self.backoff, self.codes = counts, backoff, codes

    @staticmethod
    def build(words, counts, children, follower, backoff, codes) -> bytes:
        """words: sorted hashes; children: followers of each word; follower: 32-bit hashes, sorted within a word."""
        rank = np.repeat(np.arange(len(words), dtype=np.uint64), children)
        ends = np.concatenate([[0], np.cumsum(children, dtype=np.int64)])
        parts = [EliasFano.build(v).to_bytes() for v in (_u64(words), _u64(ends), (rank << np.uint64(32)) | _u64(follower))]
        return b"".join([*parts, struct.pack("<2q", len(words), len(codes)), np.asarray(counts, dtype="<u8").tobytes(), np.asarray(backoff, dtype=np.uint8).tobytes(), np.asarray(codes, dtype=np.uint8).tobytes()])

    @classmethod
    def open(cls, buffer) -> BigramTrie:
        words, at = EliasFano.from_buffer(buffer, 0)
        pointers, at = EliasFano.from_buffer(buffer, at)
        followers, at = EliasFano.from_buffer(buffer, at)
        n, m = struct.unpack_from("<2q", buffer, at)
        counts = np.frombuffer(buffer, dtype="<u8", count=n, offset=at + 16)
        backoff = np.frombuffer(buffer, dtype=np.uint8, count=n, offset=at + 16 + 8 * n)
        codes = np.frombuffer(buffer, dtype=np.uint8, count=m, offset=at + 16 + 9 * n)
        return cls(words, pointers, followers, counts, backoff, codes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for unknown ones."""
        n = self.words.n
        if not n or not len(hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = self.words.successor(np.zeros(len(hashes), dtype=np.int64), np.full(len(hashes), n, dtype=np.int64), hashes)
        seen = self.words.access(np.minimum(at, n - 1)) == _u64(hashes)
        return np.where((at < n) & seen, at, -1)

    def follow(self, ranks: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Probability codes of followers below the words at ``ranks``, 0 for unknown ones."""
        out, known = np.zeros(len(ranks), dtype=np.uint8), np.flatnonzero(ranks >= 0)
        if not len(known) or not self.followers.n:
            return out
        r = ranks[known]
        lo, hi = self.pointers.access(r).astype(np.int64), self.pointers.access(r + 1).astype(np.int64)
        want = (r.astype(np.uint64) << np.uint64(32)) | _u64(follower[known])
        at = self.followers.successor(lo, hi, want)
        hit = at < hi
        hit[hit] = self.followers.access(at[hit]) == want[hit]
        out[known[hit]] = self.codes[at[hit]]
        return out
