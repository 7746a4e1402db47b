"""Elias-Fano sequences and an n-gram trie of them, in one memory-mapped file.

A non-decreasing sequence keeps its low bits packed and its high bits in unary,
about ``2 + log2(universe / n)`` bits a value.  Searches work on whole arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64


def pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of each value, one after the other, plus padding for 8-byte reads."""
    out = []
    if bits:
        for a in range(0, len(values), 1 << 16):  # a multiple of 8 values fills whole bytes
            part = values[a:a + (1 << 16)]
            bytes_ = part.astype("<u8").view(np.uint8).reshape(-1, 8)
            out.append(np.packbits(np.unpackbits(bytes_, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


class EliasFano:
    """A view over (n, bits, low, high); made by ``build``, read in place."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low = n, bits, np.asarray(low)
        self.zeros = np.flatnonzero(np.unpackbits(high, bitorder="little") == 0)  # where each bucket of equal high bits ends

    @staticmethod
    def build(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, min(57, (top // max(n, 1)).bit_length() - 1))
        high = (values >> U64(bits)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 2
        unary = np.zeros(-(-length // 8) * 8, np.uint8)
        unary[high + np.arange(n)] = 1
        return n, bits, pack_low(values, bits), np.packbits(unary, bitorder="little")

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.bits
        byte, out = at >> 3, np.zeros(len(i), U64)
        for j in range(8):
            out |= self.low[byte + j].astype(U64) << U64(8 * j)
        return (out >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, end) of the values whose high bits are ``high``."""
        last = len(self.zeros) - 1
        h = np.minimum(high, U64(last)).astype(np.int64)
        first = np.where(h > 0, self.zeros[np.maximum(h - 1, 0)] - (h - 1), 0)
        end = self.zeros[h] - h
        past = high > U64(last)
        return np.where(past, self.n, np.minimum(first, self.n)), np.where(past, self.n, np.minimum(end, self.n))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x (n if none), by bisection in x's bucket."""
        a, b = self.bucket(x >> U64(self.bits))
        want = x & U64((1 << self.bits) - 1) if self.bits else np.zeros(len(x), U64)
        a, b = a.copy(), b.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = self.lows(mid) < want[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)
            todo = todo[a[todo] < b[todo]]
        return a

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i`` (0 <= i < n)."""
        # the bucket of place i: the first whose end is past i
        ends = self.zeros - np.arange(len(self.zeros))
        return (np.searchsorted(ends, i, side="right").astype(U64) << U64(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, or -1."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        i = self.successor(x)
        hit = i < self.n
        hit[hit] = self.at(i[hit]) == x[hit]
        return np.where(hit, i, -1)


class Trie:
    """Two levels: words with codes (their own, and what their successors leave) and monotone pointers to their successors;
    successors as context rank * vocabulary + word rank, which only grows, with
    codes.  A successor is searched within its context's range alone."""

    def __init__(self, words: np.ndarray, word_codes: np.ndarray, left_codes: np.ndarray, context: np.ndarray, word: np.ndarray, codes: np.ndarray,
                 vocabulary: np.ndarray):
        """``context``/``word`` are ranks in ``words``/``vocabulary``, sorted by both."""
        pointers = np.searchsorted(context, np.arange(len(words) + 1)).astype(U64)
        parts = {"words": words, "pointers": pointers, "vocabulary": vocabulary,
                 "successors": context.astype(U64) * U64(max(len(vocabulary), 1)) + word.astype(U64)}
        self.file = tempfile.TemporaryFile()  # has no name: it goes with the task, however that ends
        where: dict[str, tuple[int, int, slice, slice]] = {}
        size = 0
        for name, v in parts.items():
            n, bits, low, high = EliasFano.build(v)
            self.file.write(low.tobytes() + high.tobytes())
            where[name] = (n, bits, slice(size, size + len(low)), slice(size + len(low), size + len(low) + len(high)))
            size += len(low) + len(high)
        self.file.write(word_codes.tobytes() + left_codes.tobytes() + codes.tobytes() + b"\0")
        self.file.flush()
        data = np.memmap(self.file, np.uint8, "r")
        seq = {k: EliasFano(n, bits, data[low], data[high]) for k, (n, bits, low, high) in where.items()}
        self.words, self.pointers, self.vocabulary, self.successors = (seq[k] for k in parts)
        ends = size + np.cumsum([0, len(word_codes), len(left_codes), len(codes)])
        self.word_codes, self.left_codes, self.codes = (data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))
        self.bytes = int(ends[-1])

    def context_codes(self, rank: np.ndarray, follow: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of successors (0 if there is none): ``follow[i]`` of the
        ``word``s come after the context rank ``rank[i]``."""
        out = np.zeros(len(word), np.uint8)
        known = self.vocabulary.find(word)
        at = np.maximum(rank, 0)
        range_ = [np.repeat(v.astype(np.int64), follow) for v in (self.pointers.at(at), self.pointers.at(at + 1))]
        rank = np.repeat(rank, follow)
        ask = np.flatnonzero((rank >= 0) & (known >= 0))
        if len(ask) and self.successors.n:
            first, end = range_[0][ask], range_[1][ask]
            key = rank[ask].astype(U64) * U64(max(self.vocabulary.n, 1)) + known[ask].astype(U64)
            i = self.successors.successor(key).astype(np.int64)
            inside = (i >= first) & (i < end)
            inside[inside] = self.successors.at(i[inside]) == key[inside]
            out[ask[inside]] = self.codes[i[inside]]
        return out
