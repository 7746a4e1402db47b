"""Tokens of a batch of texts inside a task: the ``search.text_tokens`` of
texts that were lower-cased before, found in the batch's bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INSIDE = np.zeros(256, bool)
_INSIDE[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True


def batch_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, tokens): a-z0-9 runs of lower-cased texts, in order.
    Bytes of other characters are never letters in UTF-8; no run crosses texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _INSIDE[raw]
    goes_on = np.r_[False, inside[:-1]][:len(raw)]
    goes_on[at[:-1][at[:-1] < len(raw)]] = False
    letters = np.flatnonzero(inside)
    first = np.flatnonzero(~goes_on[letters])  # among the letters
    tokens = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[first, len(letters)].astype(np.int64)), pa.py_buffer(raw[letters]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(letters[first], at))), tokens


def counted_places(rows: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, how often) by row, then place, of tokens at places 0 .. size - 1."""
    key, n = np.unique(rows * max(size, 1) + places, return_counts=True)
    return key // max(size, 1), key % max(size, 1), n


def lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values, ordered by their row, as one list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def murmur3(tokens: pa.Array, seed: int = 42) -> np.ndarray:
    """Signed 32-bit MurmurHash3 of the tokens' bytes, as ``HashingTF`` takes it."""
    tokens = tokens.cast(pa.large_string())
    _, offsets, data = tokens.buffers()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    at = np.frombuffer(offsets, np.int64)[tokens.offset:tokens.offset + n + 1]
    raw = np.r_[np.frombuffer(data, np.uint8)[:at[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(4, np.uint8)].astype(np.uint32)
    size, at = np.diff(at), at[:-1]
    h = np.full(n, seed, np.uint32)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    def mixed(k: np.ndarray) -> np.ndarray:
        return turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    whole, step, going = size // 4, 0, np.flatnonzero(size >= 4)
    while len(going):
        p = at[going] + 4 * step
        k = raw[p] | raw[p + 1] << np.uint32(8) | raw[p + 2] << np.uint32(16) | raw[p + 3] << np.uint32(24)
        h[going] = turned(h[going] ^ mixed(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        step += 1
        going = going[whole[going] > step]
    rest, p = size % 4, at + whole * 4
    k = np.zeros(n, np.uint32)
    for i in range(3):
        on = rest > i
        k[on] |= raw[p[on] + i] << np.uint32(8 * i)
    h ^= mixed(k)
    h ^= size.astype(np.uint32)
    for by, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(by))) * np.uint32(times)
    h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64)


def buckets(texts: pa.Array, num_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, how often) of the texts' tokens, folded as ``HashingTF`` folds them."""
    rows, tokens = batch_tokens(texts)
    enc = tokens.dictionary_encode()
    place = murmur3(enc.dictionary) % num_features
    return counted_places(rows, place[enc.indices.to_numpy(zero_copy_only=False)], num_features)
