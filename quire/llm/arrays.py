"""Vectorised hashing of texts as bytes, for use inside Arrow functions.

Texts are taken in groups of about GROUP_BYTES (or one text, if longer), so that memory follows the longest text and not the batch.
All hashes are 64-bit: a polynomial over the bytes by prefix sums modulo 2**64, then mixed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U64))[0])


@functools.lru_cache(4)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    inverse = pow(BASE, -1, 2**64)
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (BASE, inverse))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    up, down = _powers(max(GROUP_BYTES.bit_length(), int(n).bit_length()))
    return up, down


def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets): texts[first:end] as one byte array, text i at offsets[i-first]:offsets[i-first+1]. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of (data[t] + 1) * BASE**t for i <= t < j."""
    up, _ = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; equal for equal bytes wherever they stand."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of each run of anything but ASCII white space within its text."""
    solid = ~_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte starts a word whatever stands before it
    before = np.zeros(len(data), bool)
    if len(data):
        before[1:] = solid[:-1]
    start = np.nonzero(solid & (~before | edge[:-1]))[0]
    after = np.zeros(len(data), bool)
    if len(data):
        after[:-1] = solid[1:]
    end = np.nonzero(solid & (~after | edge[1:]))[0] + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    return _lower[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc, hash) of the words, A-Z read as a-z."""
    low = lower(data)
    start, end, doc = words(low, offsets)
    return start, end, doc, span_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
