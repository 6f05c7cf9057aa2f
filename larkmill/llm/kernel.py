"""Vectorised hashing of words and word windows over Arrow string arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.ones(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[97:123] = _PLAIN[128:] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: pa.Array, plain: bool, seed: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a large_string array, in order, and each row's offset into them (one more than rows).

    plain: lower-cased words of ASCII letters, digits and non-ASCII characters; else runs without ASCII white space.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if plain:
        texts = pc.utf8_lower(texts)
    texts = pa.concat_arrays([texts])
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2]
    raw = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        raw[: hi - lo] = np.frombuffer(data, np.uint8)[lo:hi]
    offsets = offsets - lo
    inside = (_PLAIN if plain else _SPACE)[raw[: hi - lo]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[offsets] = True
    before = np.zeros(hi - lo, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(hi - lo, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    size = ends - starts
    eight = np.ndarray((max(0, hi - lo + 1),), np.dtype("<u8"), raw, strides=(1,)) if hi > lo else np.zeros(1, _U)
    h = mix(size.astype(_U) + _U(seed))
    at, live = 0, np.arange(len(starts))
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] * _U(0xD6E8FEB86659FD93) ^ (eight[starts[live] + at] & _KEEP[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    return h, np.searchsorted(starts, offsets)


def windows(h: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words within rows, in order, and each row's offset into them.

    whole: a row of 1 to k - 1 words has one window, of all its words.
    """
    count = np.diff(first)
    full = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k)) if whole else np.zeros(0, int)
    n = full.copy()
    n[short] = 1
    out_first = np.concatenate(([0], np.cumsum(n)))
    start = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], n)
    acc = np.full(len(start), k, _U)
    if len(short):
        is_short = np.zeros(len(count), bool)
        is_short[short] = True
        lone = np.repeat(is_short, n)
        size = np.repeat(np.minimum(count, k), n)
        for j in range(k):
            more = ~lone | (j < size)
            acc[more] = mix(acc[more] * _U(0x9FB21C651E98DF25) + h[start[more] + j])
    else:
        for j in range(k):
            acc = mix(acc * _U(0x9FB21C651E98DF25) + h[start + j])
    return acc, out_first
