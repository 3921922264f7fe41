"""Anchors: positions that equal windows of symbols agree on, wherever the windows lie.

The window of L symbols that begins at p picks the position of its least k-symbol
hash. Equal windows pick the same position within them, so windows need only be
compared with windows whose anchor starts with the same k symbols. About
2 / (L - k + 2) of all positions are anchors.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"r": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    while len(have) < n:
        step = np.uint64(pow(int(base), len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of k symbols; values are hashes of single symbols."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power("r", _R, n), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * _power("i", _RINV, n - k + 1))


def find(values: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Anchors of all windows of the documents laid end to end in values.

    ends: where each document ends. Returns arrays: document number, position in
    values, lo, hi, hash; the anchor serves the windows that begin lo..hi before it.
    """
    n, w = len(values), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(values, k)
    bits = np.uint64(max(20, int(n).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    count = n - length + 1
    m = np.minimum(m[:count], m[w - span : w - span + count])
    at = (m & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), ends - starts)[:count]
    valid = np.arange(count) + length <= ends[doc]
    p = np.flatnonzero(valid)
    if not len(p):
        return none, none, none, none, np.zeros(0, np.uint64)
    at, doc = at[p], doc[p]
    # one run for each (document, anchor): its windows are consecutive
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    tail = np.concatenate([head[1:], [len(p)]]) - 1
    return doc[head], at[head], at[head] - p[tail], at[head] - p[head], h[at[head]]
