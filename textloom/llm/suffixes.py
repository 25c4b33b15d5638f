"""Suffix order and longest previous factors of byte strings, in numpy."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(data)].astype(np.uint64)
    return out


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _by_words(data: np.ndarray, at: np.ndarray, time: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``prefix_order``, for few positions that all have ``length`` bytes: sorted by numbers of eight bytes."""
    at8 = _words(data)
    keys = [at8[at + k] for k in range(0, length - 7, 8)]
    if length % 8:
        keys.append(at8[at + length - length % 8] >> np.uint64(64 - 8 * (length % 8)) << np.uint64(64 - 8 * (length % 8)))
    order = np.lexsort((time, *reversed(keys)))
    common, open_ = np.zeros(len(at) - 1, np.int64), np.ones(len(at) - 1, bool)
    for k in keys:
        k = k[order]
        differ = k[1:] ^ k[:-1]
        same = sum(((differ >> np.uint64(56 - 8 * b)) == 0).astype(np.int64) for b in range(8))
        common += same * open_
        open_ &= same == 8
    return order, np.concatenate([[0], np.minimum(common, length)])


def prefix_order(data: np.ndarray, at: np.ndarray, time: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions ``at`` by their next ``length`` bytes, then by ``time``; and
    the length (at most ``length``) of what each entry shares with the one before it.

    ``length`` is 16 or more.  Prefix doubling: numbers of 8 bytes, then ranks of 16, 32, ... bytes.
    """
    if at.max() + length <= len(data) and len(at) * (length // 8) < len(data) * 5:
        return _by_words(data, at, time, length)
    levels = [(8, _words(data))]
    while levels[-1][0] * 2 <= length:
        size, rank = levels[-1]
        levels.append((size * 2, _ranks(rank, _shifted(rank, size))))
    size, rank = levels[-1]
    tail = _shifted(rank, length - size)
    order = np.lexsort((time, tail[at], rank[at]))
    a, b = at[order][:-1], at[order][1:]
    common, n = np.zeros(len(a), np.int64), len(data)
    steps = [(size, rank) for size, rank in reversed(levels)] + [(1, data)] * 7
    for size, rank in steps:  # what is left after a level is shorter than it
        i, j = a + common, b + common
        fits = (np.maximum(i, j) + size <= n) & (common + size <= length)
        common += size * (fits & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]))
    return order, np.concatenate([[0], common])


def _smaller_before(time: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest earlier entry of smaller time (-1: none) and the least ``shared`` on the way."""
    n = len(time)
    to, low = np.arange(-1, n - 1), shared.copy()
    todo = np.flatnonzero((to >= 0) & (time[np.maximum(to, 0)] >= time))
    while len(todo):
        # an entry on the way isn't smaller, so what is smaller than it is the next candidate
        via = to[todo]
        low[todo] = np.minimum(low[todo], low[via])
        to[todo] = to[via]
        todo = todo[(to[todo] >= 0)]
        todo = todo[time[to[todo]] >= time[todo]]
    return to, low


def previous_factors(data: np.ndarray, at: np.ndarray, time: np.ndarray, length: int) -> np.ndarray:
    """For each position the longest string (at most ``length``) that also starts at a position of smaller time.

    The previous and the next entry of smaller time in suffix order give it.  Times must differ.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    order, shared = prefix_order(data, at, time, length)
    when = time[order]
    before, low_before = _smaller_before(when, shared)
    after, low_after = _smaller_before(when[::-1], np.concatenate([shared[1:], [0]])[::-1])
    best = np.maximum(np.where(before >= 0, low_before, 0), np.where(after >= 0, low_after, 0)[::-1])
    out = np.zeros(len(at), np.int64)
    out[order] = best
    return out
