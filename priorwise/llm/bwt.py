"""Repeats of a bounded length on a Burrows-Wheeler transform, by threshold-bounded interval expansion."""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # a byte that UTF-8 never uses


def rotation_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of ``text`` (uint8) in the order of their first ``depth`` bytes or more, by prefix doubling."""
    n = len(text)
    reach, key = 8, np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | np.roll(text, -k).astype(np.uint64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])), dtype=np.uint64)
        if reach >= depth:
            return order
        key = rank * np.uint64(n) + np.roll(rank, -reach)
        reach *= 2


def short_boundaries(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each rank, whether the rotations of it and of the rank before share fewer than ``depth`` bytes.

    Breadth-first backward extension: the interval of a string w, extended to the left by each byte before
    its occurrences, gives the intervals of all strings cw. The upper end of a new interval parts two
    rotations whose common prefix is as long as w; as intervals come by rising length, the first to reach a
    boundary tells its value, and intervals that end at a known boundary need no further extension. The
    expansion stops at the threshold: boundaries not reached by then have longer common prefixes.
    """
    n = len(text)
    before = text[order - 1]
    by_byte = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)  # rank of the rotation that starts one byte earlier
    step[by_byte] = np.arange(n)
    edge = np.zeros(n + 1, dtype=bool)  # where the first byte of the ranked rotations changes
    edge[np.concatenate(([0], np.cumsum(np.bincount(before, minlength=256))))] = True
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        if not len(low):
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        ranks = np.arange(sizes.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        to = step[ranks]
        if len(to) * 8 > n:
            of = np.full(n, -1, dtype=np.int64)
            of[to] = owner
            to = np.flatnonzero(of >= 0)
            owner = of[to]
        else:
            packed = to << 32 | owner
            packed.sort()
            to, owner = packed >> 32, packed & 0xFFFFFFFF
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | edge[to[1:]] | (to[1:] != to[:-1] + 1))))
        low = to[new]
        high = np.concatenate((to[new[1:] - 1], to[-1:])) + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return known[:n]


def least_by_window(pieces: list[bytes], values: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of ``length`` bytes of each piece, the least value of all pieces that have this window."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = rotation_order(text, length)
    groups = np.flatnonzero(short_boundaries(text, order, length))
    top = np.iinfo(np.int64).max
    value = np.full(len(text), top)
    windows = sizes - length + 1
    at = np.arange(windows.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
    value[at] = np.repeat(values, windows)
    least = np.minimum.reduceat(value[order], groups)
    value[order] = np.repeat(least, np.diff(np.append(groups, len(text))))
    return np.split(value[at], np.cumsum(windows)[:-1])
