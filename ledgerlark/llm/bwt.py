"""Repeated substrings of at least a given length, by interval expansion over a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

from .textblocks import ranges


def _ordered(key: np.ndarray, place: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys below ``most`` in order, with their places (below n; in order where keys are equal): sorted as one number if that fits."""
    room = n.bit_length()
    if most.bit_length() + room <= 63:
        both = (key << room) | place
        both.sort()
        return both >> room, both & ((1 << room) - 1)
    turn = np.lexsort((place, key))
    return key[turn], place[turn]


def suffix_order(symbols: np.ndarray, depth: int, bits: int = 9) -> np.ndarray:
    """Positions of the rotations of ``symbols`` (below 2**bits), ordered by their first ``depth`` symbols at least.

    As many symbols as fit into 63 bits are the first key; then each round doubles the
    length by the ranks found, and sorts what is still tied.
    """
    n = len(symbols)
    key = np.zeros(n, np.int64)
    have = 63 // bits
    for k in range(have):
        key = (key << bits) | np.take(symbols, np.arange(k, n + k), mode="wrap")
    order = np.argsort(key)
    while True:
        sorted_key = key[order]
        new = np.ones(n, bool)
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        classes = np.cumsum(new) - 1
        if have >= depth or classes[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = classes
        # Only members of shared classes move: each class keeps its place.
        key = rank * n + np.take(rank, np.arange(have % n, n + have % n), mode="wrap")
        single = np.ones(n, bool)
        single[:-1] &= new[1:]
        single &= new
        moving = np.flatnonzero(~single)
        part = order[moving]
        order[moving] = _ordered(key[part], part, n, n * n)[1]
        have *= 2


def long_prefix(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each rank: whether its rotation shares its first ``least`` symbols with the one before in ``order``.

    Starts from the interval of the empty string and extends intervals backwards,
    breadth first: at step L all queued intervals hold the rotations with some common
    prefix of L symbols. An interval whose right neighbour is yet unset fixes that
    common prefix's length at L - 1 and is extended; others are dropped, as the lengths
    behind them are known. Stopping at ``least`` leaves exactly the longer ones unset.
    ``order`` needs to be right for the first ``least`` symbols only.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.int64)  # the transform; order 0 wraps round
    step = np.empty(n, np.int64)
    step[np.argsort(before.astype(np.int16), kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(least):
        one = high - low == 1
        start = step[low[one]]
        wide_low, wide = low[~one], (high - low)[~one]
        low, high = start, start + 1
        if len(wide):
            # An interval's rows by symbol: each symbol's rows are next to each other one step back.
            key = np.repeat(np.arange(len(wide)) * 512, wide)
            at = ranges(wide_low, wide)
            key, at = _ordered(key + before[at], at, n, len(wide) * 512)
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first = step[at[heads]]
            low = np.concatenate([low, first])
            high = np.concatenate([high, first + np.diff(np.concatenate([heads, [len(key)]]))])
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if not len(low):
            break
    return unset[:n]


def repeated_starts(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each text the positions at which a string of ``least`` bytes starts that also starts elsewhere in ``texts``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    symbols = np.zeros(int((lengths + 1).sum()), np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    inside = ranges(begins, lengths)
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    if len(symbols) <= least:
        return [np.zeros(0, np.int64) for _ in texts]
    order = suffix_order(symbols, least)
    shared = long_prefix(symbols, order, least)
    twice = shared.copy()
    twice[:-1] |= shared[1:]
    hit = np.zeros(len(symbols), bool)
    hit[order[twice]] = True
    out = []
    for begin, length in zip(begins.tolist(), lengths.tolist(), strict=True):
        out.append(np.flatnonzero(hit[begin : begin + max(0, length - least + 1)]))
    return out
