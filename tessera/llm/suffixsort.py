"""Sorting strings by hashed prefixes: a comparison is a binary search for the common extension."""

from __future__ import annotations

import numpy as np

from .hashing import PrefixHasher


def _prefix_table(rows: np.ndarray, hasher: PrefixHasher) -> np.ndarray:
    """Hashes of the first 0, 1, ... bytes of each row."""
    n, width = rows.shape
    powers = np.ones(width, dtype=np.uint64)
    if width:
        powers[1:] = np.cumprod(np.full(width - 1, hasher.base, dtype=np.uint64), dtype=np.uint64)
    out = np.zeros((n, width + 1), dtype=np.uint64)
    np.cumsum(hasher.codes[rows] * powers, axis=1, out=out[:, 1:])
    return out


def _extension(table: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The common prefix lengths of rows i and j as their hashes have them, in a logarithm of the width."""
    low, high = np.zeros(len(i), dtype=np.int64), np.minimum(lengths[i], lengths[j]).astype(np.int64)
    for _ in range(int(table.shape[1]).bit_length()):
        middle = (low + high + 1) >> 1
        equal = table[i, middle] == table[j, middle]
        low = np.where(equal, middle, low)
        high = np.where(equal, high, middle - 1)
    return low


def _less(rows, lengths, table, i, j, or_equal):
    """Is row i before row j (or, where or_equal, not after it)? A row is before its extensions."""
    n = _extension(table, lengths, i, j)
    ended_i, ended_j = n >= lengths[i], n >= lengths[j]
    last = rows.shape[1] - 1
    x, y = rows[i, np.minimum(n, last)], rows[j, np.minimum(n, last)]
    return np.where(ended_i & ended_j, or_equal, np.where(ended_i, True, np.where(ended_j, False, x < y)))


def _merge_sort(rows, lengths, table, group_start, group_end) -> np.ndarray:
    """Row numbers in order within their groups, which are runs of row numbers. Bottom up; all merges
    of a level are made at once, each row finding its rank in the block that its own is merged with."""
    m = len(rows)
    order = np.arange(m)
    start, end = group_start, group_end  # by position, the same for all positions of a group
    width = 1
    longest = int((end - start).max()) if m else 0
    at = np.arange(m) - start
    while width < longest:
        block = at // width
        other = block ^ 1
        low = np.minimum(start + other * width, end)
        high = np.minimum(low + width, end)
        right = (block & 1).astype(bool)
        active = np.flatnonzero(high > low)
        lo, hi = low[active].copy(), high[active].copy()
        mine = order[active]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) >> 1
            # of equal rows, those of the left block come first
            before = _less(rows, lengths, table, order[middle], mine[open_], right[active][open_])
            lo[open_] = np.where(before, middle + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], middle)
        target = np.arange(m)
        target[active] = start[active] + (block[active] >> 1) * 2 * width + at[active] % width + (lo - low[active])
        moved = np.empty_like(order)
        moved[target] = order
        order = moved
        width *= 2
    return order


def sort_rows(rows: np.ndarray, lengths: np.ndarray, group_start: np.ndarray, group_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in order within each group, and each row's true common prefix with the one before
    it (0 for a group's first). rows: bytes, padded to equal width; lengths: the real lengths.

    Comparisons trust hashes; then every neighbour is compared byte by byte. Hashes that collided
    show there as a wrong order, and the sort is repeated with other ones.
    """
    m = len(rows)
    if not m:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not rows.shape[1]:
        rows = np.zeros((m, 1), dtype=np.uint8)
    for seed in range(101, 1101):
        order = _merge_sort(rows, lengths, _prefix_table(rows, PrefixHasher(seed)), group_start, group_end)
        x, y = order[:-1], order[1:]
        least = np.minimum(lengths[x], lengths[y])
        differ = rows[x] != rows[y]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        common = np.minimum(common, least)
        k = np.minimum(common, rows.shape[1] - 1)
        ordered = np.where(common < least, rows[x, k] < rows[y, k], lengths[x] <= lengths[y])
        inside = group_start[1:] == group_start[:-1]
        if (ordered | ~inside).all():
            return order, np.concatenate([[0], np.where(inside, common, 0)])
    raise RuntimeError("every hash collided")
