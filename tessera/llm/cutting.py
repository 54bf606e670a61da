"""Cutting stock by column generation, for a histogram of lengths. Sizes don't depend on the corpus:
there are at most capacity different lengths."""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first

SPARE, KEPT = 60, 4096  # patterns of one knapsack program, and of the latest ones together
LEAST_GAIN = 1e-3  # of a kept pattern's worth over its cost, below which pricing is done anew


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int, several: int = 1) -> tuple[float, np.ndarray]:
    """The multiset of lengths within capacity that is worth most: its worth, and its counts by length
    as the first row; then rows of the best ones that hold a given length, for the most promising lengths.

    One pass for each length: within a residue class of sizes, using k pieces more is a running maximum."""
    after = np.zeros((len(lengths) + 1, capacity + 1))  # worth by size with the first i lengths
    for i, (n, worth) in enumerate(zip(lengths.tolist(), prices.tolist(), strict=True)):
        best = after[i + 1]
        best[:] = after[i]
        if worth <= 0:
            continue
        if 2 * n > capacity:
            np.maximum(after[i, n:], after[i, :-n] + worth, out=best[n:])
            continue
        rows = capacity // n + 1
        grid = np.full(rows * n, -np.inf)
        grid[: capacity + 1] = after[i]
        grid = grid.reshape(rows, n)
        paid = (worth * np.arange(rows))[:, None]
        best[:] = (np.maximum.accumulate(grid - paid, axis=0) + paid).ravel()[: capacity + 1]

    def counts(c: int) -> np.ndarray:
        out = np.zeros(len(lengths))
        for i in range(len(lengths) - 1, -1, -1):
            while after[i + 1, c] > after[i, c] + 1e-12:
                out[i] += 1
                c -= int(lengths[i])
        return out

    rows = [counts(capacity)]
    if several > 1:
        holding = prices + after[-1, capacity - lengths]
        for i in np.argsort(-holding, kind="stable")[: several - 1].tolist():
            rows.append(counts(capacity - int(lengths[i])))
            rows[-1][i] += 1
    return float(after[-1, capacity]), np.unique(np.array(rows), axis=0) if several > 1 else np.array(rows)


def fractional_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts by length) and how often to use each, so that demand is met by a number of
    bins within gap of the least possible for fractional use: a linear program, solved by the
    simplex method on an explicit inverse, in which dynamic programming prices new columns.

    Demands are raised by different millionths, so no two of them run out at once: every step then
    lowers the cost, and the method cannot return to a basis it has left. Pricing keeps SPARE patterns
    of each program it solves, and the next is solved only when none of those kept is worth a step."""
    m = len(lengths)
    demand = demand * (1 + 1e-6 * np.random.default_rng(m).random(m))
    columns = [np.eye(m)[i] * (capacity // lengths[i]) for i in range(m)]
    costs = np.ones(m)
    inverse = np.diag(1.0 / (capacity // lengths))
    x = demand / (capacity // lengths)
    bound = float(demand @ lengths) / capacity
    kept = np.zeros((0, m))
    while True:
        y = costs @ inverse
        low = int(y.argmin())
        if y[low] < -1e-9:  # meeting more than the demand of that length saves bins
            column, cost = -np.eye(m)[low], 0.0
        else:
            cost, worths = 1.0, kept @ y
            if not len(kept) or worths.max() <= 1 + LEAST_GAIN:
                worth, found = _knapsack(lengths, np.maximum(y, 0), capacity, SPARE)
                total = float(costs @ x)
                bound = max(bound, total / max(worth, 1.0))
                if worth <= 1 + 1e-9 or total - bound <= gap * total:
                    break
                kept = np.concatenate([kept, found])[-KEPT:]
                worths = kept @ y
            column = kept[worths.argmax()]
        u = inverse @ column
        ratios = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratios.argmin())
        if not np.isfinite(ratios[r]):
            break
        step = ratios[r]
        x = np.maximum(x - step * u, 0)
        x[r] = step
        pivot = inverse[r] / u[r]
        u[r] = 0
        inverse -= np.outer(u, pivot)
        inverse[r] = pivot
        columns[r], costs[r] = column, cost
    return [(columns[k], float(x[k])) for k in range(m) if costs[k] and x[k] > 0]


def whole_patterns(histogram: dict[int, int], capacity: int, gap: float = 0.002) -> list[tuple[Pattern, int]]:
    """Patterns and how often to use each, such that every piece of the histogram has one place.

    Fractional uses are rounded down; the pieces left, fewer than a pattern's for each length and so
    bounded, are packed longest first into the fullest bin that has room.
    """
    lengths = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[n] for n in lengths.tolist()], dtype=np.int64)
    out: list[tuple[Pattern, int]] = []
    for counts, often in sorted(fractional_patterns(lengths, left.astype(float), capacity, gap), key=lambda p: -p[1]):
        counts = counts.astype(np.int64)
        used = counts > 0
        often = min(int(often + 1e-6), int((left[used] // counts[used]).min()))
        if often:
            left -= often * counts
            out.append((tuple((int(n), int(c)) for n, c in zip(lengths[used], counts[used], strict=True)), often))
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    bins: list[dict[int, int]] = []
    for n, c in zip(lengths.tolist(), left.tolist(), strict=True):
        while c:
            free = next((f for f in range(n, capacity + 1) if room[f]), None)
            if free is None:
                bins.append({})
                k, free = len(bins) - 1, capacity
            else:
                k = room[free].pop()
            fit = min(c, free // n)  # the bin stays the fullest for this length as long as it has room
            bins[k][n] = bins[k].get(n, 0) + fit
            c -= fit
            room[free - fit * n].append(k)
    return out + [(tuple(b.items()), 1) for b in bins]
