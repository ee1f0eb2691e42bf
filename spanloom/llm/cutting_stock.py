"""Cutting-stock patterns by column generation.

Items of sizes 1..capacity (in units) with their demands fill bins of one capacity.  The linear program over
patterns is solved by a revised simplex method whose columns are priced by an unbounded-knapsack dynamic program;
its solution is rounded down and the few items left over are packed best fit first.  The work depends on the
number of sizes alone, never on the number of items.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[int, dict[int, int]]


def _price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worth of the best pattern at these duals (index: size, 0 unused) and its counts by size."""
    worth, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        options = duals[1 : c + 1] + worth[c - 1 :: -1][:c]
        k = int(options.argmax())
        worth[c], choice[c] = options[k], k + 1
    counts, c = np.zeros(capacity + 1, dtype=np.int64), capacity
    while c > 0:
        if duals[choice[c]] > 0:
            counts[choice[c]] += 1
        c -= int(choice[c])
    return float(worth[capacity]), counts


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; no BLAS, whose thread pools can stall in a driver that shares its cores."""
    m = len(matrix)
    a = np.hstack([matrix, np.eye(m)])
    for j in range(m):
        p = j + int(np.abs(a[j:, j]).argmax())
        if p != j:
            a[[j, p]] = a[[p, j]]
        a[j] /= a[j, j]
        factors = a[:, j].copy()
        factors[j] = 0
        rows = np.flatnonzero(factors)
        a[rows] -= factors[rows, None] * a[j]
    return a[:, m:]


def _relaxed(sizes: list[int], demand: np.ndarray, capacity: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(columns, amounts) of the last basis of the covering program; columns are counts by position in ``sizes``, or a surplus."""
    m = len(sizes)
    fit = np.array([capacity // s for s in sizes], dtype=float)
    columns, inverse, amounts, cost = np.diag(fit), np.diag(1 / fit), demand / fit, np.ones(m, dtype=bool)
    for turn in range(40 * m):
        if turn % 128 == 127:  # rounding errors don't pile up
            inverse = _inverse(columns)
            amounts = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
        y = inverse[cost].sum(axis=0)
        if y.min() < -1e-7:  # covering more than the demand costs nothing
            entering = np.zeros(m)
            entering[int(y.argmin())] = -1.0
        else:
            duals = np.zeros(capacity + 1)
            duals[sizes] = np.maximum(y, 0)
            worth, counts = _price(duals, capacity)
            if worth <= 1 + gap:
                break
            entering = counts[sizes].astype(float)
        step = np.einsum("ij,j->i", inverse, entering)
        limits = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
        out = int(limits.argmin())
        if not np.isfinite(limits[out]):
            break
        amounts = np.maximum(amounts - limits[out] * step, 0)
        amounts[out] = limits[out]
        columns[:, out], cost[out] = entering, entering.max() > 0
        inverse[out] /= step[out]
        for_others = step.copy()
        for_others[out] = 0
        inverse -= np.outer(for_others, inverse[out])
    return columns, amounts


def _best_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins for the left-over items, largest first, each into the fullest bin that takes it."""
    bins: list[dict[int, int]] = []
    room: list[int] = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            at = min((i for i, r in enumerate(room) if r >= s), key=room.__getitem__, default=None)
            if at is None:
                bins.append({})
                room.append(capacity)
                at = len(bins) - 1
            bins[at][s] = bins[at].get(s, 0) + 1
            room[at] -= s
    return [(1, b) for b in bins]


def plan(demand: dict[int, int], capacity: int, gap: float = 1e-4) -> list[Pattern]:
    """(times, counts by size) of the patterns that hold exactly ``demand``; sizes must not exceed the capacity."""
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    if sizes[0] < 1 or sizes[-1] > capacity:
        raise ValueError("sizes must lie in 1..capacity")
    wanted = np.array([demand[s] for s in sizes], dtype=float)
    columns, amounts = _relaxed(sizes, wanted, capacity, gap)
    left, patterns = dict(zip(sizes, (int(demand[s]) for s in sizes))), []
    for j in np.argsort(-amounts):
        held = {s: int(n) for s, n in zip(sizes, columns[:, j]) if n > 0}
        times = int(amounts[j] + 1e-6)
        while times > 0 and held:  # where sizes were covered more than asked, later bins hold fewer of them
            now = min([times, *(left[s] // n for s, n in held.items())])
            if now:
                patterns.append((now, dict(held)))
                for s, n in held.items():
                    left[s] -= n * now
                times -= now
            held = {s: min(n, left[s]) for s, n in held.items() if left[s]}
    return patterns + _best_fit({s: n for s, n in left.items() if n}, capacity)
