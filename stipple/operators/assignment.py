"""Optimal one-to-one assignment of small dense problems."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of least total cost; min(shape) of them. Shortest augmenting paths with potentials, O(n^2 m)."""
    if cost.shape[0] > cost.shape[1]:
        return [(r, c) for c, r in assign(cost.T)]
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)  # 1-based; 0 is free
    for row in range(1, n + 1):
        row_of[0], at = row, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, np.int64)
        while row_of[at]:
            seen[at] = True
            i = row_of[at]
            reduced = cost[i - 1] - u[i] - v[1:]
            free = ~seen[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = at
            candidates = np.where(free, least[1:], np.inf)
            to = int(candidates.argmin()) + 1
            step = candidates[to - 1]
            u[row_of[seen]] += step
            v[seen] -= step
            least[~seen] -= step
            at = to
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    return [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]


def match_component(a: np.ndarray, b: np.ndarray, distance: np.ndarray, radius: float) -> np.ndarray:
    """Places of the chosen edges: as many as possible, then of least total distance.

    A pair without an edge costs more than any set of edges can save, so the number of pairs goes first.
    """
    a_ids, ia = np.unique(a, return_inverse=True)
    b_ids, ib = np.unique(b, return_inverse=True)
    missing = (min(len(a_ids), len(b_ids)) + 1) * (radius + 1.0)
    cost = np.full((len(a_ids), len(b_ids)), missing)
    cost[ia, ib] = distance
    place = {(i, j): k for k, (i, j) in enumerate(zip(ia.tolist(), ib.tolist()))}
    return np.array(sorted(place[p] for p in assign(cost) if p in place), np.int64)
