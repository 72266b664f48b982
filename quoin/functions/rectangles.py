"""Minimum-area rectangles around the vertices of many rows at once.

Convex hulls come from a monotone chain in which every row of a batch has its own stack and all rows take a step
together.  The smallest rectangle lies along a hull edge.  On a convex ring the edges turn one way only, so the
vertices that touch the four sides of an edge's rectangle are found by looking up the edge's angle plus a quarter,
a half and three quarters of a turn among the angles of the row's own edges: calipers for all edges of all rows.
"""

from __future__ import annotations

import numpy as np

#: Areas that differ by less (as a share) are equal: an acute triangle has three rectangles of one area.
SAME = 1e-9
_QUARTER = 1e-12  # angles this close to a quarter turn are none


def _chain(x: np.ndarray, y: np.ndarray, starts: np.ndarray, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (as places, row after row) of one side of every hull, its last left out, and how many each has."""
    stack, depth = np.zeros(len(x), np.int64), np.zeros(len(counts), np.int64)
    order = np.argsort(-counts, kind="stable")
    still = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")  # rows with more than t vertices
    for t in range(counts.max(initial=0)):
        rows = order[: still[t]]
        at = starts[rows] + (t if step > 0 else counts[rows] - 1 - t)
        left = np.arange(len(rows))
        while len(left):
            left = left[depth[rows[left]] > 1]
            r, p = rows[left], at[left]
            top = starts[r] + depth[r]
            a, b = stack[top - 2], stack[top - 1]
            turn = (x[b] - x[a]) * (y[p] - y[a]) - (y[b] - y[a]) * (x[p] - x[a])
            left = left[turn <= 0]
            depth[rows[left]] -= 1
        stack[starts[rows] + depth[rows]] = at
        depth[rows] += 1
    kept = np.maximum(depth - 1, 0)
    first = np.concatenate([[0], np.cumsum(kept)[:-1]])
    place = np.repeat(starts - first, kept) + np.arange(kept.sum())
    return stack[place], kept


def hulls(x: np.ndarray, y: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, row) of the hulls' vertices, counter-clockwise from the leftmost; rows with one distinct point have none."""
    order = np.lexsort((y, x, row))
    x, y, row = x[order], y[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (row[1:] != row[:-1])
    x, y, row = x[new], y[new], row[new]
    counts = np.bincount(row, minlength=rows)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sides = [_chain(x, y, starts, counts, step) for step in (1, -1)]
    place = np.concatenate([s[0] for s in sides])
    owner = np.concatenate([np.repeat(np.arange(rows), s[1]) for s in sides])
    half = np.repeat([0, 1], [len(s[0]) for s in sides])
    order = np.lexsort((half, owner))  # stable: lower side, then upper side of each row
    return x[place[order]], y[place[order]], owner[order]


def _extremes(x, y, row, ux, uy, angle, starts, counts, turn):
    """For every edge, the largest product of its row's vertices with its direction turned by ``turn`` quarters."""
    wx, wy = ((ux, uy), (-uy, ux), (-ux, -uy), (uy, -ux))[turn]
    # A ring touches the line across a direction where its edges pass the direction plus a quarter turn.
    goal = angle + (turn + 1) * np.pi / 2
    goal = np.where(goal > np.pi, goal - 2 * np.pi, goal)
    # Each row's angles run from -pi up, rows are 16 apart.
    found = np.searchsorted(row * 16.0 + angle, row * 16.0 + goal)
    best = np.full(len(x), -np.inf)
    for near in (-1, 0, 1):  # neighbours too, since angles are rounded
        at = starts[row] + (found + near - starts[row]) % counts[row]
        best = np.maximum(best, wx * x[at] + wy * y[at])
    return best


def corners(x: np.ndarray, y: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 8) corners of each row's smallest rectangle, counter-clockwise; NaN without two distinct finite points.

    The first side has an angle in [0, pi / 2).  Of rectangles of the same area the longest counts, and of those of
    the same shape the one with the smallest angle.
    """
    out = np.full((rows, 8), np.nan)
    wrong = np.bincount(row, ~(np.isfinite(x) & np.isfinite(y)), rows) > 0
    good = ~wrong[row]
    x, y, row = x[good], y[good], row[good]
    seen, first = np.unique(row, return_index=True)
    base = np.zeros((rows, 2))
    base[seen] = np.stack([x[first], y[first]], 1)  # products of large coordinates would cancel
    x, y, row = hulls(x - base[row, 0], y - base[row, 1], row, rows)
    if not len(x):
        return out
    counts = np.bincount(row, minlength=rows)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    ahead = starts[row] + (np.arange(len(x)) - starts[row] + 1) % counts[row]
    dx, dy = x[ahead] - x, y[ahead] - y
    length = np.hypot(dx, dy)
    ux, uy = dx / length, dy / length
    angle = np.arctan2(uy, ux)
    # From the leftmost vertex the lower side turns from -pi/2 to pi/2, the upper side on from there.
    angle = np.where((angle <= -np.pi / 2) & (np.arange(len(x)) > starts[row]), angle + 2 * np.pi, angle)
    low = angle[starts[row]]
    turned = [_extremes(x, y, row, ux, uy, angle - low - np.pi, starts, counts, k) for k in range(4)]
    size = (turned[0] + turned[2]) * (turned[1] + turned[3])
    odd = np.sign(dx) * np.sign(dy) <= 0  # each direction is turned into the first quarter
    ux, uy = np.where(odd, np.abs(uy), np.abs(ux)), np.where(odd, np.abs(ux), np.abs(uy))
    flat = (dy == 0) | (dx == 0) | (ux < _QUARTER)
    ux, uy = np.where(flat, 1.0, ux), np.where(flat, 0.0, uy)
    here = starts[counts > 0]
    equal = np.ones(len(x), bool)
    for worth in (-size, np.maximum(turned[0] + turned[2], turned[1] + turned[3])):
        most = np.maximum.reduceat(np.where(equal, worth, -np.inf), here)
        limit = np.repeat(most - SAME * np.maximum(1.0, np.abs(most)), counts[counts > 0])
        equal &= worth >= limit
    order = np.lexsort((np.arctan2(uy, ux), ~equal, row))
    pick = order[here]
    mine = np.flatnonzero(counts > 0)
    vx, vy = np.zeros(rows), np.zeros(rows)
    vx[mine], vy[mine] = ux[pick], uy[pick]
    along, across = vx[row] * x + vy[row] * y, vx[row] * y - vy[row] * x
    a0, a1 = np.minimum.reduceat(along, here), np.maximum.reduceat(along, here)
    c0, c1 = np.minimum.reduceat(across, here), np.maximum.reduceat(across, here)
    px, py = vx[mine], vy[mine]
    for slot, (a, c) in enumerate(((a0, c0), (a1, c0), (a1, c1), (a0, c1))):
        out[mine, 2 * slot] = a * px - c * py + base[mine, 0]
        out[mine, 2 * slot + 1] = a * py + c * px + base[mine, 1]
    return out
