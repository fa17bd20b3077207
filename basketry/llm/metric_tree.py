"""Balls of integer points, grown middle-out from anchors, with cached sums and counts, and nearest entries found ball by ball."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 24
#: Squared distances below this are exact in doubles.
EXACT = 2.0**52


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two tables of doubles."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def anchors(points: np.ndarray, wanted: int) -> np.ndarray:
    """Owner of every point among at most `wanted` anchors.

    Each new anchor is the point farthest from its own; it takes over points that are nearer to it, and looks only at those
    farther from their anchor than half the way between the two anchors: no other can be nearer.
    """
    owner = np.zeros(len(points), np.int64)
    gap = np.sqrt(((points - points[0]) ** 2).sum(1))
    places = [0]
    while len(places) < wanted and gap.max() > 0:
        new = int(gap.argmax())
        between = np.sqrt(((points[places] - points[new]) ** 2).sum(1))
        some = np.flatnonzero(gap > between[owner] / 2)
        found = np.sqrt(((points[some] - points[new]) ** 2).sum(1))
        near = found < gap[some]
        owner[some[near]], gap[some[near]] = len(places), found[near]
        places.append(new)
    return owner


@dataclass
class Balls:
    """Points in tree order; node i holds the points [low[i], high[i]) and has the children left[i] and right[i], or -1."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @property
    def centres(self) -> np.ndarray:
        return self.sums.astype(float) / (self.high - self.low)[:, None]


def grown(points: np.ndarray) -> Balls:
    """The tree of `points` (integers): anchors in the middle, their own trees below, merged pairwise into larger balls above."""
    flat = points.astype(float)
    nodes: list[tuple[int, int, list[int]]] = []  # left, right, points

    def leaf(rows: np.ndarray) -> int:
        nodes.append((-1, -1, rows.tolist()))
        return len(nodes) - 1

    def below(rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return leaf(rows)
        owner = anchors(flat[rows], max(2, int(np.sqrt(len(rows)))))
        if not owner.any():  # one point, repeated
            return leaf(rows)
        own = [rows[owner == k] for k in range(owner.max() + 1)]
        return merged([below(x) for x in own if len(x)])

    def merged(tops: list[int]) -> int:
        """Joins the two balls whose common ball is the smallest, until one is left."""
        members = [np.array(nodes[t][2]) for t in tops]
        centre = np.array([flat[m].mean(0) for m in members])
        reach = np.array([np.sqrt(((flat[m] - c) ** 2).sum(1).max()) for m, c in zip(members, centre, strict=True)])
        cost = _gaps(centre, centre) + reach[:, None] + reach
        np.fill_diagonal(cost, np.inf)
        while len(tops) > 1:
            a, b = sorted(divmod(int(cost.argmin()), len(tops)))
            nodes.append((tops[a], tops[b], nodes[tops[a]][2] + nodes[tops[b]][2]))
            whole = np.array(nodes[-1][2])
            centre[a] = flat[whole].mean(0)
            reach[a] = np.sqrt(((flat[whole] - centre[a]) ** 2).sum(1).max())
            tops[a] = len(nodes) - 1
            del tops[b]
            centre, reach = np.delete(centre, b, 0), np.delete(reach, b)
            cost = np.delete(np.delete(cost, b, 0), b, 1)
            cost[a] = cost[:, a] = _gaps(centre[a : a + 1], centre)[0] + reach + reach[a]
            cost[a, a] = np.inf
        return tops[0]

    top = below(np.arange(len(points)))
    # numbered from the top, so that the points of every node are neighbours
    order, low, high, left, right, sources = [], [], [], [], [], []
    todo = [(top, None, 0)]
    while todo:
        node, parent, side = todo.pop()
        me = len(sources)
        sources.append(node)
        a, b, rows = nodes[node]
        left.append(-1)
        right.append(-1)
        if parent is not None:
            (left if side == 0 else right)[parent] = me
        low.append(len(order))
        high.append(len(order) + len(rows))
        if a < 0:
            order += rows
        else:
            todo += [(b, me, 1), (a, me, 0)]
    order, low, high = np.array(order), np.array(low), np.array(high)
    sorted_points = points[order]
    sums = np.array([sorted_points[a:b].sum(0) for a, b in zip(low, high, strict=True)])
    radius = np.array([
        np.sqrt(((sorted_points[a:b].astype(float) - s.astype(float) / (b - a)) ** 2).sum(1).max()) for a, b, s in zip(low, high, sums, strict=True)
    ])
    return Balls(sorted_points, order, low, high, np.array(left), np.array(right), radius, sums)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and entries: in doubles where they hold them, else in Python's integers."""
    top = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4.0 * float(top) ** 2 * points.shape[1] < EXACT:
        p, e = points.astype(float), entries.astype(float)
        return (p * p).sum(1)[:, None] + (e * e).sum(1) - 2 * (p @ e.T)
    p, e = points.astype(object), entries.astype(object)
    return np.array([[((x - y) ** 2).sum() for y in e] for x in p], object).reshape(len(p), len(e))


def nearest(balls: Balls, entries: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Nearest entry (the lower index on ties) of every point: (node, entry) of the balls owned whole, then the other points' rows and entries.

    A ball inherits the candidate entries of the ball around it. An entry stays a candidate unless another is nearer to every point of the ball,
    by the distances from the centre and the radius; with one candidate left, the ball is owned.
    """
    middle, flat = balls.centres, entries.astype(float)
    slack = 1e-6 * (1 + np.abs(middle).max(initial=0) + np.abs(flat).max(initial=0)) * np.sqrt(middle.shape[1])
    front, lists = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    owned: list[tuple[int, int]] = []
    rows, chosen = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(front):
        gap = np.where(lists, _gaps(middle[front], flat), np.inf)
        lists &= gap <= (gap.min(1) + 2 * balls.radius[front] + slack)[:, None]
        single = lists.sum(1) == 1
        owned += zip(front[single].tolist(), lists[single].argmax(1).tolist(), strict=True)
        leaf = ~single & (balls.left[front] < 0)
        if leaf.any():
            sizes = (balls.high - balls.low)[front[leaf]]
            inside = np.concatenate([np.arange(balls.low[i], balls.high[i]) for i in front[leaf]])
            some = np.flatnonzero(lists[leaf].any(0))
            far = squared(balls.points[inside], entries[some])
            far = np.where(np.repeat(lists[leaf][:, some], sizes, axis=0), far, np.inf)
            rows.append(inside)
            chosen.append(some[far.argmin(1)])
        open_ = ~single & ~leaf
        lists = np.repeat(lists[open_], 2, axis=0)
        front = np.stack([balls.left[front[open_]], balls.right[front[open_]]], 1).ravel()
    return owned, np.concatenate(rows), np.concatenate(chosen)
