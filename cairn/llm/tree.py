"""A small classification tree by Gini impurity, for models that are trained on the driver."""

from __future__ import annotations

from collections.abc import Sequence

Node = tuple  # (share of positives,) or (feature, limit, left, right)


def _impurity(pos: float, n: float) -> float:
    return 2 * pos * (n - pos) / n if n else 0.0


def grow(rows: Sequence[Sequence[float]], labels: Sequence[int], depth: int = 8, least: int = 1, pick=None) -> Node:
    """pick(n) gives the features to try at a node (all by default)."""
    n, pos = len(rows), sum(labels)
    if not n:
        return (0.5,)
    if depth == 0 or pos in (0, n):
        return (pos / n,)
    best = None
    width = len(rows[0])
    for f in pick(width) if pick else range(width):
        order = sorted(range(n), key=lambda i: rows[i][f])
        left = 0
        for k in range(1, n):
            left += labels[order[k - 1]]
            a, b = rows[order[k - 1]][f], rows[order[k]][f]
            if a == b or k < least or n - k < least:
                continue
            cost = _impurity(left, k) + _impurity(pos - left, n - k)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2)
    if best is None or best[0] >= _impurity(pos, n) - 1e-12:
        return (pos / n,)
    _, f, limit = best
    sides = [[i for i in range(n) if (rows[i][f] > limit) == side] for side in (False, True)]
    left, right = (grow([rows[i] for i in s], [labels[i] for i in s], depth - 1, least, pick) for s in sides)
    return (f, limit, left, right)


def share(node: Node, row: Sequence[float]) -> float:
    while len(node) > 1:
        node = node[3] if row[node[0]] > node[1] else node[2]
    return node[0]
