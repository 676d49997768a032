"""True edit metrics on short strings and the BK-tree that prunes with them."""

from __future__ import annotations

from collections.abc import Iterable


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insertions, deletions, substitutions and transpositions.

    Unlike the restricted form it is a metric, so the triangle inequality holds.
    """
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    last: dict[str, int] = {}
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0
        ca, row, above = a[i - 1], d[i + 1], d[i]
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), match
            cost = 1
            if ca == b[j - 1]:
                cost, match = 0, j
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[ca] = i
    return d[n + 1][m + 1]


class BKTree:
    """Keys by their distance to their parent: a subtree at distance d holds no key within r of a query at distance q if |q - d| > r."""

    def __init__(self, keys: Iterable[str] = ()):
        self.root: tuple[str, dict] | None = None
        for k in keys:
            self.add(k)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while (d := edit_distance(key, node[0])) > 0:
            if d not in node[1]:
                node[1][d] = (key, {})
                return
            node = node[1][d]

    def within(self, query: str, radius: int) -> list[tuple[int, str]]:
        """Every key within ``radius``, as (distance, key), nearest first, ties by key."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            key, below = todo.pop()
            d = edit_distance(query, key)
            if d <= radius:
                out.append((d, key))
            todo += [child for at, child in below.items() if d - radius <= at <= d + radius]
        return sorted(out)
