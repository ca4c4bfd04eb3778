"""Gradient-boosted trees on histograms, in numpy, and their flat form for prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees in one set of arrays; a leaf points to itself.

    Nodes are numbered over all trees, ``roots`` has the first of each. A value
    at or below the threshold goes left.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def logits(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        """Sum of the leaves that each row reaches; all trees of a block of rows go down together."""
        out = np.full(len(x), self.start)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            own = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[own, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + rows] += self.value[node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature at most ``bins - 1`` distinct cuts, each halfway between two neighbouring values."""
    edges = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) >= bins:
            wanted = np.arange(1, bins) * len(column) / bins
            middle = middle[np.unique(np.searchsorted(np.cumsum(counts)[:-1], wanted).clip(0, len(middle) - 1))]
        edges.append(middle)
    return edges


class _Grower:
    """Grows one tree at a time over binned features, best gain first."""

    def __init__(self, binned: np.ndarray, bins: int, leaves: int, least_rows: int, shrink: float):
        self.binned, self.bins, self.leaves, self.least_rows, self.shrink = binned, bins, leaves, least_rows, shrink
        self.slots = binned + np.arange(binned.shape[1]) * bins

    def _histogram(self, rows: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """Rows, sums of first and of second derivatives in each bin of each feature."""
        features = self.binned.shape[1]
        slots = self.slots[rows].ravel()
        size = features * self.bins
        sums = [
            np.bincount(slots, weights, size)
            for weights in (None, np.repeat(slope[rows], features), np.repeat(curve[rows], features))
        ]
        return np.stack(sums).reshape(3, features, self.bins)

    def _best_cut(self, histogram: np.ndarray) -> tuple[float, int, int]:
        """Gain, feature and last bin that goes left."""
        n, slope, curve = np.cumsum(histogram, axis=2)
        all_n, all_slope, all_curve = n[:, -1:], slope[:, -1:], curve[:, -1:]
        worth = lambda g, h: g * g / (h + self.shrink)
        gain = worth(slope, curve) + worth(all_slope - slope, all_curve - curve) - worth(all_slope, all_curve)
        gain[(n < self.least_rows) | (all_n - n < self.least_rows)] = -np.inf
        at = int(gain.argmax())
        return float(gain.flat[at]), at // self.bins, at % self.bins

    def grow(self, slope: np.ndarray, curve: np.ndarray) -> list[dict]:
        """Nodes of a tree: rows, and feature, bin and children where it is cut."""
        rows = np.arange(len(slope))
        histogram = self._histogram(rows, slope, curve)
        nodes = [{"rows": rows, "histogram": histogram, "cut": self._best_cut(histogram), "depth": 0}]
        open_nodes = [0]
        for _ in range(self.leaves - 1):
            best = max(open_nodes, key=lambda k: nodes[k]["cut"][0])
            gain, feature, last = nodes[best]["cut"]
            if gain <= 1e-9:
                break
            open_nodes.remove(best)
            node = nodes[best]
            goes_left = self.binned[node["rows"], feature] <= last
            sides = node["rows"][goes_left], node["rows"][~goes_left]
            small = 0 if len(sides[0]) <= len(sides[1]) else 1
            own = self._histogram(sides[small], slope, curve)
            both = [own, node["histogram"] - own]
            node["children"] = (len(nodes), len(nodes) + 1)
            for side, part in enumerate(sides):
                histogram = both[0] if side == small else both[1]
                nodes.append({"rows": part, "histogram": histogram, "cut": self._best_cut(histogram), "depth": node["depth"] + 1})
                open_nodes.append(len(nodes) - 1)
            del node["histogram"]
        return nodes


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 120,
    leaves: int = 12,
    bins: int = 64,
    rate: float = 0.1,
    least_rows: int = 10,
    shrink: float = 1.0,
) -> FlatTrees:
    """Trees for the chance of label 1, by the logistic loss. One label only, or none: a constant."""
    n = len(y)
    chance = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(chance / (1 - chance)))
    flat: dict[str, list] = {name: [] for name in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    depth = 0
    if n and 0 < y.sum() < n:
        edges = bin_edges(x, bins)
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        grower = _Grower(binned, bins, leaves, min(least_rows, max(1, n // 20)), shrink)
        logits = np.full(n, start)
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-logits))
            slope, curve = chance - y, chance * (1 - chance)
            nodes = grower.grow(slope, curve)
            if len(nodes) == 1:
                break
            first = len(flat["feature"])
            roots.append(first)
            for k, node in enumerate(nodes):
                depth = max(depth, node["depth"])
                rows = node["rows"]
                if "children" in node:
                    _, feature, last = node["cut"]
                    new = (feature, edges[feature][last], first + node["children"][0], first + node["children"][1], 0.0)
                else:
                    step = -rate * slope[rows].sum() / (curve[rows].sum() + shrink)
                    logits[rows] += step
                    new = (0, np.inf, first + k, first + k, step)
                for name, item in zip(flat, new):
                    flat[name].append(item)
    arrays = {name: np.array(items, float if name in ("threshold", "value") else np.int64) for name, items in flat.items()}
    return FlatTrees(**arrays, roots=np.array(roots, np.int64), depth=depth, start=start)
