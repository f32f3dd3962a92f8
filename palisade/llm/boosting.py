"""Gradient-boosted trees on a bounded table of counted feature vectors, and their form as SQL."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Boosted:
    """Log-odds = base + sum of trees; probability = sigmoid(slope * log-odds + shift)."""

    features: list[str]
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(x) + self.shift)

    def probability_sql(self, row: str) -> str:
        """The same as SQL over a struct with a field per feature; as text, since the trees have hundreds of nodes."""
        margin = " + ".join([f"{self.base!r}D", *[self._tree(t, row) for t in self.trees]])
        return f"(1.0D / (1.0D + exp(-(({margin}) * {self.slope!r}D + {self.shift!r}D))))"

    def _tree(self, node: Node, row: str) -> str:
        if node.feature < 0:
            return f"{float(node.value)!r}D"
        return f"(CASE WHEN {row}.{self.features[node.feature]} <= {node.cut!r}D THEN {self._tree(node.low, row)} ELSE {self._tree(node.high, row)} END)"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _values(node.low, x), _values(node.high, x))


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, penalty: float) -> Node:
    """gradient, weight: first and second derivatives, already times the count of each vector."""
    total, mass = gradient.sum(), weight.sum()
    best, found = 1e-9, None
    if depth:
        for j in range(x.shape[1]):
            values, at = np.unique(x[:, j], return_inverse=True)
            g, h = np.cumsum(np.bincount(at, gradient))[:-1], np.cumsum(np.bincount(at, weight))[:-1]
            gain = g**2 / (h + penalty) + (total - g) ** 2 / (mass - h + penalty) - total**2 / (mass + penalty)
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (j, (values[gain.argmax()] + values[gain.argmax() + 1]) / 2)
    if found is None:
        return Node(value=float(total / (mass + penalty)))
    j, cut = found
    low = x[:, j] <= cut
    return Node(feature=j, cut=float(cut), low=_grow(x[low], gradient[low], weight[low], depth - 1, penalty),
                high=_grow(x[~low], gradient[~low], weight[~low], depth - 1, penalty))


def _scaled(node: Node, rate: float) -> Node:
    if node.feature < 0:
        node.value *= rate
    else:
        _scaled(node.low, rate)
        _scaled(node.high, rate)
    return node


def fit(features: list[str], x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 24, depth: int = 3,
        rate: float = 0.4, penalty: float = 1.0) -> Boosted:
    """x: distinct vectors; positive, negative: how many examples of either class each stands for."""
    count = positive + negative
    share = (positive.sum() + 0.5) / (count.sum() + 1.0)
    model = Boosted(features, base=float(np.log(share / (1 - share))))
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = _sigmoid(margin)
        tree = _scaled(_grow(x, positive - count * p, count * p * (1 - p), depth, penalty), rate)
        model.trees.append(tree)
        margin += _values(tree, x)
    return model


def calibrate(model: Boosted, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, steps: int = 60) -> None:
    """Platt scaling on held-out examples, by Newton steps on slope and shift."""
    z, count = model.margins(x), positive + negative
    # counts smoothed as Platt proposed, so that separable examples give finite values
    up, down = (positive.sum() + 1) / (positive.sum() + 2), 1 / (negative.sum() + 2)
    target = positive * up + negative * down
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = _sigmoid(slope * z + shift)
        error, mass = target - count * p, count * p * (1 - p) + 1e-9
        hessian = np.array([[(mass * z * z).sum() + 1e-3, (mass * z).sum()], [(mass * z).sum(), mass.sum() + 1e-3]])
        step = np.linalg.solve(hessian, np.array([(error * z).sum() - 1e-3 * (slope - 1), error.sum() - 1e-3 * shift]))
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-9))
        slope, shift = slope + step[0], shift + step[1]
    model.slope, model.shift = (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def threshold(p: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float, least: float) -> float:
    """The smallest probability from which on held-out examples reach the precision; never below ``least``."""
    order = np.argsort(-p, kind="stable")
    good, bad = np.cumsum(positive[order]), np.cumsum(negative[order])
    ends = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.array([], bool)
    fine = ends & (good >= precision * (good + bad)) & (good > 0)
    return max(least, float(p[order][fine].min())) if fine.any() else 1.0
