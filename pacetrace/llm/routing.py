"""Learned partitions of a vector space: a balanced cut of a neighbour graph, and a classifier that knows its parts."""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 24
BATCH = 256


def neighbour_graph(unit: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The ``k`` nearest others of each unit vector, by blocks of rows."""
    k = min(k, len(unit) - 1)
    out = np.empty((len(unit), k), np.int64)
    for at in range(0, len(unit), 512):
        s = unit[at : at + 512] @ unit.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[at : at + 512]
    return out


def _halves(a: np.ndarray, b: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Two equal halves of a graph with few edges ``a[i] - b[i]`` between them: True for the second half.

    Starts from the order that smoothing over the edges gives (its second mode), cut at the middle, and then exchanges
    equally many nodes of both sides that gain most by the exchange while the cut gets smaller.
    """
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    x = np.random.default_rng(seed).standard_normal(n)
    for _ in range(60):
        x -= (x * degree).sum() / degree.sum()
        x /= max(np.abs(x).max(), 1e-300)
        x = 0.5 * x + 0.5 * (np.bincount(a, x[b], n) + np.bincount(b, x[a], n)) / degree
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    cut, best = int((side[a] != side[b]).sum()), side
    for _ in range(40):
        other = (side[a] != side[b]).astype(float)
        gain = np.bincount(a, 2 * other - 1, n) + np.bincount(b, 2 * other - 1, n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        worth = int((gain[left[:m]] + gain[right[:m]] > 0).sum()) // 2  # half of them, since neighbours move as well
        if not worth:
            break
        side = side.copy()
        side[left[:worth]], side[right[:worth]] = True, False
        now = int((side[a] != side[b]).sum())
        if now >= cut:
            break
        cut, best = now, side
    return best


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node of the neighbour graph, by halving: ``parts`` is a power of two, sizes differ by one a level."""
    n = len(near)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    label = np.zeros(n, np.int64)
    step = parts
    while step > 1:
        step //= 2
        for p in np.unique(label):
            mine = np.flatnonzero(label == p)
            number = np.full(n, -1)
            number[mine] = np.arange(len(mine))
            inner = (number[a] >= 0) & (number[b] >= 0)
            label[mine[_halves(number[a[inner]], number[b[inner]], len(mine), seed)]] += step
    return label


class Router:
    """A small network from a unit vector to the probability of each part, trained on the parts of its neighbours."""

    def __init__(self, unit: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, seed: int = 0) -> None:
        g = np.random.default_rng(seed)
        want = np.zeros((len(unit), parts))
        np.add.at(want, (np.arange(len(unit)), label), 1.0)
        np.add.at(want, (np.repeat(np.arange(len(unit)), near.shape[1]), label[near].ravel()), 1.0)
        want /= want.sum(axis=1)[:, None]
        dims = unit.shape[1]
        w = [g.standard_normal((dims, HIDDEN)) / np.sqrt(dims) * 2, np.zeros(HIDDEN), g.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        mean, square, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        for epoch in range(EPOCHS):
            order = g.permutation(len(unit))
            for at in range(0, len(order), BATCH):
                x, y = unit[order[at : at + BATCH]], want[order[at : at + BATCH]]
                h = np.maximum(x @ w[0] + w[1], 0)
                d = (self._softmax(h @ w[2] + w[3]) - y) / len(x)
                back = (d @ w[2].T) * (h > 0)
                t += 1
                for i, grad in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    mean[i] = 0.9 * mean[i] + 0.1 * grad
                    square[i] = 0.999 * square[i] + 0.001 * grad * grad
                    rate = 0.004 * (1 - epoch / EPOCHS)
                    w[i] = w[i] - rate * mean[i] / (1 - 0.9**t) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
        self.weights = w

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1)[:, None])
        return e / e.sum(axis=1)[:, None]

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """Parts of each vector, the likeliest first."""
        w = self.weights
        return np.argsort(-(np.maximum(unit @ w[0] + w[1], 0) @ w[2] + w[3]), axis=1, kind="stable")


def fit(unit: np.ndarray, parts: int, seed: int = 0) -> Router:
    """A router for ``parts`` parts (a power of two), learned from unit vectors."""
    near = neighbour_graph(unit)
    return Router(unit, near, balanced_parts(near, parts, seed), parts, seed)
