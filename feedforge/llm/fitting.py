"""Small models fitted on the driver from bounded samples: calibration and chain fields."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimise from the gradient alone, with a rate that falls to a tenth."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def platt(scores: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b), fitted by Newton's method with Platt's smoothed targets."""
    good, bad = float(label.sum()), float(len(label) - label.sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([scores, np.ones_like(scores)], 1)
    at = np.zeros(2)
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - target * (x @ w)))
    for _ in range(100):
        p = sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class ChainField:
    """Linear-chain conditional random field with labels 0 and 1.

    A position's potential for label 1 is features . weights (for label 0: zero); `move[a, b]` is
    the potential of label b after label a, `begin[a]` that of label a first.
    """

    def __init__(self, weights: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.weights, self.move, self.begin = weights, move, begin

    def marginals(self, unary: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 at each position, by forward-backward over all chains at once."""
        return _forward_backward(unary, bounds, self.move, self.begin)[0]

    def none(self, unary: np.ndarray, bounds: np.ndarray, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(marginals, logarithm of the probability that no position of a chain has label 1). A position counts `each` times."""
        p, ahead = _forward_backward(unary, bounds, self.move, self.begin)[::3]
        return p, _log_none(p, unary + ahead, bounds, self.move, each)

    @classmethod
    def fit_any(cls, features: np.ndarray, any_one: np.ndarray, bounds: np.ndarray, each: np.ndarray, start: np.ndarray, steps: int = 120, rate: float = 0.1, ridge: float = 1e-3) -> ChainField:
        """Maximum marginal likelihood of chains of which only that is known whether any position has label 1.

        The positions' labels are latent. The gradient of a chain without label 1 is that of its one
        possible labelling; that of another chain is the same with the odds of no label 1 against any,
        and the other sign. A position counts `each` times; `start` holds the first weights.
        """
        width, total = features.shape[1], max(1, len(bounds) - 1)
        own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        heads = bounds[:-1][np.diff(bounds) > 0]
        inner = np.ones(len(own), bool)
        inner[heads] = False

        def gradient(x):
            unary, move, begin = features @ x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :]
            p, ahead, forward = _messages(unary, bounds, move, begin)
            none = _log_none(p, unary + ahead, bounds, move, each)
            share = np.where(any_one > 0, -np.exp(np.clip(none, -50, -1e-6) - np.log(-np.expm1(np.clip(none, -50, -1e-6)))), 1.0)
            weight = share[own] * each
            pairs, first = _expected(unary, forward, ahead, p, bounds, move, weight)
            pairs[0, 0] -= weight[inner].sum()
            first[0] -= weight[heads].sum()
            return np.concatenate([features.T @ (p * weight), pairs.ravel(), first]) / total + ridge * (x - start)

        x = adam(gradient, start.copy(), steps, rate)
        return cls(x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :])

    @classmethod
    def fit(cls, features: np.ndarray, label: np.ndarray, bounds: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3, weight: np.ndarray | None = None) -> ChainField:
        """Maximum likelihood of whole label chains, with a ridge. Chains count by `weight`."""
        width = features.shape[1]
        own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        share = np.ones(len(bounds) - 1) if weight is None else weight
        total, heads = max(1.0, float(share.sum())), bounds[:-1][np.diff(bounds) > 0]
        inner = np.ones(len(label), bool)
        inner[heads] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), share[own[at]])
        seen_first = np.bincount(label[heads], weights=share[own[heads]], minlength=2)
        each = share[own]

        def gradient(x):
            unary, move, begin = features @ x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :]
            p, pairs, first, _ = _forward_backward(unary, bounds, move, begin, each)
            return np.concatenate([features.T @ ((p - label) * each), (pairs - seen).ravel(), first - seen_first]) / total + ridge * x

        x = adam(gradient, np.zeros(width + 6), steps, rate)
        return cls(x[:width], x[width : width + 4].reshape(2, 2), x[width + 4 :])


def _forward_backward(unary: np.ndarray, bounds: np.ndarray, move: np.ndarray, begin: np.ndarray, each: np.ndarray | None = None):
    """Marginals, with `each` the expected moves and first labels, weighted by it, and the backward messages."""
    p, backward, forward = _messages(unary, bounds, move, begin)
    if each is None:
        return p, None, None, backward
    return p, *_expected(unary, forward, backward, p, bounds, move, each), backward


def _messages(unary: np.ndarray, bounds: np.ndarray, move: np.ndarray, begin: np.ndarray):
    """Marginals, backward and forward messages.

    Chains run side by side, longest first, so that step t works on the chains with over t
    positions. Messages are kept as log odds of label 1 against label 0: a forward message f is
    the odds given all before, and passes as log((e^m01 + e^(m11+f)) / (e^m00 + e^(m10+f))).
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    n = len(unary)
    forward, backward = np.zeros(n), np.zeros(n)
    m00, m01, m10, m11 = move[0, 0], move[0, 1], move[1, 0], move[1, 1]
    state = np.full(active[0] if longest else 0, begin[1] - begin[0])
    for t in range(longest):
        k = active[t]
        if t:
            f = state[:k]
            state = np.logaddexp(m01, m11 + f) - np.logaddexp(m00, m10 + f)
        at = begins[:k] + t
        state = state[:k] + unary[at]
        forward[at] = state
    state = np.zeros(0)
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        at = begins[:k] + t
        ahead = np.zeros(k)
        ahead[: len(state)] = state
        b = unary[at + 1] + ahead
        state = np.logaddexp(m10, m11 + b) - np.logaddexp(m00, m01 + b)
        backward[at] = state
    return sigmoid(forward + backward), backward, forward


def _expected(unary: np.ndarray, forward: np.ndarray, backward: np.ndarray, p: np.ndarray, bounds: np.ndarray, move: np.ndarray, each: np.ndarray):
    """Expected moves and first labels, weighted by `each`."""
    inner = np.ones(len(unary), bool)
    heads = bounds[:-1][np.diff(bounds) > 0]
    inner[heads] = False
    to = np.flatnonzero(inner)
    f, b = forward[to - 1], unary[to] + backward[to]
    logs = np.stack([np.full(len(to), move[0, 0]), move[0, 1] + b, move[1, 0] + f, move[1, 1] + f + b])
    logs -= logs.max(0) if len(to) else 0
    odds = np.exp(logs)
    odds *= each[to] / odds.sum(0)
    return odds.sum(1).reshape(2, 2), np.array([np.sum(each[heads] * (1 - p[heads])), np.sum(each[heads] * p[heads])])


def _log_none(p: np.ndarray, ahead: np.ndarray, bounds: np.ndarray, move: np.ndarray, each: np.ndarray | None) -> np.ndarray:
    """Of each chain, the logarithm of the probability of label 0 throughout: first, then after one another."""
    steps = -np.logaddexp(0, move[0, 1] - move[0, 0] + ahead)
    heads = bounds[:-1][np.diff(bounds) > 0]
    steps[heads] = np.log1p(-np.minimum(p[heads], 1 - 1e-15))
    if each is not None:
        steps *= each
    total = np.concatenate(([0.0], np.cumsum(steps)))
    return total[bounds[1:]] - total[bounds[:-1]]
