"""Tables of a Pitman-Yor restaurant, sampled from their exact conditional.

Given its restaurant's tables T, a dish with c customers has t tables with probability in
proportion to S(c, t) x^t: S are the generalised Stirling numbers of the discount d, and
x = d * u * p for the parent's probability p and a gamma variable u of shape strength / d + T.
With u drawn between the sweeps all dishes of a restaurant are independent, so that a sweep is a
Gibbs step over whole seatings: it draws how many tables each dish has, with the customers'
places at them summed out.

Up to EXACT customers the numbers are tabled. A larger dish has the tables k of its first EXACT
customers drawn from the table, weighted by what the others make of them, and those that the
others open from the Poisson limit of a large restaurant (error of the order of k^2 / EXACT^2).

Draws depend on keys alone, so they are the same wherever and however often they are made.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import bytekit

EXACT = 1024
_U = np.uint64


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit keys."""
    return ((bytekit.mix64(key) >> _U(11)).astype(float) + 0.5) / 9007199254740992.0


def gamma(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variables of shapes above 1, by rejection (Marsaglia and Tsang)."""
    d = shape - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        a, b, w = (uniform(key[left] + _U((3 * turn + i) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for i in range(3))
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + c[left] * z) ** 3
        ok = (v > 0) & (np.log(w) < 0.5 * z * z + d[left] * (1 - v + np.log(np.maximum(v, 1e-300))))
        out[left[ok]] = d[left[ok]] * v[ok]
        left, turn = left[~ok], turn + 1
    return out


@lru_cache(3)
def stirling(d: float) -> np.ndarray:
    """Logarithms of S(c, t), c and t from 0 to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(EXACT):
            stay = np.log(np.maximum(c - d * t, 0.0)) + out[c]
            stay[c + 1 :] = -np.inf
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after a shift that makes small arguments large."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def draw_tables(customers: np.ndarray, x: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of each dish; none without customers, one for one customer."""
    out = np.minimum(customers, 1).astype(np.int64)
    table, log_x, u = stirling(d), np.log(np.maximum(x, 1e-300)), uniform(key)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some], kind="stable")]
    sizes = customers[some]
    for first, last in _runs(sizes):
        c = int(sizes[first])
        t = np.arange(1, c + 1)
        for at in range(first, last, max(1, (1 << 20) // c)):
            mine = some[at : min(last, at + max(1, (1 << 20) // c))]
            out[mine] = 1 + _pick(table[c, 1 : c + 1] + t * log_x[mine, None], u[mine])
    k = np.arange(1, EXACT + 1)
    many = np.flatnonzero(customers > EXACT)
    for at in range(0, len(many), 512):
        mine = many[at : at + 512]
        c = customers[mine].astype(float)[:, None]
        opened = (1 - ((EXACT - d * k) / (c - d * k)) ** d) / d
        weights = table[EXACT, 1:] + k * log_x[mine, None] + _log_gamma(c - d * k) - _log_gamma(EXACT - d * k) + x[mine, None] * opened
        at_first = _pick(weights, u[mine])
        mean = x[mine] * opened[np.arange(len(mine)), at_first]
        more = np.array([np.random.default_rng(int(s)).poisson(m) for s, m in zip(key[mine].tolist(), mean, strict=True)])
        out[mine] = np.minimum(1 + at_first + more, customers[mine])
    return out


def _runs(values: np.ndarray):
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else []
    return zip(edges[:-1], edges[1:], strict=True)


def _pick(logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column for each row, with probability in proportion to its exponential."""
    total = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
    return np.minimum((total < (u * total[:, -1])[:, None]).sum(1), logs.shape[1] - 1)
