"""NumPy kernels on small inputs: primes, partitioning around medoids, k-means."""

from __future__ import annotations

import numpy as np


#: Rounds after which an iteration that still moves raises instead of giving unfinished results.
GUARD = 10_000


def primes(low: int, high: int) -> list[int]:
    sieve = np.ones(high + 1, bool)
    sieve[:2] = False
    for i in range(2, int(high**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve) if p >= low]


def distances(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Normalised Hamming distances of 0/1 rows."""
    y = x if y is None else y
    x, y = x.astype(np.float32), y.astype(np.float32)
    return (x.sum(1)[:, None] + y.sum(1)[None, :] - 2 * (x @ y.T)).astype(np.float64) / max(1, x.shape[1])


def pam(d: np.ndarray, k: int) -> np.ndarray:
    """Medoid rows of a distance matrix: greedy build, then best swaps while the cost falls."""
    n = len(d)
    k = min(k, n)
    medoids = [int(d.sum(1).argmin())]
    near = d[:, medoids[0]].copy()
    while len(medoids) < k:
        gain = np.maximum(near[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
        near = np.minimum(near, d[:, medoids[-1]])
    for _ in range(GUARD):
        cost = d[:, medoids].min(1).sum()
        best, swap = cost - 1e-12, None
        for i in range(k):
            rest = medoids[:i] + medoids[i + 1 :]
            other = d[:, rest].min(1) if rest else np.full(n, np.inf)
            costs = np.minimum(other[:, None], d).sum(0)
            costs[medoids] = np.inf
            if costs.min() < best:
                best, swap = costs.min(), (i, int(costs.argmin()))
        if swap is None:
            return np.array(medoids)
        medoids[swap[0]] = swap[1]
    raise RuntimeError(f"medoids still move after {GUARD} rounds")


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first on ties, and its squared distance."""
    d = np.round(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T), 0.0), 9)
    label = d.argmin(1)
    return label, d[np.arange(len(x)), label]


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels from 0; centres start at spread-out distinct rows, so fewer rows than k give fewer labels."""
    x = x.astype(np.float64)
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = [distinct[rng.integers(len(distinct))]]
    for _ in range(k - 1):
        d = np.min([((distinct - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(distinct[d.argmax()])
    c = np.array(centres)
    for _ in range(GUARD):
        label = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[label == i].mean(0) if (label == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            return label
        c = new
    raise RuntimeError(f"centres still move after {GUARD} rounds")
