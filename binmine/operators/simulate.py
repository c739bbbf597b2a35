"""Correlated binary data with known blocks: small matrices on the driver, rows drawn in seeded partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmine.session import checkpointed


def simcor(k: int, size: list[int], rho: list[float], delta: float = 0.39, epsilon: float | None = None, dims: int = 2, seed: int = 1) -> np.ndarray:
    """A correlation matrix of k blocks: rho inside, delta between, plus the products of random vectors scaled by epsilon."""
    eps = 0.99 - max(rho) if epsilon is None else epsilon
    n = sum(size)
    r = np.full((n, n), delta)
    at = 0
    for s, x in zip(size, rho, strict=True):
        r[at : at + s, at : at + s] = x
        at += s
    np.fill_diagonal(r, 1 - eps)
    v = np.random.default_rng(seed).uniform(-1, 1, (dims, n))
    v *= math.sqrt(eps) / np.sqrt((v * v).sum(0))
    out = r + v.T @ v
    np.fill_diagonal(out, 1.0)
    return out


def near_psd(c: np.ndarray) -> np.ndarray:
    """Negative eigenvalues set to zero, diagonal back to one."""
    w, v = np.linalg.eigh((c + c.T) / 2)
    out = (v * np.maximum(w, 0)) @ v.T
    d = np.sqrt(np.maximum(np.diag(out), 1e-12))
    out = out / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def bivariate_normal(h: float, k: float, r: float) -> float:
    """P(X > h, Y > k) of standard normals with correlation r: Plackett's integral over the correlation's angle."""
    p = (1 - NormalDist().cdf(h)) * (1 - NormalDist().cdf(k))
    t = math.asin(max(-1.0, min(1.0, r)))
    x = t * (_NODES + 1) / 2
    s = np.sin(x)
    f = np.exp(-(h * h + k * k - 2 * h * k * s) / (2 * np.maximum(np.cos(x) ** 2, 1e-12)))
    return p + float(t / 2 * (_WEIGHTS @ f)) / (2 * math.pi)


def tetrachoric(p1: float, p2: float, phi: float) -> float:
    """The normal correlation that gives two bits of means p1, p2 the correlation phi, by bisection."""
    h, k = NormalDist().inv_cdf(1 - p1), NormalDist().inv_cdf(1 - p2)
    want = phi * math.sqrt(p1 * (1 - p1) * p2 * (1 - p2)) + p1 * p2
    lo, hi = -0.9999, 0.9999
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if bivariate_normal(h, k, mid) < want else (lo, mid)
    return (lo + hi) / 2


def phi_bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q = 1 - p
    lo = np.maximum(-np.sqrt(np.outer(p, p) / np.outer(q, q)), -np.sqrt(np.outer(q, q) / np.outer(p, p)))
    a = np.sqrt(np.outer(p, q) / np.outer(q, p))
    return lo, np.minimum(a, 1 / a)


def normal_correlation(means: np.ndarray, sigma: np.ndarray, correct: bool = True) -> np.ndarray:
    """The latent correlation matrix; phi outside its bounds is clipped, or an error names the entries."""
    lo, hi = phi_bounds(means)
    off = ~np.eye(len(means), dtype=bool)
    bad = off & ((sigma < lo) | (sigma > hi))
    if bad.any() and not correct:
        raise ValueError("correlations out of bounds at " + ", ".join(f"({i + 1}, {j + 1})" for i, j in np.argwhere(np.triu(bad))))
    s = np.where(off, np.clip(sigma, lo, hi), 1.0)
    out = np.eye(len(means))
    known: dict[tuple, float] = {}
    for i in range(len(means)):
        for j in range(i):
            key = (round(float(means[i]), 12), round(float(means[j]), 12), round(float(s[i, j]), 12))
            if key not in known:
                known[key] = tetrachoric(*key)
            out[i, j] = out[j, i] = known[key]
    return near_psd(out)


def corrbinary(spark: SparkSession, n: int, means: list[float], sigma: np.ndarray, correct: bool = True, taken: DataFrame | None = None, seed: int = 1, per_task: int = 50_000, tries: int = 1000) -> DataFrame:
    """obs of n rows with these means and (bounded) correlations; ids from 1.

    Rows are drawn in blocks of per_task ids, each with its own seed, so partitions do not matter. taken (v): rows that must
    not occur; rows found there are drawn anew until there are none, and so many draws in vain are an error.
    """
    p = np.array(means)
    latent = normal_correlation(p, np.array(sigma), correct)
    w, v = np.linalg.eigh(latent)
    root = v * np.sqrt(np.maximum(w, 0))
    cut = np.array([NormalDist().inv_cdf(1 - x) for x in means])

    def run(turn: int):
        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for block, ids in pdf.groupby(pdf["id"] // per_task)["id"]:
                    z = np.random.default_rng([seed, turn, int(block)]).standard_normal((per_task, len(p)))[(ids % per_task).to_numpy()]
                    yield pd.DataFrame({"id": ids + 1, "v": list(((z @ root.T) > cut).astype(np.int8))})

        return draw

    ids = spark.range(0, n, 1, max(1, -(-n // per_task)))
    out = ids.mapInPandas(run(0), "id long, v array<tinyint>")
    if taken is not None:
        for turn in range(1, tries + 1):
            again = out.join(taken.select("v").distinct(), "v", "left_semi").select((F.col("id") - 1).alias("id"))
            if again.isEmpty():
                break
            fresh = again.mapInPandas(run(turn), "id long, v array<tinyint>").withColumnRenamed("v", "w")
            out = checkpointed(out.join(fresh, "id", "left").select("id", F.coalesce("w", "v").alias("v")))
        else:
            raise RuntimeError(f"rows still occur among those taken after {tries} draws")
    return out


def block_truth(obs: DataFrame, n: int, k: int) -> DataFrame:
    """Equal blocks of id order as true classes 1..k."""
    return obs.withColumn("orig", F.least(F.lit(k), F.floor((F.col("id") - 1) * k / n) + 1).cast("int"))
