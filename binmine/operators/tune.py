"""Grid searches over a stratified sample with true classes: first setting of the best score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.functions.bits import popcount, stratified
from binmine.operators import bubble, factor, leader, metrics, sketch
from binmine.sources.tables import to_items

SAMPLE = 2000
MINHASH_GRID = tuple(range(2, 51, 2))
LSH_GRID = tuple((b, n) for b in range(2, 16) for n in range(4, 51, 2) if n % b == 0 and n // b % 2 == 0)
CANOPY_GRID = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
SORTED_GRID = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
PROXIMUS_GRID = tuple(x / 10 for x in range(5, 16))
BUBBLE_GRID = tuple((t / 10, m) for t in range(5, 9) for m in (10, 20, 50, 100))


def sample_of(obs: DataFrame, classes: int, total: int = SAMPLE, seed: int = 1) -> DataFrame:
    """Rows with orig, a rounded share of total from each class; an error if a class is smaller than its share."""
    least = obs.groupBy("orig").count().agg(F.min("count")).first()[0]
    if least < total // classes:
        raise ValueError(f"the smallest class has {least} rows, its share of the sample is {total // classes}")
    return stratified(obs, total, classes, seed).persist()


def feasible(obs: DataFrame, classes: int, total: int = SAMPLE) -> int:
    """total, or where the smallest class is smaller than its share the most rows that all classes can give alike."""
    least = obs.groupBy("orig").count().agg(F.min("count")).first()[0]
    return total if least is None or least >= -(-total // classes) else classes * least


def grid_search(sample: DataFrame, grid, cluster: Callable[[DataFrame, object], DataFrame], score: str):
    """(best setting, scores): cluster gives id, cluster of the sample; score is "f1" or "rand"."""
    scores = []
    for g in grid:
        both = sample.select("id", "orig").join(cluster(sample, g).withColumnRenamed("cluster", "result"), "id")
        row = (metrics.rec_pre_f1(both) if score == "f1" else metrics.rand_index(both)).first()
        scores.append(row[score] if row[score] is not None else -1.0)
    return grid[max(range(len(grid)), key=lambda i: (scores[i], -i))], scores


def tune_minhash(obs: DataFrame, classes: int, p: int, total: int = SAMPLE, seed: int = 1, grid=MINHASH_GRID):
    """Signatures are computed once; a prefix of the hashes is a smaller family."""
    s = sample_of(obs, classes, total, seed)
    sigs = sketch.signatures(to_items(s), sketch.coefficients(max(grid), p, seed), p).persist()
    return grid_search(s, grid, lambda _, n: sketch.minhash_clusters(sigs.select("id", F.slice("sig", 1, n).alias("sig"))), "f1")


def tune_lsh(obs: DataFrame, classes: int, p: int, total: int = SAMPLE, seed: int = 1, grid=LSH_GRID):
    s = sample_of(obs, classes, total, seed)
    n = s.count()
    sigs = sketch.signatures(to_items(s), sketch.coefficients(max(h for _, h in grid), p, seed), p).persist()
    scores = []
    for b, h in grid:
        pairs = sketch.candidate_pairs(sketch.buckets(sigs.select("id", F.slice("sig", 1, h).alias("sig")), h, b))
        f1 = metrics.pair_metrics(pairs, s.select("id", "orig"), n, classes).first().f1
        scores.append(-1.0 if f1 is None else f1)
    return grid[max(range(len(grid)), key=lambda i: (scores[i], -i))], scores


def tune_canopy(obs: DataFrame, classes: int, total: int = SAMPLE, seed: int = 1, grid=CANOPY_GRID):
    return grid_search(sample_of(obs, classes, total, seed), grid, lambda s, t: leader.canopy(s, t, t, seed), "rand")


def tune_sorted(obs: DataFrame, classes: int, total: int = SAMPLE, seed: int = 1, grid=SORTED_GRID, window: int = 30, runs: int = 3):
    return grid_search(sample_of(obs, classes, total, seed), grid, lambda s, t: leader.sorted_neighborhood(s, window, t, runs, True, 1, seed), "rand")


def tune_proximus(obs: DataFrame, classes: int, total: int = SAMPLE, seed: int = 1, grid=PROXIMUS_GRID):
    """The grid is in units of the rounded mean number of ones."""
    s = sample_of(obs, classes, total, seed)
    ones = round(s.agg(F.avg(popcount("v"))).first()[0])
    best, scores = grid_search(s, grid, lambda x, g: factor.proximus(x, ones * g, classes, 1, seed), "rand")
    return ones * best, scores


def tune_bubble(obs: DataFrame, classes: int, total: int = SAMPLE, seed: int = 1, grid=BUBBLE_GRID):
    return grid_search(sample_of(obs, classes, total, seed), grid, lambda s, g: bubble.bubble_clusters(s, g[0], g[1], 1, classes), "f1")
