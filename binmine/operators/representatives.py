"""Clustering of representatives that no driver has to hold: k-means by aggregates, partitioning around medoids by blocks.

Both take a frame of idx (long, dense from 0, the order that ties follow) and v (array<double>). What reaches the driver is
a number of rows that follows k and not the representatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binmine.functions.bits import seeded
from binmine.functions.kernels import GUARD, distances, nearest_centres, pam
from binmine.session import checkpointed, discard

#: Rounds of seeding; each draws twice as many rows as centres are wanted.
SEEDINGS = 3
#: Rows of a block of representatives; two blocks' distances are in memory at a time.
BLOCK = 2048


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _to_centres(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """idx, v, label (from 0, the first on ties) and d (squared distance) of the nearest centre."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                label, d = nearest_centres(_matrix(b["v"]), centres)
                yield b.assign(label=label, d=d)

    return points.mapInPandas(run, "idx long, v array<double>, label int, d double")


def _means(points: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The mean of each centre's points; a centre without any stays. Tasks send one row a centre."""
    k, p = centres.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((k, p)), np.zeros(k)
        for b in batches:
            if len(b):
                x = _matrix(b["v"])
                label, _ = nearest_centres(x, centres)
                np.add.at(total, label, x)
                n += np.bincount(label, minlength=k)
        yield pd.DataFrame([(int(c), -1, n[c]) for c in range(k)] + [(c, j, total[c, j]) for c in np.flatnonzero(n).tolist() for j in range(p)], columns=["c", "j", "s"])

    out, counts = np.zeros((k, p)), np.zeros(k)
    for r in points.mapInPandas(run, "c int, j int, s double").groupBy("c", "j").agg(F.sum("s").alias("s")).collect():  # centres x bits
        if r.j < 0:
            counts[r.c] = r.s
        else:
            out[r.c, r.j] = r.s
    found = counts > 0
    return np.where(found[:, None], out / np.maximum(counts, 1)[:, None], centres)


def kmeans_centres(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """At most k centres. Seeding draws 2 k rows a round, the farther from the ones before the likelier (exponential keys of
    the row's seeded hash, so draws do not depend on partitions); of these candidates, weighted by the rows nearest to them,
    k are taken greedily, and Lloyd's rounds follow until no centre moves."""
    first = points.orderBy(seeded(seed, "idx"), "idx").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    drawn = np.array([first[0].v])
    for r in range(SEEDINGS):
        u = (F.pmod(F.xxhash64("idx", F.lit(seed), F.lit(r)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
        more = _to_centres(points, drawn).where("d > 0").withColumn("key", -F.log(u) / F.col("d")).orderBy("key", "idx").limit(2 * k).collect()
        if not more:
            break
        drawn = np.unique(np.vstack([drawn, [m.v for m in more]]), axis=0)
    weight = np.zeros(len(drawn))
    for r in _to_centres(points, drawn).groupBy("label").count().collect():
        weight[r.label] = r["count"]
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(drawn)):
        far = weight * nearest_centres(drawn, drawn[chosen])[1]
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    centres = drawn[chosen]
    for _ in range(GUARD):
        new = _means(points, centres)
        if np.allclose(new, centres):
            return new
        centres = new
    raise RuntimeError(f"centres still move after {GUARD} rounds")


def kmeans(points: DataFrame, k: int, seed: int) -> DataFrame:
    """idx, cluster (from 1) by k-means; fewer distinct rows than k give fewer clusters."""
    centres = kmeans_centres(points, k, seed)
    if not len(centres):
        return points.select("idx", F.lit(1).alias("cluster"))
    return _to_centres(points, centres).select("idx", (F.col("label") + 1).alias("cluster"))


def _blocks(points: DataFrame, block: int) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda r: r["v"])
    return points.groupBy(F.expr(f"idx div {block}").alias("b")).agg(rows.alias("x"))


def _meetings(blocks: DataFrame, n: int) -> DataFrame:
    """cand, other, x, y: every two blocks; those of one candidate block come in one partition, one after the other."""
    pairs = blocks.select(F.col("b").alias("cand")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    x, y = blocks.select(F.col("b").alias("cand"), "x"), blocks.select(F.col("b").alias("other"), F.col("x").alias("y"))
    both = pairs.join(y, "other").join(x, "cand")
    return both.repartition(min(n, 4096), "cand").sortWithinPartitions("cand", "other")


def _costs(k: int, medoids: np.ndarray, at: list[int], block: int) -> Callable:
    """Per candidate block: the least (cost, medoid it would replace or -1, idx). With fewer medoids than k one is added.

    The nearest and second nearest medoid of each row give, in one pass over the rows, the cost of a candidate beside all
    medoids, and for each medoid what its loss adds.
    """
    adding = len(at) < k

    def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = x.shape[1]
        d = np.rint(distances(y, x) * max(1, p))  # rows of y, candidates x
        m = np.rint(distances(y, medoids) * max(1, p)) if len(at) else np.full((len(y), 1), p + 1.0)
        near = m.min(1)
        beside = np.minimum(near[:, None], d)
        if adding:
            return beside.sum(0)[None, :]
        own = m.argmin(1)
        m[np.arange(len(y)), own] = p + 1.0
        lost = np.minimum(m.min(1)[:, None], d) - beside
        return beside.sum(0)[None, :] + (np.arange(len(at))[:, None] == own).astype(np.float64) @ lost

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cand, total = None, None

        def best() -> pd.DataFrame:
            total[:, [i - cand * block for i in at if i // block == cand]] = np.inf
            i, j = np.unravel_index(int(total.argmin()), total.shape)  # the first medoid, then the first row, on ties
            return pd.DataFrame({"cost": [float(total[i, j])], "out": [-1 if adding else int(i)], "idx": [cand * block + int(j)]})

        for b in batches:
            for c, x, y in zip(b["cand"], b["x"], b["y"], strict=True):
                if c != cand:
                    if cand is not None:
                        yield best()
                    cand, total = int(c), 0.0
                total = total + of(np.array(x.tolist()), np.array(y.tolist()))
        if cand is not None:
            yield best()

    return run


def _whole(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("idx")
        x = _matrix(b["v"])
        return pd.DataFrame({"idx": b["idx"].to_numpy()[pam(np.rint(distances(x) * max(1, x.shape[1])), k)]})

    return run


def pam_medoids(points: DataFrame, k: int, block: int = BLOCK) -> tuple[list[int], np.ndarray]:
    """idx and rows (0/1) of k medoids by Hamming distance: greedy build, then the best swap while the cost falls.

    One job costs all candidates, or all swaps: blocks of rows meet two by two and only a block's best candidate comes back.
    The same medoids, ties included, as kernels.pam, which one block's rows go to whole, in a task.
    """
    points = checkpointed(points)
    n = points.count()
    k, count = min(k, n), -(-n // block)
    if count <= 1:
        at = [int(r.idx) for r in points.groupBy().applyInPandas(_whole(k), "idx long").collect()] if n else []
    else:
        blocks = checkpointed(_blocks(points, block))
        at, rows, last = [], np.zeros((0, 0)), None
        for _ in range(GUARD):
            job = _meetings(blocks, count).mapInPandas(_costs(k, rows, at, block), "cost double, out int, idx long")
            r = job.orderBy("cost", "out", "idx").first()
            if len(at) < k:
                at.append(r.idx)
                last = r.cost
            elif r.cost < last:
                at[r.out], last = r.idx, r.cost
            else:
                break
            rows = _rows(points, at)
        else:
            raise RuntimeError(f"medoids still move after {GUARD} rounds")
        discard(blocks)
    rows = _rows(points, at)
    discard(points)
    return at, rows


def _rows(points: DataFrame, at: list[int]) -> np.ndarray:
    found = {r.idx: r.v for r in points.where(F.col("idx").isin(at)).collect()}
    return np.array([found[i] for i in at])


def medoid_clusters(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """idx, cluster (from 1): the nearest of k medoids, the first on ties."""
    _, rows = pam_medoids(points, k, block)
    if not len(rows):
        return points.select("idx", F.lit(1).alias("cluster"))
    return _to_centres(points, rows).select("idx", (F.col("label") + 1).alias("cluster"))
