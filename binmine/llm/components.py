"""Connected components of links, without gathering links, components or ids anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


class Forest:
    """Union-find over positions 0 to n - 1; add() takes arrays of pairs and returns those that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            _, first = np.unique(hi, return_index=True)  # one link for each root that is hung below a smaller one
            kept += list(zip(a[first].tolist(), b[first].tolist(), strict=True))
            self.root[hi[first]] = lo[first]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up
        return kept


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's links as stars: (node, smallest node that it reaches by links of this partition)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
    for some in np.array_split(np.fromiter(up, np.int64, len(up)), max(1, len(up) // 50_000)):
        if len(some):
            yield pd.DataFrame({"a": some, "b": [find(int(x)) for x in some]})


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; edges: a, b (long), both ways alike.

    Links are contracted inside partitions, then large-star and small-star steps alternate until nothing changes; each
    round is a written table. Smallest neighbours are pre-aggregated before the shuffle and joined back, so a star's
    centre with very many links can be split. Self-links and repeated links are harmless, no links give no rows.
    """
    spark = edges.sparkSession
    e, path = written(edges.where("a != b").select("a", "b").mapInPandas(_contract, "a long, b long").distinct(), "links")
    state = _fingerprint(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b")
        new, new_path = written(small.distinct(), "links")
        discard(spark, path)
        path, e, old, state = new_path, new, state, _fingerprint(new)
        if state == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
