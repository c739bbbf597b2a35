"""CLOPE, Large Item and SCALE: features and objectives are Spark aggregates, order-dependent passes are chunk kernels."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from binmine.functions.bits import chunked, sample_rows, seeded
from binmine.functions.kernels import distances, pam
from binmine.operators import merge
from binmine.session import checkpointed

# ---- features and objectives of a given labelling: obs_long(id, j) and labels(id, cluster)


def supports(obs_long: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, j, occ."""
    return obs_long.join(labels, "id").groupBy("cluster", "j").agg(F.count(F.lit(1)).alias("occ"))


def features(obs_long: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, n (rows), s (items), w (distinct items), occ2 (sum of squared supports)."""
    items = supports(obs_long, labels).groupBy("cluster").agg(F.sum("occ").alias("s"), F.count(F.lit(1)).alias("w"), F.sum(F.expr("occ * occ")).alias("occ2"))
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(items, "cluster", "left").na.fill(0, ["s", "w", "occ2"])


def clope_profit(obs_long: DataFrame, labels: DataFrame, r: float) -> DataFrame:
    """profit: sum of S N / W**r over clusters, divided by the rows."""
    return features(obs_long, labels).agg(F.expr(f"try_divide(sum(if(w > 0, s * n / power(w, {float(r)}D), 0D)), sum(n))").alias("profit"))


def _joined_width(sup: DataFrame, extra: DataFrame, *keys: str) -> DataFrame:
    """cluster, keys, common: how many of extra's items (keys, j) a cluster has."""
    return extra.join(sup.select("cluster", "j"), "j").groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("common"))


def clope_delta_add(obs_long: DataFrame, labels: DataFrame, rows_long: DataFrame, r: float) -> DataFrame:
    """id, cluster, delta: the profit's gain S'N'/W'**r - S N/W**r if a row of rows_long joined a cluster (clusters are few)."""
    f = features(obs_long, labels)
    x = rows_long.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    both = x.crossJoin(F.broadcast(f)).join(_joined_width(supports(obs_long, labels), rows_long, "id"), ["id", "cluster"], "left").na.fill(0, ["common"])
    return both.select("id", "cluster", F.expr(f"(s + size) * (n + 1) / power(w + size - common, {float(r)}D) - if(w > 0, s * n / power(w, {float(r)}D), 0D)").alias("delta"))


def clope_delta_merge(obs_long: DataFrame, labels: DataFrame, r: float) -> DataFrame:
    """c1 < c2 and the gain of adding cluster c2's feature to c1's; over clusters, which are few."""
    f = features(obs_long, labels)
    sup = supports(obs_long, labels).select("cluster", "j")
    common = sup.select(F.col("cluster").alias("c1"), "j").join(sup.select(F.col("cluster").alias("c2"), "j"), "j").where("c1 < c2").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("common"))
    a = f.select(F.col("cluster").alias("c1"), F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("w").alias("w1"))
    b = f.select(F.col("cluster").alias("c2"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("w").alias("w2"))
    both = a.join(F.broadcast(b), F.expr("c1 < c2")).join(common, ["c1", "c2"], "left").na.fill(0, ["common"])
    return both.select("c1", "c2", F.expr(f"(s1 + s2) * (n1 + n2) / power(w1 + w2 - common, {float(r)}D) - s1 * n1 / power(w1, {float(r)}D)").alias("delta"))


def _cost(large: DataFrame, w: float, variant: str, *keys: str) -> DataFrame:
    """keys, cost from candidate clusterings: large has keys, cluster, own, j, is_large, is_small."""
    per = large.groupBy(*keys, "cluster", "own").agg(F.count_if("is_large").alias("nl"))
    totals = per.groupBy(*keys).agg(F.sum("nl").alias("all_large"), F.sum(F.when(F.col("own"), F.col("nl")).otherwise(0)).alias("new_large"), F.count_if(~F.col("own")).alias("others"))
    unions = large.groupBy(*keys).agg(F.count_distinct(F.when(F.col("is_small"), F.col("j"))).alias("small"), F.count_distinct(F.when(F.col("is_large"), F.col("j"))).alias("large"))
    times = "others" if variant == "reference" else "least(others, 1)"
    inter = f"if(others = 0, 0, all_large - new_large + new_large * {times} - large)"
    return totals.join(unions, list(keys)).select(*keys, F.expr(f"{float(w)}D * small + {inter}").alias("cost"))


def _states(sup: DataFrame, sizes: DataFrame, minsupport: float) -> DataFrame:
    return sup.join(sizes, "cluster").withColumn("is_large", F.col("occ") >= F.col("n") * minsupport).withColumn("is_small", ~F.col("is_large"))


def largeitem_total(obs_long: DataFrame, labels: DataFrame, minsupport: float, w: float) -> DataFrame:
    """cost: w times the distinct small items plus the large items that clusters share."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    st = _states(supports(obs_long, labels), sizes, minsupport)
    return st.agg((w * F.count_distinct(F.when(F.col("is_small"), F.col("j"))) + F.count_if("is_large") - F.count_distinct(F.when(F.col("is_large"), F.col("j")))).alias("cost"))


def largeitem_costs(obs_long: DataFrame, labels: DataFrame, added: DataFrame, minsupport: float, w: float, variant: str = "reference") -> DataFrame:
    """id, target, cost of adding a feature to each cluster, and alone (target 0).

    added: id, j, occ, n (rows of the feature; a single row has occ = n = 1), few rows. Variant "reference" adds the
    grown cluster's large items once for each other cluster, "paper" once.
    """
    sup, sizes = supports(obs_long, labels), labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    x = F.broadcast(added.select("id", F.col("n").alias("xn")).distinct())
    base = sup.join(sizes, "cluster").crossJoin(x)
    targets = F.broadcast(sizes.select(F.col("cluster").alias("target")).unionByName(labels.sparkSession.createDataFrame([(0,)], "target int").select(F.col("target").cast(dict(labels.dtypes)["cluster"]))))
    old = base.crossJoin(targets)
    xs = added.select("id", "j", F.col("occ").alias("xocc"))
    # supports after the addition: the target's own are raised, the others stay
    other = old.where("cluster != target").select("id", "target", "cluster", "j", "occ", "n", F.lit(False).alias("own"))
    mine = old.where("cluster = target").select("id", "target", "j", "occ").unionByName(xs.crossJoin(targets).select("id", "target", "j", F.col("xocc").alias("occ")))
    grown = mine.groupBy("id", "target", "j").agg(F.sum("occ").alias("occ")).join(x, "id").join(F.broadcast(sizes.select(F.col("cluster").alias("target"), "n")), "target", "left").select("id", "target", F.col("target").alias("cluster"), "j", "occ", (F.coalesce("n", F.lit(0)) + F.col("xn")).alias("n"), F.lit(True).alias("own"))
    every = other.unionByName(grown).withColumn("is_large", F.col("occ") >= F.col("n") * minsupport).withColumn("is_small", ~F.col("is_large"))
    # alone beside a single cluster counts the new large items once, as does every case of one other cluster
    return _cost(every, w, variant, "id", "target")


def largeitem_row_costs(obs_long: DataFrame, labels: DataFrame, rows_long: DataFrame, minsupport: float, w: float, variant: str = "reference") -> DataFrame:
    """id, target, cost of adding each row of rows_long to each cluster, and alone (target 0); 0 < minsupport <= 1.

    For a given target an item adds to the cost by itself, so the cost is the target's own (with one more row) plus a
    correction for each of the row's items: rows meet a small table of corrections, and no pair of row and cluster
    looks at other clusters' items.
    """
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    k = sizes.count()
    times = {"reference": (max(k - 1, 0), k), "paper": (min(k - 1, 1), min(k, 1))}[variant]
    sup = supports(obs_long, labels)
    items = sup.select("j").union(rows_long.select("j")).distinct()
    grid = sizes.crossJoin(F.broadcast(items)).join(sup, ["cluster", "j"], "left").na.fill(0, ["occ"])  # clusters x items
    grid = grid.withColumn("lg", F.col("occ") >= F.col("n") * minsupport).withColumn("sm", (F.col("occ") > 0) & ~F.col("lg"))
    by_item = Window.partitionBy("j")
    grid = grid.withColumn("ls", F.count_if("lg").over(by_item)).withColumn("ss", F.count_if("sm").over(by_item))

    def part(large: str, small: str, other_large: str, other_small: str, t: int, inter: bool) -> str:
        add = f"if({large}, {t}, 0) - if({other_large} or {large}, 1, 0)" if inter else "0"
        return f"({float(w)}D * if({other_small} or {small}, 1, 0) + {add})"

    own = "ls - if(lg, 1, 0) > 0", "ss - if(sm, 1, 0) > 0"
    without = part(f"(occ >= (n + 1) * {minsupport})", f"(occ > 0 and occ < (n + 1) * {minsupport})", *own, times[0], k > 1)
    with_it = part(f"(occ + 1 >= (n + 1) * {minsupport})", f"(occ + 1 < (n + 1) * {minsupport})", *own, times[0], k > 1)
    alone0, alone1 = part("false", "false", "ls > 0", "ss > 0", 0, True), part("true", "false", "ls > 0", "ss > 0", times[1], True)
    nl = grid.groupBy("cluster").agg(F.count_if("lg").alias("nl"))
    total = nl.agg(F.sum("nl")).first()[0] or 0
    base = grid.groupBy(F.col("cluster").alias("target")).agg(F.expr(f"sum({without})").alias("base")).join(nl.withColumnRenamed("cluster", "target"), "target").select("target", (F.col("base") + (F.lit(total) - F.col("nl") if k > 1 else F.lit(0))).alias("base"))
    one = grid.select("j", "ls", "ss").distinct()
    kind = dict(labels.dtypes)["cluster"]
    base = base.unionByName(one.agg((F.expr(f"coalesce(sum({alone0}), 0D)") + total).alias("base")).select(F.lit(0).cast(kind).alias("target"), "base"))
    fix = grid.select(F.col("cluster").alias("target"), "j", F.expr(f"{with_it} - {without}").alias("fix")).unionByName(one.select(F.lit(0).cast(kind).alias("target"), "j", F.expr(f"{alone1} - {alone0}").alias("fix")))
    return rows_long.join(F.broadcast(fix), "j").groupBy("id", "target").agg(F.sum("fix").alias("fix")).join(F.broadcast(base), "target").select("id", "target", (F.col("base") + F.col("fix")).alias("cost"))


def scale_wcd(obs_long: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, n, s, wcd: sum of squared supports over S N."""
    return features(obs_long, labels).select("cluster", "n", "s", F.expr("try_divide(occ2, s * n)").alias("wcd"))


def scale_ewcd_add(obs_long: DataFrame, labels: DataFrame, rows_long: DataFrame, total: int) -> DataFrame:
    """id, cluster, ewcd: the expected weighted coverage density if a row of rows_long joined a cluster."""
    f = features(obs_long, labels).withColumn("part", F.expr("coalesce(try_divide(occ2, s), 0D)"))
    x = rows_long.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    hit = rows_long.join(supports(obs_long, labels), "j").groupBy("id", "cluster").agg(F.sum("occ").alias("hits"))
    whole = F.broadcast(f.agg(F.sum("part").alias("whole")))
    both = x.crossJoin(F.broadcast(f)).crossJoin(whole).join(hit, ["id", "cluster"], "left").na.fill(0, ["hits"])
    return both.select("id", "cluster", F.expr(f"(whole - part + (occ2 + 2 * hits + size) / (s + size)) / {total}").alias("ewcd"))


# ---- order-dependent passes


class _Clusters:
    """Features of one chunk's clusters: supports, rows N, items S, distinct items W, the last two kept up with each change."""

    def __init__(self, p: int) -> None:
        self._occ, self._sums = np.zeros((16, p), np.int64), np.zeros((3, 16), np.int64)
        self.k = 0

    occ = property(lambda self: self._occ[: self.k])
    n = property(lambda self: self._sums[0, : self.k])
    s = property(lambda self: self._sums[1, : self.k])
    w = property(lambda self: self._sums[2, : self.k])

    def grow(self) -> int:
        if self.k == len(self._occ):
            self._occ, self._sums = np.vstack([self._occ, np.zeros_like(self._occ)]), np.hstack([self._sums, np.zeros_like(self._sums)])
        self.k += 1
        return self.k - 1

    def add(self, k: int, occ: np.ndarray, n: int, sign: int = 1) -> None:
        self._occ[k] += sign * occ
        self._sums[:, k] += sign * n, sign * int(occ.sum()), 0
        self._sums[2, k] = np.count_nonzero(self._occ[k])

    def move(self, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        """Rows leave clusters old, if given, and join clusters new."""
        if old is not None:
            going = old != new
            if not going.any():
                return
            x, old, new = x[going], old[going], new[going]
        row, j = np.nonzero(x)
        for label, sign in ((new, 1), (old, -1)):
            if label is not None:
                for k, rows in zip(*np.unique(label, return_counts=True), strict=True):
                    self._sums[0, k] += sign * rows
                cells, times = np.unique(label[row] * x.shape[1] + j, return_counts=True)
                self._occ.ravel()[cells] += sign * times
        touched = np.unique(new if old is None else np.concatenate([old, new]))
        self._sums[1, touched] = self._occ[touched].sum(1)
        self._sums[2, touched] = np.count_nonzero(self._occ[touched], axis=1)


def _profit(s, n, w, r):
    return np.where(w > 0, s * n / np.maximum(w, 1).astype(float) ** r, 0.0)


def _clope_place(c: _Clusters, occ: np.ndarray, n: int, r: float, most: int, alive: np.ndarray | None = None) -> int:
    items = np.flatnonzero(occ)
    s, w = c.s, c.w
    gain = _profit(s + occ.sum(), c.n + n, w + (c.occ[:, items] == 0).sum(1), r) - _profit(s, c.n, w, r)
    live = (c.n > 0) & (s > 0)  # the cluster of rows without items takes no others
    gain = np.where(live, gain, -np.inf)
    alone = float(_profit(occ.sum(), n, (occ > 0).sum(), r))
    best = int(gain.argmax()) if live.any() else -1
    return -1 if best < 0 or (alone > gain[best] and live.sum() < most) else best


def _large_costs(occ: np.ndarray, n: np.ndarray, x: np.ndarray, xn: int, minsup: float, w: float, variant: str) -> tuple[np.ndarray, float]:
    """Cost of x joining each live cluster, and of x alone."""
    k = len(n)
    large, small = occ >= (n * minsup)[:, None], (occ > 0) & (occ < (n * minsup)[:, None])
    nl, ls, ss = large.sum(1), large.sum(0), small.sum(0)
    grown = occ + x
    gl = grown >= ((n + xn) * minsup)[:, None]
    gs = (grown > 0) & ~gl
    rest_l, rest_s = (ls - large) > 0, (ss - small) > 0
    times = k - 1 if variant == "reference" else min(1, k - 1)
    inter = (nl.sum() - nl) + gl.sum(1) * times - (gl | rest_l).sum(1) if k > 1 else np.zeros(k)
    joins = w * ((gs | rest_s) if k > 1 else gs).sum(1) + inter
    xl = x >= xn * minsup
    xs = (x > 0) & ~xl
    xl = xl & (x > 0)
    alone = w * (xs | (ss > 0)).sum() + nl.sum() + xl.sum() * (k if variant == "reference" else 1) - (xl | (ls > 0)).sum()
    return joins, float(alone)


def _largeitem_place(c: _Clusters, x: np.ndarray, xn: int, minsup: float, w: float, variant: str, new: bool = True) -> int:
    live = np.flatnonzero((c.n > 0) & (c.s > 0))
    if not len(live):
        return -1
    joins, alone = _large_costs(c.occ[live], c.n[live], x, xn, minsup, w, variant)
    i = int(joins.argmin())
    return -1 if new and alone < joins[i] else int(live[i])


def _mask(flags: np.ndarray) -> int:
    """Up to 64 flags as a number."""
    return int.from_bytes(np.packbits(flags).tobytes(), "big")


#: Clusters from which sets are looked up; stands for the large items of a cluster that left the table, whose costs become huge.
MANY, GONE = 200, -(1 << 40)


class _LargeClusters(_Clusters):
    """Clusters of Large Item with their items' states as masks, for up to 64 items and 0 < minsup <= 1; place() gives what
    _largeitem_place does for one row.

    Clusters so small that any item of theirs stays large when a row joins ("low") are found by their set of items: where no
    item is large or small in one cluster only, such a join costs the more, the more items the union has, and of equal unions the
    more, the fewer the cluster has. So rows meet sets among their own subsets, and other clusters one by one.
    """

    def __init__(self, p: int, minsup: float, w: float, variant: str) -> None:
        super().__init__(p)
        self.p, self.minsup, self.cost, self.variant = p, minsup, w, variant
        self.states: list[tuple[int, ...]] = []  # kind (0 none, 1 low, 2 other) and masks of each cluster: see follow()
        self.low: dict[int, list[int]] = {}  # low clusters by their items
        self.others: list[int] = []
        self.counts = [[0] * p, [0] * p]  # clusters in which an item is large, small
        self.once, self.more, self.total, self.live = [0, 0], [0, 0], 0, 0
        self.bit = [_mask(np.arange(p) == j) for j in range(p)]
        self.known, self.indexed, self.whole, self.sets = None, False, sum(self.bit), None
        self.width, self.rest, self.gone = -(-p // 8), 0, 0

    def grow(self) -> int:
        self.states.append((0, 0, 0, 0, 0, 0))
        self.sets = None
        return super().grow()

    def add(self, k: int, occ: np.ndarray, n: int, sign: int = 1) -> None:
        if sign > 0:
            self._occ[k] += occ
        else:
            self._occ[k] -= occ
        self._sums[0, k] += sign * n
        self.follow(k)

    def move(self, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        super().move(x, old, new)
        for k in np.unique(new if old is None else np.concatenate([old, new])).tolist():
            self.follow(k)

    def follow(self, k: int) -> None:
        """State of cluster k after a change: items certain (large whatever row joins), open (large if the row has it), present, large, small."""
        occ, n = self._occ[k], int(self._sums[0, k])
        was = self.states[k]
        if not n:
            now = (0, 0, 0, 0, 0, 0)
        elif (n + 1) * self.minsup <= 1:
            present = _mask(occ > 0)
            now = (1, present, self.whole & ~present, present, present, 0) if present else (0, 0, 0, 0, 0, 0)
        else:
            least, at = math.ceil((n + 1) * self.minsup), self.width
            bits = np.packbits(occ >= np.array([[1], [least], [least - 1], [math.ceil(n * self.minsup)]]), axis=1).tobytes()
            present, certain, may, large = (int.from_bytes(bits[i : i + at], "big") for i in range(0, 4 * at, at))
            now = (2, certain, may & ~certain, present, large, present & ~large) if present else (0, 0, 0, 0, 0, 0)
        if now == was:
            return
        self.states[k] = now
        for i in (0, 1):
            changed = now[4 + i] ^ was[4 + i]
            while changed:
                b = changed & -changed
                changed ^= b
                j = 8 * self.width - b.bit_length()
                self.counts[i][j] += 1 if now[4 + i] & b else -1
                m = self.counts[i][j]
                self.once[i] = self.once[i] | b if m == 1 else self.once[i] & ~b
                self.more[i] = self.more[i] | b if m > 1 else self.more[i] & ~b
        self.total += now[4].bit_count() - was[4].bit_count()
        self.live += (now[0] > 0) - (was[0] > 0)
        if was[0] == 1:
            sets = self.low[was[3]]
            del sets[bisect.bisect_left(sets, k)]
            if not sets:
                del self.low[was[3]]
        if now[0] == 1:
            bisect.insort(self.low.setdefault(now[3], []), k)
        if now[0] != was[0]:
            if was[0] == 2:
                del self.others[bisect.bisect_left(self.others, k)]
            if now[0] == 2:
                bisect.insort(self.others, k)
        if self.known is not None:
            shown, i = now[0] == 2 or (now[0] == 1 and not self.indexed), bisect.bisect_left(self.known, k)
            here = i < len(self.known) and self.known[i] == k
            if shown and not here:
                self.known.insert(i, k)
                self.table, self.larges = np.insert(self.table, i, 0, axis=1), np.insert(self.larges, i, 0)
            if shown:
                self.gone -= here and int(self.larges[i]) == GONE
                self.table[:, i] = now[1:]
                self.larges[i] = now[4].bit_count()
            elif here and self.larges[i] != GONE:
                self.larges[i] = GONE
                self.gone += 1
                if self.gone > 32 + len(self.known) // 2:
                    stay = self.larges != GONE
                    self.known, self.gone = [j for j, still in zip(self.known, stay.tolist(), strict=True) if still], 0
                    self.table, self.larges = self.table[:, stay], self.larges[stay]
        if self.sets is not None and 1 in (now[0], was[0]):
            self.sets[k] = now[3] if now[0] == 1 else 0

    def costs(self, x: int, times: int) -> np.ndarray:
        """Of joining each known cluster."""
        certain, may, present, large, small = self.table
        x = np.uint64(x)
        gl = may & x
        gl |= certain
        if self.live == 1:
            return np.where(self.larges == GONE, np.inf, self.cost * np.bitwise_count((present | x) & ~gl).astype(np.int64) + 0)
        inter = np.bitwise_count(gl) * np.int64(times)
        inter += self.total
        inter -= self.larges
        if self.more[0] == self.whole:
            inter -= self.p
        else:
            shared = gl | np.uint64(self.more[0])
            inter -= np.bitwise_count(shared | (np.uint64(self.once[0]) & ~large) if self.once[0] else shared)
        if self.more[1] == self.whole:
            return self.cost * self.p + inter
        gs = (present | x) & ~gl | np.uint64(self.more[1])
        return self.cost * np.bitwise_count(gs | (np.uint64(self.once[1]) & ~small) if self.once[1] else gs).astype(np.int64) + inter

    def subsets(self, x: int, within: int) -> tuple[int, int] | None:
        """(items, cluster) of the largest set of low clusters that is inside x and has all of `within`, the first such cluster."""
        best, free, sub = None, x & ~within, x & ~within
        while True:
            if (s := sub | within) and (found := self.low.get(s)) and (best is None or (-s.bit_count(), found[0]) < best):
                best = (-s.bit_count(), found[0])
            if not sub:
                return best
            sub = (sub - 1) & free

    def place(self, row: np.ndarray, new: bool = True) -> int:
        k = self.live
        if not k:
            return -1
        x = _mask(row > 0)
        size, times = x.bit_count(), k - 1 if self.variant == "reference" else min(1, k - 1)
        # whether low clusters are told apart by their sets alone: then items of the union count more than all else
        self.rest -= self.rest > 0
        indexed = k > MANY and times > 2 * self.p + 1 and not any(self.once) and not self.rest
        if self.known is None or self.indexed != indexed:
            self.rest, self.gone = 0 if indexed else MANY, 0
            self.known, self.indexed = self.others.copy() if indexed else sorted([*self.others, *(i for found in self.low.values() for i in found)]), indexed
            self.table = np.array([self.states[i][1:] for i in self.known], np.uint64).reshape(-1, 5).T.copy()
            self.larges = np.bitwise_count(self.table[3]).astype(np.int64)
        best = (np.inf, -1)
        if self.known:
            costs = self.costs(x, times)
            i = int(costs.argmin())
            best = (float(costs[i]), self.known[i])
        large, small = (self.once[i] | self.more[i] for i in (0, 1))
        if self.indexed and self.low:
            join = lambda have, union: float(self.cost * self.more[1].bit_count() + (self.total - have + union * times - (x | self.more[0]).bit_count()))
            found = self.subsets(x, 0) if size < 12 else None
            if found:
                best = min(best, (join(-found[0], size), found[1]))
            elif size >= 12 or (not new and best[0] >= join(size + 1, size + 1)):
                if self.sets is None:
                    self.sets = np.array([t[3] if t[0] == 1 else 0 for t in self.states], np.uint64)
                rank = np.bitwise_count(self.sets | np.uint64(x)) * np.int64(times) - np.bitwise_count(self.sets)
                rank[self.sets == 0] = np.iinfo(np.int64).max
                i = int(rank.argmin())
                have = self.states[i][3]
                best = min(best, (join(have.bit_count(), (have | x).bit_count()), i))
        if new:
            alone = self.cost * small.bit_count() + self.total + size * (k if self.variant == "reference" else 1) - (x | large).bit_count()
            if alone < best[0]:
                return -1
        return best[1]


#: Rows looked at ahead at once, and the fewest that must be settled for a look to have been worth it.
AHEAD, WORTH = 8192, 48
#: Clusters of Large Item up to which rows are looked at ahead.
FEW = 8


class _ClopeAhead:
    """Places of many rows at once while no cluster gains or loses an item: each row's gains from sums that follow guessed labels."""

    def __init__(self, r: float, most: int) -> None:
        self.r, self.most = r, most

    def start(self, c: _Clusters, x: np.ndarray, packed: np.ndarray, old: np.ndarray | None, again: bool) -> None:
        self.live = np.flatnonzero((c.n > 0) & (c.s > 0))
        self.c, self.x, self.old, p = c, x, old, x.shape[1]
        self.words = _words(packed)
        self.lack = ~_words(np.packbits(c.occ[self.live] > 0, axis=1))
        self.size = np.bitwise_count(self.words).sum(0, dtype=np.int64)
        self.power = np.arange(p + 1).astype(float) ** self.r
        self.alone = np.array([float(_profit(np.int64(k), 1, np.int64(k), self.r)) for k in range(p + 1)])[self.size]
        self.new = [np.bitwise_count(self.words[0] & k[0]) if len(k) == 1 else np.bitwise_count(self.words & k[:, None]).sum(0, dtype=np.int64) for k in self.lack.T]

    def places(self, guess: np.ndarray | None, at: int) -> np.ndarray:
        """Clusters of rows at.. (-1: one of its own), as if rows before them went as guessed (None: nowhere)."""
        size, best, label = self.size[at:], None, np.zeros(len(self.size) - at, np.int64)
        for k, new in zip(self.live.tolist(), self.new, strict=True):
            rows, _, n = _followed(k, guess, self.old, at)
            n, s, w, new = n + int(self.c.n[k]), int(self.c.s[k]), int(self.c.w[k]), new[at:]
            if rows is not None:
                joins, change = rows
                s = s + change(self.size) - np.where(joins, size, 0)
            gain = (s + size) * (n + 1) / self.power[w + new] - s * n / self.power[w]
            if best is None:
                best = gain
                label[:] = k
            else:
                better = gain > best
                np.copyto(best, gain, where=better)
                label[better] = k
        if len(self.live) < self.most:
            label[self.alone[at:] > best] = -1
        return label

    def stop(self, label: np.ndarray) -> tuple[int, bool]:
        """The first row after which items or clusters differ, and whether its own place is that of label."""
        missed, own = np.zeros(len(label), bool), label < 0
        for k, new in zip(self.live.tolist(), self.new, strict=True):
            own |= (label == k) & (new[: len(label)] > 0)
            if self.old is not None:
                gone = self.old[: len(label)] == k
                if (least := int(self.c.occ[k][self.c.occ[k] > 0].min())) <= (leaving := np.count_nonzero(gone)) and leaving:
                    at = np.flatnonzero(gone | (label == k))
                    g, j = gone[at, None] * self.x[at].astype(np.int64), (label[at] == k)[:, None] * self.x[at].astype(np.int64)
                    left = self.c.occ[k] + (j - g).cumsum(0) - j  # what an item has when the row is out
                    missed[at[((left <= 0) & (g > 0)).any(1)]] = True
        first = [int(z.argmax()) if z.any() else len(label) for z in (missed, own)]
        return min(first), first[1] < first[0]


class _LargeItemAhead:
    """Places of many rows at once while clusters live: large and small items of each moment follow guessed labels."""

    def __init__(self, minsup: float, w: float, variant: str) -> None:
        self.minsup, self.w, self.variant = minsup, w, variant

    def start(self, c: _Clusters, x: np.ndarray, packed: np.ndarray, old: np.ndarray | None, again: bool) -> None:
        self.live = np.flatnonzero(c.n)
        self.live = self.live[c.occ[self.live].any(1)]
        self.c, self.x, self.old, self.new = c, np.ascontiguousarray(x.T), old, not again
        self.count = np.uint8 if len(self.x) < 256 else np.int32
        if len(self.live) > FEW:
            self.live = self.live[:0]  # one by one is faster

    def total(self, flags: np.ndarray) -> np.ndarray:
        return np.add.reduce(flags.view(np.uint8), axis=0, dtype=self.count).astype(np.int64)

    def places(self, guess: np.ndarray | None, at: int) -> np.ndarray:
        """As _ClopeAhead.places; _large_costs for many rows, items first."""
        k, x = len(self.live), self.x[:, at:]
        if k == 1 and not self.new:
            return np.full(x.shape[1], self.live[0])
        least = lambda n: np.ceil(n * self.minsup).astype(np.int32)  # noqa: E731  occ >= n minsup, in whole numbers
        state, ls, ss, nls = [], np.zeros(x.shape, self.count if k < 256 else np.int32), np.zeros(x.shape, self.count if k < 256 else np.int32), 0
        for i in self.live.tolist():
            rows, _, n = _followed(i, guess, self.old, at)
            n, occ = np.asarray(n + int(self.c.n[i])), self.c.occ[i].astype(np.int32)[:, None]
            if rows is not None:
                joins, change = rows
                occ = occ + change(self.x) - x * joins
            large = occ >= least(n)
            small = (occ > 0) & ~large
            ls += large
            ss += small
            nl = self.total(np.broadcast_to(large, x.shape) if rows is not None else large)
            nls = nls + nl
            state.append((i, occ, n, large, small, nl))
        best, label = None, np.zeros(x.shape[1], np.int64)
        times = k - 1 if self.variant == "reference" else min(1, k - 1)
        for i, occ, n, large, small, nl in state:
            grown = occ + x
            gl = grown >= least(n + 1)
            gs = (grown > 0) & ~gl
            if k > 1:
                inter = (nls - nl) + self.total(gl) * times - self.total(gl | (ls > large))
                joins = self.w * self.total(gs | (ss > small)) + inter
            else:
                joins = self.w * self.total(gs) + 0
            if best is None:
                best = joins.astype(float)
                label[:] = i
            else:
                better = joins < best
                np.copyto(best, joins, where=better)
                label[better] = i
        if self.new:
            one = x > 0
            xl, xs = (one, np.zeros_like(one)) if self.minsup <= 1 else (np.zeros_like(one), one)
            alone = self.w * self.total(xs | (ss > 0)) + nls + self.total(xl) * (k if self.variant == "reference" else 1) - self.total(xl | (ls > 0))
            label[alone < best] = -1
        return label

    def stop(self, label: np.ndarray) -> tuple[int, bool]:
        """The first row after which the clusters are others, and whether its own place is that of label."""
        missed, own = np.zeros(len(label), bool), label < 0
        if self.old is not None:
            for k in self.live.tolist():
                old = self.old[: len(label)]
                if (gone := old == k).any():
                    missed |= gone & (int(self.c.n[k]) + _followed(k, label, old, 0)[2] <= 0)
        first = [int(z.argmax()) if z.any() else len(label) for z in (missed, own)]
        return min(first), first[1] < first[0]


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed rows as columns of 64-bit words."""
    out = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(out.view(np.uint64).T)


def _followed(k: int, guess: np.ndarray | None, old: np.ndarray | None, at: int):
    """How cluster k differs from the start when each of rows at.. is out: (whether the row joins it, sums of what came and went
    but for the row itself joining) or None if nothing does, None, and the difference of its rows."""
    joins = None if guess is None else guess == k
    gone = None if old is None else old == k
    if joins is None or not joins.any():
        joins = None
    if gone is None or not gone.any():
        gone = None
    if joins is None and gone is None:
        return None, None, 0
    none = np.zeros(len(guess if guess is not None else old), bool)
    joins, gone = none if joins is None else joins, none if gone is None else gone
    moves = joins.view(np.int8) - gone.view(np.int8)
    still = not moves.any()

    def change(what: np.ndarray):
        """Sums of what (values by row on the last axis) over rows up to each."""
        if still:
            return 0
        return np.cumsum(what * moves, axis=-1, dtype=np.int32 if what.ndim > 1 else np.int64)[..., at:]

    return (joins[at:], change), None, (0 if still else np.cumsum(moves, dtype=np.int64)[at:]) - joins[at:]


def _greedy(place, place_again, max_iteration: int, max_moved: int, ahead=None, clusters=_Clusters):
    """Kernel: place rows one by one, then move them while more than max_moved move. Rows stay packed until their turn.

    ahead, if given, settles many rows at once with the same labels: it guesses the labels of the next rows, places each as
    if the rows before it had gone as guessed, and so knows the rows up to the first wrong guess; guesses are mended until
    none is wrong or clusters change in a way it does not follow. There, and where looks settle few rows, rows go one by one.
    """

    def run(x: np.ndarray, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return on_packed(np.packbits(x.astype(bool), axis=1), x.shape[1], chunk)

    def settled(c: _Clusters, packed: np.ndarray, x: np.ndarray, old: np.ndarray | None, again: bool) -> np.ndarray:
        """Labels of the first rows (-1 last: a new cluster)."""
        ahead.start(c, x, packed, old, again)
        if not len(ahead.live):
            return np.zeros(0, np.int64)
        guess, at = (old if old is not None else ahead.places(None, 0)).astype(np.int64), 0
        for _ in range(12):
            found = ahead.places(guess, at)
            wrong = np.flatnonzero(found != guess[at:])
            guess = np.concatenate([guess[:at], found])
            known = at = at + int(wrong[0]) + 1 if len(wrong) else len(guess)
            end, own = ahead.stop(guess[:known])
            if end < known:
                return guess[: end + own]
            if known == len(guess):
                break
        return guess[:known]

    def one_pass(c: _Clusters, packed: np.ndarray, p: int, label: np.ndarray, again: bool) -> int:
        choose, moved, at, size, wait, pause = place_again if again else place, 0, 0, AHEAD, 0 if ahead else len(packed), 16
        while at < len(packed):
            block = packed[at : at + size]
            x = np.unpackbits(block, axis=1, count=p)
            if not wait and c.k:
                old = label[at : at + size].astype(np.int64) if again else None
                to = settled(c, block, x, old, again)
                if len(to):
                    if to[-1] < 0:
                        to[-1] = c.grow()
                    c.move(x[: len(to)], None if old is None else old[: len(to)], to)
                    moved += int((to != label[at : at + len(to)]).sum())
                    label[at : at + len(to)] = to
                at, size = at + len(to), min(AHEAD, max(128, 2 * len(to)))
                wait, pause = (1, 16) if len(to) >= WORTH else (pause, min(1024, 2 * pause))
                wait = 0 if len(to) == len(block) else wait
                continue
            for row in x[: max(wait, 1)].astype(np.int64):
                if again:
                    c.add(label[at], row, 1, -1)
                k = choose(c, row, 1)
                k = c.grow() if k < 0 else k
                c.add(k, row, 1)
                moved += k != label[at]
                label[at] = k
                at, wait = at + 1, max(wait - 1, 0)
        return moved

    def on_packed(x: np.ndarray, p: int, chunk: int = 0) -> tuple[np.ndarray, np.ndarray]:
        c, label = clusters(p), np.zeros(len(x), np.int32)
        some = x.any(1)
        if not some.all():  # rows without items are a cluster of their own
            label[:] = c.grow()
            c.add(0, np.zeros(p, np.int64), int((~some).sum()))
        rows, own = (x, label) if some.all() else (x[some], label[some])
        one_pass(c, rows, p, own, False)
        for _ in range(max_iteration + 1):
            if one_pass(c, rows, p, own, True) <= max_moved:
                break
        label[some] = own
        used = np.unique(merge.firsts(label)[np.flatnonzero(np.bincount(label))])  # first rows of the labels in use, in order
        old = label[used]
        number = np.zeros(c.k, np.int32)
        number[old] = np.arange(len(old))
        return number[label], np.column_stack([c.n[old], c.occ[old]])  # the representative is the feature itself

    run.on_packed = on_packed
    return run


def _merge_features(place):
    def join(reps: np.ndarray) -> np.ndarray:
        reps = reps.astype(np.int64)
        c, label = _Clusters(reps.shape[1] - 1), []
        for n, *occ in reps.tolist():
            occ = np.array(occ)
            k = place(c, occ, n) if occ.any() else -1
            k = c.grow() if k < 0 else k
            c.add(k, occ, n)
            label.append(k)
        return merge.dense(label)

    return join


def clope(obs: DataFrame, r: float = 2.0, chunks: int = 4, max_iteration: int = 5, max_moved: int = 0, most: int = 1000) -> DataFrame:
    """id, cluster: greedy profit in each chunk, then the chunks' features in order by the same rule."""
    place = lambda c, x, n: _clope_place(c, x, n, r, most)
    return merge.merge_in_levels(merge.local_clusters(obs, chunks, _greedy(place, place, max_iteration, max_moved, _ClopeAhead(r, most))), _merge_features(place))


def largeitem(obs: DataFrame, w: float = 1.0, minsupport: float = 0.5, chunks: int = 4, max_iteration: int = 5, max_moved: int = 0, variant: str = "reference") -> DataFrame:
    """id, cluster: greedy least cost in each chunk (moves go to existing clusters only), then features by the same rule."""
    place = lambda c, x, n: _largeitem_place(c, x, n, minsupport, w, variant)
    return merge.merge_in_levels(merge.local_clusters(obs, chunks, _largeitem_kernel(w, minsupport, max_iteration, max_moved, variant)), _merge_features(place))


def _largeitem_kernel(w: float, minsup: float, max_iteration: int, max_moved: int, variant: str):
    def place(c: _Clusters, x: np.ndarray, n: int, new: bool = True) -> int:
        return c.place(x, new) if isinstance(c, _LargeClusters) else _largeitem_place(c, x, n, minsup, w, variant, new)

    masked = lambda p: _LargeClusters(p, minsup, w, variant) if p <= 64 and 0 < minsup <= 1 else _Clusters(p)
    return _greedy(place, partial(place, new=False), max_iteration, max_moved, _LargeItemAhead(minsup, w, variant), masked)


def scale_assign(rows: pd.DataFrame, occ: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Labels of a batch's rows of one chunk, with a local copy of the features that follows them."""
    if not len(rows):
        return np.array([])
    # clusters are few: lists of numbers cost less a row than arrays
    by_item, s, squares = occ.T.tolist(), occ.sum(1).tolist(), (occ**2).sum(1).tolist()
    parts = np.array([q / t if t else 0.0 for q, t in zip(squares, s, strict=True)])
    part, whole, label = parts.tolist(), float(parts.sum()), []
    x = np.concatenate(rows["v"].to_numpy()).reshape(len(rows), -1)
    none = [0] * len(s)
    for at in range(0, len(x), 4096):
        items = np.nonzero(x[at : at + 4096])[1].tolist()
        start = 0
        for end in x[at : at + 4096].sum(1, dtype=np.int64).cumsum().tolist():
            size, own = end - start, [by_item[j] for j in items[start:end]]
            start = end
            hits = map(sum, zip(*own, strict=True)) if own else none
            # sums of squares after each cluster's supports of the row's items have grown by one
            grown = [q + 2 * h + size for q, h in zip(squares, hits, strict=True)]
            new = [float(g) / (t + size) if t + size else 0.0 for g, t in zip(grown, s, strict=True)]
            scores = [(whole - p + m) / total for p, m in zip(part, new, strict=True)]
            k = scores.index(max(scores))
            for supports_of in own:
                supports_of[k] += 1
            squares[k], s[k] = grown[k], s[k] + size
            if new[k] != part[k]:
                part[k] = parts[k] = new[k]
                whole = float(parts.sum())
            label.append(k)
    return np.array(label)


def _placing(occ: np.ndarray, n: np.ndarray, total: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        return pdf.assign(old=pdf["cluster"], cluster=scale_assign(pdf, occ, n, total) + 1)

    return run


def _feature_parts(k: int, p: int):
    """A task's rows (item -1) and supports of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, p + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                label = b.column("cluster").to_numpy(zero_copy_only=False) - 1
                total[:, 0] += np.bincount(label, minlength=k)
                for c in np.unique(label):
                    total[c, 1:] += x[label == c].sum(0, dtype=np.int64)
        c = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c + 1, p + 1), pa.int32()), pa.array(np.tile(np.arange(-1, p), len(c)), pa.int32()), pa.array(total[c].ravel(), pa.int64())], ["cluster", "j", "s"])

    return run


def scale(obs: DataFrame, k: int, sample: int = 100, chunks: int = 2, batches: int = 8, max_iteration: int = 2, max_moved: int = 0, seed: int = 1) -> DataFrame:
    """id, cluster. A sample is clustered around medoids, then shuffled rows come in `batches` of `chunks` chunks each.

    Chunks of a batch are placed against the same features; features are updated, as Spark aggregates, after each batch,
    and up to max_iteration + 1 passes that take a batch out and place it again follow. Sampled rows stay where they are.
    A batch is a share of the rows and a job reads its own batch only, so all jobs of a pass read the table once; batches
    and chunks are part of the result, and a chunk must fit a task, so let chunks grow with the data.
    """
    spark, obs = obs.sparkSession, checkpointed(obs.select("id", "v"))  # read for the count, the sample, the ranks and the rows
    total = obs.count()
    first = sample_rows(obs.select("id", "v"), sample, seed).collect()
    if not first:
        return spark.createDataFrame([], "id long, cluster int")
    x = np.array([r.v for r in first], np.int64)
    d = distances(x)
    label = merge.dense(d[:, pam(d, k)].argmin(1))
    occ = np.array([x[label == i].sum(0) for i in range(label.max() + 1)])
    n = np.bincount(label)
    seeds = spark.createDataFrame([(r.id, int(c) + 1) for r, c in zip(first, label, strict=True)], "id long, cluster int")
    rest = obs.select("id", "v").join(F.broadcast(seeds.select("id")), "id", "left_anti").withColumn("h", F.concat(seeded(seed), F.col("id").cast("string")))
    rows = chunked(rest, batches * chunks, key="h").withColumn("batch", F.expr(f"(chunk - 1) div {chunks}")).withColumn("cluster", F.lit(0)).withColumn("old", F.lit(0))
    rows = checkpointed(rows.select("id", "v", "h", "chunk", "cluster", "old", "batch"), "batch")  # a folder for each batch
    state = [rows.where(F.col("batch") == b).drop("batch") for b in range(batches)]

    def feature_sums(labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        o, m = np.zeros_like(occ), np.zeros_like(n)
        f = labels.select("cluster", "v").mapInArrow(_feature_parts(*occ.shape), "cluster int, j int, s long").groupBy("cluster", "j").agg(F.sum("s").alias("s"))
        for r in f.collect():  # clusters x items
            if r.j < 0:
                m[r.cluster - 1] = r.s
            else:
                o[r.cluster - 1, r.j] = r.s
        return o, m

    sums = [(np.zeros_like(occ), np.zeros_like(n))] * batches
    for step in range(max_iteration + 2):
        moved = 0
        for b in range(batches):
            occ, n = occ - sums[b][0], n - sums[b][1]
            state[b] = checkpointed(state[b].groupBy("chunk").applyInPandas(_placing(occ.copy(), n.copy(), total), state[b].schema))
            sums[b] = feature_sums(state[b])
            occ, n = occ + sums[b][0], n + sums[b][1]
            if step:
                moved += state[b].where("cluster != old").count()
        if step and moved <= max_moved:
            break
    for b in state:
        seeds = seeds.unionByName(b.select("id", "cluster"))
    return seeds
