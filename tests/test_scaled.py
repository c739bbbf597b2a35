"""Algorithms in rounds against their plain serial forms, and what reaches the driver."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from binmine.operators import leader


def obs_of(spark, x, first=0):
    return spark.createDataFrame([(first + i, [int(b) for b in r]) for i, r in enumerate(x)], "id long, v array<tinyint>")


# ---- canopies


def serial_canopies(rows, t2):
    """One row after the other: the first centre nearer than t2 takes a row, else it is the next centre."""
    centres, out = [], {}
    for i, v in sorted(rows.items(), key=lambda r: hashlib.md5(f"1-{r[0]}".encode()).hexdigest()):
        for k, c in enumerate(centres, 1):
            if sum(a != b for a, b in zip(v, c, strict=True)) < t2 * len(v):
                out[i] = k
                break
        else:
            centres.append(v)
            out[i] = len(centres)
    return out


@pytest.mark.parametrize("prefix", [4, 1000])
def test_canopies_in_rounds(spark, prefix):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2, (9, 20))
    x = centres[rng.integers(0, 9, 120)] ^ (rng.random((120, 20)) < 0.15)
    x[::3] = x[0]  # a third of the rows are copies
    got = {r.id: r.cluster for r in leader.canopy(obs_of(spark, x), 0.3, 0.25, prefix=prefix).collect()}
    assert got == serial_canopies({i: r.tolist() for i, r in enumerate(x.astype(int))}, 0.25) and len(set(got.values())) > 5


def test_canopies_of_odd_tables(spark):
    assert leader.canopy(obs_of(spark, []), 0.4, 0.4).count() == 0
    one = obs_of(spark, np.eye(3, dtype=int)).unionByName(spark.createDataFrame([(9, None)], "id long, v array<tinyint>"))
    got = {r.id: r.cluster for r in leader.canopy(one.unionByName(one.where("id = 1")), 0.4, 0.4, prefix=1).collect()}
    assert set(got) == {0, 1, 2} and sorted(got.values()) == [1, 2, 3]


# ---- representatives


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(b) for b in r]) for i, r in enumerate(x)], "idx long, v array<double>")


@pytest.mark.parametrize("n,k,p,block", [(300, 5, 64, 64), (90, 1, 20, 32), (40, 60, 16, 16), (200, 4, 6, 32)])
def test_medoids_by_blocks_are_those_of_one_array(spark, n, k, p, block):
    from binmine.functions import kernels
    from binmine.operators import representatives

    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2, (6, p))
    x = centres[rng.integers(0, 6, n)] ^ (rng.random((n, p)) < 0.2)
    k = min(k, 8) if block < n else k
    want = kernels.pam(np.rint(kernels.distances(x) * p), k).tolist()
    for size in (block, n):
        at, rows = representatives.pam_medoids(points_of(spark, x.astype(int)).repartition(3), k, size)
        assert at == want and (rows == x[want]).all()


def test_kmeans_by_aggregates(spark):
    from binmine.operators import representatives

    rng = np.random.default_rng(2)
    truth = rng.integers(0, 5, 400)
    x = rng.integers(0, 2, (5, 40))[truth] ^ (rng.random((400, 40)) < 0.08)
    points = points_of(spark, x.astype(int))
    got = np.array([r.cluster for r in representatives.kmeans(points.repartition(5), 5, 1).orderBy("idx").collect()])
    assert len({(t, c) for t, c in zip(truth.tolist(), got.tolist(), strict=True)}) == 5
    again = np.array([r.cluster for r in representatives.kmeans(points.repartition(2), 5, 1).orderBy("idx").collect()])
    assert (got == again).all(), "partitions change nothing"
    centres = np.array([x[got == c].mean(0) for c in range(1, 6)])
    assert (((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) + 1 == got).all(), "no row would move"
    few = points_of(spark, np.eye(2, dtype=int).repeat(10, axis=0))
    assert representatives.kmeans(few, 7, 1).select("cluster").distinct().count() == 2
    assert representatives.kmeans(few.limit(0), 3, 1).count() == 0 and representatives.medoid_clusters(few.limit(0), 3).count() == 0


def test_collected_representatives_do_not_grow_with_chunks(spark, monkeypatch):
    """Rows that reach the driver in a merge follow k, not the number of representatives."""
    from pyspark.sql import DataFrame as Frame

    from binmine.operators import merge

    rng = np.random.default_rng(3)
    seen, plain = [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: seen.append(out := plain(self)) or out)
    monkeypatch.setattr(Frame, "toPandas", lambda self: pytest.fail("toPandas"))
    most = []
    for n in (200, 800):
        local = spark.createDataFrame([(i, i % 20, i // 20, [float(b) for b in rng.integers(0, 2, 12)]) for i in range(n)], merge.LOCAL)
        for join in (merge.by_kmeans(3, 1), merge.by_pam(3)):
            seen.clear()
            assert merge.merge(local, join).count() == n
            most.append(max((len(o) for o in seen), default=0))
    assert max(most) <= 3 * 13, most


# ---- BUBBLE


def ham(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True)) / len(a)


class PlainTree:
    """A tree of dictionaries: leaves hold features, nodes hold nodes; every medoid is computed when it is asked for."""

    def __init__(self, threshold, most, budget):
        self.t, self.most, self.budget, self.root = threshold, most, budget, None

    def centre(self, e):
        if "n" in e:
            return e["c"]
        points = [self.centre(x) for x in e["has"]]
        sums = [round(sum(ham(a, b) for b in points), 9) for a in points]
        return points[sums.index(min(sums))]

    def nearest(self, node, x):
        d = [ham(self.centre(e), x) for e in node["has"]]
        return d.index(min(d)), min(d)

    def features(self, node=None):
        node = node or self.root
        return [f for e in node["has"] for f in ([e] if "n" in e else self.features(e))]

    def leaf_nodes(self, node):
        return [node] if "n" in node["has"][0] else [n for e in node["has"] for n in self.leaf_nodes(e)]

    def put(self, f):
        if self.root is None:
            self.root = {"has": [f]}
            return
        path = [self.root]
        while "n" not in path[-1]["has"][0]:
            path.append(path[-1]["has"][self.nearest(path[-1], f["c"])[0]])
        leaf = path[-1]
        i, d = self.nearest(leaf, f["c"])
        if d <= self.t:
            self.take(leaf["has"][i], f, d)
        elif len(leaf["has"]) < self.most:
            leaf["has"].append(f)
        else:
            self.split(path)
            self.put(f)

    def take(self, g, f, d):
        f["into"] = g
        if f["n"] > 1:
            pool = [(s + b["n"] * ham(o, b["c"]) + b["rs"], o) for a, b in ((g, f), (f, g)) for o, s in [(a["c"], a["rs"]), *zip(a["near"], a["sums"], strict=True)]]
            pool = sorted(pool, key=lambda z: round(z[0], 9))[:11]
            g["rad"] += f["rad"] + f["n"] * d
            g["n"] += f["n"]
            (g["rs"], g["c"]), g["near"], g["sums"] = pool[0], [o for _, o in pool[1:]], [s for s, _ in pool[1:]]
            return
        x = f["c"]
        own = d + sum(ham(x, o) for o in g["near"]) if g["n"] <= 10 else g["rad"] + g["n"] * d
        g["sums"] = [s + ham(x, o) for s, o in zip(g["sums"], g["near"], strict=True)]
        g["rs"], g["rad"], g["n"] = g["rs"] + d, g["rad"] + d, g["n"] + 1
        sums = [*g["sums"], own]
        best = sums.index(min(sums))
        late = (own, x)
        if sums[best] < g["rs"]:
            old = (g["rs"], g["c"])
            if best == len(g["near"]):
                (g["rs"], g["c"]), late = late, old
            else:
                g["rs"], g["c"] = g["sums"][best], g["near"][best]
                g["sums"][best], g["near"][best] = old
        if len(g["near"]) < 10:
            g["near"].append(late[1])
            g["sums"].append(late[0])
        else:
            worst = g["sums"].index(max(g["sums"]))
            if late[0] < g["sums"][worst]:
                g["sums"][worst], g["near"][worst] = late

    def split(self, path):
        for at in range(len(path) - 1, -1, -1):
            node = path[at]
            if len(node["has"]) < self.most:
                return
            points = [self.centre(e) for e in node["has"]]
            far = max((ham(a, b), -i) for i, a in enumerate(points) for b in points)
            order = sorted(range(len(points)), key=lambda j: ham(points[-far[1]], points[j]))
            close = set(order[: self.most // 2])
            other = {"has": [e for j, e in enumerate(node["has"]) if j in close]}
            node["has"] = [e for j, e in enumerate(node["has"]) if j not in close]
            if at:
                path[at - 1]["has"].append(other)
                if len(path[at - 1]["has"]) <= self.most:
                    return
            else:
                self.root = {"has": [node, other]}

    def add(self, f):
        self.put(f)
        while len(self.features()) > self.budget:
            gaps = [min(ham(a["c"], b["c"]) for i, a in enumerate(n["has"]) for b in n["has"][i + 1 :]) for n in self.leaf_nodes(self.root) if len(n["has"]) > 1]
            old = self.features()
            self.t, self.root = max(self.t + 1 / len(old[0]["c"]), sum(gaps) / len(gaps) if gaps else 0.0), None
            for g in old:
                self.put(g)


def row(x):
    return {"c": tuple(x), "n": 1, "rs": 0.0, "rad": 0.0, "near": [], "sums": [], "into": None}


def last(f):
    while f["into"] is not None:
        f = f["into"]
    return f


def plain_leaves(x, t, most, chunks, budget, fan, centres=False):
    """{row: leaf}: trees of contiguous chunks, joined fan at a time; their number, the threshold, and the clustroids if asked for."""
    small, extra = divmod(len(x), chunks)
    cuts = [0]
    for c in range(chunks):
        cuts.append(cuts[-1] + small + (c < extra))
    trees, mine = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        tree = PlainTree(t, most, budget)
        for r in x[a:b]:
            mine.append(row(r))
            tree.add(mine[-1])
        trees.append(tree)
    while len(trees) > 1:
        now = []
        for g in range(0, len(trees), fan):
            tree = PlainTree(max(u.t for u in trees[g : g + fan]), most, budget)
            for u in trees[g : g + fan]:
                for f in u.features():
                    tree.add(f)
            now.append(tree)
        trees = now
    number = {id(f): k for k, f in enumerate(trees[0].features(), 1)}
    out = {i: number[id(last(f))] for i, f in enumerate(mine)}, len(number), trees[0].t
    return (*out, {number[id(f)]: f["c"] for f in trees[0].features()}) if centres else out


@pytest.mark.parametrize("chunks,budget,fan", [(1, 1000, 8), (1, 6, 8), (4, 1000, 8), (5, 9, 2)])
def test_joined_trees_against_plain_python(spark, chunks, budget, fan):
    from binmine.operators import bubble

    rng = np.random.default_rng(7)
    x = (rng.integers(0, 2, (12, 16))[rng.integers(0, 12, 160)] ^ (rng.random((160, 16)) < 0.12)).astype(int)
    rows, leaves = bubble.joined_trees(obs_of(spark, x), 0.2, 4, chunks, budget, fan)
    want, n, t = plain_leaves(x.tolist(), 0.2, 4, chunks, budget, fan)
    assert {r.id: r.leaf for r in rows.collect()} == want
    got = {r.leaf: r.n for r in leaves.collect()}
    assert len(got) == n <= budget and (t > 0.2) == (budget < 20)
    assert got == {k: sum(v == k for v in want.values()) for k in got}


# ---- CLOPE and Large Item


class PlainClusters:
    """Clusters as lists of rows; profits and costs are computed anew each time."""

    def __init__(self, rule, r=2.0, minsup=0.5, w=1.0):
        self.rule, self.r, self.minsup, self.w, self.has = rule, r, minsup, w, []

    def profit(self, rows):
        items = [j for x in rows for j in x]
        return len(items) * len(rows) / len(set(items)) ** self.r if items else 0.0

    def states(self, rows):
        count = {}
        for x in rows:
            for j in x:
                count[j] = count.get(j, 0) + 1
        large = {j for j, c in count.items() if c >= len(rows) * self.minsup}
        return large, set(count) - large

    def cost(self, clusters, k):
        """The least-cost rule's total once cluster k has been grown; its large items count once for each other cluster."""
        state = [self.states(c) for c in clusters]
        small = set().union(*(s for _, s in state))
        large = set().union(*(l for l, _ in state))
        others = len(clusters) - 1
        inter = sum(len(l) for i, (l, _) in enumerate(state) if i != k) + len(state[k][0]) * others - len(large) if others else 0
        return self.w * len(small) + inter

    def place(self, rows, new=True):
        live = [i for i, c in enumerate(self.has) if c and any(c)]
        if not live:
            return None
        if self.rule == "clope":
            gain = [self.profit(self.has[i] + rows) - self.profit(self.has[i]) for i in live]
            best = gain.index(max(gain))
            return None if self.profit(rows) > gain[best] else live[best]
        costs = [self.cost([self.has[j] + rows if j == i else self.has[j] for j in live], k) for k, i in enumerate(live)]
        best = costs.index(min(costs))
        return None if new and self.cost([self.has[j] for j in live] + [rows], len(live)) < costs[best] else live[best]

    def put(self, rows, new=True):
        k = self.place(rows, new)
        if k is None:
            self.has.append([])
            k = len(self.has) - 1
        self.has[k] = self.has[k] + rows
        return k


def plain_chunk(x, rule, passes, **more):
    c, label, empty = PlainClusters(rule, **more), [], None
    for r in x:
        if not r:
            if empty is None:
                c.has.append([])
                empty = len(c.has) - 1
            c.has[empty] = c.has[empty] + [r]
            label.append(empty)
        else:
            label.append(c.put([r]))
    for _ in range(passes):
        moved = 0
        for i, r in enumerate(x):
            if r:
                rest = list(c.has[label[i]])
                rest.remove(r)
                c.has[label[i]] = rest
                k = c.put([r], new=rule == "clope")
                moved += k != label[i]
                label[i] = k
        if not moved:
            break
    groups = {}
    for i, k in enumerate(label):
        groups.setdefault(k, []).append(i)
    return list(groups.values())


def plain_baskets(x, rule, chunks, fan, passes, **more):
    """Chunks of contiguous rows, then their clusters in order, `fan` chunks at a time."""
    small, extra = divmod(len(x), chunks)
    at, now = 0, []
    for c in range(chunks):
        n = small + (c < extra)
        now.append([[at + i for i in g] for g in plain_chunk(x[at : at + n], rule, passes, **more)])
        at += n
    while True:
        nxt = []
        for g in range(0, len(now), fan):
            c, members = PlainClusters(rule, **more), {}
            for group in (q for chunk in now[g : g + fan] for q in chunk):
                rows = [x[i] for i in group]
                if any(rows):
                    k = c.put(rows)
                else:
                    c.has.append(rows)
                    k = len(c.has) - 1
                members.setdefault(k, []).extend(group)
            nxt.append(list(members.values()))
        now = nxt
        if len(now) == 1:
            return sorted(sorted(g) for g in now[0])


@pytest.mark.parametrize("rule", ["clope", "largeitem"])
@pytest.mark.parametrize("chunks,fan", [(1, 8), (3, 8), (5, 2)])
def test_baskets_against_plain_python(spark, monkeypatch, rule, chunks, fan):
    from binmine.operators import itemset, merge

    rng = np.random.default_rng(11)
    x = (rng.random((4, 14)) < 0.35)[rng.integers(0, 4, 48)] ^ (rng.random((48, 14)) < 0.08)
    x[7] = x[20] = False
    full = merge.merge_in_levels
    monkeypatch.setattr(merge, "merge_in_levels", lambda local, join: full(local, join, fan))
    run = (lambda o: itemset.clope(o, 2.0, chunks)) if rule == "clope" else (lambda o: itemset.largeitem(o, 1.0, 0.5, chunks))
    got = {}
    for r in run(obs_of(spark, x.astype(int))).collect():
        got.setdefault(r.cluster, []).append(r.id)
    rows = [tuple(np.flatnonzero(r).tolist()) for r in x]
    assert sorted(sorted(g) for g in got.values()) == plain_baskets(rows, rule, chunks, fan, 6)


# ---- PROXIMUS


@pytest.mark.parametrize("radius,small", [(0.0, 20), (2.0, 20), (5.0, 0), (2.0, 4096)])
def test_whole_table_patterns_are_those_of_one_chunk(spark, radius, small):
    from binmine.operators import factor

    rng = np.random.default_rng(13)
    x = ((rng.random((5, 16)) < 0.4)[rng.integers(0, 5, 70)] ^ (rng.random((70, 16)) < 0.06)).astype(int)
    x[:3] = 0
    labels, patterns = factor.proximus_tree(obs_of(spark, x).repartition(3), radius, small)
    want, reps = factor.proximus_kernel(radius)(x)
    assert {r.id: r.cluster - 1 for r in labels.collect()} == dict(enumerate(want.tolist()))
    assert {r.cluster - 1: list(r.v) for r in patterns.collect()} == {i: y.tolist() for i, y in enumerate(reps)}


def test_planted_patterns_without_chunks(spark):
    from binmine.operators import factor

    planted = np.kron(np.eye(4, dtype=int), np.ones(6, int))
    x = np.repeat(planted, 25, axis=0)
    flip = np.random.default_rng(1).integers(0, 24, 100)
    x[np.arange(100), flip] ^= np.arange(100) % 3 == 0
    labels, patterns = factor.proximus_tree(obs_of(spark, x), 1, small=30)
    assert sorted(map(tuple, planted.tolist())) == sorted(tuple(r.v) for r in patterns.collect())
    assert [r.cluster for r in labels.orderBy("id").collect()] == [1 + i // 25 for i in range(100)]
    got = factor.proximus_whole(obs_of(spark, x), 1, 4)
    assert got.count() == 100 and got.select("cluster").distinct().count() == 4
    assert factor.proximus_tree(obs_of(spark, []), 1)[0].count() == 0


def plain_patterns(x, radius):
    """The recursion on arrays of integers, a step as it is defined."""
    from binmine.operators import merge

    todo, label, reps = [np.arange(len(x))], np.zeros(len(x), int), []
    while todo:
        at = todo.pop()
        a = x[at]
        rows, y = np.zeros(len(a), bool), a[a.sum(1).argmax()]
        while True:
            new = 2 * (a @ y) >= y.sum()
            if not new.any():
                new[(a @ y).argmax()] = True
            z = (2 * a[new].sum(0) >= new.sum()).astype(int)
            if (new == rows).all() and (z == y).all():
                break
            rows, y = new, z
        d = (a != y).sum(1)
        if (d <= radius).all() or len(at) == 1:
            label[at] = len(reps)
            reps.append(y)
            continue
        if rows.all():
            rows = d <= radius
            if not rows.any():
                rows[d.argmin()] = True
        todo += [at[rows], at[~rows]]
    used = merge.dense(label)
    return used, np.array([reps[label[np.flatnonzero(used == i)[0]]] for i in range(used.max() + 1)])


@pytest.mark.parametrize("p", [3, 25, 64, 130])
def test_patterns_from_words_are_those_of_integers(p):
    from binmine.operators import factor

    rng = np.random.default_rng(p)
    for share in (0.05, 0.5, 0.9):
        x = (rng.random((700, p)) < share).astype(np.int64)
        x[600:] = x[rng.integers(0, 600, 100)]
        for radius in (0, 1.5, p // 3):
            got, want = factor.proximus_kernel(radius)(x), plain_patterns(x, radius)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_patterns_from_words_take_a_fraction_of_the_time():
    import time

    from binmine.operators import factor

    x = (np.random.default_rng(2).random((6000, 64)) < 0.5).astype(np.int64)
    took = []
    for f in (factor.proximus_kernel(24), lambda x: plain_patterns(x, 24)):
        began = time.process_time()
        f(x)
        took.append(time.process_time() - began)
    assert took[0] < took[1] / 2


def test_nodes_that_fit_a_task_need_no_job_a_level(spark):
    from binmine.operators import factor

    x = (np.random.default_rng(3).random((5000, 16)) < 0.5).astype(int)
    sc = spark.sparkContext
    sc.setJobGroup("levels", "levels")
    try:
        labels, _ = factor.proximus_tree(obs_of(spark, x), 4)
        jobs = len(sc.statusTracker().getJobIdsForGroup("levels"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30
    want, _ = factor.proximus_kernel(4)(x)
    assert {r.id: r.cluster - 1 for r in labels.collect()} == dict(enumerate(want.tolist()))


# ---- counts of pairs


@pytest.mark.parametrize("part", [7, 16_384])
def test_pairs_are_counted_without_rows_for_them(spark, part):
    from binmine.operators import metrics, sketch

    rng = np.random.default_rng(21)
    sig, ids = rng.integers(-1, 3, (300, 5)), rng.permutation(900)[:300] - 100
    orig = [None if o == 6 else int(o) for o in rng.integers(0, 7, 300)]  # 1..4 are classes
    sigs = spark.createDataFrame([(int(i), o, x) for i, o, x in zip(ids, orig, sig.tolist(), strict=True)], "id long, orig int, sig array<long>").repartition(3)
    got = sketch.pair_counts(sigs, 5, 2, 4, 4, part)
    tp = fp = 0
    for i in range(300):
        for j in range(300):
            if ids[i] < ids[j] and orig[i] in (1, 2, 3, 4) and ((sig[i, :3] == sig[j, :3]).all() or (sig[i, 3:] == sig[j, 3:]).all()):
                tp, fp = tp + (orig[i] == orig[j]), fp + (orig[i] != orig[j])
    assert tuple(got.first()) == (tp, fp) and tp and fp
    assert metrics.pair_scores(got, 300, 4).collect() == metrics.pair_metrics(sketch.signature_pairs(sigs, 5, 2), sigs, 300, 4).collect()
    assert tuple(sketch.pair_counts(sigs.limit(0), 5, 2, 4, 4).first()) == (0, 0)


# ---- chunks in batches


def test_chunks_reach_their_kernel_packed_and_in_order(spark):
    from binmine.operators import itemset, merge

    x = (np.random.default_rng(8).random((60, 11)) < 0.3).astype(np.int64)
    x[[3, 50]] = 0
    place = lambda c, row, n: itemset._clope_place(c, row, n, 2.0, 99)
    kernel, seen = itemset._greedy(place, place, 3, 0), merge.firsts(np.array([1, 0, 1, 2]))
    assert seen.tolist() == [1, 0, 3]
    packed = kernel.on_packed(np.packbits(x[:30].astype(bool), axis=1), 11)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.id: r for r in merge.local_clusters(obs_of(spark, x).repartition(3), 2, kernel).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for chunk, part in ((1, range(30)), (2, range(30, 60))):
        labels, reps = kernel(x[list(part)])
        assert [got[i].local for i in part] == labels.tolist() and {got[i].chunk for i in part} == {chunk}
        assert [got[part[k]].rep for k in merge.firsts(labels)] == reps.tolist()
        assert sum(got[i].rep is not None for i in part) == len(reps)
    assert (packed[0] == kernel(x[:30])[0]).all() and (packed[1] == kernel(x[:30])[1]).all()


def test_scale_places_rows_by_kept_sums_in_a_fraction_of_the_time():
    import time

    import pandas as pd

    from binmine.operators import itemset

    rng = np.random.default_rng(9)
    x, occ = (rng.random((4000, 25)) < 0.15).astype(np.int8), rng.integers(0, 5, (10, 25))
    x[7], occ[4:6] = 0, 0
    took = [time.process_time()]
    got = itemset.scale_assign(pd.DataFrame({"v": list(x)}), occ, np.ones(10, int), 4010)
    took.append(time.process_time())
    now, want = occ.copy(), []
    for row in x.astype(np.int64):
        s, part = now.sum(1), np.zeros(10)
        part[s > 0] = (now[s > 0] ** 2).sum(1) / s[s > 0]
        new = np.divide(((now + row) ** 2).sum(1), s + row.sum(), out=np.zeros(10), where=s + row.sum() > 0)
        k = int(((part.sum() - part + new) / 4010).argmax())
        now[k] += row
        want.append(k)
    took.append(time.process_time())
    assert got.tolist() == want and took[1] - took[0] < 0.75 * (took[2] - took[1])


def basket_rows(n, seed=5):
    x = (np.random.default_rng(seed).random((n, 25)) < 0.15).astype(np.int64)
    x[::97] = 0
    return x


def timed(kernel, x):
    import time

    took = time.process_time()
    got = kernel(x)
    return got, time.process_time() - took


def same(got, want):
    return (got[0] == want[0]).all() and got[1].shape == want[1].shape and (got[1] == want[1]).all()


@pytest.mark.parametrize("minsup,w,variant", [(0.15, 1.0, "reference"), (0.3, 0.5, "paper"), (0.05, 3.0, "reference")])
@pytest.mark.parametrize("few,many,ahead", [(8, 200, 8192), (40, 1, 64), (0, 1, 64)])
def test_largeitem_by_masks_and_ahead_is_that_of_single_rows(monkeypatch, minsup, w, variant, few, many, ahead):
    from binmine.operators import itemset

    for name, value in (("FEW", few), ("MANY", many), ("AHEAD", ahead), ("WORTH", 4)):
        monkeypatch.setattr(itemset, name, value)
    for x in (basket_rows(500), np.hstack([basket_rows(250, 6)[:, :20], basket_rows(250, 7)[:, :13]])):
        place = lambda c, row, n: itemset._largeitem_place(c, row, n, minsup, w, variant)
        again = lambda c, row, n: itemset._largeitem_place(c, row, n, minsup, w, variant, new=False)
        assert same(itemset._largeitem_kernel(w, minsup, 3, 0, variant)(x), itemset._greedy(place, again, 3, 0)(x))


def test_largeitem_takes_a_fraction_of_the_time_of_single_rows():
    from binmine.operators import itemset

    place = lambda c, row, n: itemset._largeitem_place(c, row, n, 0.15, 1.0, "reference")
    again = lambda c, row, n: itemset._largeitem_place(c, row, n, 0.15, 1.0, "reference", new=False)
    (got, fast), (want, slow) = (timed(k, basket_rows(2500)) for k in (itemset._largeitem_kernel(1.0, 0.15, 2, 0, "reference"), itemset._greedy(place, again, 2, 0)))
    assert same(got, want) and fast < 0.5 * slow


@pytest.mark.parametrize("r,most,ahead", [(2.0, 1000, 8192), (2.6, 5, 64), (1.3, 1000, 256)])
def test_clope_ahead_is_that_of_single_rows(monkeypatch, r, most, ahead):
    from binmine.operators import itemset

    monkeypatch.setattr(itemset, "AHEAD", ahead)
    monkeypatch.setattr(itemset, "WORTH", 4)
    place = lambda c, row, n: itemset._clope_place(c, row, n, r, most)
    for x in (basket_rows(1500), np.hstack([basket_rows(500, k) for k in (6, 7, 8)])):
        assert same(itemset._greedy(place, place, 3, 0, itemset._ClopeAhead(r, most))(x), itemset._greedy(place, place, 3, 0)(x))


def test_clope_takes_a_fraction_of_the_time_of_single_rows():
    from binmine.operators import itemset

    place = lambda c, row, n: itemset._clope_place(c, row, n, 2.0, 1000)
    x = np.tile(basket_rows(4000), (8, 1))
    (got, fast), (want, slow) = (timed(k, x) for k in (itemset._greedy(place, place, 0, 0, itemset._ClopeAhead(2.0, 1000)), itemset._greedy(place, place, 0, 0)))
    assert same(got, want) and fast < 0.5 * slow


# ---- neighbours


@pytest.mark.parametrize("p,width,k", [(24, 8, 3), (20, 6, 5), (10, 4, 60)])
def test_neighbours_by_segments(spark, p, width, k):
    from binmine.operators import neighbours

    rng = np.random.default_rng(p)
    x = (rng.integers(0, 2, (5, p))[rng.integers(0, 5, 70)] ^ (rng.random((70, p)) < 0.15)).astype(int)
    x[::3] = x[0]  # copies: many ties
    obs = obs_of(spark, x)
    got = {(r.query, r["rank"]): (r.id, r.d) for r in neighbours.hamming_neighbours(obs, obs.where("id % 7 = 0"), k, width).collect()}
    want = {}
    for q in range(0, 70, 7):
        near = sorted((int((x[q] != x[i]).sum()), i) for i in range(70) if i != q)
        want |= {(q, r): (i, d) for r, (d, i) in enumerate(near[:k], 1)}
    assert got == want
    assert neighbours.hamming_neighbours(obs.limit(0), obs, 3).count() == 0


# ---- merged forms


def chunk_cuts(n, chunks):
    small, extra = divmod(n, chunks)
    out = [0]
    for c in range(chunks):
        out.append(out[-1] + small + (c < extra))
    return list(zip(out, out[1:], strict=False))


@pytest.mark.parametrize("model", ["binary", "block"])
def test_merged_models_against_one_array(spark, model):
    """Each chunk's model, medoids of its clusters, then one partitioning around medoids of all of these."""
    from binmine.functions import kernels
    from binmine.operators import factor

    rng = np.random.default_rng(17)
    x = (rng.integers(0, 2, (3, 16))[rng.integers(0, 3, 90)] ^ (rng.random((90, 16)) < 0.1)).astype(int)
    run, kernel = (lambda o: factor.binary_model_par(o, 3, 4), factor.binary_kernel(3, 1)) if model == "binary" else (lambda o: factor.block_model_par(o, 3, 3, 4), factor.block_kernel(3, 3, 1))
    reps, of = [], {}
    for c, (a, b) in enumerate(chunk_cuts(90, 4), 1):
        label, own = kernel(x[a:b], c)
        for i, k in enumerate(label.tolist()):
            of[a + i] = len(reps) + k
            sums = [int((x[a:b][label == k][:, None] != x[a:b][label == k][None]).sum(2)[r].sum()) for r in range(int((label == k).sum()))]
            assert (own[k] == x[a:b][label == k][sums.index(min(sums))]).all(), "a cluster's medoid"
        reps += [r.tolist() for r in own]
    d = (np.array(reps)[:, None] != np.array(reps)[None]).sum(2).astype(float)
    near = d[:, kernels.pam(d, 3)].argmin(1)
    assert {r.id: r.cluster for r in run(obs_of(spark, x)).collect()} == {i: int(near[k]) + 1 for i, k in of.items()}


@pytest.mark.parametrize("name", ["canopy_par", "mbt_par", "proximus"])
def test_merged_by_kmeans_follow_their_representatives(spark, name):
    from binmine.operators import factor, leader, representatives, trees

    rng = np.random.default_rng(19)
    x = (rng.integers(0, 2, (4, 18))[rng.integers(0, 4, 100)] ^ (rng.random((100, 18)) < 0.1)).astype(int)
    run, kernel = {
        "canopy_par": (lambda o: leader.canopy_par(o, 0.3, 0.25, 4, 3), leader.canopy_kernel(0.3, 0.25, 1)),
        "mbt_par": (lambda o: trees.mbt_par(o, 8, 4, 3), trees.mbt_kernel(8, 4, 1)),
        "proximus": (lambda o: factor.proximus(o, 3.0, 4, 3), factor.proximus_kernel(3.0)),
    }[name]
    reps, of = [], {}
    for c, (a, b) in enumerate(chunk_cuts(100, 3), 1):
        label, own = kernel(x[a:b], c)
        of |= {a + i: len(reps) + k for i, k in enumerate(label.tolist())}
        reps += [r.tolist() for r in own]
    cluster = {r.idx: r.cluster for r in representatives.kmeans(points_of(spark, reps), 4, 1).collect()}
    got = {r.id: r.cluster for r in run(obs_of(spark, x)).collect()}
    assert got == {i: cluster[k] for i, k in of.items()} and len(set(got.values())) > 1
