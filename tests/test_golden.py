"""Hand-computed cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from binmine.functions import bits, kernels
from binmine.operators import bubble, factor, graph, itemset, kmedoids, leader, merge, metrics, simulate, sketch, trees
from binmine.sources import tables


def obs_of(spark, rows):
    return spark.createDataFrame([(i + 1, list(map(int, r))) for i, r in enumerate(rows)], "id long, v array<tinyint>")


def labelled(spark, orig, result):
    return spark.createDataFrame(list(zip(range(1, len(orig) + 1), orig, result, strict=True)), "id long, orig int, result int")


SF = "/root/testdata/sf0.001"
GOLD = ([1, 1, 1, 2, 2], [1, 1, 2, 2, 3])


def test_pair_metrics(spark):
    r = metrics.rec_pre_f1(labelled(spark, *GOLD)).first()
    assert (round(r.recall, 6), r.precision, round(r.f1, 6)) == (round(1 / 3, 6), 0.5, 0.4)
    exact = metrics.rec_pre_f1(labelled(spark, *GOLD), exact=True).first()
    assert exact.recall == 0.25  # 1 of 4 pairs


def test_rand_entropy_purity(spark):
    df = labelled(spark, *GOLD)
    assert metrics.rand_index(df).first().rand == pytest.approx(0.6)
    assert metrics.entropy(df).first().entropy == pytest.approx(0.4)
    assert metrics.purity_blocks(df, 2).first().purity == pytest.approx(0.8)
    same = labelled(spark, [1, 1, 2, 2], [9, 9, 4, 4])
    assert metrics.rand_index(same).first().rand == 1


def test_metrics_do_not_depend_on_label_names(spark):
    rng = np.random.default_rng(3)
    o, r = rng.integers(1, 5, 60).tolist(), rng.integers(1, 6, 60).tolist()
    a, b = labelled(spark, o, r), labelled(spark, o, [10 - x for x in r])
    for f in (metrics.rec_pre_f1, metrics.rand_index, metrics.entropy):
        assert f(a).first() == pytest.approx(f(b).first())


def test_empty_metrics(spark):
    none = labelled(spark, [], [])
    assert metrics.rec_pre_f1(none).first().recall is None
    assert metrics.rand_index(none).first().rand is None


def test_lsh_pair_metrics(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "id1 long, id2 long")
    r = metrics.pair_metrics(pairs, labelled(spark, [1, 1, 2, 2], [0] * 4), 4, 2).first()
    assert (r.recall, r.precision, r.f1, round(r.rand, 6)) == (0.5, 0.5, 0.5, round(2 / 3, 6))


def test_signatures(spark):
    items = spark.createDataFrame([(1, [1, 5, 9]), (2, [2, 3]), (3, [4]), (4, [])], "id long, items array<int>")
    assert sketch.modulus(10) == 13
    got = {r.id: r.sig for r in sketch.signatures(items, [(7, 3), (5, 1)], 10).collect()}
    assert got == {1: [1, 0], 2: [0, 0], 3: [5, 8], 4: [-1, -1]}
    assert sketch.coefficients(5, 64) == sketch.coefficients(9, 64)[:5]
    assert sketch.band_sizes(10, 4) == [3, 3, 2, 2] and sketch.band_sizes(17, 4) == [5, 4, 4, 4]


def test_pairs_of_buckets(spark):
    b = spark.createDataFrame([(1, [1], 1), (1, [1], 2), (1, [1], 3), (2, [7], 1), (2, [7], 2), (2, [8], 3)], "band int, h array<int>, id long")
    assert {tuple(r) for r in sketch.candidate_pairs(b).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_hamming_and_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (40, 70))
    obs = obs_of(spark, x)
    reps = obs.where("id <= 5").select(F.col("id").cast("int").alias("cluster"), "v")
    got = {r.id: (r.cluster, r.d) for r in bits.nearest(obs, reps).collect()}
    d = (x[:, None] != x[None, :5]).sum(2)
    assert got == {i + 1: (int(d[i].argmin()) + 1, int(d[i].min())) for i in range(40)}


def test_chunks_are_balanced_and_ordered(spark):
    got = bits.chunked(spark.range(1, 18), 4).orderBy("id").collect()
    assert [r.chunk for r in got] == [1] * 5 + [2] * 4 + [3] * 4 + [4] * 4
    assert bits.chunked(spark.range(0, 2), 5).count() == 2


def test_stratified_uses_half_even_bounds(spark):
    df = labelled(spark, [1] * 9 + [2] * 9 + [3] * 9, [0] * 27)
    n = {r.orig: r["count"] for r in bits.stratified(df, 10, 3, 1).groupBy("orig").count().collect()}
    assert n == {1: 3, 2: 4, 3: 3}


def test_canopy_is_strict_and_total(spark):
    x = np.array([[0, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1], [0, 0, 0, 1]])
    label, _ = leader.canopy_kernel(0.5, 0.5)(x)
    assert label.tolist() == [0, 1, 2, 0]  # at exactly half, row 2 stays out
    with pytest.raises(ValueError):
        leader.canopy(obs_of(spark, x), 0.3, 0.4)


def test_sorted_neighbourhood_edges_match_brute_force(spark):
    x = np.random.default_rng(5).integers(0, 2, (60, 16))
    got = {(r.a, r.b, r.d) for r in leader.neighbour_edges(obs_of(spark, x), 5, 0.4, 1, "popcount").collect()}
    order = sorted(range(60), key=lambda i: (x[i].sum(), i))
    want = set()
    for k, i in enumerate(order):
        before = order[max(0, k - 5) : k]
        if before:
            d = [(int((x[i] != x[j]).sum()), n) for n, j in enumerate(before)]
            m, n = min(d)
            if m < 0.4 * 16:
                want.add((i + 1, before[n] + 1, m))
    assert got == want


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in graph.connected_components(e, spark.range(1, 10)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7, 8: 8, 9: 8}


def test_clope_gain(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (9, 1), (9, 2), (9, 3)], "id long, j int")
    lab = spark.createDataFrame([(1, 1)], "id long, cluster int")
    gain = itemset.clope_delta_add(b, lab, b.where("id = 9"), 2.0).first().delta
    assert gain == pytest.approx(10 / 9 - 1 / 2)
    label, _ = itemset._greedy(lambda c, x, n: itemset._clope_place(c, x, n, 2.0, 99), lambda c, x, n: itemset._clope_place(c, x, n, 2.0, 99), 3, 0)(np.array([[1, 1, 0], [1, 1, 1], [0, 0, 0]]))
    assert label.tolist() == [0, 0, 1]  # the row without items stands alone


def test_largeitem_costs(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (9, 1), (9, 3)], "id long, j int")
    lab = spark.createDataFrame([(1, 1)], "id long, cluster int")
    added = spark.createDataFrame([(9, 1, 1, 1), (9, 3, 1, 1)], "id long, j int, occ long, n long")
    got = {r.target: r.cost for r in itemset.largeitem_costs(b, lab, added, 0.6, 1.0).collect()}
    assert got == {1: 2.0, 0: 1.0}
    joins, alone = itemset._large_costs(np.array([[1, 1, 0]]), np.array([1]), np.array([1, 0, 1]), 1, 0.6, 1.0, "reference")
    assert (joins.tolist(), alone) == ([2.0], 1.0)


def test_largeitem_kernel_agrees_with_the_frame(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (40, 6))
    x[x.sum(1) == 0, 0] = 1
    lab = rng.integers(1, 4, 40)
    long = tables.to_long(obs_of(spark, x))
    labels = spark.createDataFrame([(i + 1, int(c)) for i, c in enumerate(lab)], "id long, cluster int")
    row = np.array([1, 0, 1, 1, 0, 0])
    added = spark.createDataFrame([(99, int(j) + 1, 1, 1) for j in np.flatnonzero(row)], "id long, j int, occ long, n long")
    for variant in ("reference", "paper"):
        got = {r.target: r.cost for r in itemset.largeitem_costs(long, labels, added, 0.5, 1.0, variant).collect()}
        occ, n = np.array([x[lab == c].sum(0) for c in (1, 2, 3)]), np.array([(lab == c).sum() for c in (1, 2, 3)])
        joins, alone = itemset._large_costs(occ, n, row, 1, 0.5, 1.0, variant)
        assert [got[1], got[2], got[3], got[0]] == pytest.approx([*joins, alone])
        rows = {r.target: r.cost for r in itemset.largeitem_row_costs(long, labels, added.select("id", "j"), 0.5, 1.0, variant).collect()}
        assert rows == pytest.approx(got)


def test_scale_density(spark):
    b = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3)], "id long, j int")
    lab = spark.createDataFrame([(1, 1), (2, 1)], "id long, cluster int")
    assert itemset.scale_wcd(b, lab).first().wcd == 0.75


def test_mona_gain(spark):
    got = {r.j: r.gain for r in trees.information_gain(obs_of(spark, [[0, 0], [0, 1], [1, 0], [1, 1]])).collect()}
    assert got[1] == pytest.approx(4 * math.log(2)) and got[2] == pytest.approx(4 * math.log(2))


def test_mbt_splits_the_most_balanced_bit(spark):
    obs = obs_of(spark, [[0, 1, 0], [0, 1, 1], [0, 0, 1], [1, 0, 1]])
    assert trees.balanced_variables(obs).first().j == 2
    parts = trees.mbt_partitions(obs, 1)
    assert parts.count() == 4 and parts.select("part").distinct().count() == 4


def test_mbt_splits_below_32_levels(spark):
    parts = trees.mbt_partitions(obs_of(spark, np.eye(36, dtype=int)), 1)  # each level splits one row off
    assert parts.select("part").distinct().count() == 36 and parts.count() == 36
    assert trees.mbt_partitions(parts.select("id", "v").limit(0), 1).count() == 0


def test_tuners_are_registered_over_their_full_grids(spark, monkeypatch):
    from binmine.operators import tune
    from binmine.plans import registry

    seen = {}
    for name in ("minhash", "lsh", "canopy", "sorted", "proximus", "bubble"):

        def record(obs, *args, grid, name=name, **more):
            seen[name] = grid, args[-1], more
            return grid[0], [0.0] * len(grid)

        monkeypatch.setattr(tune, f"tune_{name}", record)
        registry.QUERIES[f"tune_{name}"](spark, SF)
    assert seen == {n: (getattr(tune, f"{n.upper()}_GRID"), 420, {}) for n in seen} and len(seen) == 6
    many = labelled(spark, [1, 2] * 60, [0] * 120)
    assert (tune.feasible(many, 2, 100), tune.feasible(many, 2, 200)) == (100, 120)


def uncapped_blocks(x, k, c, first=lambda n, k: np.searchsorted([n * i // k for i in range(1, k + 1)], np.arange(1, n + 1))):
    a, b, last, rounds = first(len(x), k), first(x.shape[1], c), None, 0
    m = lambda: np.array([[x[np.ix_(a == i, b == j)].mean() if (a == i).any() and (b == j).any() else 0 for j in range(c)] for i in range(k)])
    while True:
        mean = np.where(m() == 0, 1e-8, m())
        # costs are rounded so that ties are ties, as the operator does
        na = np.round(((x[:, None, :] - mean[:, b][None]) ** 2).sum(2), 9).argmin(1)
        nb = np.round(((x.T[:, None, :] - mean.T[:, na][None]) ** 2).sum(2), 9).argmin(1)
        keep, (a, b) = (a, b), (na, nb)
        now = float(((x - np.where(m() == 0, 1e-8, m())[np.ix_(na, nb)]) ** 2).sum()) ** 0.5
        if last is not None and now >= last - 1e-12:
            return keep[0], rounds
        last, rounds = now, rounds + 1


def test_models_run_until_the_objective_no_longer_falls(spark):
    from binmine.plans import registry

    x = np.array([r.v for r in tables.sign_bits(spark, SF).orderBy("id").collect()])
    want, rounds = uncapped_blocks(x, 5, 4)
    got = np.array([r.cluster - 1 for r in registry.QUERIES["blockmodel"](spark, SF).orderBy("id").collect()])
    assert rounds > 5 and (got == want).all()
    for f in (lambda: factor.block_model(obs_of(spark, x[:60]), 5, 4, rounds=1), lambda: factor.binary_model(obs_of(spark, x[:60]), 3, rounds=1)):
        with pytest.raises(RuntimeError):
            f()


def test_block_model_variants_and_objective(spark):
    x = np.kron(np.eye(2, dtype=int), np.ones((4, 3), int))
    labels, cols = factor.block_model(obs_of(spark, x), 2, 2)
    assert len({r.cluster for r in labels.where("id <= 4").collect()}) == 1
    assert {r.j: r.colcluster for r in cols.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2}


def test_pam_beats_its_build_and_handles_few_rows():
    x = np.array([[0, 0, 0, 0]] * 3 + [[1, 1, 1, 1]] * 3)
    d = kernels.distances(x)
    assert d[:, kernels.pam(d, 2)].min(1).sum() == 0
    assert len(kernels.pam(d[:2, :2], 5)) == 2


def test_bubble_tree_keeps_every_row_once(spark):
    x = np.random.default_rng(4).integers(0, 2, (200, 12))
    labels, reps = bubble.bubble(obs_of(spark, x), 0.2, 4, 2)
    n = {(r.chunk, r.local): r["count"] for r in labels.groupBy("chunk", "local").count().collect()}
    assert n == {(r.chunk, r.local): r.n for r in reps.collect()} and sum(n.values()) == 200
    with pytest.raises(ValueError):
        bubble.Tree(0.2, 5)


def blocks(spark, n=120, k=3, p=24):
    centres = np.kron(np.eye(k, dtype=int), np.ones(p // k, int))
    rng = np.random.default_rng(8)
    x = np.array([centres[i * k // n] for i in range(n)]) ^ (rng.random((n, p)) < 0.04)
    return simulate.block_truth(obs_of(spark, x.astype(int)), n, k)


@pytest.mark.parametrize(
    "name,run",
    [
        ("clara", lambda o: kmedoids.clara(o, 3, 2, 40)),
        ("clarans", lambda o: kmedoids.clarans(o, 3, 2, 30, 10)[1]),
        ("canopy_par", lambda o: leader.canopy_par(o, 0.3, 0.3, 3, 2)),
        ("sorted", lambda o: leader.sorted_neighborhood(o, 20, 0.25, 2, True)),
        ("clope", lambda o: itemset.clope(o, 2.0, 2)),
        ("scale", lambda o: itemset.scale(o, 3, 30, 2, 2, 1)),
        ("mbt_par", lambda o: trees.mbt_par(o, 20, 3, 2)),
        ("mona", lambda o: trees.mona(o, 3)),
        ("binary_par", lambda o: factor.binary_model_par(o, 3, 2)),
        ("block_par", lambda o: factor.block_model_par(o, 3, 3, 2)),
        ("proximus", lambda o: factor.proximus(o, 6, 3, 2)),
        ("bubble", lambda o: bubble.bubble_clusters(o, 0.3, 10, 2, 3)),
    ],
)
def test_recovery(spark, name, run):
    truth = blocks(spark)
    got = run(truth.select("id", "v"))
    both = truth.join(got.withColumnRenamed("cluster", "result"), "id")
    assert both.count() == 120
    assert metrics.rand_index(both).first().rand >= (0.6 if name in ("mbt_par", "mona") else 0.8)


def test_simulator_moments_and_redraw(spark):
    sigma = simulate.simcor(2, [2, 2], [0.5, 0.5], delta=0.1, epsilon=0.01)
    x = np.array([r.v for r in simulate.corrbinary(spark, 6000, [0.7, 0.5, 0.3, 0.5], sigma).collect()])
    assert np.abs(x.mean(0) - [0.7, 0.5, 0.3, 0.5]).max() < 0.03
    assert abs(np.corrcoef(x.T)[0, 1] - sigma[0, 1]) < 0.06
    taken = spark.createDataFrame([([0, 0, 0, 0],)], "v array<tinyint>")
    again = simulate.corrbinary(spark, 300, [0.5] * 4, np.eye(4), taken=taken)
    assert all(any(r.v) for r in again.collect())
    with pytest.raises(ValueError):
        simulate.normal_correlation(np.array([0.1, 0.9]), np.array([[1, 0.9], [0.9, 1]]), correct=False)


def test_merge_of_one_chunk_and_single_rows(spark):
    x = np.eye(3, dtype=int)
    got = merge.merge(merge.local_clusters(obs_of(spark, x), 3, leader.canopy_kernel(0.1, 0.1)), merge.by_kmeans(3, 1))
    assert got.select("cluster").distinct().count() == 3


def test_wide_and_long_forms(spark):
    wide = spark.createDataFrame([(1, 0, 1, 9), (2, 1, 1, 9)], "id long, V2 int, V1 int, Vx int")
    obs = tables.from_wide(wide)
    assert [r.v for r in obs.orderBy("id").collect()] == [[1, 0], [1, 1]]
    assert [r.v for r in tables.from_long(tables.to_long(obs), 2).orderBy("id").collect()] == [[1, 0], [1, 1]]
