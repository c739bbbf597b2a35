"""Scores of tuner settings, and CLARA, against direct computation in plain Python."""

from hashlib import md5
from itertools import combinations

import numpy as np
import pytest

from binmine.functions import kernels
from binmine.operators import kmedoids, sketch, tune

from .test_scaled import plain_leaves, serial_canopies

N, CLASSES, P = 60, 3, 16


@pytest.fixture(scope="module")
def truth(spark):
    rng = np.random.default_rng(21)
    x = rng.integers(0, 2, (CLASSES, P))[np.arange(90) % CLASSES] ^ (rng.random((90, P)) < 0.12)
    return spark.createDataFrame([(i, i % CLASSES + 1, [int(b) for b in r]) for i, r in enumerate(x)], "id long, orig int, v array<tinyint>")


@pytest.fixture(scope="module")
def sample(truth):
    return {r.id: (r.orig, tuple(r.v)) for r in tune.sample_of(truth, CLASSES, N).collect()}


def rand(sample, label):
    same = [(sample[a][0] == sample[b][0]) == (label[a] == label[b]) for a, b in combinations(sample, 2)]
    return sum(same) / len(same)


def f1(sample, label):
    """Pairs of one class that are apart count as missed, but for those of lone rows."""
    tp = missed = 0
    for c in {o for o, _ in sample.values()}:
        n = {}
        for i, (o, _) in sample.items():
            if o == c:
                n[label[i]] = n.get(label[i], 0) + 1
        own, size, lone = sum(k * (k - 1) // 2 for k in n.values()), sum(n.values()), sum(k == 1 for k in n.values())
        tp, missed = tp + own, missed + size * (size - 1) // 2 - own - lone * (lone - 1) // 2
    found = sum(label[a] == label[b] for a, b in combinations(sample, 2))
    recall, precision = tp / (tp + missed) if tp + missed else None, tp / found if found else None
    return 2 * recall * precision / (recall + precision) if recall and precision else -1.0


def signature(v, n):
    big = sketch.modulus(P)
    return tuple(min(((j + 1) * a + b) % big % (P + 1) for j, x in enumerate(v) if x) if any(v) else -1 for a, b in sketch.coefficients(24, P, 1)[:n])


def test_minhash_scores(truth, sample):
    best, scores = tune.tune_minhash(truth, CLASSES, P, N, grid=(2, 4, 24))
    want = [f1(sample, {i: signature(v, n) for i, (_, v) in sample.items()}) for n in (2, 4, 24)]
    assert scores == pytest.approx(want) and best == (2, 4, 24)[int(np.argmax(want))]


def test_lsh_scores(truth, sample):
    grid = ((2, 4), (3, 24))
    _, scores = tune.tune_lsh(truth, CLASSES, P, N, grid=grid)
    for (bands, n), got in zip(grid, scores, strict=True):
        step = n // bands
        sig = {i: signature(v, n) for i, (_, v) in sample.items()}
        pairs = [(a, b) for a, b in combinations(sample, 2) if any(sig[a][k : k + step] == sig[b][k : k + step] for k in range(0, n, step))]
        tp = sum(sample[a][0] == sample[b][0] for a, b in pairs)
        recall, precision = tp / (N / CLASSES * (N / CLASSES - 1) / 2 * CLASSES), tp / len(pairs)
        assert got == pytest.approx(2 * recall * precision / (recall + precision))


def test_canopy_scores(truth, sample):
    _, scores = tune.tune_canopy(truth, CLASSES, N, grid=(0.3, 0.45))
    rows = {i: v for i, (_, v) in sample.items()}
    assert scores == pytest.approx([rand(sample, serial_canopies(rows, t)) for t in (0.3, 0.45)])


def test_sorted_scores(truth, sample):
    _, scores = tune.tune_sorted(truth, CLASSES, N, grid=(0.2, 0.3), window=7, runs=2)
    for t, got in zip((0.2, 0.3), scores, strict=True):
        label = {i: i for i in sample}
        for seed in (1, 2):
            order = sorted(sample, key=lambda i: (md5(f"{seed}-{i}".encode()).hexdigest(), i))
            for k, i in enumerate(order):
                d = [(sum(a != b for a, b in zip(sample[i][1], sample[j][1], strict=True)), n, j) for n, j in enumerate(order[max(0, k - 7) : k])]
                if d and min(d)[0] < t * P:
                    one, other = label[i], label[min(d)[2]]
                    label = {x: min(one, other) if c in (one, other) else c for x, c in label.items()}
        assert got == pytest.approx(rand(sample, label))


def test_bubble_scores(truth, sample):
    grid = ((0.15, 4), (0.3, 10))
    _, scores = tune.tune_bubble(truth, CLASSES, N, grid=grid)
    ids = sorted(sample)
    for (t, most), got in zip(grid, scores, strict=True):
        leaf, n, _, centres = plain_leaves([sample[i][1] for i in ids], t, most, 1, 1000, 8, True)
        x = np.array([centres[k] for k in range(1, n + 1)])
        d = np.rint(kernels.distances(x) * P)
        of = d[:, kernels.pam(d, CLASSES)].argmin(1) if n > CLASSES else np.arange(n)
        assert got == pytest.approx(f1(sample, {i: int(of[leaf[k] - 1]) for k, i in enumerate(ids)}))


@pytest.mark.parametrize("compat", [False, True])
def test_clara(spark, truth, compat):
    rows = {r.id: tuple(r.v) for r in truth.collect()}
    got = {r.id: r.cluster for r in kmedoids.clara(truth.select("id", "v"), 3, samples=3, size=20, compat=compat).collect()}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    sets, costs = [], []
    for seed in (1, 2, 3):
        some = [rows[i] for i in sorted(rows, key=lambda i: (md5(f"{seed}-{i}".encode()).hexdigest(), i))[:20]]
        at = sorted(kernels.pam(kernels.distances(np.array(some)), 3).tolist())
        sets.append([some[i] for i in at])
        costs.append(sum(min(ham(v, m) for m in sets[-1]) for v in rows.values()))
    best = costs.index(min(costs))
    if compat:
        best, last = 0, costs[0]
        for c in (1, 2):
            best, last = (c if costs[c] < last else best), costs[c]
    for i, v in rows.items():
        d = [ham(v, m) for m in sets[best]]
        assert got[i] == d.index(min(d)) + 1
