"""Periodic runs against all periods of all texts."""

import random
import re
import zlib

import numpy as np

from binmine.llm import periodic

DOCS = "doc_id long, text string, runs string, collapsed int, n_words int, start int"


def brute(x):
    n, out = len(x), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out[i, j + q] = min(q, out.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def some(rng):
    n, k = rng.choice([0, 1, 5, 24, 30, 60, 100, 300]), rng.choice([1, 2, 3, 5, 50])
    x = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p = rng.randrange(n), rng.randint(1, 30)
            for i in range(a + p, min(n, a + rng.randint(20, 100))):
                x[i] = x[i - p]
    return x


def test_runs_against_all_periods():
    rng = random.Random(5)
    for _ in range(150):
        texts = [some(rng) for _ in range(rng.randrange(9))]
        assert periodic.runs_of([np.array(t, np.int32) for t in texts]) == [brute(t) for t in texts]


def test_runs_that_fill_or_overlap():
    fib, ahead = [0], [0, 1]
    while len(ahead) < 800:
        fib, ahead = ahead, ahead + fib
    for x in ([7] * 24, [7] * 23, list(range(8)) * 3, list(range(9)) * 3, list(range(9)) * 2, ahead, [0, 1, 0, 1, 1] * 40, [1] * 30 + [2] + [1] * 30):
        assert periodic.runs_of([np.array(x, np.int32)]) == [brute(x)]


def test_several_trees_and_small_ones(monkeypatch):
    rng = random.Random(6)
    texts = [some(rng) for _ in range(60)]
    monkeypatch.setattr(periodic, "TREE", 64)
    assert periodic.runs_of([np.array(t, np.int32) for t in texts]) == [brute(t) for t in texts]


def plain(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_odd_rows_and_planted_texts(spark):
    rng = random.Random(7)
    words = ["a", "b,", "é", "\U0001f600", "c\x00"]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\x0b\t ", "\r\n"]).join(rng.choices(words, k=rng.choice([0, 1, 30, 90])))) for i in range(150)]
    rows += [(None, "x " * 40), (None, None), (5, None), (7, " \t"), (7, "no break  x"), (9, "z " * 200_000), (9, "z " * 200_000), (11, "y")]
    df = spark.createDataFrame([(*r, "r", 1, 2, 3) for r in rows], DOCS)
    made = periodic.planted(df.select("doc_id", "text"))
    got = sorted(map(repr, ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(made).collect())))
    want = []
    for i, t in rows:
        w = plain(i, t)
        runs = brute(w) if len(w) < 1000 else [(0, len(w), 1)]
        keep = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        want.append(repr((i, len(w), runs, " ".join(keep))))
    assert got == sorted(want)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and len(plain(i, t)) > 40 for i, t in rows if i), "some rows are planted"
    assert periodic.periodic_runs(df.limit(0)).count() == 0
