"""Prefix trie against a plain dictionary trie; global ranks and running sums against one sorted list."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from binmine.llm import ordered, trie

ROWS = "conv_id long, turn long, role string, text string, rank int, at string, label long, seq int, depth int"


def convs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], ROWS)


def plain(rows):
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            said.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    said = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in said.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        src = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = said.get(src, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, s in built.items():
        ends.setdefault(tuple(s), []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out, below = set(), {p: [0, 0, 0] for p in members}
    for p in members:
        if p:
            below[p[:-1]][0] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][1] += below[p][0] == 0
            below[p[:d]][2] += (len(m) - 1) * words(p)
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), *below[p], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def test_trie_against_a_dictionary(spark):
    rng = random.Random(3)
    rows = []
    for c in rng.sample(range(-50, 130), 90):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "a\x0bb c", "é z"])))
    long = [(c, t, "user", f"t{t}") for c in (200, 201, 202) for t in range(150 + c % 2)]
    long += [(203, t, "user", f"t{t}" if t != 100 else "other") for t in range(150)]
    odd = [(300, None, "z", "first"), (300, 0, "b", "x"), (300, 0, "b", "x"), (300, 0, "a", "y"), (None, 0, "u", "lost"), (None, 1, "u", "lost"), (301, 5, None, None), (321, 0, "u", "has no source"), (341, 0, "u", "w " * 30_000)]
    rows += long + odd
    rng.shuffle(rows)
    df = convs(spark, rows).repartition(7)
    got = trie.prefix_trie(df).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r)[:8] for r in got} == plain(rows)
    assert sorted(r.pos for r in got) == list(range(1, len(got) + 1)), "preorder numbers nodes"
    assert all(r.pos <= r.subtree_end for r in got)
    top = {r.pos: r for r in got}
    assert all(sum(top[p].n_children == 0 for p in range(r.pos, r.subtree_end + 1)) == r.n_leaves for r in got), "intervals are subtrees"


def test_hot_sequences_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 6000) for t in range(1 + (c % 20 == 0))]
    got = {tuple(r)[:8] for r in trie.prefix_trie(convs(spark, rows)).collect()}
    assert got == plain(rows)
    alone = [(c, 0, "u", "short") for c in range(1, 20)]  # no source: those that borrow are turnless
    assert {tuple(r)[:8] for r in trie.prefix_trie(convs(spark, alone)).collect()} == plain(alone)


def test_no_conversation_has_no_node(spark):
    assert trie.prefix_trie(convs(spark, [])).count() == 0
    assert trie.prefix_trie(convs(spark, [(None, 0, "u", "x")])).count() == 0


def test_running_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c", "dd"]), i, rng.randint(0, 9)) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for group in ("g", None):
            out, _ = ordered.running(spark.createDataFrame(rows, "g string, i long, x long").repartition(5), group, ["i"], ["g", "i"], ("x",))
            assert out.select(F.count_distinct("rank")).first()[0] == (4 if group else 1)
            got = {r.i: (r["rank"], r["at"], r.run_x) for r in out.collect()}
            state = {}
            for g, i, x in sorted(rows) if group else sorted(rows, key=lambda r: r[1]):
                k = g if group else ""
                at, total = state.get(k, (0, 0))
                state[k] = (at + 1, total + x)
                assert got[i] == (len(state), at + 1, total + x)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
