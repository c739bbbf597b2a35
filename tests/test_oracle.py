"""Each query that has SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import numpy as np
import pytest

from binmine.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "part lineitem embeddings documents".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, (float, np.floating)) else str(x) for x in r) for r in df[cols].itertuples(index=False)), cols


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_parity(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.ORACLE_SQL[name]).df())
    assert got == want


def test_stream_of_scale_batches(spark, tmp_path):
    from binmine.streaming.scale_stream import ScaleStream

    obs = spark.createDataFrame([(i, [1, 0] if i % 2 else [0, 1]) for i in range(20)], "id long, v array<tinyint>")
    obs.write.parquet(str(tmp_path / "in"))
    out = {}
    s = ScaleStream(np.array([[5, 0], [0, 5]]), np.array([5, 5]), 2, lambda df, e: out.update({r.id: r.cluster for r in df.collect()}))
    q = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(s.batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert out == {i: 1 if i % 2 else 2 for i in range(20)} and s.n.tolist() == [15, 15]


def test_stream_goes_on_from_its_state(spark, tmp_path):
    from binmine.streaming.scale_stream import ScaleStream

    rng, out = np.random.default_rng(3), []
    batches = [spark.createDataFrame([(10 * e + i, [int(x) for x in rng.integers(0, 2, 4)]) for i in range(10)], "id long, v array<tinyint>") for e in range(4)]
    new = lambda state: ScaleStream(np.array([[5, 0, 1, 0], [0, 5, 0, 1]]), np.array([5, 5]), 2, lambda df, e: out.append({r.id: r.cluster for r in df.collect()}), state)
    whole = new(None)
    for e, b in enumerate(batches):
        whole.batch(b, e)
    want, out[:] = list(out), []
    first = new(str(tmp_path / "state"))
    for e in (0, 1, 2):
        first.batch(batches[e], e)
    again = new(str(tmp_path / "state"))  # a new driver: batch 2 comes again, then 3
    for e in (2, 3):
        again.batch(batches[e], e)
    assert out == want[:3] + want[2:] and again.occ.tolist() == whole.occ.tolist() and again.n.tolist() == whole.n.tolist()
    with pytest.raises(RuntimeError):
        new(str(tmp_path / "state")).batch(batches[0], 9)


def plain_scale(rows, labels, k, chunks, batches, passes):
    """SCALE in plain Python: rows {id: v} in seeded order, labels of the sample; counts only, no shared code."""
    from hashlib import md5

    total, p = len(rows), len(next(iter(rows.values())))
    occ, labels = [[0] * p for _ in range(k)], dict(labels)
    for i, c in labels.items():
        occ[c] = [a + b for a, b in zip(occ[c], rows[i], strict=True)]
    order = sorted((i for i in rows if i not in labels), key=lambda i: md5(f"1-{i}".encode()).hexdigest() + str(i))
    small, extra = divmod(len(order), chunks * batches)
    cuts = [0]
    for i in range(chunks * batches):
        cuts.append(cuts[-1] + small + (i < extra))
    for step in range(passes + 1):
        moved = 0
        for b in range(batches):
            ids = order[cuts[b * chunks] : cuts[(b + 1) * chunks]]
            for i in ids if step else ():
                occ[labels[i]] = [a - x for a, x in zip(occ[labels[i]], rows[i], strict=True)]
            placed = {}
            for c in range(b * chunks, (b + 1) * chunks):
                own = [o[:] for o in occ]
                for i in order[cuts[c] : cuts[c + 1]]:
                    density = lambda o: sum(a * a for a in o) / sum(o) if sum(o) else 0.0
                    grown = [[a + x for a, x in zip(o, rows[i], strict=True)] for o in own]
                    score = [density(g) - density(o) for g, o in zip(grown, own, strict=True)]
                    placed[i] = max(range(k), key=lambda j: (round(score[j], 9), -j))
                    own[placed[i]] = grown[placed[i]]
            for i, j in placed.items():
                moved += step > 0 and labels[i] != j
                labels[i] = j
                occ[j] = [a + x for a, x in zip(occ[j], rows[i], strict=True)]
        if step and not moved:
            break
    return labels


def test_scale_against_plain_python(spark):
    from binmine.operators import itemset

    rng = np.random.default_rng(5)
    centres = rng.random((3, 17)) < 0.5
    rows = {i: [int(x) for x in centres[i % 3] ^ (rng.random(17) < 0.13)] for i in range(150)}
    obs = spark.createDataFrame(list(rows.items()), "id long, v array<tinyint>")
    got = {r.id: r.cluster - 1 for r in itemset.scale(obs, 3, sample=20, chunks=2, batches=3, max_iteration=2).collect()}
    from binmine.functions.bits import sample_rows

    sample = {r.id: got[r.id] for r in sample_rows(obs, 20, 1).collect()}
    assert len(got) == 150 and got == plain_scale(rows, sample, 3, 2, 3, 3)
    assert itemset.scale(obs.limit(0), 3).count() == 0


def test_neighbours_do_not_depend_on_blocks(spark):
    from binmine.operators import leader

    rng = np.random.default_rng(6)
    obs = spark.createDataFrame([(i, [int(x) for x in rng.integers(0, 2, 12)]) for i in range(90)], "id long, v array<tinyint>")
    for chunks in (1, 4):
        one, many = (sorted(map(tuple, leader.neighbour_edges(obs, 7, 0.5, chunks, block=n).collect())) for n in (1000, 10))
        assert one == many and one


def test_signatures_read_their_documents_once(spark):
    """The plans of MinHash and LSH scan documents once, whatever follows, and pair rows of one exchange."""
    from binmine.operators import sketch
    from binmine.plans import registry, sql
    from binmine.sources import tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sigs = plan(sketch.signatures_long(tables.word_numbers(spark, SF), sql.DOC_COEFS, sql.DOC_P))
    assert sigs.count("FileScan parquet") == 1 and sigs.count("Exchange hashpartitioning") == 1
    for name in ("lsh_candidate_pairs", "minhash_clusters"):
        df = registry.QUERIES[name](spark, SF)
        df.collect()
        assert "documents.parquet" not in plan(df), "signatures are written once and read again"


def test_pairs_of_split_buckets(spark):
    """One bucket with a third of the rows, split in parts, gives the pairs of whole buckets, each once."""
    from binmine.operators import sketch

    rng = np.random.default_rng(8)
    rows = [(i, [1, 1, int(a), int(b)] if i % 3 == 0 else [int(a), int(b), int(c), 7]) for i, (a, b, c) in enumerate(rng.integers(0, 4, (240, 3)))]
    sigs = spark.createDataFrame(rows, "id long, sig array<long>")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and any(x[k : k + 2] == y[k : k + 2] for k in (0, 2)))
    for part in (16, 100_000):
        assert sorted(map(tuple, sketch.signature_pairs(sigs, 4, 2, part).collect())) == want
        assert sorted(map(tuple, sketch.candidate_pairs(sketch.buckets(sigs, 4, 2), part).collect())) == want
    assert sketch.signature_pairs(sigs.limit(0), 4, 2).count() == 0
