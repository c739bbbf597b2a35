"""Different contents under one id are different rows: none of them may be lost or joined with the other."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from binmine.llm import simhash, vector_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(2)
    return [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60)) for _ in range(3)]


def docs(spark):
    a, b, c = texts()
    rows = [(5, a), (5, b), (7, a), (9, b), (11, c), (5, b)]
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], DOCS)


def test_near_copies_keep_each_text(spark):
    a, b, c = texts()
    for keep in (simhash.without_near_copies, simhash.without_near_duplicates, lambda d: corpus_pipeline.drop_near_duplicates(spark, d, "")):
        for parts in (1, 5):
            got = keep(docs(spark).repartition(parts))
            assert got.columns == docs(spark).columns
            assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(5, a), (5, b), (11, c)])


def test_which_of_repeated_rows_stays_is_settled(spark):
    kept = {tuple(sorted(tuple(r) for r in simhash.without_near_copies(docs(spark).orderBy(F.rand(seed))).collect())) for seed in (1, 2, 3)}
    assert len(kept) == 1


def test_components_of_repeated_ids(spark):
    for found in (simhash.near_copies(docs(spark)), simhash.near_duplicates(docs(spark))):
        assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]
    # what the id hides: two components, the larger of which begins at 3 once its own row is renamed
    renamed = docs(spark).withColumn("doc_id", F.when(F.col("text") == texts()[1], F.lit(3)).otherwise(F.col("doc_id")))
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_copies(renamed).collect()) == [(3, 3), (3, 3), (3, 3), (5, 5), (7, 5), (11, 11)]


def test_vectors_of_one_id(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8))
    rows = [(int(i) // 2, [float(v) for v in r]) for i, r in enumerate(x)]  # every id has two vectors
    rows += [(100 + k, [float(v) for v in x[k] * 2.0]) for k in (0, 1, 2)]  # copies of ids 0, 0 and 1
    got = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    m = np.array([r for _, r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    name = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((rows[i][0], int(near[i].sum()) - 1, name[root[i]]) for i in range(len(rows)))
