"""The pipeline against plain Python, and the entry file's registration."""

import os
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from binmine.llm import packing, secrets, toxicity
from binmine.llm.common import written

from .test_operators import base_spans, docs_of, pieces_of, plain_copies

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_against_plain_python(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.probability(scorer.evidence(*scorer.segments(t))) < toxicity.THRESHOLD]
    parts = plain_copies(rows)
    rows = [r for r in rows if parts[r[0]] == r[0]]
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in words(t) for x in items)]
    scanner, w, want = secrets.Scanner(), packing.Words(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        assert [(a, k, e) for k, a, e in scanner.spans(t) if k < 3] == base_spans(t)
        spans, out, last = [(a, e) for _, a, e in scanner.spans(t)], "", 0
        for a, e in spans:
            if a >= last:
                out += t[last:a] + "[secret]"
            last = max(last, e)
        ids = w.whole(out + t[last:]).tobytes() + np.array([2], "<u4").tobytes()
        want += [(i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for a, n in pieces_of(len(ids) // 4)]
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted(want)


def odd_documents(spark):
    """Nulls in every column, repeats, ties, empty and very long texts, columns with names that stages use themselves."""
    text = "some words that stand in this text more than once, some words that stand in it again and then a few others"
    rows = [(i, f"{text} {i} {i * 7} {i * 11}") for i in range(40)] + [(50, None), (51, ""), (None, None), (None, text), (3, f"{text} 3 21 33"), (3, f"{text} 3 21 33"), (60, "long text " * 200_000), (61, "password = abcdef123")]
    blank = spark.createDataFrame([(None, None, None, None, None, None, None, None, None, None)], docs_of(spark, []).schema)
    return docs_of(spark, rows).unionByName(blank)


def tables_of(spark, folder, benchmark):
    labels = spark.createDataFrame([(None, 0, 0), (3, 0, None), (None, None, None), *((i, 1, 0) for i in range(4, 40))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("rows", [True, False])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, rows):
    pytest.importorskip("public_tokenizers")
    item = "an item of the benchmark that no document holds at all"
    tables_of(spark, str(tmp_path), [(1, item), (1, item), (2, None), (3, ""), (None, item)] if rows else [])
    docs = odd_documents(spark) if rows else odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, _ = written(stage(spark, docs, str(tmp_path)), name)
        if name != "packing":
            assert sorted(out.columns) == sorted(docs.columns)
            docs = out
        if name == "toxicity":
            toxic_kept = docs.count()
        if name == "near_duplicates" and rows:
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert ids.count(None) == 3 and ids.count(3) <= 1 and (50 in ids) != (51 in ids)
        if name == "secrets" and rows:
            kept = {r.doc_id: r for r in docs.where("doc_id is not null").collect()}
            assert 61 not in kept or (kept[61].text == "[secret]" and kept[61].n_chars == 8)
    assert out.count() >= docs.count() if rows else out.count() == toxic_kept == 0


def test_stages_and_queries_are_registered():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    found = __spark_entry__.queries()
    assert "pipeline" in found and sorted(int(n[2:].split("_")[0]) for n in found if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def sql_parity(spark, name, folder):
    import duckdb

    from binmine.llm import queries

    c = duckdb.connect()
    for t in "documents embeddings pages labels conversations".split():
        if os.path.exists(f"{folder}/{t}.parquet"):
            one = f"{folder}/{t}.parquet"
            c.execute(f"create view {t} as select * from read_parquet('{one + '/*.parquet' if os.path.isdir(one) else one}')")
    got, want = queries.QUERIES[name](spark, str(folder)).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple("-" if pd.isna(x) else str(int(x)) if isinstance(x, (float, np.floating)) else str(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))
    assert cols == sorted(want.columns) and rows(got) == rows(want)
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op2_grid_order", "op3_warc_revisits", "op4_secret_scan", "op6_url_reputation", "op7_chat_format", "op10_interleave"])
def test_sql_parity(spark, name):
    sql_parity(spark, name, SF)


def test_sql_parity_with_linked_vectors(spark, tmp_path):
    rng = np.random.default_rng(30)
    rows = []
    for _ in range(20):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (centre + 0.15 * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(500, rows[0][1]), (501, None), (502, [0.0] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sql_parity(spark, "op2_grid_order", tmp_path)
    assert (got["n_links"] > 0).sum() > 30 and 20 < got["component_id"].nunique() < len(rows) - 10


def test_sql_parity_with_repeated_payloads(spark, tmp_path):
    bodies = ["a" * 300, "b" * 100, "é" * 50, "c" * 99, "", None, *(f"page {i} " * 30 for i in range(20))]
    spark.createDataFrame([(1000 - i, f"http://x/{i}", bodies[i * 7 % len(bodies)]) for i in range(120)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sql_parity(spark, "op3_warc_revisits", tmp_path)
    assert (got["record_type"] == "revisit").sum() > 60 and got["ok"].all()


def test_sql_parity_with_bad_hosts(spark, tmp_path):
    rng = np.random.default_rng(31)
    hosts = [(f"h{i}.site{i % 7}.net", 0.1) for i in range(30)] + [(f"s{i}.spam.biz", 0.9) for i in range(6)] + [("new.spam.biz", None), ("x.co.uk", 0.15), ("tiny.net", 0.99)]
    pages, labels = [], []
    for h, bad in hosts:
        for _ in range(2 if h == "tiny.net" else 40):
            k = len(pages)
            pages.append((k, f"https://{h}/p/{k}" if bad is not None else f"https://{h}/about"))
            if bad is not None:
                labels.append((k, int(rng.random() >= bad), 0))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sql_parity(spark, "op6_url_reputation", tmp_path)
    blocked = set(got.loc[got["verdict"] == "block", "host"])
    assert blocked == {f"s{i}.spam.biz" for i in range(6)} | {"new.spam.biz"}  # the new host after its domain; two pages are too few
