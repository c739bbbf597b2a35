"""What matchers send to the workers, and how often a benchmark of several groups reads the corpus for its frequencies."""

import random
from dataclasses import replace

from pyspark import cloudpickle

from binmine.llm import decontaminate


def tables(spark, n):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(6000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(16, 60)))) for k in range(n)]
    docs = [(i, " ".join(rng.choices(words, k=80))) for i in range(60)]
    docs += [(1000 + k, " ".join(rng.choices(words, k=20)) + " " + items[k][1] + " " + words[k]) for k in range(0, n, 9)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_matchers_hold_their_own_terms_only(spark):
    docs, items = tables(spark, 512)
    (group,) = decontaminate.matchers(docs, items)
    assert len(group) == 2
    for m in group:
        assert len(m.space) <= 1 + len({i for ids in m.ids for i in ids}) < m.terms.none
    assert len(cloudpickle.dumps(group)) < 20 << 20


def test_groups_count_words_once(spark, monkeypatch):
    docs, items = tables(spark, 120)
    seen, plain = [], decontaminate.document_frequencies
    monkeypatch.setattr(decontaminate, "document_frequencies", lambda d, t: seen.append(len(t)) or plain(d, t))
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    some = replace(decontaminate.Settings(), group=30, block=15)
    parts = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, some).collect()}
    assert len(seen) == 2, "once for each call, however many groups"
    assert whole == parts and {(1000 + k, k) for k in range(0, 120, 9)} <= whole
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
