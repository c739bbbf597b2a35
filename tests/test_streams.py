"""Streams with keyed state: a query that is stopped, or fails in a batch, and started again labels as one run does."""

import numpy as np
import pytest

from binmine.operators import itemset
from binmine.streaming import basket_stream

P = 10


def batches(spark, folder, n, first=0):
    rng = np.random.default_rng(first + 1)
    for b in range(first, first + n):
        x = (np.arange(P) // 5 == rng.integers(0, 2, (30, 1))) ^ (rng.random((30, P)) < 0.1)
        x[3] = False
        rows = [(1000 * b + i, [int(v) for v in r]) for i, r in enumerate(x)]
        spark.createDataFrame(rows, "id long, v array<tinyint>").coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(spark, kind, source, out, check):
    rows = spark.readStream.schema("id long, v array<tinyint>").option("maxFilesPerTrigger", 1).parquet(source)
    stream = basket_stream.clope_stream(rows, P, 3) if kind == "clope" else basket_stream.largeitem_stream(rows, P, 3)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination(180)


def labels(spark, out):
    return {r.id: (r.key, r.cluster) for r in spark.read.parquet(out).collect()}


@pytest.mark.parametrize("kind", ["clope", "largeitem"])
def test_restarted_stream_gives_the_labels_of_one_run(spark, tmp_path, kind):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", basket_stream.PROVIDER)
    path = lambda x: str(tmp_path / x)
    batches(spark, path("in"), 2)
    run(spark, kind, path("in"), path("out"), path("check"))
    half = labels(spark, path("out"))
    batches(spark, path("in"), 2, 2)
    run(spark, kind, path("in"), path("out"), path("check"))
    two = labels(spark, path("out"))
    run(spark, kind, path("in"), path("whole"), path("check2"))
    whole = labels(spark, path("whole"))
    assert len(half) == 60 and len(two) == 120 and two == whole and half.items() <= two.items()
    # each key's rows, batch after batch, by the batch algorithm's first pass
    rows = {r.id: np.array(r.v, np.int64) for r in spark.read.parquet(path("in")).collect()}
    for key in range(3):
        c = itemset._Clusters(P)
        c.grow()
        for i in sorted(i for i, (k, _) in whole.items() if k == key):
            x = rows[i]
            place = itemset._clope_place(c, x, 1, 2.0, 1000) if kind == "clope" else itemset._largeitem_place(c, x, 1, 0.5, 1.0, "reference")
            at = 0 if not x.any() else c.grow() if place < 0 else place
            c.add(at, x, 1)
            assert whole[i][1] == at
