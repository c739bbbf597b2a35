"""CLOPE and Large Item on a stream: a stateful processor keeps each key's clusters in the state store.

Rows are dealt to `keys` keys by a hash of their id. A key's clusters (rows, and how often each item occurs) are a map state,
so only clusters that a batch has changed are written, and a query that is stopped or killed goes on from its checkpoint with
the clusters of the last finished batch. Rows of a batch are placed in the order of their ids by the rule of the batch algorithms'
first pass; what a key has placed is never moved again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from binmine.operators.itemset import _Clusters, _clope_place, _largeitem_place

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LABELS = "id long, key int, cluster int"


class BasketClusters(StatefulProcessor):
    """place(clusters, row, 1) gives a row's cluster, or -1 for one of its own. Cluster 0 is that of rows without items."""

    def __init__(self, place, p: int) -> None:
        self.place, self.p = place, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("clusters", "cluster int", "n long, occ array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clusters, changed = _Clusters(self.p), set()
        clusters.grow()
        known = sorted((k[0], v[0], v[1]) for k, v in self.state.iterator())
        for k, n, occ in known:
            while clusters.k <= k:
                clusters.grow()
            clusters.add(k, np.array(occ, np.int64), int(n))
        batch = list(rows)
        if batch:  # in the order of ids, so a batch that comes again is placed again alike
            pdf, labels = pd.concat(batch).sort_values("id", kind="stable"), []
            for v in pdf["v"]:
                x = np.array(v, np.int64)
                k = self.place(clusters, x, 1) if x.any() else 0
                k = clusters.grow() if k < 0 else k
                clusters.add(k, x, 1)
                changed.add(k)
                labels.append(k)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "key": key[0], "cluster": labels})
        for k in sorted(changed):
            self.state.updateValue((int(k),), (int(clusters.n[k]), [int(x) for x in clusters.occ[k]]))

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, place, p: int, keys: int) -> DataFrame:
    """id, key, cluster. rows: a stream of id, v (p bits); a null row is in no cluster."""
    dealt = rows.where("v is not null").select(F.pmod(F.xxhash64("id"), F.lit(keys)).cast("int").alias("key"), F.col("id").cast("long").alias("id"), "v")
    return dealt.groupBy("key").transformWithStateInPandas(BasketClusters(place, p), LABELS, "Append", "None")


def clope_stream(rows: DataFrame, p: int, keys: int, r: float = 2.0, most: int = 1000) -> DataFrame:
    """CLOPE's placing by profit. Needs the session's state store provider to be PROVIDER."""
    return _stream(rows, partial(_clope_place, r=r, most=most), p, keys)


def largeitem_stream(rows: DataFrame, p: int, keys: int, w: float = 1.0, minsupport: float = 0.5, variant: str = "reference") -> DataFrame:
    """Large Item's placing by cost. Needs the session's state store provider to be PROVIDER."""
    return _stream(rows, partial(_largeitem_place, minsup=minsupport, w=w, variant=variant), p, keys)
