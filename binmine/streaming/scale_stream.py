"""SCALE's first phase on a stream: each micro-batch is placed against the features so far, which then take it in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binmine.operators.itemset import scale_assign


class ScaleStream:
    """Features of k clusters, k small; use as df.writeStream.foreachBatch(stream.batch).

    sink(labels, epoch) gets id, cluster of each batch. A batch that comes again after a failure is placed again against
    the features before it, so its labels stay the same. state names a shared folder for the features after each batch (the
    last two are kept), from which a new driver goes on; without it a restart begins from occ and n.
    """

    def __init__(self, occ: np.ndarray, n: np.ndarray, chunks: int, sink: Callable[[DataFrame, int], None], state: str | None = None) -> None:
        self.occ, self.n, self.chunks, self.sink, self.state = occ, n, chunks, sink, state
        self.before: tuple[int, np.ndarray, np.ndarray] | None = None

    def _path(self, spark: SparkSession, epoch: int):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{epoch}")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _load(self, spark: SparkSession, epoch: int) -> None:
        fs, path = self._path(spark, epoch)
        if fs.exists(path):
            rows = spark.read.parquet(path.toString()).orderBy("cluster").collect()
            self.occ, self.n = np.array([r.occ for r in rows]), np.array([r.n for r in rows])
        elif epoch >= 0:
            raise RuntimeError(f"no features of epoch {epoch} below {self.state}")

    def _save(self, spark: SparkSession, epoch: int) -> None:
        rows = [(k, n, occ) for k, (n, occ) in enumerate(zip(self.n.tolist(), self.occ.tolist(), strict=True))]
        spark.createDataFrame(rows, "cluster int, n long, occ array<long>").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/{epoch}")
        fs, old = self._path(spark, epoch - 2)
        fs.delete(old, True)

    def batch(self, df: DataFrame, epoch: int) -> None:
        if self.state and self.before is None:
            self._load(df.sparkSession, epoch - 1)
        if self.before and self.before[0] == epoch:
            self.occ, self.n = self.before[1], self.before[2]
        self.before = (epoch, self.occ.copy(), self.n.copy())
        occ, n, total = self.occ, self.n, int(self.n.sum()) + df.count()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            return pd.DataFrame({"id": pdf["id"], "cluster": scale_assign(pdf, occ, n, total) + 1, "v": pdf["v"]})

        labels = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(self.chunks)).alias("chunk")).groupBy("chunk").applyInPandas(run, "id long, cluster int, v array<tinyint>").persist()
        added, rows = np.zeros_like(occ), np.zeros_like(n)
        for r in labels.select("cluster", F.posexplode("v").alias("j", "b")).groupBy("cluster", "j").agg(F.sum("b").alias("s"), F.count(F.lit(1)).alias("n")).collect():
            added[r.cluster - 1, r.j], rows[r.cluster - 1] = r.s, r.n
        self.sink(labels.select("id", "cluster"), epoch)
        self.occ, self.n = occ + added, n + rows
        labels.unpersist()
        if self.state:
            self._save(df.sparkSession, epoch)
