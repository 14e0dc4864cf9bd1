"""An inverted-file index: vectors in cells around KMeans centroids, searched in the nearest cells first.

Centroids are fitted on a bounded sample (``fit_rows``, a parameter), but every row is assigned to a cell. The assignment is a
pandas UDF over batches; the index is Parquet partitioned by cell, so a search reads the probed cells only. A search
widens its probes until k rows pass the predicates, or all cells are read: then it is exact.

How many cells a search probes if it is not told is measured when the index is built: on a sample of rows, the least number
that finds a share ``AIM`` of the true neighbours of other rows, for each k of ``MEASURED_K``. A sample is sparser than the table,
so its neighbours spread over more cells, not fewer. Larger k, and searches with a predicate (the nearest rows that pass can be
anywhere), read all cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.knn import knn_join, nearest


#: The share of neighbours that default probes are to find in the sample, the k that it is measured for, and rows of the sample and queries among them.
AIM, MEASURED_K, SAMPLE_ROWS, SAMPLE_QUERIES = 0.95, (10, 100), 4096, 256
#: Decimals of distances that many searches at once are ordered by; equal ones are ordered by id.
DIGITS = 9


class IvfIndex:
    def __init__(self, rows: DataFrame, centroids: np.ndarray, metric: str, vector: str, id_col: str, kind: str, measured: dict[int, int] | None = None) -> None:
        self.rows, self.centroids, self.metric, self.vector, self.id_col, self.kind = rows, centroids, metric, vector, id_col, kind
        #: By k: the cells that hold a share AIM of the k nearest.
        self.measured = measured or {}

    @classmethod
    def build(cls, df: DataFrame, cells: int = 16, metric: str = "l2", vector: str = "vector", id_col: str = "id", kind: str = "float4", iterations: int = 10, fit_rows: int = 100_000, seed: int = 1, path: str | None = None) -> IvfIndex:
        points = df.select(F.col(vector).cast("array<double>").alias("v"))
        total = max(1, points.count())
        if total > fit_rows:
            points = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / total))
        if metric == "cosine":
            norm = F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")
            points = points.withColumn("v", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")))
        if min(cells, total) < 2:
            size = df.select(F.size(vector)).first()[0]
            centroids = np.array([[points.agg(F.avg(F.get("v", F.lit(k)))).first()[0] for k in range(size)]])
        else:
            model = KMeans(k=min(cells, total), maxIter=iterations, seed=seed, featuresCol="f").fit(points.select(array_to_vector("v").alias("f")))
            centroids = np.array(model.clusterCenters())
        assigned = df.withColumn("cell", cls._cell(centroids, metric)(F.col(vector).cast("array<double>")))
        return cls(cls._kept(assigned, path), centroids, metric, vector, id_col, kind, cls._measure(points, centroids, metric))

    @classmethod
    def _measure(cls, points: DataFrame, centroids: np.ndarray, metric: str) -> dict[int, int]:
        """By k: the least number of nearest cells with a share AIM of the true neighbours, over a sample."""
        held = points.orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
        x = np.asarray(held.flatten()).reshape(len(held), -1)
        if len(x) < 2 or len(centroids) < 2:
            return {}
        q, square = x[:SAMPLE_QUERIES], lambda y: (y * y).sum(1)[None]
        own = (square(centroids) - 2 * x @ centroids.T).argmin(1)
        far, order = -q @ x.T, -q @ centroids.T
        if metric != "ip":
            far, order = square(x) + 2 * far, square(centroids) + 2 * order
        far[np.arange(len(q)), np.arange(len(q))] = np.inf
        place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
        nearest_first, measured = np.argsort(far, axis=1)[:, : len(x) - 1], {}
        for k in MEASURED_K:
            at = np.sort(np.take_along_axis(place, own[nearest_first[:, :k]], axis=1), axis=None)
            measured[k] = int(at[math.ceil(AIM * len(at)) - 1]) + 1
        return measured

    def probes(self, k: int, where: str | None = None) -> int:
        """The cells that a search for k rows probes if it is not told."""
        return next((p for most, p in sorted(self.measured.items()) if k <= most and where is None), len(self.centroids))

    @staticmethod
    def _kept(assigned: DataFrame, path: str | None) -> DataFrame:
        if path is None:
            return assigned
        assigned.write.mode("overwrite").partitionBy("cell").parquet(path)
        return assigned.sparkSession.read.schema(assigned.schema).parquet(path)

    @staticmethod
    def _cell(centroids: np.ndarray, metric: str):
        @F.pandas_udf("int")
        def cell(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, centroids.shape[1]))
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return pd.Series(((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)[None]).argmin(1).astype("int32"))

        return cell

    def nearest_cells(self, query: Sequence[float]) -> list[int]:
        q = np.asarray(query, float)
        if self.metric == "ip":
            return np.argsort(-(self.centroids @ q), kind="stable").tolist()
        if self.metric == "cosine":
            q = q / max(np.linalg.norm(q), 1e-300)
        return np.argsort(((self.centroids - q) ** 2).sum(axis=1), kind="stable").tolist()

    def search(self, query: Sequence[float], k: int, nprobe: int | None = None, where: str | None = None) -> DataFrame:
        nprobe = nprobe or self.probes(k, where)
        order, rows = self.nearest_cells(query), self.rows if where is None else self.rows.where(where)
        while True:
            probed = rows.where(F.col("cell").isin(order[:nprobe])) if nprobe < len(order) else rows
            if nprobe >= len(order) or probed.limit(k).count() >= k:
                return nearest(probed.drop("cell"), query, k, self.metric, self.vector, self.id_col, self.kind)
            nprobe *= 2

    def search_many(self, queries: DataFrame, k: int, nprobe: int | None = None, query_id: str = "qid", query_vector: str = "vector", digits: int = DIGITS) -> DataFrame:
        """(query_id, id, distance, rank): what ``search`` finds for each query, all in one pass over the rows. Each row is met by the queries that probe its cell."""
        least, cells = nprobe or self.probes(k), len(self.centroids)
        held = np.zeros(cells, np.int64)
        for row in self.rows.groupBy("cell").count().collect():
            held[row["cell"]] = row["count"]

        def reach(matrix: np.ndarray) -> np.ndarray:
            order = self._cell_order(matrix)
            seen, probed = np.cumsum(held[order], axis=1), np.full(len(matrix), min(least, cells))
            while (few := (probed < cells) & (seen[np.arange(len(matrix)), probed - 1] < k)).any():
                probed[few] = np.minimum(2 * probed[few], cells)
            meets = np.zeros((len(matrix), cells), bool)
            np.put_along_axis(meets, order, np.arange(cells)[None] < probed[:, None], axis=1)
            return meets

        return knn_join(queries, self.rows, k, self.metric, query_id, query_vector, self.id_col, self.vector, digits, reach=("cell", reach))

    def _cell_order(self, matrix: np.ndarray) -> np.ndarray:
        """The cells from near to far, by query."""
        if self.metric == "ip":
            return np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")
        if self.metric == "cosine":
            matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        return np.argsort((self.centroids * self.centroids).sum(1)[None] - 2 * matrix @ self.centroids.T, axis=1, kind="stable")

    def reconcile(self, data: DataFrame, path: str | None = None) -> IvfIndex:
        """The index of ``data`` as it is now: its rows, vectors and other columns, in cells around the same centroids."""
        assigned = data.withColumn("cell", self._cell(self.centroids, self.metric)(F.col(self.vector).cast("array<double>")))
        return IvfIndex(self._kept(assigned, path), self.centroids, self.metric, self.vector, self.id_col, self.kind, self.measured)


def recall(spark: SparkSession, index: IvfIndex, exact: DataFrame, queries: list[Sequence[float]] | DataFrame, k: int, nprobe: int | None = None) -> float:
    """The share of true neighbours that the index finds; ``queries``: vectors, or a table (qid, vector).

    Both sides answer all queries in one pass each, so neither jobs nor what the driver holds at once grow with the queries.
    """
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame([(n, [float(x) for x in q]) for n, q in enumerate(queries)], "qid long, vector array<double>")
    true = knn_join(queries, exact, k, index.metric, "qid", "vector", index.id_col, index.vector, DIGITS)
    met = true.join(index.search_many(queries, k, nprobe).select("qid", index.id_col), ["qid", index.id_col], "left_semi")
    return met.count() / (k * queries.count())
