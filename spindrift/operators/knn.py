"""Exact nearest neighbours: one query as a top-k plan, many queries as blocks of matrix products.

One query is ``orderBy(distance, id).limit(k)``: Spark keeps k rows per partition (TakeOrderedAndProject), and predicates stay
below it, down to the scan. Ties are settled by id.

Many queries meet the table in blocks: a block of queries of bounded size is broadcast, every partition answers it with
one matrix product per batch and keeps k rows per query, and the partial answers, k per query and partition, merge by
query. The table is never shuffled, and neither side has to be small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import check_metric, distance, literal
from spindrift.plans.knn_plan import KnnPlan, Predicate, plan

#: Bytes of query vectors broadcast at once.
QUERY_BLOCK_BYTES = 64 << 20
#: Distances computed at once: queries of a block times rows of a batch.
SCORES = 4 << 20


def with_distance(df: DataFrame, query: Sequence[float], metric: str = "l2", vector: str = "vector", kind: str = "float4") -> DataFrame:
    return df.withColumn("distance", F.expr(distance(f"`{vector}`", literal(query), metric, kind)))


def nearest(df: DataFrame, query: Sequence[float], k: int | None, metric: str = "l2", vector: str = "vector", id_col: str = "id", kind: str = "float4", digits: int | None = None) -> DataFrame:
    """The k nearest rows with ``distance``, nearest first; k None: all rows. ``digits``: distances are rounded before they are ordered."""
    found = with_distance(df, query, metric, vector, kind)
    if digits is not None:
        found = found.withColumn("distance", F.round("distance", digits) + 0.0)
    found = found.orderBy("distance", id_col)
    return found if k is None else found.limit(k)


def run_plan(df: DataFrame, query: Sequence[float], plan: KnnPlan, metric: str = "l2", vector: str = "vector", id_col: str = "id", kind: str = "float4", digits: int | None = None) -> DataFrame:
    for p in plan.before:
        df = df.where(p.sql())
    found = nearest(df, query, plan.k, metric, vector, id_col, kind, digits)
    for p in plan.after:
        found = found.where(p.sql())
    if plan.order_by and list(plan.order_by) != [("distance", True)]:
        found = found.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in plan.order_by], id_col)
    if plan.offset:
        found = found.offset(plan.offset)
    return found if plan.limit is None else found.limit(plan.limit)


def search(df: DataFrame, query: Sequence[float], metadata: Sequence[str] = (), where: Sequence[Predicate] = (), limit: int | None = None, order_by: Sequence[tuple[str, bool]] = (), offset: int = 0, metric: str = "l2", vector: str = "vector", id_col: str = "id", kind: str = "float4", digits: int | None = None) -> DataFrame:
    """A nearest-neighbour query with predicates, order and limit, under the rules of ``plans.knn_plan``."""
    return run_plan(df, query, plan(metadata, where, limit, order_by, offset), metric, vector, id_col, kind, digits)


def _scores(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ rows.T
    if metric == "ip":
        return -dots
    q2, r2 = (queries * queries).sum(axis=1)[:, None], (rows * rows).sum(axis=1)[None, :]
    if metric == "l2":
        return np.maximum(q2 + r2 - 2 * dots, 0)
    norms = np.sqrt(q2) * np.sqrt(r2)
    return np.where(norms > 0, 1 - dots / np.where(norms > 0, norms, 1), 1.0)


def knn_join(queries: DataFrame, data: DataFrame, k: int, metric: str = "l2", query_id: str = "qid", query_vector: str = "vector", id_col: str = "id", vector: str = "vector", digits: int = 6, exclude_same: bool = False, reach: tuple[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """(query_id, id_col, distance, rank): the k nearest rows of ``data`` for each query, ordered by rounded distance and id.

    ``exclude_same`` leaves out the row with the query's own id. ``reach``: a column of ``data``, from 0, and a function of the query
    matrix that says, by query and value of that column, whether they meet; others don't.
    """
    check_metric(metric)
    spark = queries.sparkSession
    own = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    row = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = 1 + (row["n"] or 0) * 8 * (row["d"] or 0) // QUERY_BLOCK_BYTES
    answers = None
    for b in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        got = part.toArrow()
        ids = np.asarray(got.column("q"))
        flat = np.asarray(got.column("v").combine_chunks().flatten()) if len(ids) else np.empty(0)
        matrix = flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 1))
        held = spark.sparkContext.broadcast((ids, matrix, reach[1](matrix) if reach and len(ids) else None))

        def answer(batches, held=held):
            ids, matrix, meets = held.value
            if not len(ids):
                return
            # The k best of each query so far; an infinite distance is an empty place.
            best, best_ids = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

            def meet(asked, rows, vectors):
                """Rows in order of id meet the queries at these places."""
                scores = np.round(_scores(matrix[asked], vectors, metric), digits) + 0.0
                if exclude_same:
                    scores[rows[None, :] == ids[asked][:, None]] = np.inf
                # Only queries that a row could better are sorted.
                closer = np.flatnonzero((scores <= best[asked, -1:]).any(axis=1))
                asked, scores = asked[closer], scores[closer]
                # A stable sort settles ties by id.
                top = np.argsort(scores, axis=1, kind="stable")[:, :k]
                all_scores = np.concatenate([best[asked], np.take_along_axis(scores, top, axis=1)], axis=1)
                all_ids = np.concatenate([best_ids[asked], rows[top]], axis=1)
                first = np.lexsort((all_ids, all_scores), axis=1)[:, :k]
                best[asked], best_ids[asked] = np.take_along_axis(all_scores, first, axis=1), np.take_along_axis(all_ids, first, axis=1)

            everyone = np.arange(len(ids))
            for batch in batches:
                rows, flat = np.asarray(batch.column(0)), np.asarray(batch.column(1).flatten())
                if not len(rows):
                    continue
                vectors, groups = flat.reshape(len(rows), -1), [(everyone, np.arange(len(rows)))]
                if meets is not None:
                    own = np.asarray(batch.column(2))
                    groups = [(np.flatnonzero(meets[:, value]), np.flatnonzero(own == value)) for value in np.unique(own)]
                for asked, places in groups:
                    step = max(1, SCORES // max(1, len(asked)))
                    for at in range(0, len(places) if len(asked) else 0, step):
                        some = places[at : at + step]
                        some = some[np.argsort(rows[some], kind="stable")]
                        meet(asked, rows[some], vectors[some])
            found = np.isfinite(best)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, found.sum(axis=1))), pa.array(best_ids[found]), pa.array(best[found])], ["q", "id", "distance"])

        columns = [F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *([F.col(reach[0]).cast("int").alias("at")] if reach else [])]
        some = data.select(*columns).mapInArrow(answer, "q long, id long, distance double")
        answers = some if answers is None else answers.unionByName(some)
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "distance", F.col("rank").cast("long").alias("rank"))
