"""A stream of vectors appended to a table batch by batch, and the best neighbours so far of a standing query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators import knn
from spindrift.sources.table import VectorTable


def append_stream(stream: DataFrame, table: VectorTable, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes one commit of the table, which records the batch's number: one that runs again is inserted once."""

    def insert(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            table.insert(batch, (checkpoint, epoch))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StandingQuery:
    """Keeps the k nearest of all batches seen: the old answer and a batch's own top k merge, so no batch is kept."""

    def __init__(self, query: Sequence[float], k: int, metric: str = "l2", vector: str = "vector", id_col: str = "id", kind: str = "float4") -> None:
        self.query, self.k, self.metric, self.vector, self.id_col, self.kind = query, k, metric, vector, id_col, kind
        self.best: list[tuple[float, int]] = []

    def see(self, batch: DataFrame, epoch: int = 0) -> None:
        found = knn.nearest(batch, self.query, self.k, self.metric, self.vector, self.id_col, self.kind)
        new = [(r["distance"], r[self.id_col]) for r in found.collect()]
        self.best = sorted({*self.best, *new})[: self.k]

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.see).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
