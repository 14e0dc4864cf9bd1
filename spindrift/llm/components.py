"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import release, settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hang a node's larger neighbours on its smallest one. Small: hang the node and its smaller neighbours there.

    Neighbours are never gathered: the smallest one is an aggregate, combined before its shuffle, and is joined back. Spark may split that
    join where a node has very many edges.
    """
    around = _both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = around.join(lowest, "a")
    moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge (a, b) of long ids touches; a component is its smallest node."""
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    while True:
        old, edges = edges, settle(_star(_star(edges, large=True), large=False).distinct(), "edges")
        release(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = now
