"""Vectors at the edges of Spark: packed little-endian bytes, and Arrow IPC streams of fixed-size lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.vectors import TYPES, check_type

#: Type name -> numpy type of packed bytes, Arrow type.
WIRE = {"float2": ("<f2", pa.float16()), "float4": ("<f4", pa.float32()), "float8": ("<f8", pa.float64()), "int1": ("<i1", pa.int8()), "int2": ("<i2", pa.int16()), "int4": ("<i4", pa.int32())}

#: Bytes of vectors in a stream that is made or read in one place.
MAX_STREAM = 1 << 30


def pack_udf():
    """(array, type) -> packed bytes."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v).astype(WIRE[check_type(t)][0]).tobytes() for v, t in zip(vectors, types)], dtype=object)

    return pack


def unpack_udf():
    """(packed bytes, type) -> array of doubles; bytes that make no whole element are left."""

    @F.pandas_udf("array<double>")
    def unpack(blobs: pd.Series, types: pd.Series) -> pd.Series:
        def one(blob, kind):
            wire = np.dtype(WIRE[check_type(kind)][0])
            return None if blob is None else np.frombuffer(blob, wire, len(blob) // wire.itemsize).astype(np.float64)

        return pd.Series([one(b, t) for b, t in zip(blobs, types)], dtype=object)

    return unpack


def pack(df: DataFrame, name: str, col: str, to: str) -> DataFrame:
    return df.withColumn(to, pack_udf()(F.col(col), F.lit(check_type(name))))


def unpack(df: DataFrame, name: str, col: str, to: str) -> DataFrame:
    kind = TYPES[check_type(name)][0]
    return df.withColumn(to, unpack_udf()(F.col(col), F.lit(name)).cast(f"array<{kind}>"))


def vectors_to_ipc(vectors: DataFrame, name: str, order: str = "id", col: str = "vector") -> bytes:
    """One Arrow IPC stream of one column ``vector``, in order of id, made on the driver; no vectors, no bytes.

    More than MAX_STREAM bytes of vectors are refused: ``ipc_streams`` writes those.
    """
    size = vectors.agg(F.sum(F.size(col))).first()[0] or 0
    if size * TYPES[check_type(name)][1] > MAX_STREAM:
        raise ValueError(f"{size * TYPES[name][1]} bytes of vectors are too many for one stream; use ipc_streams")
    table = vectors.orderBy(order).select(col).toArrow()
    if not table.num_rows:
        return b""
    rows = table.column(0).combine_chunks()
    dim = len(rows[0])
    flat = pa.array(np.asarray(rows.flatten()).astype(WIRE[check_type(name)][0]), WIRE[name][1])
    batch = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(flat, dim)], schema=pa.schema([pa.field("vector", pa.list_(WIRE[name][1], dim), nullable=False)]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ipc_streams(vectors: DataFrame, name: str, dim: int, order: str = "id", col: str = "vector") -> DataFrame:
    """The same for tables of any size: one stream per partition of an ordered table, with its number."""
    wire, kind = WIRE[check_type(name)]

    def run(batches):
        from pyspark import TaskContext

        schema = pa.schema([pa.field("vector", pa.list_(kind, dim), nullable=False)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            for batch in batches:
                flat = pa.array(np.asarray(batch.column(0).flatten()).astype(wire), kind)
                out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(flat, dim)], schema=schema))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "stream"])

    return vectors.repartitionByRange(order).sortWithinPartitions(order).select(col).mapInArrow(run, "part int, stream binary")


def streams_to_vectors(streams: DataFrame, name: str) -> DataFrame:
    """(part, position, vector) of a table of streams, read where they lie."""
    kind = TYPES[check_type(name)][0]

    def run(batches):
        for batch in batches:
            for part, stream in zip(batch.column("part").to_pylist(), batch.column("stream").to_pylist()):
                at = 0
                for piece in pa.ipc.open_stream(stream):
                    rows = piece.column(0)
                    values = np.asarray(rows.flatten()).astype(np.float32 if name == "float2" else WIRE[name][0])
                    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.type.list_size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(np.arange(at, at + len(rows))), pa.ListArray.from_arrays(ends, pa.array(values))], ["part", "position", "vector"])
                    at += len(rows)

    return streams.select("part", "stream").mapInArrow(run, f"part int, position long, vector array<{kind}>")


def ipc_to_vectors(spark: SparkSession, stream: bytes, name: str) -> DataFrame:
    """Column 0 of every batch as (position, vector). It must be a fixed-size list of the type's elements."""
    kind = WIRE[check_type(name)][1]
    schema = f"position long, vector array<{TYPES[name][0]}>"
    if not stream:
        return spark.createDataFrame([], schema)
    table = pa.ipc.open_stream(stream).read_all()
    column = table.column(0).combine_chunks()
    if not pa.types.is_fixed_size_list(column.type):
        raise ValueError("arrow error: expected FixedSizeListArray")
    if column.type.value_type != kind:
        raise ValueError(f"arrow error: expected {kind} elements, got {column.type.value_type}")
    values = np.asarray(column.flatten()).astype(np.float32 if name == "float2" else WIRE[name][0])
    lists = pa.FixedSizeListArray.from_arrays(pa.array(values), column.type.list_size).cast(pa.list_(pa.array(values).type))
    return spark.createDataFrame(pa.table({"position": pa.array(np.arange(len(column))), "vector": lists})).select("position", F.col("vector").cast(f"array<{TYPES[name][0]}>").alias("vector"))
