"""The vector functions as SQL functions of a session: vector_distance(a, b, 'cosine', 'float4') and so on.

Vectors are arrays of doubles on this surface, rounded to what their type holds; packed bytes go through the ``_blob``
functions. The type and metric names are constants in practice, so Catalyst folds the choice between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from spindrift.functions import vectors as v


def _by(argument: str, names, make: Callable[[str], str], kind: str, what: str) -> str:
    ways = " ".join(f"when '{n}' then cast({make(n)} as {kind})" for n in names)
    return f"case {argument} {ways} else cast(raise_error(concat('unknown {what}: ', {argument})) as {kind}) end"


def _typed(make: Callable[[str], str], kind: str = "array<double>") -> str:
    return _by("type", v.TYPES, make, kind, "vector type")


def definitions() -> dict[str, str]:
    """Name -> signature and body, as CREATE TEMPORARY FUNCTION takes them."""
    vec = "ARRAY<DOUBLE>"
    return {
        "vector_from_json": f"(json STRING, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.from_json('json', n))}",
        "vector_to_json": f"(a {vec}, type STRING) RETURNS STRING RETURN {_typed(lambda n: f'to_json(cast(a as array<{v.TYPES[n][0]}>))', 'string')}",
        "vector_dims": f"(a {vec}, type STRING) RETURNS BIGINT RETURN {_typed(lambda n: v.dims('a'), 'bigint')}",
        "vector_distance": f"(a {vec}, b {vec}, metric STRING, type STRING) RETURNS DOUBLE RETURN "
        + _by("metric", v.METRICS, lambda m: f"if(type = 'float8', {v.distance('a', 'b', m, 'float8')}, {v.distance('a', 'b', m, 'float4')})", "double", "metric"),
        "vector_normalize": f"(a {vec}, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.normalize('a', n))}",
        "vector_add": f"(a {vec}, b {vec}, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.add('a', 'b', n))}",
        "vector_sub": f"(a {vec}, b {vec}, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.sub('a', 'b', n))}",
        "vector_scale": f"(a {vec}, factor DOUBLE, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.scale('a', 'factor', n))}",
        "vector_slice": f"(a {vec}, type STRING, start BIGINT, stop BIGINT) RETURNS {vec} RETURN {_typed(lambda n: v.slice_('a', 'start', 'stop', n))}",
        "vector_quantize_int8": f"(a {vec}, type STRING) RETURNS {vec} RETURN {_typed(lambda n: v.quantize_int8('a', n))}",
    }


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; the names."""
    from spindrift.sources.codec import pack_udf, unpack_udf

    found = definitions()
    for name, body in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("vector_to_blob", pack_udf())
    spark.udf.register("vector_from_blob", unpack_udf())
    return [*found, "vector_to_blob", "vector_from_blob"]
