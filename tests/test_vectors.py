"""Vector functions against hand-computed values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import register
from spindrift.functions import vectors as v


def value(spark, sql):
    return spark.range(1).select(F.expr(sql).alias("x")).first()["x"]


def arr(values, kind):
    return f"cast({v.literal(values)} as array<{v.TYPES[kind][0]}>)"


@pytest.mark.parametrize("metric,a,b,kind,want", [
    ("l2", [1, 0, 0], [0, 1, 0], "float4", 2.0), ("l2", [3, 4], [0, 0], "int1", 25.0), ("l2", [0, 0], [3, 4], "int4", 25.0), ("l2", [1, 1], [4, 5], "float8", 25.0),
    ("cosine", [1, 2], [1, 2], "float8", 0.0), ("cosine", [1, 0], [0, 1], "float4", 1.0), ("cosine", [1, 0], [-1, 0], "float4", 2.0), ("cosine", [0, 0], [1, 0], "float4", 1.0),
    ("ip", [2, 3], [4, 5], "float8", -23.0), ("ip", [1, 2], [3, 4], "int4", -11.0), ("l2", [1, 2], [2, 4], "float2", 5.0), ("ip", [3], [4], "int2", -12.0),
])
def test_distance(spark, metric, a, b, kind, want):
    assert value(spark, v.distance(arr(a, kind), arr(b, kind), metric, kind)) == pytest.approx(want, abs=1e-6)


def test_distance_guards(spark):
    with pytest.raises(Exception, match="vector dimensions do not match"):
        value(spark, v.distance(arr([1], "float4"), arr([1, 2], "float4"), "l2"))
    assert value(spark, v.distance("cast(null as array<float>)", arr([1], "float4"), "l2")) is None
    with pytest.raises(ValueError, match="unknown metric: x"):
        v.distance("a", "b", "x")
    with pytest.raises(ValueError, match="unknown vector type: y"):
        v.distance("a", "b", "l2", "y")


def test_single_precision_accumulates(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=40).astype(np.float32), rng.normal(size=40).astype(np.float32)
    want = np.float32(0)
    for x, y in zip(a, b):
        want = np.float32(want + (x - y) * (x - y))
    assert value(spark, v.distance(arr(a, "float4"), arr(b, "float4"), "l2")) == float(want)


def test_arithmetic(spark):
    assert value(spark, v.normalize(arr([3, 4], "float4"))) == pytest.approx([0.6, 0.8])
    assert value(spark, v.normalize(arr([3, 4], "int1"), "int1")) == pytest.approx([0.6, 0.8])
    assert value(spark, v.add(arr([1, 2], "float4"), arr([3, 4], "float4"))) == [4, 6]
    assert value(spark, v.scale(arr([1, -2], "float4"), "2.5D")) == [2.5, -5]
    assert value(spark, v.slice_(arr([0, 1, 2, 3], "float4"), "1", "3")) == [1, 2]
    assert value(spark, v.slice_(arr([0, 1], "float4"), "1", "1")) == []
    assert value(spark, v.quantize_int8(arr([2, -1], "float4"))) == [127, -64]
    assert value(spark, v.quantize_int8(arr([0, 0], "float4"))) == [0, 0]
    assert value(spark, v.add(arr([100, -100], "int1"), arr([100, -100], "int1"), "int1")) == [127, -128]
    assert value(spark, v.scale(arr([3, -3], "int2"), "0.5D", "int2")) == [1, -1]
    assert value(spark, v.scale(arr([3], "int2"), "double('NaN')", "int2")) == [0]
    with pytest.raises(Exception, match="cannot normalize a zero vector"):
        value(spark, v.normalize(arr([0, 0], "float4")))
    with pytest.raises(Exception, match="out of bounds for dimension 2"):
        value(spark, v.slice_(arr([0, 1], "float4"), "0", "3"))


def test_half_precision(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in np.concatenate([rng.normal(size=50), 10.0 ** rng.uniform(-9, 5, 100), [0, 65504, 65519, 65520, 70000, 5.96e-8, 2.9e-8]]) for x in (x, -x)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", F.expr(v.half("x")).alias("h")).collect()
    with np.errstate(over="ignore"):
        for r in rows:
            assert r["h"] == float(np.float16(r["x"])), r


@pytest.mark.parametrize("text,kind,want", [
    ("[1.0, 2.0, 3.0]", "float4", [1, 2, 3]), ("[1, 2, -3]", "float8", [1, 2, -3]), ("[]", "float4", []), ("[0, 127, -128, -1, 42, 128, 300]", "int1", [0, 127, -128, -1, 42, -128, 44]),
    ("[0, 32767, -32768]", "int2", [0, 32767, -32768]), ("[2147483648]", "int4", [-2147483648]), (" [1e2] ", "float8", [100]),
])
def test_from_json(spark, text, kind, want):
    assert value(spark, v.from_json(f"'{text}'", kind)) == want


@pytest.mark.parametrize("text,kind,message", [
    ('{"x": 1}', "float4", "expected a JSON array"), ("42", "float4", "expected a JSON array"), ("[1, 2,", "float4", "invalid JSON"), ('[1.0, "two", 3.0]', "float4", "is not a number"),
    ('["bad", 2]', "float4", "element 0 is not a number"), ("[1.0, null]", "float4", "is not a number"), ("[1e40]", "float4", "NaN or Inf"), ("[1.0]", "int1", "is not a number"), ('["NaN"]', "float4", "is not a number"),
])
def test_from_json_rejects(spark, text, kind, message):
    with pytest.raises(Exception, match=message):
        value(spark, v.from_json(f"'{text}'", kind))


def test_to_json_and_dims(spark):
    assert value(spark, v.to_json(arr([1, 2, 3], "float4"))) == "[1.0,2.0,3.0]"
    assert value(spark, v.to_json(arr([], "float4"))) == "[]"
    assert value(spark, v.dims(arr([1, 2], "float4"))) == 2
    assert value(spark, v.dims_binary("X'000102030405'", "float4")) == 1


def test_sql_surface(spark):
    names = register(spark)
    assert len(names) == 12
    sql = lambda s: spark.sql(f"SELECT {s} AS x").first()["x"]
    assert sql("vector_to_json(vector_from_json('[1.0, 2.0]', 'float4'), 'float4')") == "[1.0,2.0]"
    assert sql("vector_distance(array(1D, 0D), array(0.9D, 0.1D), 'cosine', 'float4')") == pytest.approx(0.006116, abs=1e-6)
    assert sql("vector_quantize_int8(array(2D, -1D), 'float4')") == [127, -64]
    assert sql("vector_slice(array(0D, 1D, 2D, 3D), 'float4', 1, 3)") == [1, 2]
    assert sql("vector_from_blob(vector_to_blob(array(1D, -2D), 'int2'), 'int2')") == [1, -2]
    with pytest.raises(Exception, match="unknown metric: nope"):
        sql("vector_distance(array(1D), array(1D), 'nope', 'float4')")
    assert math.isclose(sql("vector_normalize(array(3D, 4D), 'float8')")[0], 0.6)
