"""Vector functions as Spark SQL expressions over arrays.

Every function takes its arguments as SQL expressions and gives a SQL expression, so that Catalyst sees plain higher-order
functions: the DataFrame API wraps the text with ``expr``, and the SQL surface makes it the body of a session function. A
vector is an array whose element type follows from its type name; a NULL argument gives NULL.

Sums of all types but float8 accumulate in single precision, in order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type name -> (Spark element type, bytes of an element).
TYPES = {"float2": ("float", 2), "float4": ("float", 4), "float8": ("double", 8), "int1": ("tinyint", 1), "int2": ("smallint", 2), "int4": ("int", 4)}
METRICS = ("l2", "cosine", "ip")
FLOATS = ("float2", "float4", "float8")


def check_type(name: str) -> str:
    if name not in TYPES:
        raise ValueError(f"unknown vector type: {name}")
    return name


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise ValueError(f"unknown metric: {name}")
    return name


def literal(values: Iterable[float]) -> str:
    """A vector written out as SQL."""
    shown = [f"double('{float(v)!r}')" for v in values]
    return f"array({', '.join(shown)})" if shown else "cast(array() as array<double>)"


def col(sql: str) -> Column:
    return F.expr(sql)


def _range(name: str) -> tuple[int, int]:
    bits = 8 * TYPES[name][1]
    return -(1 << (bits - 1)), (1 << (bits - 1)) - 1


def half(x: str) -> str:
    """``x`` rounded to half precision, as a double; beyond its range, infinity."""
    step = f"pow(2D, greatest(floor(log2(abs({x}))), -14) - 10)"
    rounded = f"rint({x} / {step}) * {step}"
    return f"case when {x} = 0D or isnan({x}) or abs({x}) = double('Infinity') then {x} when abs({rounded}) > 65504D then signum({x}) * double('Infinity') else {rounded} end"


def narrowed(x: str, name: str) -> str:
    """A double as an element of a type: floats round, integers truncate towards zero and saturate, NaN becomes 0."""
    if name == "float2":
        return f"cast({half(x)} as float)"
    if name in FLOATS:
        return f"cast({x} as {TYPES[name][0]})"
    low, high = _range(name)
    return f"cast(case when isnan({x}) then 0D else greatest({low}D, least({high}D, {x})) end as {TYPES[name][0]})"


def _finite(x: str) -> str:
    return f"(not isnan({x}) and abs({x}) < double('Infinity'))"


def from_json(json: str, name: str) -> str:
    """A JSON array of numbers as a vector: integers wrap around, floats must stay finite."""
    check_type(name)
    items = f"from_json({json}, 'array<string>', map('mode', 'PERMISSIVE'))"
    number = r"^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$" if name in FLOATS else r"^-?(0|[1-9][0-9]*)$"
    raw = f"from_json({json}, 'array<{'double' if name in FLOATS else 'bigint'}>')"
    quoted = f"transform(from_json({json}, 'array<string>'), x -> x rlike '{number}')"
    if name in FLOATS:
        element = narrowed("x", name)
        made = f"transform({raw}, x -> if({_finite(f'cast({element} as double)')}, {element}, cast(raise_error('vector contains NaN or Inf') as {TYPES[name][0]})))"
    else:
        low, high = _range(name)
        span = high - low + 1
        made = f"transform({raw}, x -> cast(pmod(x + {-low}L, {span}L) - {-low}L as {TYPES[name][0]}))"
    bad = f"array_position({quoted}, false)"
    return (
        f"case when {json} is null then null"
        f" when not ltrim({json}) like '[%' then cast(raise_error('expected a JSON array') as array<{TYPES[name][0]}>)"
        f" when not rtrim({json}) like '%]' or {items} is null then cast(raise_error(concat('invalid JSON: ', {json})) as array<{TYPES[name][0]}>)"
        f" when {bad} > 0 or exists({items}, x -> x is null) or {raw} is null or exists({raw}, x -> x is null) or {json} rlike '[\\\\[,]\\\\s*\"'"
        f" then cast(raise_error(concat('element ', cast(greatest({bad}, 1) - 1 as string), ' is not a number')) as array<{TYPES[name][0]}>)"
        f" else {made} end"
    )


def to_json(v: str, name: str = "float4") -> str:
    check_type(name)
    return f"to_json({v})"


def dims(v: str) -> str:
    return f"cast(case when {v} is null then null else size({v}) end as bigint)"


def dims_binary(blob: str, name: str) -> str:
    return f"cast(octet_length({blob}) div {TYPES[check_type(name)][1]} as bigint)"


def _sum(values: str, kind: str) -> str:
    return f"aggregate({values}, cast(0 as {kind}), (s, z) -> cast(s + z as {kind}))"


def distance(a: str, b: str, metric: str, name: str = "float4") -> str:
    """Squared Euclidean distance, one minus the cosine (1 for a zero vector), or the negated inner product; double."""
    check_metric(metric), check_type(name)
    kind = "double" if name == "float8" else "float"
    x, y = f"cast({a} as array<{kind}>)", f"cast({b} as array<{kind}>)"
    dot = lambda p, q: _sum(f"zip_with({p}, {q}, (x, y) -> x * y)", kind)
    if metric == "l2":
        made = _sum(f"zip_with({x}, {y}, (x, y) -> (x - y) * (x - y))", kind)
    elif metric == "ip":
        made = f"-{dot(x, y)}"
    else:
        norms = f"cast(cast(sqrt({dot(x, x)}) as {kind}) * cast(sqrt({dot(y, y)}) as {kind}) as {kind})"
        made = f"if({norms} = 0, 1D, 1D - cast(cast({dot(x, y)} / {norms} as {kind}) as double))"
    return f"case when {a} is null or {b} is null then null when size({a}) != size({b}) then cast(raise_error('vector dimensions do not match') as double) else cast({made} as double) end"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once: Spark would evaluate it again wherever a lambda mentions it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def normalize(v: str, name: str = "float4") -> str:
    """Divided by the Euclidean norm; integers become float4."""
    kind = check_type(name) if name in FLOATS else "float4"
    norm = f"sqrt({_sum('transform(v_, x -> cast(x as double) * cast(x as double))', 'double')})"
    scaled = f"transform(transform(v_, x -> cast(x as double) / n_), x -> {narrowed('x', kind)})"
    fail = f"cast(raise_error('cannot normalize a zero vector') as array<{TYPES[kind][0]}>)"
    return let(v, "v_", let(norm, "n_", f"case when v_ is null then null when n_ = 0 then {fail} else {scaled} end"))


def _pairwise(a: str, b: str, sign: str, name: str) -> str:
    made = f"transform(zip_with({a}, {b}, (x, y) -> cast(x as double) {sign} cast(y as double)), x -> {narrowed('x', check_type(name))})"
    return f"case when {a} is null or {b} is null then null when size({a}) != size({b}) then cast(raise_error('vector dimensions do not match') as array<{TYPES[name][0]}>) else {made} end"


def add(a: str, b: str, name: str = "float4") -> str:
    return _pairwise(a, b, "+", name)


def sub(a: str, b: str, name: str = "float4") -> str:
    return _pairwise(a, b, "-", name)


def scale(v: str, factor: str, name: str = "float4") -> str:
    return f"transform(transform({v}, x -> cast(x as double) * cast({factor} as double)), x -> {narrowed('x', check_type(name))})"


def slice_(v: str, start: str, end: str, name: str = "float4") -> str:
    """Elements start to end - 1, counted from 0."""
    wrong = f"concat('slice [', {start}, ', ', {end}, ') out of bounds for dimension ', size({v}))"
    return f"case when {v} is null then null when {start} < 0 or {end} < {start} or {end} > size({v}) then cast(raise_error({wrong}) as array<{TYPES[check_type(name)][0]}>) else slice({v}, cast({start} as int) + 1, cast({end} - {start} as int)) end"


def quantize_int8(v: str, name: str = "float4") -> str:
    """Scaled so that the largest magnitude is 127, and rounded half away from zero."""
    check_type(name)
    top = "coalesce(array_max(transform(v_, x -> abs(cast(x as double)))), 0D)"
    scaled = "transform(v_, x -> cast(greatest(-127D, least(127D, round(cast(x as double) * (127D / t_)))) as tinyint))"
    return let(v, "v_", let(top, "t_", f"case when v_ is null then null when t_ = 0 then transform(v_, x -> cast(0 as tinyint)) else {scaled} end"))


def valid(v: str, dim: int, name: str) -> str:
    """SQL that gives the vector, or fails where its length is wrong or a float is not finite."""
    kind = TYPES[check_type(name)][0]
    finite = f"forall({v}, x -> x is not null and {_finite('cast(x as double)')})" if name in FLOATS else f"forall({v}, x -> x is not null)"
    return (
        f"case when {v} is null then cast(raise_error('vector column cannot be NULL') as array<{kind}>)"
        f" when size({v}) != {dim} then cast(raise_error(concat('expected {dim} dimensions, got ', size({v}))) as array<{kind}>)"
        f" when not {finite} then cast(raise_error('vector contains NaN or Inf') as array<{kind}>)"
        f" else transform({v}, x -> {narrowed('cast(x as double)', name)}) end"
    )
