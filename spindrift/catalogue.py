"""The registered queries over the driver's tables, each with the SQL it is compared with.

Compared values are computed in double precision on both sides and rounded to six digits; single precision is covered by the tests.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import vectors as v
from spindrift.functions.registration import register
from spindrift.operators import ivf, knn
from spindrift.operators.ivf import IvfIndex
from spindrift.plans.knn_plan import Predicate
from spindrift.sources import codec
from spindrift.sources.table import Catalog
from spindrift.storage import shared_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_E = "embedding::DOUBLE[]"
_DUCK = {
    "l2": f"pow(list_distance({_E}, {_Q0}), 2)",
    "cosine": f"list_cosine_distance({_E}, {_Q0})",
    "ip": f"list_negative_inner_product({_E}, {_Q0})",
}


def _duck(metric: str) -> str:
    return f"round({_DUCK[metric]}, 6) + 0.0"


def _sql(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return found.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def _query(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return _vectors(spark, sf_dir).where(F.col("vec_id") == vec_id).first()["vector"]


def _rounded(df: DataFrame, metric: str, query: list[float]) -> DataFrame:
    """vec_id, label and the rounded distance, to order and compare by."""
    return knn.with_distance(df, query, metric, kind="float8").select("vec_id", "label", (F.round("distance", 6) + 0.0).alias("distance"))


def _top(df: DataFrame, metric: str, query: list[float], k: int) -> DataFrame:
    return _rounded(df, metric, query).orderBy("distance", "vec_id").limit(k)


def _add_metric(metric: str) -> None:
    def distances(spark, sf_dir):
        return _rounded(_vectors(spark, sf_dir), metric, _query(spark, sf_dir)).select("vec_id", "distance")

    def exact(spark, sf_dir):
        return _top(_vectors(spark, sf_dir), metric, _query(spark, sf_dir), 10).select("vec_id", "distance")

    QUERIES[f"distance_{metric}"], ORACLE_SQL[f"distance_{metric}"] = distances, f"SELECT vec_id, {_duck(metric)} AS distance FROM embeddings"
    QUERIES[f"knn_exact_{metric}"] = exact
    ORACLE_SQL[f"knn_exact_{metric}"] = f"SELECT vec_id, {_duck(metric)} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10"


for _metric in v.METRICS:
    _add_metric(_metric)


def _search(spark, sf_dir, **rules) -> DataFrame:
    """Through the library's planner; distances are rounded as in the SQL before they are ordered."""
    found = knn.search(_vectors(spark, sf_dir), _query(spark, sf_dir), ["label"], metric="l2", id_col="vec_id", kind="float8", digits=6, **rules)
    return found.select("vec_id", "distance")


_RANKED = f"SELECT vec_id, label, {_duck('l2')} AS distance FROM embeddings"


def _add_search(name: str, sql: str, **rules) -> None:
    QUERIES[name] = lambda spark, sf_dir: _search(spark, sf_dir, **rules)
    ORACLE_SQL[name] = sql


_add_search("knn_default_k100", f"SELECT vec_id, distance FROM ({_RANKED}) ORDER BY distance, vec_id LIMIT 100")
_add_search("knn_filtered_eq", f"SELECT vec_id, distance FROM ({_RANKED} WHERE label = 3) ORDER BY distance, vec_id LIMIT 5", where=[Predicate("label", "=", 3)], limit=5)
_add_search("knn_filtered_range", f"SELECT vec_id, distance FROM ({_RANKED} WHERE label < 5) ORDER BY distance, vec_id LIMIT 100", where=[Predicate("label", "<", 5)])
_add_search("knn_filtered_dup_pred", f"SELECT vec_id, distance FROM ({_RANKED} WHERE label > 2 AND label > 7) ORDER BY distance, vec_id LIMIT 7", where=[Predicate("label", ">", 2), Predicate("label", ">", 7)], limit=7)
_add_search("knn_limit_zero", f"SELECT vec_id, distance FROM ({_RANKED}) LIMIT 0", limit=0)
_add_search("knn_negative_limit", f"SELECT vec_id, distance FROM ({_RANKED})", limit=-1)
_add_search("knn_huge_limit", f"SELECT vec_id, distance FROM ({_RANKED})", limit=5_000_000_000)
_add_search("knn_offset", f"SELECT vec_id, distance FROM ({_RANKED}) ORDER BY distance, vec_id LIMIT 10 OFFSET 5", limit=10, offset=5)
_add_search("knn_order_desc", f"SELECT vec_id, distance FROM (SELECT * FROM ({_RANKED}) ORDER BY distance, vec_id LIMIT 100) ORDER BY distance DESC, vec_id DESC LIMIT 5", order_by=[("distance", False), ("vec_id", False)], limit=5)
_add_search("knn_postfilter", f"SELECT vec_id, distance FROM (SELECT * FROM ({_RANKED}) ORDER BY distance, vec_id LIMIT 100) WHERE label <> 3", where=[Predicate("label", "<>", 3)])


@_sql(f"SELECT count(*) AS n FROM (SELECT * FROM ({_RANKED}) ORDER BY distance, vec_id LIMIT 100)")
def knn_count(spark, sf_dir):
    return _search(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


def _add_join(name: str, every: int, k: int) -> None:
    def joined(spark, sf_dir):
        data = _vectors(spark, sf_dir)
        queries = data.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("qid"), "vector")
        return knn.knn_join(queries, data, k, "l2", id_col="vec_id")

    away = "round(pow(list_distance(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 2), 6) + 0.0"
    QUERIES[name] = joined
    ORACLE_SQL[name] = (
        f"SELECT qid, vec_id, distance, rank FROM (SELECT q.vec_id AS qid, d.vec_id AS vec_id, {away} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {away}, d.vec_id) AS rank"
        f" FROM embeddings q, embeddings d WHERE q.vec_id % {every} = 0) WHERE rank <= {k}"
    )


_add_join("knn_join_top3", 100, 3)
_add_join("knn_join_100", 20, 10)


def _exploded(df: DataFrame, made: str, kind: str = "double") -> DataFrame:
    value = F.round(F.col("x").cast("double"), 6) + 0.0 if kind == "double" else F.col("x").cast("long")
    return df.select("vec_id", F.posexplode(F.expr(made)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), value.alias("x"))


def _duck_exploded(made: str, kind: str = "double", source: str = "embeddings") -> str:
    value = "round(x::DOUBLE, 6) + 0.0" if kind == "double" else "CAST(x AS BIGINT)"
    return f"SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, {value} AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (SELECT vec_id, {made} AS v FROM {source}))"


_norm = f"sqrt(list_sum(list_transform({_E}, lambda x: x * x)))"
_pair = f"list_zip({_E}, {_Q0})"


@_sql(_duck_exploded(f"list_transform({_E}, lambda x: x / {_norm})"))
def vector_normalize(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.normalize("vector", "float8"))


@_sql(_duck_exploded(f"list_transform({_pair}, lambda p: p[1] + p[2])"))
def vector_add(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.add("vector", v.literal(_query(spark, sf_dir)), "float8"))


@_sql(_duck_exploded(f"list_transform({_pair}, lambda p: p[1] - p[2])"))
def vector_sub(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.sub("vector", v.literal(_query(spark, sf_dir)), "float8"))


@_sql(_duck_exploded(f"list_transform({_E}, lambda x: x * 2.5)"))
def vector_scale(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.scale("vector", "2.5D", "float8"))


@_sql(_duck_exploded(f"list_slice({_E}, 9, 16)"))
def vector_slice(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.slice_("vector", "8", "16", "float8"))


@_sql(_duck_exploded(f"list_transform({_E}, lambda x: round(x * (127.0 / list_max(list_transform({_E}, lambda y: abs(y))))))", "long"))
def vector_quantize_int8(spark, sf_dir):
    return _exploded(_vectors(spark, sf_dir), v.quantize_int8("vector", "float8"), "long")


@_sql("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings")
def vector_dims(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.expr(v.dims("vector")).alias("dims"))


def _add_typed(name: str, factor: float) -> None:
    """Distances of vectors held in another element type; the oracle computes them from the same integers."""
    whole = name.startswith("int")

    def typed(spark, sf_dir):
        kind = v.TYPES[name][0]
        made = f"transform(vector, x -> cast({f'rint(x * {factor}D)' if whole else 'x'} as {kind}))"
        df = _vectors(spark, sf_dir).select("vec_id", F.expr(made).alias("t"))
        query = v.literal(float(round(x * factor)) if whole else x for x in _query(spark, sf_dir))
        df = df.select("vec_id", F.expr(v.distance("cast(t as array<double>)", query, "l2", "float8")).alias("distance"))
        # Squares of integers are whole numbers, and need no rounding.
        return df if whole else df.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))

    QUERIES[f"distance_{name}"] = typed
    cast = f"list_transform({{}}, lambda x: round_even(x * {factor}, 0))" if whole else "{}"
    squares = f"list_sum(list_transform(list_zip({cast.format(_E)}, {cast.format(_Q0)}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ORACLE_SQL[f"distance_{name}"] = f"SELECT vec_id, {squares if whole else f'round({squares}, 6) + 0.0'} AS distance FROM embeddings"


for _name, _factor in (("int1", 100), ("int2", 10_000), ("int4", 1_000_000), ("float8", 1)):
    _add_typed(_name, _factor)


@_sql(None)
def distance_float2(spark, sf_dir):
    """Half-precision vectors; the tests hold the rounding against numpy's."""
    half = f"transform(vector, x -> {v.narrowed('x', 'float2')})"
    df = _vectors(spark, sf_dir).select("vec_id", F.expr(half).alias("t"))
    return df.select("vec_id", F.expr(v.distance("t", v.literal(_query(spark, sf_dir)), "l2", "float2")).alias("distance"))


@_sql("SELECT vec_id, CAST(64 AS BIGINT) AS dims, true AS same FROM embeddings")
def json_roundtrip(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.expr(v.to_json("embedding")).alias("j"))
    back = df.select("vec_id", "embedding", F.expr(v.from_json("j", "float4")).alias("w"))
    return back.select("vec_id", F.size("w").cast("long").alias("dims"), (F.col("w") == F.col("embedding")).alias("same"))


@_sql("SELECT vec_id, CAST(256 AS BIGINT) AS n_bytes, true AS same FROM embeddings")
def binary_roundtrip(spark, sf_dir):
    df = codec.pack(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "float4", "embedding", "packed")
    back = codec.unpack(df, "float4", "packed", "w")
    return back.select("vec_id", F.octet_length("packed").cast("long").alias("n_bytes"), (F.col("w") == F.col("embedding")).alias("same"))


@_sql("SELECT vec_id - (SELECT min(vec_id) FROM embeddings) AS position, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def arrow_roundtrip(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    back = codec.ipc_to_vectors(spark, codec.vectors_to_ipc(df, "float4"), "float4")
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return back.select("position", (F.round(total, 6) + 0.0).alias("total"))


@_sql("SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(NULL AS DOUBLE) AS distance FROM embeddings")
def full_scan(spark, sf_dir):
    return _seeded(spark, sf_dir).scan().select(F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"), "distance")


@_sql("SELECT count(*) AS n, max(vec_id) AS high FROM embeddings")
def table_count(spark, sf_dir):
    return _vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.max("vec_id").alias("high"))


@_sql("SELECT vec_id, label FROM embeddings WHERE label = 4 AND vec_id > 100")
def scan_filter(spark, sf_dir):
    return _vectors(spark, sf_dir).where("label = 4 and vec_id > 100").select("vec_id", "label")


@_sql("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def lookup_id(spark, sf_dir):
    return _seeded(spark, sf_dir).rows().where("id = 7").select(F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"))


@_sql(f"SELECT vec_id, {_duck('cosine')} AS distance FROM embeddings")
def sql_functions(spark, sf_dir):
    """The same through the SQL surface."""
    register(spark)
    df, name = _vectors(spark, sf_dir), f"v_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    query = v.literal(_query(spark, sf_dir))
    return spark.sql(f"SELECT vec_id, round(vector_distance(vector, {query}, 'cosine', 'float8'), 6) + 0D AS distance FROM {name}")


def _catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, shared_path(spark, "vectors"))


def _seeded(spark, sf_dir, mode: str = "exact"):
    rows = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "vector", "label")
    table = _catalog(spark).create("emb", dim=64, type="float8", mode=mode, metadata="label INTEGER")
    table.insert(rows)
    return table


def _state(table) -> DataFrame:
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return table.rows().select("id", F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label"), (F.round(total, 6) + 0.0).alias("total"))


_STATE = "SELECT vec_id AS id, CAST(label AS BIGINT) AS label, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings"


@_sql(f"{_STATE} UNION ALL SELECT max(vec_id) + 1, -1, 64.0 FROM embeddings")
def crud_insert(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.insert(spark.createDataFrame([([1.0] * 64,)], "vector array<double>"))
    return _state(table)


@_sql(f"SELECT id, CASE WHEN id < 10 THEN 99 ELSE label END AS label, total FROM ({_STATE})")
def crud_update(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.update("id < 10", label="99")
    return _state(table)


@_sql(f"SELECT CASE WHEN id = 3 THEN 1000003 ELSE id END AS id, label, total FROM ({_STATE})")
def crud_update_id(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.update("id = 3", id="id + 1000000")
    return _state(table)


@_sql(f"SELECT * FROM ({_STATE}) WHERE label <> 5")
def crud_delete(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.delete("label = 5")
    return _state(table)


@_sql(_STATE)
def crud_rollback(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.begin()
    table.delete("label < 5")
    table.rollback()
    return _state(table)


@_sql(f"SELECT * FROM ({_STATE}) WHERE label <> 1")
def crud_savepoint(spark, sf_dir):
    table = _seeded(spark, sf_dir)
    table.begin()
    table.delete("label = 1")
    at = table.savepoint()
    table.delete("label = 2")
    table.rollback_to(at)
    table.commit()
    return _state(table)


@_sql("SELECT count(*) AS rows, CAST(64 AS BIGINT) AS dim, 'float8' AS type, 'l2' AS metric, 'exact' AS mode, CAST(64 AS BIGINT) AS ef_search FROM embeddings")
def index_info(spark, sf_dir):
    info = json.loads(_seeded(spark, sf_dir).index_info())
    return spark.createDataFrame([[info[k] for k in ("rows", "dim", "type", "metric", "mode", "ef_search")]], "rows long, dim long, type string, metric string, mode string, ef_search long")


@_sql("SELECT count(*) AS n FROM embeddings")
def rebuild_count(spark, sf_dir):
    return spark.createDataFrame([[_seeded(spark, sf_dir, "hnsw").rebuild_index()]], "n long")


@_sql(ORACLE_SQL["knn_exact_l2"])
def ivf_knn(spark, sf_dir):
    """Through the index, with every cell probed."""
    index = IvfIndex.build(_vectors(spark, sf_dir), cells=8, id_col="vec_id", kind="float8")
    found = index.search(_query(spark, sf_dir), 12, nprobe=8)
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance")).orderBy("distance", "vec_id").limit(10)


@_sql("SELECT round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings")
def arrow_streams(spark, sf_dir):
    """A stream for each partition, written and read on the executors."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    back = codec.streams_to_vectors(codec.ipc_streams(df, "float4", 64), "float4")
    return back.select((F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6) + 0.0).alias("total"))


@_sql(f"SELECT row_number() OVER (ORDER BY id) AS id, CAST(-1 AS BIGINT) AS label, total FROM ({_STATE})")
def insert_arrow(spark, sf_dir):
    """One table's vectors exported, and inserted into another, which numbers them."""
    stream = _seeded(spark, sf_dir).export_arrow()
    table = _catalog(spark).create("copy", dim=64, type="float8", mode="exact", metadata="label INTEGER")
    table.insert_arrow(stream)
    return _state(table)


@_sql(_STATE)
def insert_binary(spark, sf_dir):
    """Vectors inserted as packed bytes."""
    packed = codec.pack(_vectors(spark, sf_dir), "float8", "vector", "vector")
    table = _catalog(spark).create("bytes", dim=64, type="float8", mode="exact", metadata="label INTEGER")
    table.insert(packed.select(F.col("vec_id").alias("id"), "vector", "label"))
    return _state(table)


def _through_index(table, query) -> DataFrame:
    found = table.search_index(query, 12, nprobe=table.config.m)
    return found.select(F.col("id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance")).orderBy("distance", "vec_id").limit(10)


@_sql(f"SELECT vec_id, distance FROM ({_RANKED} WHERE vec_id > 5) ORDER BY distance, vec_id LIMIT 10")
def index_after_delete(spark, sf_dir):
    """A search of the index after rows that it held are gone."""
    table = _seeded(spark, sf_dir, "hnsw")
    table.rebuild_index()
    table.delete("id <= 5")
    return _through_index(table, _query(spark, sf_dir))


@_sql(f"SELECT vec_id, distance FROM (SELECT vec_id, distance FROM ({_RANKED}) UNION ALL SELECT 1000000, 0.0) ORDER BY distance, vec_id LIMIT 10")
def index_after_insert(spark, sf_dir):
    table, query = _seeded(spark, sf_dir, "hnsw"), _query(spark, sf_dir)
    table.rebuild_index()
    table.insert(spark.createDataFrame([(1_000_000, query, 0)], "id long, vector array<double>, label long"))
    return _through_index(table, query)


@_sql(ORACLE_SQL["knn_exact_l2"])
def index_after_rollback(spark, sf_dir):
    table, query = _seeded(spark, sf_dir, "hnsw"), _query(spark, sf_dir)
    table.rebuild_index()
    table.begin()
    table.delete("label < 5")
    table.search_index(query, 3).collect()
    table.rollback()
    return _through_index(table, query)


@_sql(ORACLE_SQL["knn_exact_l2"])
def index_after_reopen(spark, sf_dir):
    table = _seeded(spark, sf_dir, "hnsw")
    table.rebuild_index()
    return _through_index(Catalog(spark, table.catalog.root).open("emb"), _query(spark, sf_dir))


@_sql("SELECT count(*) AS queries, true AS some_cells_only, true AS recall_reached FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf_dir):
    """Whether default probes, fewer than all cells, find 0.9 of the ten nearest of every hundredth vector."""
    rows = _vectors(spark, sf_dir)
    index = IvfIndex.build(rows, cells=16, id_col="vec_id", kind="float8", path=shared_path(spark, "ivf"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vector")
    found = ivf.recall(spark, index, rows, queries, 10)
    return spark.createDataFrame([(queries.count(), index.probes(10) < len(index.centroids), found >= 0.9)], "queries long, some_cells_only boolean, recall_reached boolean")


@_sql(f"SELECT vec_id, distance FROM ({_RANKED} WHERE label = 3) ORDER BY distance, vec_id LIMIT 5")
def knn_match(spark, sf_dir):
    """A table's rows by a match and a predicate."""
    table = _seeded(spark, sf_dir)
    found = table.select([Predicate("vector", "knn_match", _query(spark, sf_dir)), Predicate("label", "=", 3)], limit=5)
    return found.select(F.col("id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


@_sql(f"SELECT vec_id, label, distance FROM ({_RANKED} WHERE label <> 3) ORDER BY distance, vec_id LIMIT 5")
def sql_knn(spark, sf_dir):
    """A search from SQL: the table function of a vector table, over its rows and over those that pass a predicate."""
    table, query = _seeded(spark, sf_dir), _query(spark, sf_dir)
    table.delete("label = 3")
    name = table.register_sql(f"v_{uuid.uuid4().hex[:8]}")
    return spark.sql(f"SELECT id AS vec_id, CAST(label AS INT) AS label, round(distance, 6) + 0D AS distance FROM {name}_knn({v.literal(query)}, 5)")


_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789 ,.?"


@_sql(
    "WITH f AS (SELECT doc_id, list_transform(range(1, 41), lambda i: CAST(length(lower(text)) - length(replace(lower(text), substr('" + _CHARS + "', i, 1), '')) AS DOUBLE) / greatest(strlen(text), 1)) AS v FROM documents WHERE text IS NOT NULL),"
    " u AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM f),"
    " w AS (SELECT doc_id, list_transform(v, lambda x: x / n) AS v FROM u WHERE n > 0)"
    " SELECT doc_id, round(list_cosine_distance(v, (SELECT v FROM w ORDER BY doc_id LIMIT 1)), 6) + 0.0 AS distance FROM w ORDER BY distance, doc_id LIMIT 10"
)
def doc_char_freq_knn(spark, sf_dir):
    """Documents by the frequencies of their characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.lower("text").rlike("[a-z0-9 ,.?]"))

    def frequencies(rows: DataFrame) -> DataFrame:
        """One pass over the characters: each is a row, combined by document before the shuffle."""
        chars = rows.select("doc_id", F.octet_length("text").alias("size"), F.explode(F.split(F.lower("text"), "")).alias("char")).where(F.col("char").isin(list(_CHARS)))
        counts = chars.groupBy("doc_id", "size", "char").count()
        share = [F.coalesce(F.sum(F.when(F.col("char") == c, F.col("count"))), F.lit(0)).cast("double") / F.greatest("size", F.lit(1)) for c in _CHARS]
        return counts.groupBy("doc_id", "size").agg(F.array(*share).alias("raw")).select("doc_id", F.expr(v.normalize("raw", "float8")).alias("vector"))

    df, query = frequencies(docs), frequencies(docs.orderBy("doc_id").limit(1)).first()["vector"]
    found = knn.with_distance(df, query, "cosine", kind="float8").select("doc_id", (F.round("distance", 6) + 0.0).alias("distance"))
    return found.orderBy("distance", "doc_id").limit(10)


# What users of a SQL host run over the same tables: plain Spark.


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_sql(
    "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, count(*) AS n, round(avg(l_extendedprice), 4) AS avg_price"
    " FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def host_pricing_summary(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


@_sql("SELECT r_name, n_name, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def host_join_count(spark, sf_dir):
    c, n, r = (_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_customers"))


@_sql("SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) WHERE rank <= 2")
def host_window_top(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    return _vectors(spark, sf_dir).select("label", "vec_id", rank.alias("rank")).where("rank <= 2")


@_sql("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY ALL")
def host_semi_join(spark, sf_dir):
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_sql("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def host_anti_join(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@_sql("SELECT coalesce(label, -1) AS label, count(*) AS n, count(DISTINCT vec_id % 7) AS sevenths FROM embeddings GROUP BY CUBE (label)")
def host_cube(spark, sf_dir):
    return _vectors(spark, sf_dir).cube("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("vec_id") % 7).alias("sevenths")).withColumn("label", F.coalesce("label", F.lit(-1)))


@_sql("SELECT n_nationkey AS k FROM nation INTERSECT SELECT c_nationkey FROM customer")
def host_set_ops(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).intersect(_table(spark, sf_dir, "customer").select("c_nationkey"))


@_sql("SELECT typeof_ AS kind, count(*) AS n FROM (SELECT CASE WHEN label IS NULL THEN 'null' ELSE CAST(label % 2 AS VARCHAR) END AS typeof_ FROM embeddings) GROUP BY ALL")
def host_cast_null(spark, sf_dir):
    kind = F.when(F.col("label").isNull(), "null").otherwise((F.col("label") % 2).cast("string"))
    return _vectors(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@_sql("SELECT n_name, count(c_custkey) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS without_customer FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY ALL")
def host_outer_join(spark, sf_dir):
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    return n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_name").agg(F.count("c_custkey").alias("n"), F.sum(F.col("c_custkey").isNull().cast("long")).alias("without_customer")).select("n_name", "n", "without_customer")


@_sql("SELECT a.n_name AS below, b.n_name AS above FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def host_range_join(spark, sf_dir):
    a, b = _table(spark, sf_dir, "nation").alias("a"), _table(spark, sf_dir, "nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("below"), F.col("b.n_name").alias("above"))


@_sql(
    "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END)"
    " OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type <> 'purchase'"
)
def host_as_of(spark, sf_dir):
    """For each other event of a user, the highest purchase so far."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    found = _table(spark, sf_dir, "events").withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(before))
    return found.where("event_type <> 'purchase'").select("event_id", "last_purchase")


@_sql("SELECT coalesce(o_orderstatus, '-') AS status, coalesce(o_orderpriority, '-') AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def host_rollup(spark, sf_dir):
    found = _table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.coalesce("o_orderstatus", F.lit("-")).alias("status"), F.coalesce("o_orderpriority", F.lit("-")).alias("priority"), "n")


@_sql("SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def host_grouping_sets(spark, sf_dir):
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("host_lineitem")
    return spark.sql("SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n FROM host_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")


@_sql("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, upper(substr(o_orderpriority, 1, 3)) AS p, count(*) AS n FROM orders GROUP BY ALL")
def host_dates_and_strings(spark, sf_dir):
    day = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").groupBy(F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m"), F.upper(F.substring("o_orderpriority", 1, 3)).alias("p")).agg(F.count(F.lit(1)).alias("n"))


@_sql("SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 2 UNION SELECT r_regionkey FROM region EXCEPT SELECT 3")
def host_union_except(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation").where("n_regionkey < 2"), _table(spark, sf_dir, "region")
    return nation.select(F.col("n_nationkey").alias("k")).union(region.select("r_regionkey")).distinct().exceptAll(spark.createDataFrame([(3,)], "k int"))
