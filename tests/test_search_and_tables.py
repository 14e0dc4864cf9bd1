"""Search rules, tables, transactions, codecs and the index."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.operators import knn
from spindrift.operators.ivf import IvfIndex, recall
from spindrift.plans.knn_plan import DEFAULT_K, Predicate, plan
from spindrift.sources import codec
from spindrift.sources.table import Catalog, Config


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/tables")


def rows(spark, data, extra=""):
    return spark.createDataFrame(data, f"vector array<double>{extra}")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_plan_rules():
    p = Predicate
    assert plan([], limit=7).k == 7
    assert plan(["a"], [p("a", "=", 1)], 7).before and plan(["a"], [p("a", "=", 1)], 7).k == 7
    assert plan([], limit=7, order_by=[("distance", True)]).k == 7
    assert plan([], limit=7, order_by=[("distance", False)]).k == DEFAULT_K
    assert plan(["a"], [p("a", "!=", 1)], 7).k == DEFAULT_K and plan(["a"], [p("id", "=", 1)], 7).after
    assert plan([]).k == DEFAULT_K and plan([], limit=-1).k is None and plan([], limit=5_000_000_000).k is None
    assert plan([], limit=3, offset=4).k == 7


def test_basis_search(spark, catalog):
    t = catalog.create("emb", dim=3)
    t.insert(rows(spark, [([1.0, 0.0, 0.0],), ([0.0, 1.0, 0.0],), ([0.0, 0.0, 1.0],)]))
    assert ids(t.knn([0.9, 0.1, 0.0], 2)) == [1, 2]
    assert t.scan().where("distance is null").count() == 3
    with pytest.raises(ValueError, match="vector dimensions do not match"):
        t.knn([1.0], 2)
    for bad, message in (([1.0, 2.0], "expected 3 dimensions, got 2"), ([1.0, float("nan"), 3.0], "NaN or Inf")):
        with pytest.raises(Exception, match=message):
            t.insert(rows(spark, [(bad,)]))
    assert t.rows().count() == 3


@pytest.mark.parametrize("kind", ["float2", "float4", "float8", "int1", "int2", "int4"])
def test_type_matrix(spark, kind):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [9.0, 9.0, 9.0, 9.0])], "id long, vector array<double>")
    for metric in ("l2", "cosine"):
        assert ids(knn.nearest(df, [1, 2, 3, 5], 1, metric, kind=kind)) == [1]


def test_filters_run_before_the_search(spark, catalog):
    t = catalog.create("fk", dim=2, metadata='"label TEXT, score REAL"')
    near = [([0.01 * i, 0.0], "b", float(i)) for i in range(150)]
    t.insert(rows(spark, near + [([float(i), 50.0], "a", 1000.0 + i) for i in range(5)], ", label string, score double"))
    assert t.knn([0.0, 0.0], 3, [Predicate("label", "=", "a")]).count() == 3
    assert ids(t.knn([0.0, 0.0], 9, [Predicate("score", ">", 1001.0), Predicate("score", ">", 1003.0)])) == [155]
    assert ids(t.knn([0.0, 0.0], 2, order_by=[("distance", False)])) == [100, 99]
    assert t.knn([0.0, 0.0], 9, [Predicate("label", "!=", "b")]).count() == 0
    assert t.knn([0.0, 0.0], 0).count() == 0 and t.knn([0.0, 0.0], -1).count() == 155 and t.knn([0.0, 0.0]).count() == DEFAULT_K
    text = t.knn([0.0, 0.0], 3, [Predicate("label", "=", "a")])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "PushedFilters: [IsNotNull(label), EqualTo(label,a)]" in text


def test_crud_and_transactions(spark, catalog):
    t = catalog.create("t", dim=2, metadata="label TEXT")
    assert t.insert(rows(spark, [([float(i), 0.0], "x") for i in range(4)], ", label string")) == 4
    with pytest.raises(ValueError, match="UNIQUE constraint failed"):
        t.insert(spark.createDataFrame([(2, [0.0, 0.0])], "id long, vector array<double>"))
    t.update("id = 2", vector="array(9D, 9D)", label="null")
    assert t.rows().where("label is null").select("vector").first()[0] == [9.0, 9.0]
    with pytest.raises(Exception, match="cannot be NULL"):
        t.update("id = 1", vector="null")
    t.delete("id = 4")
    t.insert(rows(spark, [([5.0, 5.0],)]))
    assert sorted(ids(t.rows())) == [1, 2, 3, 5]
    t.begin()
    t.delete("id < 3")
    first = t.savepoint()
    t.delete("true")
    assert t.rows().count() == 0
    t.rollback_to(first)
    assert sorted(ids(t.rows())) == [3, 5]
    t.rollback()
    assert sorted(ids(t.rows())) == [1, 2, 3, 5]
    again = catalog.open("t", dim=2)
    assert sorted(ids(again.rows())) == [1, 2, 3, 5]
    with pytest.raises(ValueError, match="dim of 't' is 2"):
        catalog.open("t", dim=3)
    catalog.drop("t")
    with pytest.raises(KeyError, match="no vector table named t"):
        catalog.get("t")


def test_config_errors():
    for args, message in (({}, "dim"), ({"dim": 0}, "positive"), ({"dim": "x"}, "invalid dim"), ({"dim": 2, "foo": 1}, "unknown parameter"), ({"dim": 2, "type": "q"}, "unknown vector type"), ({"dim": 2, "metric": "q"}, "unknown metric"), ({"dim": 2, "mode": "q"}, "unknown mode"), ({"dim": 2, "sync_every": 0}, "sync_every"), ({"dim": 2, "metadata": "label"}, "without type")):
        with pytest.raises(ValueError, match=message):
            Config.parse("t", **args)


def test_names_and_info(spark, catalog):
    for n in ("a.t", "b.t", "a.u"):
        catalog.create(n, dim=2, mode="exact")
    assert catalog.get("u").config.name == "a.u"
    with pytest.raises(KeyError, match="ambiguous table name 't'"):
        catalog.get("t")
    with pytest.raises(ValueError, match="has no index"):
        catalog.get("u").rebuild_index()
    t = catalog.create("q", dim=4, metric="cosine", m=8, ef_search=32)
    t.insert(rows(spark, [([1.0, 0.0, 0.0, 0.0],)]))
    info = json.loads(t.index_info())
    assert (info["rows"], info["m"], info["ef_search"], info["changes_since_persist"]) == (1, 8, 32, 1)
    assert t.set_ef_search(50) == 50 and json.loads(t.index_info())["ef_search"] == 50
    with pytest.raises(ValueError, match="ef_search must be positive"):
        t.set_ef_search(0)
    assert t.sync_index() == 1 and t.rebuild_index() == 1


def test_arrow(spark, catalog):
    a = catalog.create("a", dim=3)
    a.insert(rows(spark, [([1.0, 2.0, 3.0],), ([4.0, 5.0, 6.0],)]))
    stream = a.export_arrow()
    table = pa.ipc.open_stream(stream).read_all()
    assert table.schema.field("vector").type == pa.list_(pa.float32(), 3)
    b = catalog.create("b", dim=3)
    assert b.insert_arrow(stream) == 2 and b.insert_arrow(b"") == 0
    assert [r["vector"] for r in b.rows().orderBy("id").collect()] == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(ValueError, match="arrow error"):
        codec.ipc_to_vectors(spark, stream, "float8")
    assert catalog.create("c", dim=3).export_arrow() == b""
    assert codec.ipc_streams(a.rows(), "float4", 3).count() >= 1


def test_knn_join_and_index(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    for metric in ("l2", "cosine", "ip"):
        got = {(r["qid"], r["rank"]): r["id"] for r in knn.knn_join(queries, df, 4, metric).collect()}
        for q in range(0, 300, 50):
            d = {"l2": ((x - x[q]) ** 2).sum(1), "cosine": 1 - x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q]), "ip": -(x @ x[q])}[metric]
            assert [got[q, k] for k in range(1, 5)] == np.lexsort((np.arange(300), d.round(6)))[:4].tolist()
    index = IvfIndex.build(df, cells=8, kind="float8")
    assert recall(spark, index, df, [x[k].tolist() for k in (1, 2)], 10, 8) == 1.0
    assert index.search(x[0].tolist(), 290, nprobe=1).count() == 290
    fewer = index.reconcile(df.where("id < 100"))
    assert fewer.rows.count() == 100


def test_index_follows_the_table(spark, catalog):
    t = catalog.create("t", dim=2, m=4, sync_every=1_000_000, metadata="label TEXT")
    t.insert(rows(spark, [([float(i), float(i % 7)], "a") for i in range(40)], ", label string"))

    def same():
        want = [(r["id"], r["label"], r["distance"]) for r in t.knn([3.0, 3.0], 12).collect()]
        got = [(r["id"], r["label"], r["distance"]) for r in t.search_index([3.0, 3.0], 12, nprobe=4).collect()]
        assert got == want
        return [x[0] for x in got]

    assert 41 not in same()
    t.insert(rows(spark, [([3.0, 3.0], "new")], ", label string"))
    assert 41 in same()
    t.update("id = 41", vector="array(900D, 900D)")
    assert 41 not in same()
    t.update("id = 4", label="'changed'")
    same()
    t.delete("id = 4")
    assert 4 not in same()
    t.begin()
    t.delete("id < 10")
    at = t.savepoint()
    t.insert(rows(spark, [([3.0, 3.0], "later")], ", label string"))
    assert same()[0] == 42 and t.sync_index() == 1
    t.rollback_to(at)
    assert 42 not in same()
    t.rollback()
    assert same()[0] == 3
    t = catalog.open("t")
    assert t.saved is not None and same()[0] == 3
    t.insert(rows(spark, [([3.0, 3.0 + i / 1000], "many") for i in range(60)], ", label string"))
    same()
    assert t.covered.rows == 100
    t.delete("true")
    assert t.search_index([3.0, 3.0], 12).count() == 0 and t.rebuild_index() == 0


def test_persisted_index_is_read_again(spark, catalog, monkeypatch):
    t = catalog.create("t", dim=2, m=4)
    t.insert(rows(spark, [([float(i), 0.0],) for i in range(40)]))
    t.sync_index()
    monkeypatch.setattr(IvfIndex, "build", None)
    again = catalog.open("t")
    assert ids(again.search_index([7.0, 0.0], 1, nprobe=1)) == [8]
    again.insert(rows(spark, [([7.0, 0.0],)]))
    assert ids(again.search_index([7.0, 0.0], 2, nprobe=4)) == [8, 41]


def test_recall_at_the_defaults(spark, catalog):
    """Queries vec_id % 100 = 0 of sf0.1 against brute force, with nothing but defaults."""
    found = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toArrow()
    x, at = np.stack(found.column("embedding").to_pylist()), np.asarray(found.column("vec_id"))
    t = catalog.create("t", dim=64)
    t.insert(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id + 1 as id", "embedding as vector"))
    hit, queries = 0, np.flatnonzero(at % 100 == 0)
    for q in queries:
        true = set((at[np.lexsort((at, ((x - x[q]) ** 2).sum(1)))[:10]] + 1).tolist())
        hit += len(true & set(ids(t.search_index(x[q].tolist(), 10))))
    print("recall", hit / 10 / len(queries), "cells", t.index.probes(10), "of", len(t.index.centroids), t.index.measured)
    assert hit / 10 / len(queries) >= 0.9


def test_default_probes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 100 == 0) for i, v in enumerate(x)], "id long, vector array<double>, rare boolean")
    for metric in ("l2", "cosine", "ip"):
        index = IvfIndex.build(df, metric=metric, kind="float8")
        assert recall(spark, index, df, [v.tolist() for v in x[:8]], 10) >= 0.9, metric
        assert index.probes(10) <= index.probes(100) <= index.probes(101) == 16 == index.probes(1, "rare")
    assert sorted(ids(index.search(x[1].tolist(), 2, where="rare"))) == sorted(ids(knn.nearest(df.where("rare"), x[1].tolist(), 2, "ip", kind="float8")))


def test_many_searches_in_one_pass(spark, monkeypatch):
    """All queries at once find what each finds alone, ties and widened probes too; recall runs no job for a query."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 8)), np.tile(rng.normal(size=(1, 8)), (40, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    monkeypatch.setattr(knn, "SCORES", 64)
    for metric in ("l2", "cosine", "ip"):
        index = IvfIndex.build(df, cells=8, metric=metric, kind="float8")
        for k, nprobe in ((5, 2), (5, None), (120, 1), (400, 1)):
            got = {}
            for r in index.search_many(queries, k, nprobe).orderBy("qid", "rank").collect():
                got.setdefault(r["qid"], []).append(r["id"])
            for q in (0, 140, 320):
                alone = index.search(x[q].tolist(), k, nprobe).withColumn("distance", F.round("distance", 9) + 0.0).orderBy("distance", "id")
                assert got[q] == ids(alone), (metric, k, nprobe, q)
    monkeypatch.setattr(IvfIndex, "search", None)
    assert 0 < recall(spark, index, df, queries, 10, 1) < recall(spark, index, df, queries, 10, 8) == 1.0


def test_inserts_append(spark, tmp_path, monkeypatch):
    """An insert adds a folder of its own rows; beyond the limit all rows go into one."""
    monkeypatch.setattr("spindrift.sources.table.MAX_FOLDERS", 3)
    table = Catalog(spark, f"file://{tmp_path}/t").create("a", dim=1, type="float8", mode="exact")
    sizes = []
    for k in range(5):
        table.insert(spark.createDataFrame([([float(k)],)], "vector array<double>"))
        sizes.append(len(table.state.snapshot))
    assert sizes == [1, 2, 3, 1, 2] and sorted((r["id"], r["vector"][0]) for r in table.rows().collect()) == [(k + 1, float(k)) for k in range(5)]
    with pytest.raises(ValueError, match="UNIQUE"):
        table.insert(spark.createDataFrame([(2, [0.0])], "id long, vector array<double>"))
    assert table.rows().count() == 5


def test_streams_of_partitions(spark):
    rows = spark.createDataFrame([(k, [k + 0.5, float(-k)]) for k in range(50)], "id long, vector array<double>").repartition(5)
    for kind in ("float2", "float4", "float8", "int2"):
        back = codec.streams_to_vectors(codec.ipc_streams(rows, kind, 2), kind).orderBy("part", "position").collect()
        assert [float(r["vector"][1]) for r in back] == [float(-k) for k in range(50)]


def test_select_takes_one_match(spark, tmp_path):
    table = Catalog(spark, f"file://{tmp_path}/t").create("a", dim=2, type="float8", mode="exact", metadata="label TEXT")
    table.insert(rows(spark, [([float(k), 0.0], "ab"[k % 2]) for k in range(6)], ", label string"))
    match = Predicate("vector", "knn_match", [4.2, 0.0])
    assert [r["id"] for r in table.select([match, Predicate("label", "=", "b")], limit=2).collect()] == [6, 4]
    found = table.select([Predicate("label", "=", "b"), Predicate("id", ">", 2)], order_by=[("id", False)], offset=1).collect()
    assert [(r["id"], r["distance"]) for r in found] == [(4, None)]
    with pytest.raises(ValueError, match="at most one knn_match constraint is supported per query"):
        table.select([match, match])
    with pytest.raises(ValueError, match="knn_match"):
        table.select([Predicate("label", "knn_match", [4.2, 0.0])])
