"""The driver contract, the shell and streams."""

import pathlib
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from spindrift import catalogue
from spindrift.operators import knn
from spindrift.shell import Shell
from spindrift.sources.table import Catalog
from spindrift.streaming.ingest import StandingQuery, append_stream

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["vec_id", "distance"] and df.count() == 10
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_against_sql(spark, name):
    own = catalogue.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    columns = sorted(own.columns)
    want = db.execute(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in own.select(*columns).collect()))) == sorted(map(str, want))


def test_the_rest_stands_alone(tmp_path):
    """Without the folders of the training-data operators, the entry imports and lists the other queries."""
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES))"], cwd=copy, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr


def test_shell(spark):
    shell = Shell(spark)
    spark.range(2).createOrReplaceTempView("two")
    assert shell.feed("select id, null as n,") == "" and shell.feed("x'0102' as b from two order by id;") == "0|NULL|x'0102'\n1|NULL|x'0102'"
    assert shell.feed(".headers on") == "" and shell.feed(".mode csv") == ""
    assert shell.feed("select vector_dims(array(1D), 'float4') as d;") == "d\n1"
    assert "two" in shell.feed(".tables t%") and "id bigint" in shell.feed(".schema two")
    assert shell.feed("select nope;").startswith("Error") and shell.feed(".what") == "unknown command: .what" and shell.feed(".quit") is None
    shell.mode = "column"
    assert shell.feed("select 1 as a;") == "a\n-\n1"
    shell.mode = "line"
    assert shell.feed("select 1 as a;") == "a = 1"


def test_shell_vector_tables(spark, tmp_path):
    shell = Shell(spark)
    assert shell.feed(".info emb") == "no folder is open" and shell.feed(f".open file://{tmp_path}/vectors") == ""
    assert shell.feed('.create emb dim=3 type=float4 metadata="label TEXT"') == ""
    spark.createDataFrame([(1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "b"), (3, [0.0, 0.0, 1.0], "c")], "id long, vector array<double>, label string").createOrReplaceTempView("three")
    assert shell.feed(".insert emb three") == "3" and shell.feed("select id, label from emb_knn(array(0.9D, 0.1D, 0D), 2);") == "1|a\n2|b"
    assert shell.feed(".rebuild emb") == "3" and shell.feed(".ef_search emb 32") == "32" and '"ef_search": 32' in shell.feed(".info emb")
    assert shell.feed(f".export emb {tmp_path}/x") == "" and shell.feed(f".import emb {tmp_path}/x") == "3" and shell.feed("select count(*), max(id) from emb;") == "6|6"
    assert shell.feed(".sync emb") == "1" and shell.feed(".info nope").startswith("Error")
    again = Shell(spark)
    assert again.feed(f".open file://{tmp_path}/vectors") == "emb" and again.feed(".drop emb") == "" and again.vectors.names() == []


def test_a_batch_is_inserted_once(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/t")
    table, rows = catalog.create("s", dim=2, type="float8"), spark.createDataFrame([([1.0, 2.0],)], "vector array<double>")
    assert [table.insert(rows, ("a", 0)), table.insert(rows, ("a", 0)), table.insert(rows, ("a", 1)), table.insert(rows, ("b", 0))] == [1, 0, 1, 1]
    assert Catalog(spark, catalog.root).open("s").insert(rows, ("a", 1)) == 0 and sorted(r["id"] for r in table.rows().collect()) == [1, 2, 3]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(1, 21)], "id long, vector array<double>")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = Catalog(spark, f"file://{tmp_path}/t").create("s", dim=2, type="float8")
    append_stream(stream, table, f"{tmp_path}/c1").awaitTermination()
    assert table.rows().count() == 20
    standing = StandingQuery([7.2, 0.0], 3)
    standing.start(stream, f"{tmp_path}/c2").awaitTermination()
    assert [i for _, i in standing.best] == [r["id"] for r in knn.nearest(rows, [7.2, 0.0], 3).collect()] == [7, 8, 6]
