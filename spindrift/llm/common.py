"""Helpers that the operators share: tables, shared storage, and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.storage import discard, shared_path

#: White space of all word and line contracts: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to shared storage and read it back: lineage ends here, and a lost executor loses nothing.

    The shuffle files of the write are of no more use after it, and Spark is told to delete them then.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._settled = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote, once all that reads them is written itself."""
    for df in tables:
        discard(df.sparkSession, df._settled)


def without(df: DataFrame, added) -> DataFrame:
    """The table without columns that an operator is about to add: the new ones take their place."""
    names = {a.lower() for a in added}
    return df.select(*[c for c in df.columns if c.lower() not in names])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. ``lower`` does that, and fast, where a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \x09-\x0D]+", -1), "")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with unlike seeds: together they tell apart the keys of any corpus."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("spindrift"), *cols)


def id_key(col: Column) -> Column:
    """An id that joins and sorts where the id is null: null is the smallest."""
    return F.coalesce(col.cast("long"), F.lit(-(2**63)))
