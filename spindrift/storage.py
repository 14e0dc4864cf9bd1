"""The folder that driver and executors share, and paths in it that end with the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path_of(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex[:12]}"
    where, fs = _path_of(spark, path)
    fs.deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path whose last reader is done."""
    where, fs = _path_of(spark, path)
    fs.delete(where, True)
