"""Shared storage for written intermediates.

Iterative operators cut their lineage by writing a table into the folder the
cluster names in ``spark.checkpoint.dir``; every executor can read it back, so
losing one loses no state.  Only a local session without that setting gets a
folder of its own, removed when the process ends.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str, **options) -> DataFrame:
    """``cut``, after which the driver lets go of the step's plans and shuffle files, which otherwise stay until it happens to collect its garbage."""
    out = cut(df, name, **options)
    df.sparkSession._jvm.System.gc()
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the written table behind ``df`` once nothing reads it any more."""
    for f in {os.path.dirname(p) for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
