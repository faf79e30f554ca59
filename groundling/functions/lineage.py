"""Cutting lineage at tables in the shared folder that the session names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _home(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests, a laptop) gets a folder that goes with the process; a cluster has no
    folder that all machines see, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="groundling-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = "file://" + made
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/groundling/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files, not at executors' disks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete all that this application has cut; for when its results have been read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
