"""Folders that the driver and all executors share, and tables kept there between steps."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or else below the checkpoint folder that is set.

    Without either, a session in one process (as in tests) gets a local temporary folder; any other session is an error,
    as its executors would write to disks of their own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="sitemigrate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        return f"file://{own}"
    path = f"{base.rstrip('/')}/sitemigrate-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def keep(spark: SparkSession, df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet (at ``path``, or in a scratch folder) and read again: later steps start from there, and ids
    and orders stay as they are."""
    path = path or f"{scratch_dir(spark)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df``, which may have a row for each post of an export or a site, as a side of a join that both sides are dealt for.

    Spark takes a table for as small as its files, and names and running numbers pack well: a row of five bytes there has
    hundreds in the driver and in all tasks, so such tables went to them whole.
    """
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is kept in it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names at least one file or folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0
