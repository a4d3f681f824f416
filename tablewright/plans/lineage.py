"""Cuts a plan's lineage at the shared checkpoint folder."""

from __future__ import annotations

import gc
import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in one JVM, as in tests; on a cluster that is an error, as executors wouldn't share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.match(r"local(\[(\d+|\*)(,\d+)?\])?$", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return posixpath.join(shared(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df, which Spark doesn't broadcast in a join, whatever size it takes it for.

    For what an explode makes it takes the size of what goes in, and for an array
    that of one element, so it would send a table to the driver that is many
    times its limit.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames that nothing refers to any more.

    Its cleaner acts on what the driver's garbage collection finds, and a driver
    with memory to spare may not collect in the whole of a job of many rounds.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder, so that later scans read only the columns they use. Its path is added to made, for removed()."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what staged() has written, once nothing reads it any more."""
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
