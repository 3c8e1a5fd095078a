"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that materialize has written, by session.
WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``.

    Where it is unset, the context's checkpoint folder, and a folder of our own only
    if all tasks run in this process's machine; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="drawloom-")
    context.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; ``clear_tables`` deletes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> str:
    """The path of the table that ``materialize`` reads."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and survives lost executors; a fresh name each time, so a
    rerun never reads an older table.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def clear_tables(spark: SparkSession) -> int:
    """Delete the tables written in this session; to be called when their results are no longer read."""
    paths = WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)
