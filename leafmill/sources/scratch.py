"""Reliable intermediate results: tables written to the shared folder that the cluster names.

A written table is compressed, is read by column, and does not depend on any executor. Tables are
deleted when the application ends, or earlier by ``clear_scratch``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one is set only in local mode without the setting (tests).

    A cluster without the setting is an error: a folder of the driver's machine is no shared folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
            named = tempfile.mkdtemp(prefix="leafmill-scratch-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _written.append(path)
    return path


def cut_lineage(frame: DataFrame) -> DataFrame:
    """The rows of a frame, computed once and read back from a table in the shared folder."""
    spark = frame.sparkSession
    path = scratch_path(spark)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables written so far; frames that were made from them can't be read any more."""
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
