"""Session-level helpers: the shared folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine serves a local session (tests); on a cluster other
    machines could not read it, so that raises.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'arbora-checkpoints')}"


def _path(spark: SparkSession, folder: str):
    """(file system, path) of a folder on the JVM side."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def delete_on_exit(spark: SparkSession, folder: str) -> None:
    """Has a folder deleted when the session's JVM ends."""
    fs, path = _path(spark, folder)
    fs.mkdirs(path)  # only what is there can be marked
    fs.deleteOnExit(path)


def write(df: DataFrame, *by: str) -> str:
    """Writes a table to a new folder of the shared one, and has it deleted when the session's JVM ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(folder) if by else df.write.parquet(folder)
    delete_on_exit(spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, which survives a lost executor.

    The table is read again with its true size, so that plans of many rounds keep sound estimates.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df))


def unbroadcast(df: DataFrame) -> DataFrame:
    """df, but no join sends it to the driver: a compressed file or a fold tells little about the size of its rows."""
    return df.hint("merge")


def empty(spark: SparkSession, schema) -> DataFrame:
    """No rows, and known to have none (a table made of an empty list counts as unboundedly large)."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


class Rounds:
    """The state of an iteration, cut at every round into rows that are done and rows that are live.

    Done rows are written once; the live rows of the round before are deleted as soon as the next ones
    are there. ``done`` and ``live`` are DataFrames with the columns of ``df`` but the flag.
    """

    def __init__(self, df: DataFrame, live: str):
        self.spark, self.flag, self.last = df.sparkSession, live, None
        self.done = empty(self.spark, df.drop(live).schema)
        self.next(df)

    def _read(self, folder: str, schema) -> DataFrame | None:
        fs, path = _path(self.spark, folder)
        return self.spark.read.schema(schema).parquet(folder) if fs.exists(path) else None

    def next(self, df: DataFrame) -> None:
        """Takes the rows that replace the live ones; done rows of earlier rounds stay as they are."""
        schema = df.drop(self.flag).schema
        folder = write(df.withColumn(self.flag, F.col(self.flag).cast("int")), self.flag)
        done, live = (self._read(f"{folder}/{self.flag}={i}", schema) for i in (0, 1))
        self.done = self.done if done is None else self.done.unionByName(done)
        self.over = live is None
        self.live = empty(self.spark, schema) if live is None else live
        if self.last:
            remove(self.spark, f"{self.last}/{self.flag}=1")
        self.last = folder
