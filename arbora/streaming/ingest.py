"""Streaming ingestion of SWC files: each new file becomes node rows and a row of per-file measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import tree_summary
from ..sources.swc import parse


def stream_nodes(spark: SparkSession, folder: str, mode: str = "DROPMALFORMED", ext: str = ".swc") -> DataFrame:
    """An unbounded node table of the files that arrive in a folder."""
    text = spark.readStream.option("wholetext", True).option("pathGlobFilter", f"*{ext}").text(folder)
    lines = text.select(F.input_file_name().alias("tree_id"), F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("pos", "value"))
    return parse(lines, mode=mode).drop("pos", "n_ignored")


def stream_summaries(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends tree_summary rows of new files to a Parquet table, each file once.

    A batch that is repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        tree_summary(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream_nodes(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
