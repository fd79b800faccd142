"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder

#: A word, as every operator here counts it: a run of bytes that are not ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder, so the rows survive a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df bears it (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_key() -> "F.Column":
    """64-bit key of a document row; rows with equal id and text share it, others do not."""
    return F.xxhash64("doc_id", "text")


def byte_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow string or binary array without copying; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks may remain in old versions
        column = pa.concat_arrays(column.chunks)
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d, o


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: idle workers stay for a while, beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def thrifty(run):
    """A function from batches to batches that gives freed memory back when it has read all."""

    def outer(batches):
        yield from run(batches)
        give_back()

    return outer


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of every value; null gives empty bytes."""
    d, o = byte_buffers(column)
    raw = memoryview(d)
    return [bytes(raw[a:b]) for a, b in zip(o[:-1].tolist(), o[1:].tolist())]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), the smallest node of each.

    Large-star/small-star contraction. Every round is two aggregations by node with map-side
    combining, so a node with very many links needs no list of them in one task; about
    log2(longest chain) rounds. Each round is cut by a checkpoint. Isolated nodes are not listed.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def state(d: DataFrame):
        r = d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = state(e)
    while before[0]:
        # large star: every larger neighbour links to the smallest of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the node itself link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = state(e)
        if now == before:
            break
        before = now
    star = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return star.union(roots)
