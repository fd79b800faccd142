"""Reading and writing SWC and extended SWC.

``read_swc`` scans text files line by line with built-in expressions, so files split over tasks and
projections and filters work as for any table. ``SwcDataSource`` is the same as a named format for
``spark.read.format("swc")``, with a writer of one file a tree.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import surgery
from ..operators import topology as T
from ..schema import EXTENDED

#: A decimal number, in any of its usual spellings.
_NUMBER = r"[-+]?(?=\.?\d)\d*\.?\d*(?:[Ee][-+]?\d+)?"
_FIELDS = ["id", "type", "x", "y", "z", "r", "pid"]


def _line(extra: tuple[str, ...]) -> str:
    tail = "".join(rf"\s+({_NUMBER})" for _ in extra)
    return rf"^\s*(\d+)\s+(\d+)\s+({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s+(-?\d+){tail}((?:\s+{_NUMBER})*)\s*$"


def swc_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", recursive: bool = True, ext: str = ".swc") -> DataFrame:
    """(tree_id, pos, value): the lines of all files in their order; tree_id is the file's path."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("encoding", encoding)
    if any(os.path.isdir(p.removeprefix("file://")) for p in paths):
        reader = reader.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{ext}")
    text = reader.text(paths, wholetext=True).withColumn("tree_id", F.input_file_name())
    lines = F.split("value", r"\r\n|\n|\r", -1)
    if encoding.upper() not in ("UTF-8", "UTF8"):
        raw = spark.read.format("binaryFile")
        if any(os.path.isdir(p.removeprefix("file://")) for p in paths):
            raw = raw.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{ext}")
        text = raw.load(paths).select(F.col("path").alias("tree_id"), F.decode("content", encoding).alias("value"))
    return text.select("tree_id", F.posexplode(lines).alias("pos", "value"))


def parse(lines: DataFrame, extra: tuple[str, ...] = (), mode: str = "FAILFAST") -> DataFrame:
    """Node rows of lines (tree_id, pos, value), in the form (tree_id, pos, <7 columns>, <extra>, n_ignored).

    What follows ``#`` is a comment. A line that is no node raises with its number (FAILFAST), is left
    out (DROPMALFORMED) or is kept with nulls and its text in _corrupt (PERMISSIVE). Further numeric
    fields are counted in n_ignored.
    """
    rx = _line(extra)
    body = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), "﻿", ""))
    rows = lines.withColumn("_b", body).where("_b <> ''")
    good = F.col("_b").rlike(rx)
    at = lambda i: F.regexp_extract("_b", rx, i)
    get = lambda i, t: F.when(good, at(i)).try_cast(t)
    if mode == "FAILFAST":
        message = F.concat(F.lit("not an SWC row: line "), (F.col("pos") + 1).cast("string"), F.lit(" of "), F.col("tree_id"))
        rows = rows.where(F.assert_true(good, message).isNull())
    elif mode == "DROPMALFORMED":
        rows = rows.where(good)
    kinds = ["int", "int", "double", "double", "double", "double", "int"]
    cols = [get(i + 1, k).alias(n) for i, (n, k) in enumerate(zip(_FIELDS, kinds))]
    more = [get(8 + i, "double").alias(n) for i, n in enumerate(extra)]
    ignored = F.size(F.filter(F.split(F.trim(at(8 + len(extra))), r"\s+"), lambda v: v != ""))
    out = [F.col("tree_id"), F.col("pos"), *cols, *more, F.when(good, ignored).otherwise(0).alias("n_ignored")]
    if mode == "PERMISSIVE":
        out.append(F.when(~good, F.col("value")).alias("_corrupt"))
    return rows.select(*out)


def comments(lines: DataFrame) -> DataFrame:
    """(tree_id, comments): full-line comments in order, without a repeated column header."""
    c = lines.where(F.col("value").rlike(r"^\s*#"))
    body = F.rtrim(F.regexp_replace("value", r"^\s*#\s?", ""))
    c = c.withColumn("_c", body).where(~F.lower(F.trim("_c")).rlike(r"^id\s+type\s+x\s+y\s+z\s+r\s+pid"))
    g = c.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_c"))).alias("_l"))
    return g.select("tree_id", F.transform("_l", lambda s: s["_c"]).alias("comments"))


def read_swc(
    spark: SparkSession, path: str | list[str], extra: tuple[str, ...] = (), fix_roots: str | None = None, sort: bool = True,
    reset: bool = True, encoding: str = "UTF-8", mode: str = "FAILFAST", ext: str = ".swc",
) -> DataFrame:
    """Node table of SWC files (a file, files, or folders that are searched for ``ext``).

    ``fix_roots``: None (several roots raise if ``sort``), "somas" (other roots hang on the first) or
    "nearest" (each further tree hangs on its nearest node). ``sort`` numbers nodes from 0 in preorder,
    ``reset`` only shifts ids so that the root is 0. An empty file has no rows.
    """
    n = parse(swc_lines(spark, path, encoding, ext=ext), extra, mode)
    n = n.drop("pos", "n_ignored")
    if fix_roots == "somas":
        n = surgery.mark_roots_as_somas(n)
    elif fix_roots == "nearest":
        from ..operators.construct import link_nearest

        n = link_nearest(n)
    elif fix_roots is not None:
        raise ValueError("fix_roots must be None, 'somas' or 'nearest'")
    if sort:
        from ..operators.construct import sort_nodes

        return sort_nodes(n)
    return surgery.reset_index(n) if reset else n


def read_eswc(spark: SparkSession, path: str | list[str], extra: tuple[str, ...] = (), **options) -> DataFrame:
    """As ``read_swc`` with the five columns of extended SWC, as integers."""
    n = read_swc(spark, path, extra=(*EXTENDED, *extra), ext=options.pop("ext", ".eswc"), **options)
    return n.withColumns({c: F.col(c).cast("int") for c in EXTENDED})


def read_components(spark: SparkSession, path: str | list[str], extra: tuple[str, ...] = (), reset: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Files of several trees: each component is a tree named <file>#component_<i>, in order of the roots.

    With ``reset`` the nodes of a component are numbered 0, 1, ... in order of id.
    """
    n = parse(swc_lines(spark, path, encoding), extra).drop("pos", "n_ignored")
    c = T.components(n)
    c = c.withColumn("tree_id", F.concat("tree_id", F.lit("#component_"), F.col("component_id").cast("string"))).select(*n.columns)
    return surgery.densify(c).drop("old_id") if reset else c


def to_lines(nodes: DataFrame, extra: tuple[str, ...] = (), id_offset: int = 1) -> DataFrame:
    """(tree_id, id, line): nodes as SWC lines, floats with four decimals, ids shifted."""
    shift = lambda c: F.when(F.col(c) == -1, -1).otherwise(F.col(c) + id_offset)
    kinds = dict(nodes.dtypes)
    more = [F.col(c) for c in extra]
    form = "%d %d %.4f %.4f %.4f %.4f %d" + "".join(" %d" if kinds[c] in ("int", "bigint", "smallint", "tinyint") else " %.4f" for c in extra)
    return nodes.select("tree_id", "id", F.format_string(form, F.col("id") + id_offset, "type", "x", "y", "z", "r", shift("pid"), *more).alias("line"))


def to_text(nodes: DataFrame, extra: tuple[str, ...] = (), id_offset: int = 1, comment: DataFrame | None = None, source: bool = True) -> DataFrame:
    """(tree_id, text): one SWC file a tree, with a ``source`` comment, ``comment`` (tree_id, comments) and a header."""
    lines = to_lines(nodes, extra, id_offset).groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("_l"))
    body = F.transform("_l", lambda s: s["line"])
    head = F.array(F.lit("# " + " ".join([*_FIELDS, *extra])))
    if comment is not None:
        lines = lines.join(comment, "tree_id", "left")
        head = F.concat(F.transform(F.coalesce("comments", F.array().cast("array<string>")), lambda c: F.concat(F.lit("# "), c)), head)
    if source:
        head = F.concat(F.array(F.concat(F.lit("# source: "), F.col("tree_id").cast("string"))), head)
    return lines.select("tree_id", F.concat(F.array_join(F.concat(head, body), "\n"), F.lit("\n")).alias("text"))


def write_swc(nodes: DataFrame, folder: str, extra: tuple[str, ...] = (), id_offset: int = 1, comment: DataFrame | None = None, suffix: str = ".swc") -> None:
    """One file a tree in ``folder``, which all executors must see; the name is the tree's last path part."""
    name = F.regexp_replace(F.element_at(F.split(F.col("tree_id").cast("string"), "/"), -1), r"\.e?swc$", "")
    rows = to_text(nodes, extra, id_offset, comment).select(name.alias("name"), "text")
    register(nodes.sparkSession)
    rows.write.format(SwcDataSource.name()).mode("append").option("suffix", suffix).save(folder)


def write_eswc(nodes: DataFrame, folder: str, **options) -> None:
    write_swc(nodes, folder, extra=(*EXTENDED, *options.pop("extra", ())), suffix=".eswc", **options)


def find_swcs(spark: SparkSession, root: str, ext: str = ".swc", relative: bool = False) -> DataFrame:
    """(path, length): all files under a folder with exactly this extension; paths relative to it if asked."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").load(root).select("path", "length")
    if relative:
        base = "file:" + os.path.abspath(root.removeprefix("file://")) + "/"
        f = f.withColumn("path", F.expr(f"replace(path, '{base}', '')"))
    return f


# Section: the same as a named data source


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def _extra(self) -> tuple[str, ...]:
        return tuple(c for c in self.options.get("extra", "").split(",") if c)

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"].removeprefix("file://")
        ext = self.options.get("ext", ".swc")
        files = sorted(glob.glob(os.path.join(path, "**", f"*{ext}"), recursive=True)) if os.path.isdir(path) else [path]
        n = int(self.options.get("filesPerPartition", 64))
        return [_Files(files[i : i + n]) for i in range(0, len(files), n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        extra = self._extra()
        rx = re.compile(_line(extra))
        for path in partition.files:
            with open(path, encoding=self.options.get("encoding", "utf-8-sig")) as f:
                for k, line in enumerate(f, 1):
                    body = line.partition("#")[0].strip()
                    if not body:
                        continue
                    m = rx.match(body)
                    if not m:
                        if self.options.get("mode", "FAILFAST").upper() == "FAILFAST":
                            raise ValueError(f"not an SWC row: line {k} of {path}")
                        continue
                    g = m.groups()
                    yield (path, int(g[0]), int(g[1]), *map(float, g[2:6]), int(g[6]), *map(float, g[7 : 7 + len(extra)]))


class _Message(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.suffix = options.get("suffix", ".swc")

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for r in rows:
            path = os.path.join(self.folder, r["name"] + self.suffix)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["text"].encode())
            os.replace(part, path)  # a task that runs again leaves the same file
            files.append(path)
        return _Message(files)


class SwcDataSource(DataSource):
    """``swc``: reads node rows (options ext, extra, mode, encoding), writes rows (name, text) as files."""

    @classmethod
    def name(cls) -> str:
        return "swc"

    def schema(self) -> str:
        extra = "".join(f", `{c}` double" for c in self.options.get("extra", "").split(",") if c)
        return f"tree_id string, id int, type int, x double, y double, z double, r double, pid int{extra}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("swc")`` and ``df.write.format("swc")`` known to the session."""
    spark.dataSource.register(SwcDataSource)
