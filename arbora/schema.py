"""The data model: one node table for any number of trees.

A node table has the columns of ``NODES`` and any extra ones; ``pid`` is -1 at a root. Edges, branches
and paths are tables derived from it.
"""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = {"id": "int", "type": "int", "x": "double", "y": "double", "z": "double", "r": "double", "pid": "int"}
#: Extra integer columns of extended SWC.
EXTENDED = ("level", "mode", "timestamp", "teraflyindex", "feature_value")


class NodeType(IntEnum):
    UNDEFINED = 0
    SOMA = 1
    AXON = 2
    BASAL_DENDRITE = 3
    APICAL_DENDRITE = 4
    CUSTOM = 5
    UNSPECIFIED = 6
    GLIA = 7


def node_table(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """A table with the canonical columns, renamed by ``names`` (canonical -> given) and cast; extras stay.

    Missing columns get their defaults: tree_id 0, type 0, coordinates 0, r 1, id by no rule (required),
    pid id - 1.
    """
    for canonical, given in (names or {}).items():
        df = df.withColumnRenamed(given, canonical)
    default = {"tree_id": F.lit(0), "type": F.lit(0), "x": F.lit(0.0), "y": F.lit(0.0), "z": F.lit(0.0), "r": F.lit(1.0), "pid": F.col("id") - 1}
    for c, v in default.items():
        if c not in df.columns:
            df = df.withColumn(c, v)
    extra = [c for c in df.columns if c not in NODES and c != "tree_id"]
    return df.select("tree_id", *(F.col(c).cast(t).alias(c) for c, t in NODES.items()), *extra)
