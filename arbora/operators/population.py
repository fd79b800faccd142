"""Collections of trees: sets, selections and maps over a node table with population labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union(*populations: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """All trees of several populations with population (0, 1, ...) and, where given, label."""
    out = []
    for i, p in enumerate(populations):
        q = p.drop("population").withColumn("population", F.lit(i).cast("long"))
        out.append(q.withColumn("label", F.lit(labels[i])) if labels else q)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def intersect(*populations: DataFrame, key: str = "tree_id") -> DataFrame:
    """As ``union``, but only trees whose key is in every population."""
    keys = [p.select(key).distinct() for p in populations]
    common = reduce(lambda a, b: a.join(b, key, "left_semi"), keys)
    return union(*populations).join(common, key, "left_semi")


def same_keys(*populations: DataFrame, key: str = "tree_id") -> bool:
    """Whether all populations hold the same keys."""
    keys = [p.select(key).distinct() for p in populations]
    return all(a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty() for a, b in zip(keys, keys[1:]))


def where(nodes: DataFrame, qualifying: DataFrame) -> DataFrame:
    """Nodes of trees that have a row (tree_id) in ``qualifying``."""
    return nodes.join(qualifying.select("tree_id").distinct(), "tree_id", "left_semi")


def ordinals(nodes: DataFrame) -> DataFrame:
    """(tree_id, ordinal): places of the trees in order of id, from 0; per population where there is one."""
    keys = ["population"] if "population" in nodes.columns else []
    trees = nodes.select(*keys, "tree_id").distinct()
    w = Window.partitionBy(*keys).orderBy("tree_id") if keys else Window.orderBy("tree_id")
    return trees.withColumn("ordinal", F.row_number().over(w) - 1)


def nth(nodes: DataFrame, *places: int) -> DataFrame:
    """The trees at the given places; a negative place counts from the end."""
    o = ordinals(nodes)
    keys = [c for c in o.columns if c != "ordinal"]
    total = o.groupBy(*[k for k in keys if k != "tree_id"]).count().withColumnRenamed("count", "_n")
    o = o.join(total, [k for k in keys if k != "tree_id"]) if len(keys) > 1 else o.crossJoin(F.broadcast(total))
    hit = reduce(lambda a, b: a | b, [F.col("ordinal") == (F.lit(p) if p >= 0 else F.col("_n") + p) for p in places])
    return nodes.join(o.where(hit).select(*keys), keys, "left_semi")


def flatten(nodes: DataFrame) -> DataFrame:
    """One population of all: tree ids are led by their population's number."""
    return nodes.withColumn("tree_id", F.concat_ws("/", F.col("population").cast("string"), F.col("tree_id").cast("string"))).drop("population")


def count(nodes: DataFrame) -> int:
    """Number of populations."""
    return nodes.select("population").distinct().count()


def map_trees(nodes: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None) -> DataFrame:
    """An arbitrary Python function of one tree (its nodes in order of id) for every tree.

    The tree is one group in one task: use it for what the relational operators can't express.
    """
    kind = schema or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.groupBy("tree_id").applyInPandas(lambda pdf: fn(pdf.sort_values("id")), kind)


class Transforms:
    """A chain of functions from node table to node table; chains in it are flattened."""

    def __init__(self, *steps):
        self.steps = [s for t in steps for s in (t.steps if isinstance(t, Transforms) else [t])]

    def __call__(self, nodes: DataFrame) -> DataFrame:
        return reduce(lambda d, f: d.transform(f), self.steps, nodes)

    def __getitem__(self, i):
        return self.steps[i]

    def __len__(self) -> int:
        return len(self.steps)


def identity(nodes: DataFrame) -> DataFrame:
    return nodes
