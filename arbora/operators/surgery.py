"""Cutting, re-rooting and grafting trees of a node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..runtime import cut, unbroadcast
from . import topology as T

EPS = 1e-5


def remove(nodes: DataFrame, gone: Column) -> DataFrame:
    """nodes without those where ``gone`` holds and without all that descends from them."""
    return T.climb(nodes, {"_gone": (F.coalesce(gone, F.lit(False)), "or")}, carry=nodes.columns).where("NOT _gone").select(*nodes.columns)


def to_subtree(nodes: DataFrame, removals: DataFrame) -> DataFrame:
    """nodes without the listed ones (tree_id, id) and their descendants; ids stay (see ``densify``)."""
    r = removals.select("tree_id", "id").distinct().withColumn("_r", F.lit(True))
    n = nodes.join(r, ["tree_id", "id"], "left")
    return remove(n, F.col("_r")).select(*nodes.columns)


def get_subtree(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The trees under the given nodes (tree_id, id), which become roots; ids stay."""
    s = T.subtree(nodes, starts)
    return s.withColumn("pid", F.when(F.col("id") == F.col("start"), -1).otherwise(F.col("pid"))).select(*nodes.columns)


def densify(nodes: DataFrame, order: Column | None = None) -> DataFrame:
    """nodes with ids 0 .. n - 1 in order of id (or ``order``) and pids to match; old_id keeps the former.

    Places are counted per range of the order and added up, so no tree is sorted in one task.
    """
    key = order if order is not None else F.col("id")
    ranked = rank(nodes.withColumn("_key", key))
    ids = ranked.select("tree_id", F.col("id").alias("pid"), F.col("_rank").alias("_pid"))
    out = ranked.join(unbroadcast(ids), ["tree_id", "pid"], "left")
    rest = [c for c in nodes.columns if c not in ("id", "pid", "old_id")]
    return out.select(*rest, F.col("_rank").alias("id"), F.coalesce("_pid", F.lit(-1)).alias("pid"), F.col("id").alias("old_id")).select(*[c for c in nodes.columns if c != "old_id"], "old_id")


def rank(n: DataFrame) -> DataFrame:
    """n with _rank, the place (from 0) of _key in its tree; ties by id."""
    s = cut(n.orderBy("tree_id", "_key", "id").withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    per = s.groupBy("tree_id", part.alias("_p")).agg(F.min("_i").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tree_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before)
    out = s.withColumn("_p", part).join(unbroadcast(per), ["tree_id", "_p"])
    return out.withColumn("_rank", (F.col("_before") + F.col("_i") - F.col("_low")).cast("int")).drop("_p", "_i", "_low", "_n", "_before")


def reset_index(nodes: DataFrame) -> DataFrame:
    """Ids shifted so that the smallest root of a tree is 0."""
    low = T.roots(nodes).groupBy("tree_id").agg(F.min("id").alias("_r"))
    out = nodes.join(low, "tree_id")
    pid = F.when(T.is_root(), -1).otherwise(F.col("pid") - F.col("_r"))
    return out.withColumn("pid", pid).withColumn("id", F.col("id") - F.col("_r")).select(*nodes.columns)


def mark_roots_as_somas(nodes: DataFrame, update_type: int | None = 1) -> DataFrame:
    """All roots but the first of a tree become its children; they get ``update_type`` unless it is None."""
    low = T.roots(nodes).groupBy("tree_id").agg(F.min("id").alias("_r"))
    out = nodes.join(low, "tree_id")
    extra = T.is_root() & (F.col("id") != F.col("_r"))
    if update_type is not None:
        out = out.withColumn("type", F.when(T.is_root(), update_type).otherwise(F.col("type")))
    return out.withColumn("pid", F.when(extra, F.col("_r")).otherwise(F.col("pid"))).select(*nodes.columns)


def cut_by_type(nodes: DataFrame, kind: int) -> DataFrame:
    """Nodes of a type and all that lies between them and the root."""
    return T.gather(nodes, {"_keep": (F.col("type") == kind, "or")}, carry=nodes.columns).where("_keep").select(*nodes.columns)


def cut_axon(nodes: DataFrame) -> DataFrame:
    return cut_by_type(nodes, 2)


def cut_dendrite(nodes: DataFrame) -> DataFrame:
    return cut_by_type(nodes, 3)


def cut_by_furcation_order(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes below level ``most``: the root is level 0, every later furcation starts the next level."""
    return T.root_walk(nodes).where(F.col("furcation_level") < most).select(*nodes.columns)


#: The same by its older name.
cut_by_bifurcation_order = cut_by_furcation_order


def cut_by_box(nodes: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Nodes inside the box (bounds included) whose whole way to the root is inside, too."""
    if not all(a < b for a, b in zip(low, high)):
        raise AssertionError("the lower bounds must be below the upper ones")
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(float(a), float(b))
    return remove(nodes, ~inside)


def short_tips(nodes: DataFrame, thre: float = 5.0) -> DataFrame:
    """(tree_id, branch_id, length) of terminal branches on a furcation that are at most ``thre`` long."""
    b = T.branches(nodes)
    n = T.child_counts(nodes).select("tree_id", "id", "n_children")
    ends = b.groupBy("tree_id", "branch_id").agg(F.max_by("id", "pos").alias("_end"), F.min_by("id", "pos").alias("_start"))
    tip = ends.join(n.where("n_children = 0").select("tree_id", F.col("id").alias("_end")), ["tree_id", "_end"], "left_semi")
    tip = tip.join(n.where("n_children > 1").select("tree_id", F.col("id").alias("_start")), ["tree_id", "_start"], "left_semi")
    lengths = T.branch_lengths(b).where(F.col("length") <= thre)
    return lengths.join(tip, ["tree_id", "branch_id"], "left_semi").select("tree_id", "branch_id", "length")


def cut_short_tips(nodes: DataFrame, thre: float = 5.0) -> DataFrame:
    """nodes without their short terminal branches, in one pass; the furcations stay."""
    return to_subtree(nodes, short_tips(nodes, thre).select("tree_id", F.col("branch_id").alias("id")))


def redirect(nodes: DataFrame, new_roots: DataFrame) -> DataFrame:
    """Trees rooted at the given nodes (tree_id, id), one a tree: parents on the way up are reversed.

    The old and the new root exchange their types. Other trees stay as they are. Ids stay.
    """
    target = new_roots.select("tree_id", F.col("id").alias("_new"))
    n = nodes.join(target, ["tree_id"], "left")
    way = cut(T.gather(n, {"_on": (F.col("id") == F.coalesce("_new", F.lit(-1)), "or")}, carry=n.columns, sizes=nodes))
    # a node on the way gets the child that is on the way as its parent
    child = way.where(F.col("_on") & ~T.is_root()).select("tree_id", F.col("pid").alias("id"), F.col("id").alias("_child"))
    old = T.roots(nodes).select("tree_id", F.col("id").alias("_old"), F.col("type").alias("_old_type"))
    new = nodes.join(target, "tree_id").where("id = _new").select("tree_id", F.col("type").alias("_new_type"))
    out = way.join(unbroadcast(child), ["tree_id", "id"], "left").join(old, "tree_id").join(new, "tree_id", "left")
    pid = F.when(F.col("id") == F.col("_new"), -1).when(F.col("_on"), F.col("_child")).otherwise(F.col("pid"))
    kind = F.when(F.col("_new").isNull() | (F.col("_new") == F.col("_old")), F.col("type"))
    kind = kind.when(F.col("id") == F.col("_new"), F.col("_old_type")).when(F.col("id") == F.col("_old"), F.col("_new_type")).otherwise(F.col("type"))
    return out.withColumn("_kind", kind).withColumn("pid", pid).withColumn("type", F.col("_kind")).select(*nodes.columns)


def cat(first: DataFrame, second: DataFrame, pairs: DataFrame, translate: bool = True) -> DataFrame:
    """Grafts trees of ``second`` onto trees of ``first``.

    ``pairs``: (tree_id, node1, tree2_id, node2), one a tree of ``first``: the second tree, rooted at
    node2, is moved so that node2 meets node1 (if ``translate``) and hangs on it. A node2 that then is
    within 1e-5 of node1 goes and its children hang on node1. Ids of the second follow those of the first.
    """
    p = pairs.select("tree_id", "node1", F.col("tree2_id").alias("_t2"), "node2")
    high = first.groupBy("tree_id").agg(F.max("id").alias("_high"))
    at = first.select("tree_id", F.col("id").alias("node1"), *(F.col(c).alias(f"a_{c}") for c in "xyz"))
    rooted = redirect(second, pairs.select(F.col("tree2_id").alias("tree_id"), F.col("node2").alias("id")).distinct())
    b = rooted.select(F.col("tree_id").alias("_t2"), F.col("id").alias("node2"), *(F.col(c).alias(f"b_{c}") for c in "xyz"))
    p = p.join(unbroadcast(at), ["tree_id", "node1"]).join(unbroadcast(high), "tree_id").join(unbroadcast(b), ["_t2", "node2"])
    low = rooted.groupBy(F.col("tree_id").alias("_t2")).agg(F.min("id").alias("_low"))
    p = p.join(unbroadcast(low), "_t2")
    moved = rooted.withColumnRenamed("tree_id", "_t2").join(unbroadcast(p), "_t2")
    shift = {c: (F.col(f"a_{c}") - F.col(f"b_{c}")) if translate else F.lit(0.0) for c in "xyz"}
    same = V.distance(V.vec("a_"), tuple(F.col(f"b_{c}") + shift[c] for c in "xyz")) < EPS
    new = lambda c: F.col(c) - F.col("_low") + F.col("_high") + 1
    hangs = (F.col("pid") == -1) | (same & (F.col("pid") == F.col("node2")))
    moved = moved.where(~(same & (F.col("id") == F.col("node2"))))
    moved = moved.withColumn("_pid", F.when(hangs, F.col("node1")).otherwise(new("pid"))).withColumn("id", new("id")).withColumn("pid", F.col("_pid"))
    for c in "xyz":
        moved = moved.withColumn(c, F.col(c) + shift[c])
    return first.unionByName(moved.select(*first.columns))
