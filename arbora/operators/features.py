"""Morphometric features in long form, Sholl profiles and histograms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from . import topology as T


def radial_distance(nodes: DataFrame) -> DataFrame:
    """nodes with radial_distance, straight to the root of the tree (its first, if there are several)."""
    r = T.roots(nodes).groupBy("tree_id").agg(F.min_by(F.struct("x", "y", "z"), "id").alias("_root"))
    return nodes.join(r, "tree_id").withColumn("radial_distance", V.distance(V.vec(), V.of(F.col("_root")))).drop("_root")


def tree_summary(nodes: DataFrame) -> DataFrame:
    """tree_id, n_nodes, n_edges, n_tips, n_furcations, n_stems, length."""
    n = T.child_counts(T.with_parent(nodes, "x", "y", "z"))
    step = F.coalesce(V.distance(V.vec(), V.vec("p_")), F.lit(0.0))
    return n.groupBy("tree_id").agg(
        F.count("*").alias("n_nodes"),
        F.sum((~T.is_root()).cast("long")).alias("n_edges"),
        F.sum((F.col("n_children") == 0).cast("long")).alias("n_tips"),
        F.sum((F.col("n_children") > 1).cast("long")).alias("n_furcations"),
        F.sum(F.when(T.is_root(), F.col("n_children")).otherwise(0)).alias("n_stems"),
        F.sum(step).alias("length"),
    )


def branch_count(nodes: DataFrame) -> DataFrame:
    """(tree_id, n_branches): branches and, where the root has not exactly one child, the root alone."""
    n = T.with_parent(T.child_counts(nodes), "pid", "n_children")
    head = ~T.is_root() & ((F.col("p_pid") == -1) | (F.col("p_n_children") > 1))
    alone = T.is_root() & (F.col("n_children") != 1)
    return n.groupBy("tree_id").agg(F.sum((head | alone).cast("long")).alias("n_branches"))


def node_branch_order(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, branch_order) of root, furcations and tips: depth in the contracted tree."""
    w = T.root_walk(nodes).where("pid = -1 OR n_children <> 1")
    up = F.col("branch_order") - (F.col("n_children") > 1).cast("long")
    # the root counts as a branching point whether it forks or not
    root_forks = w.where("pid = -1").select("tree_id", (F.col("n_children") > 1).cast("long").alias("_f"))
    order = F.when(T.is_root(), 0).otherwise(up + 1 - F.col("_f"))
    return w.join(root_forks, "tree_id").select("tree_id", "id", order.cast("long").alias("branch_order"))


def path_features(nodes: DataFrame) -> DataFrame:
    """(tree_id, tip, length, straight, tortuosity) of every path from root to tip."""
    w = radial_distance(T.root_walk(nodes)).where("n_children = 0")
    return w.select("tree_id", F.col("id").alias("tip"), F.col("path_length").alias("length"), F.col("radial_distance").alias("straight"), T.tortuosity(F.col("radial_distance"), F.col("path_length")).alias("tortuosity"))


def longest_path(nodes: DataFrame) -> DataFrame:
    """(tree_id, tip, length): the longest path of every tree; ties to the smaller tip."""
    best = path_features(nodes).groupBy("tree_id").agg(F.max(F.struct("length", (-F.col("tip")).alias("_t"))).alias("_b"))
    return best.select("tree_id", (-F.col("_b._t")).alias("tip"), F.col("_b.length").alias("length"))


def to_longest_path(nodes: DataFrame) -> DataFrame:
    """Only the nodes of the longest path of every tree."""
    b = longest_path(nodes).select("tree_id", F.col("tip").alias("_tip"))
    return T.gather(nodes.join(b, "tree_id"), {"_on": (F.col("id") == F.col("_tip"), "or")}, carry=nodes.columns, sizes=nodes).where("_on").select(*nodes.columns)


def branch_features(nodes: DataFrame) -> DataFrame:
    """(tree_id, branch_id, n_nodes, length, straight, tortuosity) of every branch."""
    b = T.branch_lengths(T.branches(nodes))
    return b.withColumn("tortuosity", T.tortuosity(F.col("straight"), F.col("length")))


def branch_angles(nodes: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(tree_id, branch_a, branch_b, angle) in radians, of all pairs of branches of a tree by their ends."""
    at = F.struct("x", "y", "z")
    e = T.branches(nodes).groupBy("tree_id", "branch_id").agg(F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b"))
    d = e.select("tree_id", "branch_id", *(v.alias(c) for v, c in zip(V.sub(V.of(F.col("b")), V.of(F.col("a"))), "xyz")))
    p = d.select("tree_id", F.col("branch_id").alias("branch_a"), *(F.col(c).alias(f"a_{c}") for c in "xyz"))
    q = d.select("tree_id", F.col("branch_id").alias("branch_b"), *(F.col(c).alias(f"b_{c}") for c in "xyz"))
    a, b = V.vec("a_"), V.vec("b_")
    cos = V.dot(a, b) / (V.norm(a) * V.norm(b) + eps)
    return p.join(q, "tree_id").select("tree_id", "branch_a", "branch_b", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).alias("angle"))


# Section: Sholl


def sholl_edges(nodes: DataFrame) -> DataFrame:
    """(tree_id, lo, hi, rmax): radii of both ends of every edge about the root and the largest of the tree."""
    n = radial_distance(nodes)
    e = T.with_parent(n, "radial_distance").where(~T.is_root())
    a, b = F.col("radial_distance"), F.col("p_radial_distance")
    top = n.groupBy("tree_id").agg(F.max("radial_distance").alias("rmax"))
    return e.select("tree_id", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).join(top, "tree_id")


def sholl(nodes: DataFrame, steps: int = 20, shared: bool = False, step: float | None = None) -> DataFrame:
    """(tree_id, k, radius, crossings) for k = 1 .. steps, radius k * rmax / (steps + 1).

    With ``shared`` rmax is that of all trees. With ``step`` radii are its multiples below rmax. An edge
    crosses a radius if lo <= radius < hi, so it adds one to a range of k that is found directly from its
    ends: every edge sends +1 and -1, and a prefix sum over the few k of a tree gives the counts.
    """
    e = sholl_edges(nodes)
    if shared:
        top = e.agg(F.max("rmax")).first()[0] or 0.0
        e = e.withColumn("rmax", F.lit(float(top)))
    gap = F.lit(float(step)) if step is not None else F.col("rmax") / (steps + 1)
    count = F.ceil(F.col("rmax") / gap).cast("int") - 1 if step is not None else F.lit(steps)
    e = e.withColumn("gap", gap).withColumn("n", count)
    radius = lambda k: k * F.col("gap") if step is not None else k * F.col("rmax") / (steps + 1)

    def first_at_least(v: Column) -> Column:
        """Smallest k with radius(k) >= v, exact against rounding."""
        k = F.coalesce(F.ceil(F.try_divide(v, F.col("gap"))), F.lit(1)).cast("long")
        k = F.when((k > 1) & (radius(k - 1) >= v), k - 1).otherwise(k)
        k = F.when(radius(k) < v, k + 1).otherwise(k)
        return F.greatest(k, F.lit(1)).cast("long")

    a, b = first_at_least(F.col("lo")), first_at_least(F.col("hi"))
    marks = F.array(F.struct(a.alias("k"), F.lit(1).alias("d")), F.struct(b.alias("k"), F.lit(-1).alias("d")))
    ev = e.where("rmax > 0").select("tree_id", "rmax", "gap", "n", F.explode(marks).alias("m")).groupBy("tree_id", F.col("m.k").alias("k")).agg(F.sum("m.d").alias("d"), F.max("rmax").alias("rmax"), F.max("n").alias("n"), F.max("gap").alias("gap"))
    per = ev.groupBy("tree_id").agg(F.max("rmax").alias("rmax"), F.max("n").alias("n"), F.max("gap").alias("gap"))
    ks = per.select("tree_id", "rmax", "gap", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n"), F.lit(1)).cast("long"))).alias("k"))
    both = ks.select("tree_id", "k", F.lit(0).cast("long").alias("d")).unionByName(ev.select("tree_id", "k", "d")).groupBy("tree_id", "k").agg(F.sum("d").alias("d"))
    total = F.sum("d").over(Window.partitionBy("tree_id").orderBy("k"))
    counted = both.withColumn("crossings", total).select("tree_id", "k", "crossings")
    return ks.join(counted, ["tree_id", "k"]).select("tree_id", F.col("k").cast("int").alias("k"), radius(F.col("k")).alias("radius"), "crossings")


def sholl_at(nodes: DataFrame, r: float) -> DataFrame:
    """(tree_id, crossings) at one radius."""
    e = sholl_edges(nodes)
    return e.groupBy("tree_id").agg(F.sum(((F.col("lo") <= r) & (F.col("hi") > r)).cast("long")).alias("crossings"))


def sholl_statistics(nodes: DataFrame, steps: int = 20) -> DataFrame:
    """(tree_id, avg, std, sum) of the crossings; std is that of the population."""
    return sholl(nodes, steps).groupBy("tree_id").agg(F.avg("crossings").alias("avg"), F.stddev_pop("crossings").alias("std"), F.sum("crossings").alias("sum"))


# Section: registry


def _nodes_where(cond: str) -> Callable[[DataFrame], DataFrame]:
    return lambda n: radial_distance(T.child_counts(n)).where(cond).select("tree_id", F.col("id").alias("pos"), F.col("radial_distance").alias("value"))


def _count_where(cond: str) -> Callable[[DataFrame], DataFrame]:
    return lambda n: T.child_counts(n).groupBy("tree_id").agg(F.sum(F.expr(cond).cast("double")).alias("value")).withColumn("pos", F.lit(0))


FEATURES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "length": lambda n: tree_summary(n).select("tree_id", F.lit(0).alias("pos"), F.col("length").alias("value")),
    "node_count": _count_where("true"),
    "node_radial_distance": _nodes_where("true"),
    "node_branch_order": lambda n: node_branch_order(n).select("tree_id", F.col("id").alias("pos"), F.col("branch_order").cast("double").alias("value")),
    "furcation_count": _count_where("n_children > 1"),
    "furcation_radial_distance": _nodes_where("n_children > 1"),
    "bifurcation_count": _count_where("n_children > 1"),
    "bifurcation_radial_distance": _nodes_where("n_children > 1"),
    "tip_count": _count_where("n_children = 0"),
    "tip_radial_distance": _nodes_where("n_children = 0"),
    "path_count": _count_where("n_children = 0"),
    "path_length": lambda n: path_features(n).select("tree_id", F.col("tip").alias("pos"), F.col("length").alias("value")),
    "path_tortuosity": lambda n: path_features(n).select("tree_id", F.col("tip").alias("pos"), F.col("tortuosity").alias("value")),
    "branch_count": lambda n: branch_count(n).select("tree_id", F.lit(0).alias("pos"), F.col("n_branches").cast("double").alias("value")),
    "branch_length": lambda n: branch_features(n).select("tree_id", F.col("branch_id").alias("pos"), F.col("length").alias("value")),
    "branch_tortuosity": lambda n: branch_features(n).select("tree_id", F.col("branch_id").alias("pos"), F.col("tortuosity").alias("value")),
    "sholl": lambda n: sholl(n).select("tree_id", F.col("k").alias("pos"), F.col("crossings").cast("double").alias("value")),
}


def extract(nodes: DataFrame, *names: str) -> DataFrame:
    """(tree_id, feature, pos, value) of the named features; ValueError for an unknown name."""
    out = None
    for name in names:
        if name not in FEATURES:
            raise ValueError(f"unknown feature: {name}")
        one = FEATURES[name](nodes).select("tree_id", F.lit(name).alias("feature"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def padded(long_form: DataFrame, fill: float = 0.0) -> DataFrame:
    """(tree_id, feature, values): ordered by pos, filled with ``fill`` to the longest of the feature."""
    g = long_form.groupBy("tree_id", "feature").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_v"))
    top = g.groupBy("feature").agg(F.max(F.size("_v")).alias("_n"))
    v = F.transform("_v", lambda s: s["value"])
    return g.join(F.broadcast(top), "feature").select("tree_id", "feature", F.concat(v, F.array_repeat(F.lit(fill), F.col("_n") - F.size(v))).alias("values"))


def histogram(long_form: DataFrame, bins: int = 20) -> DataFrame:
    """(feature, bin, low, high, n): equal bins over the values that are not 0, the last one closed."""
    v = long_form.where("value <> 0")
    ends = v.groupBy("feature").agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    j = v.join(F.broadcast(ends), "feature")
    width = (F.col("_b") - F.col("_a")) / bins
    k = F.least(F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("_a"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    n = j.groupBy("feature", k.alias("bin")).agg(F.count("*").alias("n"))
    full = ends.select("feature", "_a", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("_a") + F.col("bin") * F.col("_w")
    return full.join(n, ["feature", "bin"], "left").select("feature", "bin", low.alias("low"), (low + F.col("_w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
