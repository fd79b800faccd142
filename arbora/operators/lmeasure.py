"""L-Measure morphometrics, as tables by node, compartment, bifurcation, branch and tree.

Angles are in degrees and null where a vector is zero. A bifurcation is a node with exactly two
children, taken in order of id. ``compartment_point`` chooses the end (0: parent, -1: child) whose
radius stands for a compartment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solids as S
from ..functions import vector as V
from . import topology as T
from .features import branch_count, radial_distance, tree_summary
from .surgery import rank


def node_metrics(nodes: DataFrame) -> DataFrame:
    """tree_id, id, type, diameter, diameter_pow, section_area, euc_distance."""
    d = 2 * F.col("r")
    return radial_distance(nodes).select("tree_id", "id", "type", d.alias("diameter"), F.pow(d, F.lit(1.5)).alias("diameter_pow"), S.circle_area(F.col("r")).alias("section_area"), F.col("radial_distance").alias("euc_distance"))


def node_orders(nodes: DataFrame) -> DataFrame:
    """tree_id, id, path_distance, branch_order, terminal_degree."""
    w = T.root_walk(nodes)
    t = T.gather(w, {"terminal_degree": ((F.col("n_children") == 0).cast("long"), "sum")})
    return w.join(t, ["tree_id", "id"]).select("tree_id", "id", F.col("path_length").alias("path_distance"), "branch_order", "terminal_degree")


def compartment_metrics(nodes: DataFrame, compartment_point: int = -1) -> DataFrame:
    """tree_id, id (of the child), length, surface, volume of every compartment, as cylinders."""
    if compartment_point not in (0, -1):
        raise ValueError("compartment_point must be 0 or -1")
    r = F.col("c_r" if compartment_point == -1 else "p_r")
    return T.edges(nodes).select("tree_id", "id", "length", S.cylinder_side_area(r, F.col("length")).alias("surface"), S.cylinder_volume(r, F.col("length")).alias("volume"))


def helix(nodes: DataFrame) -> DataFrame:
    """tree_id, id, helix: triple product of three steps in a row over three times their lengths."""
    p = T.with_parent(nodes, "pid", "x", "y", "z").where(~T.is_root() & (F.col("p_pid") != -1))
    g = T.with_parent(nodes, "x", "y", "z").where(~T.is_root())
    # n2 -> n1 -> parent -> grandparent
    up = g.select("tree_id", F.col("id").alias("p_pid"), *(F.col(c).alias(f"g_{c}") for c in "xyz"), *(F.col(f"p_{c}").alias(f"h_{c}") for c in "xyz"))
    j = p.join(up, ["tree_id", "p_pid"])
    a, b, c = V.sub(V.vec("p_"), V.vec("g_")), V.sub(V.vec("g_"), V.vec("h_")), V.sub(V.vec(), V.vec("p_"))
    n = 3 * V.norm(a) * V.norm(b) * V.norm(c)
    return j.select("tree_id", "id", F.try_divide(V.dot(V.cross(a, b), c), F.when(n > 0, n)).alias("helix"))


def _pairs(nodes: DataFrame) -> DataFrame:
    """Bifurcations with their parent (p_*, null at roots) and children a, b (structs)."""
    at = F.struct("id", "x", "y", "z", "r")
    kids = nodes.where(~T.is_root()).groupBy("tree_id", F.col("pid").alias("id")).agg(F.count("*").alias("_n"), F.min(at).alias("a"), F.max(at).alias("b")).where("_n = 2")
    return T.with_parent(nodes, "id", "x", "y", "z", "r").join(kids.drop("_n"), ["tree_id", "id"])


def bifurcation_local(nodes: DataFrame) -> DataFrame:
    """tree_id, id, ampl_local, tilt_local, daughter_ratio, parent_daughter_ratio, pk_classic, pk_2.

    What needs the parent is null at the root.
    """
    b = _pairs(nodes)
    u, v = V.sub(V.of(F.col("a")), V.vec()), V.sub(V.of(F.col("b")), V.vec())
    up = V.sub(V.vec("p_"), V.vec())
    tilt = F.least(F.degrees(V.angle(up, u)), F.degrees(V.angle(up, v)))
    da, db, dp = 2 * F.col("a.r"), 2 * F.col("b.r"), 2 * F.col("p_r")
    hi, lo = F.greatest(da, db), F.least(da, db)

    def pk(k: float) -> Column:
        return F.try_divide(F.pow(da, F.lit(k)) + F.pow(db, F.lit(k)), F.pow(dp, F.lit(k)))

    return b.select(
        "tree_id", "id", F.degrees(V.angle(u, v)).alias("ampl_local"), F.when(~T.is_root(), tilt).alias("tilt_local"),
        F.try_divide(hi, lo).alias("daughter_ratio"), F.try_divide(hi, 2 * F.col("r")).alias("parent_daughter_ratio"),
        pk(1.5).alias("pk_classic"), pk(2.0).alias("pk_2"),
    )


def rall_power(nodes: DataFrame, absolute: bool = False) -> DataFrame:
    """tree_id, id, rall_power, pk of bifurcations below the root.

    The power p in 0, 0.005, ... below 5 with the smallest da^p + db^p - dp^p (of its absolute value, if
    ``absolute``); the first of equal ones. pk is (da^p + db^p) / dp^p.
    """
    b = _pairs(nodes).where(~T.is_root())
    da, db, dp = 2 * F.col("a.r"), 2 * F.col("b.r"), 2 * F.col("p_r")
    steps = F.sequence(F.lit(0), F.lit(999))

    def value(k: Column) -> Column:
        p = k * F.lit(5) / F.lit(1000)
        y = F.pow(da, p) + F.pow(db, p) - F.pow(dp, p)
        return F.struct((F.abs(y) if absolute else y).alias("y"), p.alias("p"))

    best = F.array_min(F.transform(steps, value))["p"]
    out = b.withColumn("rall_power", best)
    p = F.col("rall_power")
    return out.select("tree_id", "id", "rall_power", F.try_divide(F.pow(da, p) + F.pow(db, p), F.pow(dp, p)).alias("pk"))


def _remote(nodes: DataFrame) -> DataFrame:
    """Bifurcations with parent and a, b as the far ends of the daughters' branches."""
    ends = T.branches(nodes).groupBy("tree_id", "branch_id").agg(F.max_by(F.struct("x", "y", "z"), "pos").alias("_e"))
    b = _pairs(nodes)
    for k in "ab":
        e = ends.select("tree_id", F.col("branch_id").alias(f"_{k}"), F.col("_e").alias(f"{k}_end"))
        b = b.withColumn(f"_{k}", F.col(f"{k}.id")).join(e, ["tree_id", f"_{k}"])
    return b


def bifurcation_remote(nodes: DataFrame) -> DataFrame:
    """tree_id, id, ampl_remote, tilt_remote."""
    b = _remote(nodes)
    u, v = V.sub(V.of(F.col("a_end")), V.vec()), V.sub(V.of(F.col("b_end")), V.vec())
    up = V.sub(V.vec("p_"), V.vec())
    tilt = F.least(F.degrees(V.angle(up, u)), F.degrees(V.angle(up, v)))
    return b.select("tree_id", "id", F.degrees(V.angle(u, v)).alias("ampl_remote"), F.when(~T.is_root(), tilt).alias("tilt_remote"))


def torque(nodes: DataFrame, remote: bool = False) -> DataFrame:
    """tree_id, id, torque: angle between the planes of a bifurcation and of the one before it.

    Bifurcations without another one directly before them (root, or a node with more children) are left out.
    """
    b = _remote(nodes) if remote else _pairs(nodes)
    u, v = ("a_end", "b_end") if remote else ("a", "b")
    plane = V.cross(V.sub(V.of(F.col(u)), V.vec()), V.sub(V.of(F.col(v)), V.vec()))
    b = b.select("tree_id", "id", F.struct(*(c.alias(k) for c, k in zip(plane, "xyz"))).alias("plane"))
    # a bifurcation that ends a branch has the branch's start before it
    before = T.contracted(nodes).select("tree_id", "id", F.col("pid").alias("_start"))
    q = b.select("tree_id", F.col("id").alias("_start"), F.col("plane").alias("_plane"))
    j = b.join(before, ["tree_id", "id"]).join(q, ["tree_id", "_start"])
    return j.select("tree_id", "id", F.degrees(V.angle(V.of(F.col("plane")), V.of(F.col("_plane")))).alias("torque"))


def partition_asymmetry(nodes: DataFrame) -> DataFrame:
    """tree_id, id, partition_asymmetry: |n1 - n2| / (n1 + n2 - 2) of the tips under both children; 0 if equal."""
    n = T.child_counts(nodes)
    t = T.gather(n, {"tips": ((F.col("n_children") == 0).cast("long"), "sum")})
    kids = n.where(~T.is_root()).join(t, ["tree_id", "id"]).groupBy("tree_id", F.col("pid").alias("id"))
    k = kids.agg(F.count("*").alias("_n"), F.min("tips").alias("a"), F.max("tips").alias("b")).where("_n = 2")
    value = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.try_divide((F.col("b") - F.col("a")).cast("double"), (F.col("a") + F.col("b") - 2).cast("double")))
    return k.select("tree_id", "id", value.alias("partition_asymmetry"))


def branch_metrics(nodes: DataFrame) -> DataFrame:
    """tree_id, branch_id, pathlength, contraction, fragmentation, taper_1, taper_2, terminal, last_parent_diam, hillman_threshold, fractal_dim.

    contraction is null at length 0. fragmentation counts compartments. hillman_threshold is half the
    mean of the diameters of a branch's end and its two daughters. fractal_dim is the slope of log path
    length over log straight distance along the branch (null below three usable nodes).
    """
    b = T.branches(nodes)
    n = T.child_counts(nodes).select("tree_id", "id", "n_children")
    g = b.groupBy("tree_id", "branch_id").agg(F.min_by(F.struct("id", "r", "x", "y", "z"), "pos").alias("_a"), F.max_by(F.struct("id", "r"), "pos").alias("_b"), (F.count("*") - 1).alias("fragmentation"))
    g = g.join(T.branch_lengths(b).select("tree_id", "branch_id", "length", "straight"), ["tree_id", "branch_id"])
    g = g.withColumn("_end", F.col("_b.id")).join(n.select("tree_id", F.col("id").alias("_end"), "n_children"), ["tree_id", "_end"])
    kids = nodes.where(~T.is_root()).groupBy("tree_id", F.col("pid").alias("_end")).agg(F.count("*").alias("_n"), F.sum("r").alias("_rs")).where("_n = 2")
    g = g.join(kids, ["tree_id", "_end"], "left").join(_fractal(b), ["tree_id", "branch_id"], "left")
    d0, d1 = 2 * F.col("_a.r"), 2 * F.col("_b.r")
    terminal = F.col("n_children") == 0
    return g.select(
        "tree_id", "branch_id", F.col("length").alias("pathlength"), F.try_divide(F.col("straight"), F.col("length")).alias("contraction"),
        "fragmentation", F.try_divide(d0 - d1, F.col("length")).alias("taper_1"), F.try_divide(d0 - d1, d0).alias("taper_2"), terminal.alias("terminal"),
        F.when(terminal, d0).alias("last_parent_diam"), ((d1 + 2 * F.col("_rs")) / 3 / 2).alias("hillman_threshold"), "fractal_dim",
    )


def _fractal(b: DataFrame) -> DataFrame:
    """Slope of log path length over log straight distance from the start of every branch."""
    w = Window.partitionBy("tree_id", "branch_id").orderBy("pos")
    step = V.distance(V.vec(), tuple(F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz"))
    s = b.withColumn("_d", step).withColumn("_p", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_e", V.distance(V.vec(), tuple(F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in "xyz")))
    s = s.where("_e > 0 AND _p > 0")
    slope = F.regr_slope(F.log("_p"), F.log("_e"))
    return s.groupBy("tree_id", "branch_id").agg(F.when(F.count("*") >= 2, slope).alias("fractal_dim"))


def trimmed_extent(nodes: DataFrame, percentile: float = 95.0) -> DataFrame:
    """tree_id, width, height, depth: extents along x, y, z of the middle ``percentile`` per cent of nodes.

    Of n sorted values those from place floor(n (1 - p) / 2) up to, not including, floor(n (1 - (1 - p) / 2)).
    """
    share, out = 1 - percentile / 100, None
    size = nodes.groupBy("tree_id").agg(F.count("*").alias("n"))
    lo, hi = F.floor(F.col("n") * (share / 2)), F.floor(F.col("n") * (1 - share / 2))
    for axis, name in zip("xyz", ("width", "height", "depth")):
        r = rank(nodes.select("tree_id", "id", F.col(axis).alias("_key"))).join(size, "tree_id")
        e = r.where((F.col("_rank") >= lo) & (F.col("_rank") < hi)).groupBy("tree_id").agg((F.max("_key") - F.min("_key")).alias(name))
        out = e if out is None else out.join(e, "tree_id")
    return out


def tree_metrics(nodes: DataFrame) -> DataFrame:
    """tree_id, n_stems, n_bifs, n_branch, n_tips, soma_surface."""
    soma = T.roots(nodes).groupBy("tree_id").agg(F.min_by("r", "id").alias("_r"))
    t = tree_summary(nodes).join(branch_count(nodes), "tree_id").join(soma, "tree_id")
    return t.select("tree_id", "n_stems", F.col("n_furcations").alias("n_bifs"), F.col("n_branches").alias("n_branch"), "n_tips", S.sphere_area(F.col("_r")).alias("soma_surface"))


def diameter_threshold(nodes: DataFrame) -> DataFrame:
    """tree_id, id, diam_threshold: diameter at the last bifurcation before each terminal branch."""
    m = T.contracted(nodes)
    tip = T.tips(nodes).select("tree_id", "id")
    start = m.join(tip, ["tree_id", "id"], "left_semi").select("tree_id", F.col("pid").alias("id"), F.col("branch_id"))
    return start.join(nodes.select("tree_id", "id", "r"), ["tree_id", "id"]).select("tree_id", F.col("branch_id").alias("id"), (2 * F.col("r")).alias("diam_threshold"))


PI = math.pi
