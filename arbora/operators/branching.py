"""Ordered operators along branches: smoothing, resampling, standard position, reversal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from . import folds
from . import topology as T

KEY = ("tree_id", "branch_id")


def from_points(df: DataFrame, points: str = "xyzr") -> DataFrame:
    """Branches of rows (tree_id, branch_id, array<struct<x, y, z[, r]>>): type 3, r 1 where it is missing."""
    kind = df.schema[points].dataType.elementType
    has_r = "r" in kind.fieldNames()
    e = df.select(*KEY, F.posexplode(points).alias("pos", "p"))
    r = F.col("p.r") if has_r else F.lit(1.0)
    return e.select(*KEY, "pos", F.col("pos").alias("id"), F.lit(3).alias("type"), "p.x", "p.y", "p.z", r.alias("r"))


def as_arrays(b: DataFrame) -> DataFrame:
    """(tree_id, branch_id, xyzr): one row a branch, points in order."""
    g = b.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z", "r"))).alias("_p"))
    return g.select(*KEY, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["r"].alias("r"))).alias("xyzr"))


def smooth(b: DataFrame, n: int = 5) -> DataFrame:
    """Moving average of x, y, z over n neighbours in order; ends stay, near them fewer are averaged.

    For even n the window reaches one further back, as a centred convolution does.
    """
    w = Window.partitionBy(*KEY).orderBy("pos")
    frame = w.rowsBetween(-(n // 2), (n - 1) // 2)
    end = (F.lag("pos").over(w).isNull()) | (F.lead("pos").over(w).isNull())
    return b.withColumns({c: F.when(end, F.col(c)).otherwise(F.avg(c).over(frame)) for c in "xyz"})


def smooth_tree(nodes: DataFrame, n: int = 5) -> DataFrame:
    """Every branch of the trees smoothed; root, furcations and tips stay."""
    s = smooth(T.branches(nodes), n).where("pos > 0").select("tree_id", "id", *(F.col(c).alias(f"_{c}") for c in "xyz"))
    j = nodes.join(s, ["tree_id", "id"], "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in "xyz"}).select(*nodes.columns)


def _measured(b: DataFrame) -> DataFrame:
    """b with _s, the length up to each point, _t, that of the next, and next x, y, z, r."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    step = V.distance(V.vec(), tuple(F.coalesce(F.lag(c).over(w), F.col(c)) for c in "xyz"))
    m = b.withColumn("_d", step).withColumn("_s", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_t", F.lead("_s").over(w)).withColumn("_len", F.sum("_d").over(Window.partitionBy(*KEY)))
    return m.withColumns({f"_n{c}": F.lead(c).over(w) for c in "xyzr"}).drop("_d")


def _sample(b: DataFrame, gap: Column, count: Column, last: bool) -> DataFrame:
    """Points at k * gap, k = 0 .. count - 1, and the end of the branch if ``last``; linear in between.

    Every piece between two points yields the samples that fall on it, so nothing is joined.
    """
    m = _measured(b).withColumn("_gap", gap).withColumn("_count", count.cast("int"))
    piece = m.where("_t IS NOT NULL AND _t > _s")
    final = F.col("_t") >= F.col("_len")
    a = F.greatest(F.ceil(F.col("_s") / F.col("_gap") - 1e-9).cast("int"), F.lit(0))
    z = F.least(F.ceil(F.col("_t") / F.col("_gap") - 1e-9).cast("int") - 1, F.col("_count") - 1)
    z = F.when(final, F.col("_count") - 1).otherwise(z)
    ks = F.when(a <= z, F.sequence(a, z)).otherwise(F.array().cast("array<int>"))
    rows = piece.withColumn("_k", F.explode(F.concat(ks, F.when(final & F.lit(last), F.array(F.col("_count"))).otherwise(F.array().cast("array<int>")))))
    at = F.when((F.col("_k") >= F.col("_count")) | (final & (F.col("_k") * F.col("_gap") > F.col("_t"))), F.col("_t")).otherwise(F.col("_k") * F.col("_gap"))
    share = (at - F.col("_s")) / (F.col("_t") - F.col("_s"))
    return rows.select(*KEY, F.col("_k").alias("pos"), *((F.col(c) + share * (F.col(f"_n{c}") - F.col(c))).alias(c) for c in "xyzr"))


def resample_linear(b: DataFrame, n: int) -> DataFrame:
    """n >= 2 points evenly spaced by length, both ends included. Branches of length 0 are n equal points."""
    if n < 2:
        raise ValueError("a branch needs two points at least")
    out = _sample(b, F.col("_len") / (n - 1), F.lit(n), False)
    m = b.groupBy(*KEY).agg(F.min_by(F.struct("x", "y", "z", "r"), "pos").alias("p"))
    flat = m.join(T.branch_lengths(b).where("length = 0").select(*KEY), list(KEY)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.unionByName(flat.select(*KEY, "pos", "p.x", "p.y", "p.z", "p.r"))


def resample_isometric(b: DataFrame, distance: float, adjust_last_gap: bool = True) -> DataFrame:
    """Points ``distance`` apart along the branch.

    With ``adjust_last_gap`` the ceil(length / distance) gaps are all equal; else only the last is
    shorter. Both ends are kept. Branches of length 0 are one point.
    """
    gaps = F.ceil(F.col("_len") / distance - 1e-12)
    if adjust_last_gap:
        out = _sample(b, F.col("_len") / gaps, gaps + 1, False)
    else:
        out = _sample(b, F.lit(float(distance)), gaps, True)
    m = b.groupBy(*KEY).agg(F.min_by(F.struct("x", "y", "z", "r"), "pos").alias("p"))
    flat = m.join(T.branch_lengths(b).where("length = 0").select(*KEY), list(KEY))
    return out.unionByName(flat.select(*KEY, F.lit(0).alias("pos"), "p.x", "p.y", "p.z", "p.r"))


def resample_tree(nodes: DataFrame, distance: float | None = None, n: int | None = None, adjust_last_gap: bool = True) -> DataFrame:
    """Trees whose branches are resampled (by ``distance`` or to ``n`` points) and joined again at their ends.

    Ids are new: the root is 0, a node is numbered by its branch and place. Types are those of the
    branch's end.
    """
    b = T.branches(nodes)
    s = resample_isometric(b, distance, adjust_last_gap) if distance is not None else resample_linear(b, n)
    ends = T.contracted(nodes).select("tree_id", "branch_id", F.col("id").alias("_end"), F.col("pid").alias("_start"))
    kinds = nodes.select("tree_id", F.col("id").alias("_end"), "type")
    top = s.groupBy(*KEY).agg(F.max("pos").alias("_last"))
    inner = s.where("pos > 0").join(ends, list(KEY)).join(top, list(KEY)).join(kinds, ["tree_id", "_end"])
    root = T.roots(nodes).select("tree_id", "type", "x", "y", "z", "r", F.struct(F.lit(-1).alias("b"), F.lit(0).alias("p")).alias("key"), F.lit(None).cast("struct<b:int,p:int>").alias("up"), F.col("id").alias("_root"))
    roots = root.select("tree_id", "_root")
    ended = ends.select("tree_id", F.col("_end").alias("_start"), F.col("branch_id").alias("_before"))
    lasts = top.select("tree_id", F.col("branch_id").alias("_before"), F.col("_last").alias("_before_last"))
    inner = inner.join(ended, ["tree_id", "_start"], "left").join(lasts, ["tree_id", "_before"], "left").join(roots, "tree_id")
    first = F.when(F.col("_start") == F.col("_root"), F.struct(F.lit(-1).alias("b"), F.lit(0).alias("p"))).otherwise(F.struct(F.col("_before").alias("b"), F.col("_before_last").alias("p")))
    up = F.when(F.col("pos") == 1, first).otherwise(F.struct(F.col("branch_id").alias("b"), (F.col("pos") - 1).alias("p")))
    rows = inner.select("tree_id", "type", "x", "y", "z", "r", F.struct(F.col("branch_id").alias("b"), F.col("pos").alias("p")).alias("key"), up.alias("up"))
    allrows = root.drop("_root").unionByName(rows)
    from .surgery import rank

    ranked = rank(allrows.withColumn("_key", F.col("key")).withColumn("id", F.col("key.p")))
    ids = ranked.select("tree_id", F.col("key").alias("up"), F.col("_rank").alias("_pid"))
    out = ranked.join(ids, ["tree_id", "up"], "left")
    return out.select("tree_id", F.col("_rank").alias("id"), "type", "x", "y", "z", "r", F.coalesce("_pid", F.lit(-1)).alias("pid"))


def reverse(b: DataFrame) -> DataFrame:
    """Branches in the other direction; the types of the two ends stay at their places."""
    top = b.groupBy(*KEY).agg(F.max("pos").alias("_last"), F.min_by("type", "pos").alias("_t0"), F.max_by("type", "pos").alias("_t1"))
    j = b.join(top, list(KEY)).withColumn("pos", F.col("_last") - F.col("pos"))
    kind = F.when(F.col("pos") == 0, F.col("_t0")).when(F.col("pos") == F.col("_last"), F.col("_t1")).otherwise(F.col("type"))
    return j.withColumn("type", kind).select(*b.columns)


def to_tree(b: DataFrame) -> DataFrame:
    """Every branch or path as a tree of its own: tree_id is a struct of tree and branch, ids are places."""
    return b.select(F.concat_ws("#", F.col("tree_id").cast("string"), F.col("branch_id").cast("string")).alias("tree_id"), F.col("pos").alias("id"), "type", "x", "y", "z", "r", (F.col("pos") - 1).alias("pid"))


def standard_matrix(xyz: np.ndarray) -> np.ndarray:
    """The 4 x 4 matrix that moves the start to the origin, the end to (1, 0, 0) and the point farthest
    from the axis into the upper xy-plane."""
    t = np.eye(4)
    t[:3, 3] = -xyz[0]
    v = xyz[-1] - xyz[0]
    size = np.linalg.norm(v)
    if not size:
        return t
    ex = v / size
    basis = np.eye(3)
    if len(xyz) > 2:
        d = xyz[1:-1] - xyz[0]
        off = d - np.outer(d @ ex, ex)
        k = int(np.argmax(np.linalg.norm(off, axis=1)))
        if np.linalg.norm(off[k]) > 1e-12:
            ey = off[k] / np.linalg.norm(off[k])
            basis = np.stack([ex, ey, np.cross(ex, ey)])
        else:
            basis = _frame(ex)
    else:
        basis = _frame(ex)
    r = np.eye(4)
    r[:3, :3] = basis / size
    return r @ t


def _frame(ex: np.ndarray) -> np.ndarray:
    a = np.eye(3)[int(np.argmin(np.abs(ex)))]
    ey = a - (a @ ex) * ex
    ey /= np.linalg.norm(ey)
    return np.stack([ex, ey, np.cross(ex, ey)])


def standardise(b: DataFrame) -> DataFrame:
    """(tree_id, branch_id, pos, x, y, z, r): branches in standard position (as by ``standard_matrix``), r over its maximum.

    A branch lies in one task, as its farthest point fixes the matrix of all; many branches are moved at once.
    """
    kinds = dict(b.dtypes)
    return folds.in_groups(b.select(*KEY, "pos", "x", "y", "z", "r"), KEY, ("pos",), _standard, f"tree_id {kinds['tree_id']}, branch_id {kinds['branch_id']}, pos int, x double, y double, z double, r double")


def _standard(t: pa.Table, starts: np.ndarray) -> pa.Table:
    xyz, r = np.stack([folds.numbers(t, c).astype(float) for c in "xyz"], 1), folds.numbers(t, "r").astype(float)
    n = len(xyz)
    sizes = np.diff(np.append(starts, n))
    branch = np.repeat(np.arange(len(starts)), sizes)
    dot = lambda a, b: a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]
    v = xyz[starts + sizes - 1] - xyz[starts]
    size = np.sqrt(dot(v, v))
    ex = v / np.where(size > 0, size, 1)[:, None]
    d = xyz - xyz[starts][branch]
    along = dot(d, ex[branch])
    off = d - along[:, None] * ex[branch]
    far = np.sqrt(dot(off, off))
    far[starts] = far[starts + sizes - 1] = -1  # the ends don't count
    top = np.maximum.reduceat(far, starts)
    row = np.minimum.reduceat(np.where(far == top[branch], np.arange(n), n), starts)
    ey = off[row] / np.where(top > 0, top, 1)[:, None]
    straight = top <= 1e-12
    a = np.eye(3)[np.abs(ex[straight]).argmin(1)]  # as in _frame
    a -= dot(a, ex[straight])[:, None] * ex[straight]
    ey[straight] = a / np.sqrt(dot(a, a))[:, None]
    ez = np.cross(ex, ey)
    out = np.stack([along, dot(d, ey[branch]), dot(d, ez[branch])], 1) / np.where(size > 0, size, 1)[branch, None]
    out = np.where((size > 0)[branch, None], out, d)
    most = np.maximum.reduceat(r, starts)[branch]
    return pa.table([t["tree_id"], t["branch_id"], t["pos"].cast(pa.int32()), *(pa.array(out[:, k]) for k in range(3)), pa.array(r / np.where(most != 0, most, 1))], ["tree_id", "branch_id", "pos", "x", "y", "z", "r"])
