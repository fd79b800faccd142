"""Voxel operators: per-voxel expressions over a voxel table, and whole-stack filters.

A voxel table is (path, i, j, k, c, v). Point-wise operators and statistics run on it as built-in
expressions; filters that need a neighbourhood of the whole stack map rows of image stacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import SCHEMA, array, row
from . import folds
from . import topology as T

KEY = "path"


def voxels(images: DataFrame) -> DataFrame:
    """(path, i, j, k, c, v) of image stacks."""

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = array(r.shape, r.dtype, bytes(r.data))
                i, j, k, c = (x.ravel() for x in np.indices(a.shape))
                yield pd.DataFrame({"path": r.path, "i": i, "j": j, "k": k, "c": c, "v": a.ravel().astype(float)})

    return images.mapInPandas(run, "path string, i int, j int, k int, c int, v double")


def map_stacks(images: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Image stacks changed one by one by an array function."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([row(r.path, fn(array(r.shape, r.dtype, bytes(r.data)))) for r in pdf.itertuples()], columns=["path", "shape", "dtype", "data"])

    return images.select("path", "shape", "dtype", "data").mapInPandas(run, SCHEMA)


# Section: statistics


def contrasts(v: DataFrame, foreground: Column | None = None) -> DataFrame:
    """(path, std, michelson, rms, weber) of every stack; weber is null without a foreground mask."""
    lo, hi = F.min("v"), F.max("v")
    out = [F.stddev_pop("v").alias("std"), F.try_divide(hi - lo, hi + lo).alias("michelson"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")]
    if foreground is not None:
        bg = F.avg(F.when(~foreground, F.col("v")))
        out.append(F.try_divide(F.avg(F.when(foreground, F.col("v"))) - bg, bg).alias("weber"))
    else:
        out.append(F.lit(None).cast("double").alias("weber"))
    return v.groupBy(KEY).agg(*out)


def contrast_scaled(v: DataFrame, factor: float) -> DataFrame:
    return v.withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") * factor)))


def folder_statistics(v: DataFrame) -> DataFrame:
    """One row: count, minimum, maximum, mean of all voxels and the mean over places of the variance over stacks."""
    at = [c for c in ("i", "j", "k", "c") if c in v.columns]
    per = v.groupBy(*at).agg(F.var_samp("v").alias("_var"), F.sum("v").alias("_s"), F.count("v").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return per.agg(F.max("_n").alias("count"), F.min("_lo").alias("minimum"), F.max("_hi").alias("maximum"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.avg("_var").alias("variance"))


# Section: point-wise


def scale(v: DataFrame, k: float) -> DataFrame:
    return v.withColumn("v", F.col("v") * k)


def clip(v: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    return v.withColumn("v", F.greatest(F.lit(low), F.least(F.lit(high), F.col("v"))))


def normalise(v: DataFrame) -> DataFrame:
    """(v - mean) / variance of each stack; null where the variance is 0."""
    s = v.groupBy(KEY).agg(F.avg("v").alias("_m"), F.var_pop("v").alias("_d"))
    return v.join(s, KEY).withColumn("v", F.try_divide(F.col("v") - F.col("_m"), F.col("_d"))).select(*v.columns)


def adjust(v: DataFrame, mean: float, variance: float) -> DataFrame:
    return v.withColumn("v", (F.col("v") - mean) / variance)


def to_unit_range(v: DataFrame, low: float, high: float, clipped: bool = True) -> DataFrame:
    out = v.withColumn("v", (F.col("v") - low) / (high - low))
    return clip(out) if clipped else out


def equalise(v: DataFrame, bins: int = 256) -> DataFrame:
    """Histogram equalisation: values through the cumulative share of equal bins, linear between their left edges."""
    ends = v.groupBy(KEY).agg(F.min("v").alias("_a"), F.max("v").alias("_b"), F.count("*").alias("_n"))
    j = v.join(ends, KEY)
    width = (F.col("_b") - F.col("_a")) / bins
    pos = F.coalesce(F.try_divide(F.col("v") - F.col("_a"), width), F.lit(0.0))
    j = j.withColumn("_pos", pos).withColumn("_bin", F.least(F.floor(pos), F.lit(bins - 1)).cast("int"))
    h = j.groupBy(KEY, "_bin").agg(F.count("*").alias("_c"))
    full = ends.select(KEY, "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin")).join(h, [KEY, "_bin"], "left")
    w = Window.partitionBy(KEY).orderBy("_bin")
    cum = F.sum(F.coalesce("_c", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("_n")
    cdf = full.withColumn("_f", cum).withColumn("_g", F.coalesce(F.lead("_f").over(w), F.col("_f"))).select(KEY, "_bin", "_f", "_g")
    out = j.join(cdf, [KEY, "_bin"])
    share = F.least(F.col("_pos") - F.col("_bin"), F.lit(1.0))
    return out.withColumn("v", F.col("_f") + F.when(F.col("_bin") < bins - 1, share * (F.col("_g") - F.col("_f"))).otherwise(0.0)).select(*v.columns)


def flip(v: DataFrame, axis: str = "j") -> DataFrame:
    top = v.groupBy(KEY).agg(F.max(axis).alias("_m"))
    return v.join(top, KEY).withColumn(axis, F.col("_m") - F.col(axis)).select(*v.columns)


def center_crop(v: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """The middle (sx, sy, sz) of every stack; indices start at 0 again."""
    top = v.groupBy(KEY).agg(*((F.max(a) + 1).alias(f"_{a}") for a in "ijk"))
    j = v.join(top, KEY)
    for a, n in zip("ijk", size):
        first = F.floor((F.col(f"_{a}") - n) / 2).cast("int")
        j = j.where((F.col(a) >= first) & (F.col(a) < first + n)).withColumn(a, F.col(a) - first)
    return j.select(*v.columns)


# Section: whole stacks


def sigmoid(a: np.ndarray, sigma: float = 3.0, percentile: float = 25.0) -> np.ndarray:
    x = a / 255.0
    return (255 / (1 + np.exp(-sigma * (x - np.percentile(x, percentile))))).astype(np.uint8)


def subtract_min_z(a: np.ndarray) -> np.ndarray:
    """Less the minimum in a window as deep as the stack, centred along z, with the maximum beyond its ends."""
    d = a.shape[2]
    out = np.empty_like(a)
    for z in range(d):
        lo, hi = z - d // 2, z - d // 2 + d
        out[:, :, z] = a[:, :, max(lo, 0) : min(hi, d)].min(2)
    return a - out


def _gauss(a: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    if not r:
        return a
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric")
    return sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))


def bilateral(a: np.ndarray, spatial: tuple[float, float, float] = (1, 1, 0.33), value: float = 35.0) -> np.ndarray:
    """Each voxel the mean of the stack, weighted by the smoothed stack and likeness of value.

    The weights depend on a voxel's value alone, so each of the at most 256 values is worked out once.
    """
    x = a.astype(float)
    s = x
    for axis, g in enumerate(spatial):
        s = _gauss(s, g, axis)
    out = np.zeros_like(a)
    for v in np.unique(a):
        w = s * np.exp(-((x - float(v)) ** 2) / (2 * value**2))
        out[a == v] = (x * w).sum() / max(w.sum(), 1e-12)
    return out


def high_pass(a: np.ndarray) -> np.ndarray:
    """Without frequencies nearer to zero than a quarter of the depth."""
    h, w, d = a.shape[:3]
    f = np.fft.fftshift(np.fft.fftn(a))
    off = [(np.arange(n) - n / 2) ** 2 for n in (h, w, d)]
    far = np.sqrt(off[0][:, None, None] + off[1][:, None] + off[2]) > d // 4
    return np.clip(np.real(np.fft.ifftn(np.fft.ifftshift(f * far[..., None]))), 0, 255).astype(np.uint8)


def preprocess(a: np.ndarray) -> np.ndarray:
    """sigmoid, less the minimum along z, bilateral, high pass."""
    return high_pass(bilateral(subtract_min_z(sigmoid(a))))


AUGMENTATIONS: list[Callable[[np.ndarray], np.ndarray]] = [
    lambda a: a.swapaxes(0, 1), lambda a: a.swapaxes(0, 2), lambda a: a.swapaxes(1, 2),
    lambda a: np.flip(a, 0), lambda a: np.flip(a, 1), lambda a: np.flip(a, 2),
    lambda a: np.rot90(a, 1, (0, 1)), lambda a: np.rot90(a, 1, (0, 2)), lambda a: np.rot90(a, 1, (1, 2)),
]


def augment(a: np.ndarray, method: int) -> np.ndarray:
    """One of nine; -1 leaves the stack as it is."""
    return a if method == -1 else AUGMENTATIONS[method](a)


def augmentation_schedule(n: int, k: int, seed: int = 0, include_identity: bool = True) -> np.ndarray:
    """(2, n * k): k different methods for each of n images, as image and method."""
    rng = np.random.default_rng(seed)
    methods = np.arange(-1 if include_identity else 0, len(AUGMENTATIONS))
    if k > len(methods):
        raise ValueError("more augmentations than methods")
    drawn = [rng.choice(methods, k, replace=False) for _ in range(n)]
    return np.array([np.arange(n).repeat(k), np.concatenate(drawn)]) if n else np.zeros((2, 0), int)


# Section: rasterisation


#: Voxels of the boxes about a tree's edges up to which one task takes the tree as a whole.
WHOLE = 20_000_000


def voxelise(nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(tree_id, i, j, k) of the voxels of a tree: those whose centre lies in a round cone of an edge.

    Each edge is taken in pieces about as long as thick and each piece yields the voxels of its own box,
    so work follows the volume of the tree and not the box of the whole. Centres are at (i + 0.5) *
    resolution. Edges of a tree meet in one task, which lists each voxel once, so no voxel goes through an
    exchange; only those of trees of more than ``WHOLE`` voxels do.
    """
    res = float(resolution)
    kind = dict(nodes.dtypes)["tree_id"]
    schema = f"tree_id {kind}, i int, j int, k int"
    columns = [f"{e}_{c}" for e in "pc" for c in "xyzr"]
    edges = T.edges(nodes).select("tree_id", "id", *columns, "length")
    across = 2 * F.greatest("p_r", "c_r") / res + 2
    volume = F.sum((F.col("length") / res + across) * across * across)
    large = edges.groupBy("tree_id").agg(volume.alias("_v")).where(F.col("_v") > WHOLE).select("tree_id")
    large = large if large.limit(1).count() else None

    def found(t: pa.Table) -> list[np.ndarray]:
        ends = np.stack([folds.numbers(t, c).astype(float) for c in columns], 1)
        return [_edge_voxels(e[:3], e[4:7], e[3], e[7], res) for e in ends]

    def table(tree_ids: pa.ChunkedArray, sizes: np.ndarray, v: np.ndarray) -> pa.Table:
        v = v.astype(np.int32)
        return pa.table([tree_ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *(pa.array(v[:, k]) for k in range(3))], ["tree_id", "i", "j", "k"])

    def by_tree(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        per = found(t)
        held, sizes, first = [], [], 0
        for n, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(per)])):
            held.append(_distinct(np.concatenate(per[a:b])))
            sizes.append(len(held[-1]))
            per[a:b] = [None] * (b - a)
            if sum(sizes) > 200_000 or n + 1 == len(starts):
                yield table(t["tree_id"].take(pa.array(starts[first : n + 1])), np.array(sizes), np.concatenate(held))
                held, sizes, first = [], [], n + 1

    # an edge yields many rows, so trees are spread by number and not by size
    tasks = folds.spread(nodes)
    few = edges if large is None else edges.join(large, "tree_id", "left_anti")
    out = folds.in_groups(few.drop("length"), ("tree_id",), ("id",), by_tree, schema, rows=500, tasks=tasks)
    if large is None:
        return out

    def by_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                t = pa.Table.from_batches([b.slice(i, 200)])
                per = found(t)
                yield from table(t["tree_id"], np.array([len(v) for v in per]), np.concatenate(per)).to_batches()

    rest = edges.join(large, "tree_id", "left_semi").select("tree_id", *columns)
    return out.unionByName(rest.repartition(tasks, *rest.columns).mapInArrow(by_edge, schema).distinct())


def _distinct(v: np.ndarray) -> np.ndarray:
    """The rows of v (n, 3), each once and in order."""
    if not len(v):
        return v
    low = v.min(0)
    span = v.max(0) - low + 1
    if float(span[0]) * float(span[1]) * float(span[2]) >= 2**62:
        return np.unique(v, axis=0)
    code = np.sort(((v[:, 0] - low[0]) * span[1] + (v[:, 1] - low[1])) * span[2] + (v[:, 2] - low[2]))
    code = code[np.append(True, code[1:] != code[:-1])]
    code, k = np.divmod(code, span[2])
    i, j = np.divmod(code, span[1])
    return np.stack([i + low[0], j + low[1], k + low[2]], 1)


def _edge_voxels(p: np.ndarray, c: np.ndarray, rp: float, rc: float, res: float) -> np.ndarray:
    """(n, 3) voxels whose centre lies in the round cone from p to c, some more than once."""
    axis = c - p
    size, wide = float(axis @ axis), max(rp, rc)
    m = max(int(np.ceil(np.sqrt(size) / (2 * wide + 2 * res))), 1)
    out = []
    for first in range(0, m, 256):  # some pieces at a time, however long the edge
        t = np.arange(first, min(first + 256, m) + 1) / m
        along = p + axis * t[:, None]
        lo = np.floor((np.minimum(along[:-1], along[1:]) - wide) / res).astype(np.int64)
        hi = np.ceil((np.maximum(along[:-1], along[1:]) + wide) / res).astype(np.int64)
        n = (hi - lo + 1).max(0)
        x = [lo[:, k, None] + np.arange(n[k]) for k in range(3)]
        q = [(x[k] + 0.5) * res - p[k] for k in range(3)]
        wing = lambda k: q[k].reshape(len(lo), *(n[k] if k == d else 1 for d in range(3)))
        dot = sum(wing(k) * axis[k] for k in range(3))
        q2 = sum(wing(k) ** 2 for k in range(3))
        s = np.clip(dot / size, 0, 1) if size else np.zeros_like(dot)
        # first the distance to the axis, which few voxels of a box pass; then the exact one
        piece, i, j, k = np.nonzero(q2 - 2 * s * dot + s * s * size <= wide * wide + 1e-9)
        v = np.stack([lo[piece, 0] + i, lo[piece, 1] + j, lo[piece, 2] + k], 1)
        to = (v + 0.5) * res - p
        out.append(v[_in_round_cone(to, axis, rp, rc)])
    return out[0] if len(out) == 1 else np.concatenate(out)


def _in_round_cone(to: np.ndarray, axis: np.ndarray, ra: float, rb: float) -> np.ndarray:
    """Whether ``solids.sdf_round_cone`` of points, relative to the start of the axis, is 0 or less."""
    size, fall = float(axis @ axis), ra - rb
    reach = size - fall * fall
    to2 = (to * to).sum(1)
    after2 = ((to - axis) ** 2).sum(1)
    in_a, in_b = np.sqrt(to2) - ra <= 0, np.sqrt(after2) - rb <= 0
    if size <= 0 or reach <= 0:
        return in_a | in_b
    before = to @ axis
    after = before - size
    across = to * size - axis * before[:, None]
    wide = (across * across).sum(1)
    tilt = np.sign(fall) * wide * fall * fall
    near_a = reach * size * before * before * np.sign(before) < tilt
    near_b = reach * size * after * after * np.sign(after) > tilt
    between = (before * fall + np.sqrt(np.maximum(reach * wide / size, 0))) / size - ra <= 0
    return np.where(near_a, in_a, np.where(near_b, in_b, between))


def to_stacks(v: DataFrame) -> DataFrame:
    """Image stacks (uint8, 255 inside) of voxels (tree_id, i, j, k), cut to their box; path is the tree's id."""
    box = v.groupBy("tree_id").agg(*(F.min(a).alias(f"l{a}") for a in "ijk"), *(F.max(a).alias(f"h{a}") for a in "ijk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        a = np.zeros((f.hi - f.li + 1, f.hj - f.lj + 1, f.hk - f.lk + 1, 1), np.uint8)
        a[pdf.i - f.li, pdf.j - f.lj, pdf.k - f.lk] = 255
        return pd.DataFrame([row(str(f.tree_id), a)], columns=["path", "shape", "dtype", "data"])

    return v.join(box, "tree_id").groupBy("tree_id").applyInPandas(run, SCHEMA)
