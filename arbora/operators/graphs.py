"""Trees as graphs: edge lists with features, distances, products of matrices, clusters."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..runtime import unbroadcast
from . import folds
from . import topology as T


def to_graph(nodes: DataFrame, bidirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges (tree_id, src, dst), vertices (tree_id, id, features [x, y, z, r, type]))."""
    e = nodes.where(~T.is_root()).select("tree_id", F.col("pid").alias("src"), F.col("id").alias("dst"))
    if bidirected:
        e = e.unionByName(e.select("tree_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return e, nodes.select("tree_id", "id", F.array("x", "y", "z", "r", F.col("type").cast("double")).alias("features"))


def edge_distances(nodes: DataFrame) -> DataFrame:
    """(tree_id, i, j, v): length of every edge from parent i to child j, the entries of a sparse matrix."""
    return T.edges(nodes).select("tree_id", F.col("pid").alias("i"), F.col("id").alias("j"), F.col("length").alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of sparse matrices (tree_id, i, j, v), tree by tree."""
    left = a.select("tree_id", "i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select("tree_id", F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, ["tree_id", "k"]).groupBy("tree_id", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def pair_distances(nodes: DataFrame, within: float) -> DataFrame:
    """(tree_id, a, b, distance) of pairs of nodes of a tree at most ``within`` apart, a < b.

    Nodes meet through the cells of a grid of that width: in a task for trees that fit into one, by an equi-join
    for larger ones. No pair goes through an exchange.
    """
    kinds = dict(nodes.dtypes)
    points = nodes.select("tree_id", "id", "x", "y", "z")
    large = folds.large_trees(nodes)
    few = points if large is None else points.join(large, "tree_id", "left_anti")

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        xyz = np.stack([folds.numbers(t, c).astype(float) for c in "xyz"], 1)
        ids = folds.numbers(t, "id")
        for a, b, d in near_pairs(xyz, starts, within):
            low = ids[a] < ids[b]
            yield pa.table([t["tree_id"].take(pa.array(a)), pa.array(np.where(low, ids[a], ids[b])), pa.array(np.where(low, ids[b], ids[a])), pa.array(d)], ["tree_id", "a", "b", "distance"])

    out = folds.in_groups(few, ("tree_id",), ("id",), run, f"tree_id {kinds['tree_id']}, a {kinds['id']}, b {kinds['id']}, distance double")
    return out if large is None else out.unionByName(_joined_pairs(points.join(large, "tree_id", "left_semi"), within))


def near_pairs(xyz: np.ndarray, starts: np.ndarray, within: float, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, distances) of the pairs of points of the same group at most ``within`` apart, each once, about ``most`` candidates at a time."""
    n = len(xyz)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    cell = np.floor(xyz / within)
    axes, ranks = zip(*(np.unique(cell[:, k], return_inverse=True) for k in range(3)))
    if len(starts) * len(axes[0]) * len(axes[1]) * len(axes[2]) >= 2**62:  # the names of cells would not fit into 64 bits
        half = len(starts) // 2
        at = int(starts[half])
        for off, part in ((0, slice(0, half)), (at, slice(half, None))):
            rows = slice(0, at) if not off else slice(at, n)
            for a, b, d in near_pairs(xyz[rows], starts[part] - off, within, most):
                yield a + off, b + off, d
        return
    name = lambda g, r: ((g * len(axes[0]) + r[0]) * len(axes[1]) + r[1]) * len(axes[2]) + r[2]
    key = name(group, ranks)
    order = np.argsort(key, kind="stable")
    held = key[order]
    for step in itertools.product((-1, 0, 1), repeat=3):
        if step < (0, 0, 0):
            continue  # seen from the other cell
        if step == (0, 0, 0):
            rows = order
            lo, hi = np.arange(n) + 1, np.searchsorted(held, held, "right")
        else:
            there, other = np.ones(n, bool), []
            for k in range(3):
                want = cell[:, k] + step[k]
                r = np.minimum(np.searchsorted(axes[k], want), len(axes[k]) - 1)
                there &= axes[k][r] == want
                other.append(r)
            rows = np.flatnonzero(there)
            want = name(group[rows], [r[rows] for r in other])
            lo, hi = np.searchsorted(held, want, "left"), np.searchsorted(held, want, "right")
        count = np.maximum(hi - lo, 0)
        first = 0
        total = np.cumsum(count)
        while first < len(rows):
            last = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")), first + 1)
            c = count[first:last]
            a = np.repeat(rows[first:last], c)
            b = order[np.repeat(lo[first:last] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            d = xyz[a] - xyz[b]
            d = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            near = d <= within
            yield a[near], b[near], d[near]
            first = last


def _joined_pairs(nodes: DataFrame, within: float) -> DataFrame:
    cell = [F.floor(F.col(c) / within).alias(f"g{c}") for c in "xyz"]
    p = nodes.select("tree_id", F.col("id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in "xyz"), *cell)
    q = nodes.select("tree_id", F.col("id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in "xyz"), *cell)
    for c in "xyz":
        q = q.withColumn(f"g{c}", F.explode(F.array(*(F.col(f"g{c}") + d for d in (-1, 0, 1)))))
    d = V.distance(V.vec("a_"), V.vec("b_"))
    return p.join(unbroadcast(q), ["tree_id", "gx", "gy", "gz"]).where("a < b").withColumn("distance", d).where(F.col("distance") <= within).select("tree_id", "a", "b", "distance")


def clusters(nodes: DataFrame, k: int, max_iter: int = 20) -> DataFrame:
    """(id, cluster) of one tree's nodes by power iteration on its adjacency (weights 1 / (1 + length))."""
    from pyspark.ml.clustering import PowerIterationClustering

    e = T.edges(nodes).select(F.col("pid").cast("long").alias("src"), F.col("id").cast("long").alias("dst"), (1 / (1 + F.col("length"))).alias("weight"))
    p = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", weightCol="weight")
    return p.assignClusters(e).select(F.col("id").cast("int").alias("id"), "cluster")


def branch_tensors(branch_rows: DataFrame, radius: bool = True, channels_first: bool = True) -> DataFrame:
    """(tree_id, branch_id, values): xyz or xyzr of each branch as (channels, points) or (points, channels)."""
    names = "xyzr" if radius else "xyz"
    g = branch_rows.groupBy("tree_id", "branch_id").agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("_p"))
    if channels_first:
        v = F.array(*(F.col(f"_p.{c}") for c in names))
    else:
        v = F.transform("_p", lambda s: F.array(*(s[c] for c in names)))
    return g.select("tree_id", "branch_id", v.alias("values"))
