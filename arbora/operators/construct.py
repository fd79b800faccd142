"""Operators that visit a tree or a point cloud as a whole: exact order, spanning trees, assembly.

Spanning trees, assembly and callbacks are sequential by definition (each step depends on the last), so
a tree is one group here; many trees are worked on at once. The exact order of a large tree is worked out by
folds instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from . import folds
from . import topology as T

EPS = 1e-5
#: Nodes of a tree that one task numbers.
GROUP = 200_000
SOMA, GLIA = 1, 7
_NODE = "id int, type int, x double, y double, z double, r double, pid int"


def preorder(ids: np.ndarray, pids: np.ndarray) -> list[int]:
    """Row numbers in preorder, the last sibling first; exactly one root, else ValueError."""
    top = np.flatnonzero(pids == -1)
    if len(top) != 1:
        raise ValueError(f"a tree must have one root, not {len(top)}")
    kids: dict[int, list[int]] = {}
    for row, p in enumerate(pids.tolist()):
        kids.setdefault(p, []).append(row)
    out, stack = [], [int(top[0])]
    names = ids.tolist()
    while stack:
        row = stack.pop()
        out.append(row)
        stack += kids.get(names[row], [])
    return out


def _numbered(ids: np.ndarray, pids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers in preorder, new pids): nodes numbered from 0 in that order."""
    order = np.array(preorder(ids, pids), np.int64)
    new = dict(zip(ids[order].tolist(), range(len(order))))
    return order, np.array([new.get(p, -1) for p in pids[order].tolist()], np.int64)


def _trees(t: pa.Table, starts: np.ndarray, one: Callable[[slice], tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> pa.Table:
    """The table of all trees: ``one(rows of a tree)`` gives (rows to take, counted in the tree, their ids, their pids)."""
    took, ids, pids = [], [], []
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
        rows, i, p = one(slice(first, last))
        took.append(first + rows)
        ids.append(i)
        pids.append(p)
    rows = np.concatenate(took) if took else np.zeros(0, np.int64)
    out = t.take(pa.array(rows, pa.int64()))
    new = {"id": ids, "pid": pids}
    return pa.table([pa.array(np.concatenate(new[c]) if took else rows, pa.int32()) if c in new else out[c] for c in names], names)


def sort_nodes(nodes: DataFrame, group_up_to: int = GROUP) -> DataFrame:
    """Every tree numbered from 0 in preorder, the last sibling first; a tree without one root raises.

    Nodes that the root does not lead to go. Trees of up to ``group_up_to`` nodes are numbered one by one,
    larger ones by folds (``_sorted_by_folds``), with the same result.
    """
    size = cut(nodes.groupBy("tree_id").count())
    large = size.where(F.col("count") > group_up_to).select("tree_id")
    if large.isEmpty():
        return _sorted_in_tasks(nodes)
    small = nodes.join(large, "tree_id", "left_anti").select(*nodes.columns)
    return _sorted_in_tasks(small).unionByName(_sorted_by_folds(nodes.join(large, "tree_id", "left_semi").select(*nodes.columns)))


def _sorted_in_tasks(nodes: DataFrame) -> DataFrame:
    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, pids = folds.numbers(t, "id"), folds.numbers(t, "pid")

        def one(at: slice):
            order, up = _numbered(ids[at], pids[at])
            return order, np.arange(len(order)), up

        return _trees(t, starts, one, names)

    names = nodes.columns
    return folds.in_groups(nodes, ("tree_id",), ("id",), run, nodes.schema)


def _sorted_by_folds(nodes: DataFrame) -> DataFrame:
    """A node's number is one more than its parent's plus the sizes of the subtrees of later siblings: a fold up and one down."""
    n = T.check_single_root(nodes)
    size = T.gather(n.select("tree_id", "id", "pid"), {"_size": (F.lit(1).cast("long"), "sum")})
    ahead = Window.partitionBy("tree_id", "pid").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(T.is_root(), 0).otherwise(1 + F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    walk = n.select("tree_id", "id", "pid").join(size, ["tree_id", "id"]).withColumn("_step", step)
    new = T.climb(walk, {"_new": (F.col("_step"), "sum")})
    # only what the root leads to
    tops = T.roots(n).select("tree_id", F.col("id").alias("top"))
    new = cut(new.join(tops, ["tree_id", "top"], "left_semi").select("tree_id", "id", F.col("_new").cast("int").alias("_new")))
    out = n.join(new, ["tree_id", "id"]).join(new.select("tree_id", F.col("id").alias("pid"), F.col("_new").alias("_up")), ["tree_id", "pid"], "left")
    return out.withColumn("id", F.col("_new")).withColumn("pid", F.coalesce("_up", F.lit(-1))).select(*nodes.columns)


def _linked(ids: np.ndarray, pids: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    """pids by which each further component hangs on the nearest node of another, one after the other."""
    row = {v: i for i, v in enumerate(ids.tolist())}
    for p in pids.tolist():
        if p != -1 and p not in row:
            raise ValueError("a node's parent is missing")
    tops = np.flatnonzero(pids == -1).tolist()
    if len(tops) < 2:
        return pids
    label = list(range(len(ids)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, p in enumerate(pids.tolist()):
        if p != -1:
            label[find(i)] = find(row[p])
    part = np.array([find(i) for i in range(len(ids))])
    pids = pids.copy()
    for i in tops[1:]:
        mine = part == part[i]
        d = np.linalg.norm(xyz - xyz[i], axis=1)
        d[mine] = np.inf
        j = int(d.argmin())
        pids[i] = ids[j]
        part[mine] = part[j]
    return pids


def link_nearest(nodes: DataFrame) -> DataFrame:
    """Trees of several roots made one: every root but the first hangs on its nearest node of another part."""
    names = nodes.columns

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        ids, pids = folds.numbers(t, "id"), folds.numbers(t, "pid")
        xyz = np.stack([folds.numbers(t, c).astype(float) for c in "xyz"], 1)
        return _trees(t, starts, lambda at: (np.arange(at.stop - at.start), ids[at], _linked(ids[at], pids[at], xyz[at])), names)

    return folds.in_groups(nodes, ("tree_id",), ("id",), run, nodes.schema)


def spanning_tree(points: np.ndarray, bf: float = 0.0, furcations: int = 2, exclude_soma: bool = True) -> np.ndarray:
    """Parents (the first point is the root) of a greedy tree over points (n, 3).

    Each step joins the cheapest pair of a tree node i and a free point j, at distance + bf * (path
    length of i); ties to the smaller i, then j. A node with ``furcations`` children (-1: no bound)
    takes no more, except the root if ``exclude_soma``. Each free point keeps its best partner, so a step
    takes O(n), but for points whose partner just filled up.
    """
    n = len(points)
    pid, acc, kids = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    joined, open_ = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return pid
    joined[0] = open_[0] = True
    best = np.linalg.norm(points - points[0], axis=1)
    src = np.zeros(n, int)
    best[0] = np.inf
    for _ in range(n - 1):
        low = best.min()
        at = np.flatnonzero(best == low)
        j = int(at[np.lexsort((at, src[at]))[0]])
        i = int(src[j])
        pid[j], joined[j] = i, True
        acc[j] = acc[i] + np.linalg.norm(points[i] - points[j])
        kids[i] += 1
        best[j] = np.inf
        if furcations != -1 and kids[i] >= furcations and not (exclude_soma and i == 0):
            open_[i] = False
            lost = np.flatnonzero(~joined & (src == i))
            rows = np.flatnonzero(open_)
            if len(lost):
                best[lost] = np.inf
                for k in range(0, len(rows), block := max(1, 1_000_000 // len(lost))):
                    r = rows[k : k + block]
                    c = np.linalg.norm(points[lost] - points[r][:, None], axis=2) + (bf * acc[r])[:, None]
                    low = c.argmin(0)
                    c = c[low, np.arange(len(lost))]
                    up = c < best[lost]
                    best[lost[up]], src[lost[up]] = c[up], r[low[up]]
        if furcations != 0:
            open_[j] = True
            c = np.linalg.norm(points - points[j], axis=1) + bf * acc[j]
            up = ~joined & ((c < best) | ((c == best) & (j < src)))
            best[up], src[up] = c[up], j
    return pid


#: Points of a cloud whose distances are all held at once, and distances that are held for many clouds.
_PADDED, _HELD = 256, 2_000_000


def spanning_trees(clouds: list[np.ndarray], bf: float = 0.0, furcations: int = 2, exclude_soma: bool = True) -> list[np.ndarray]:
    """``spanning_tree`` of many clouds: small ones take each step together."""
    out: list[np.ndarray | None] = [None] * len(clouds)
    small = []
    for k, p in enumerate(clouds):
        if len(p) > _PADDED or len(p) < 2 or (furcations != -1 and furcations < 1) or not np.isfinite(p).all():
            out[k] = spanning_tree(p, bf, furcations, exclude_soma)
        else:
            small.append(k)
    small.sort(key=lambda k: -len(clouds[k]))
    at = 0
    while at < len(small):
        n = len(clouds[small[at]])
        some = small[at : at + max(1, _HELD // (n * n))]
        for k, pid in zip(some, _padded_trees([clouds[k] for k in some], bf, furcations, exclude_soma)):
            out[k] = pid[: len(clouds[k])]
        at += len(some)
    return out


def _padded_trees(clouds: list[np.ndarray], bf: float, furcations: int, exclude_soma: bool) -> np.ndarray:
    """Parents (clouds, points of the largest); the clouds come by falling size."""
    count = np.array([len(p) for p in clouds])
    m, n = len(clouds), int(count[0])
    points = np.zeros((m, n, 3))
    for k, p in enumerate(clouds):
        points[k, : len(p)] = p
    d = points[:, :, None] - points[:, None]
    d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
    pid, acc, kids = np.full((m, n), -1), np.zeros((m, n)), np.zeros((m, n), int)
    joined = np.arange(n) >= count[:, None]
    open_ = np.zeros((m, n), bool)
    joined[:, 0] = open_[:, 0] = True
    best, src = np.where(joined, np.inf, d[:, 0]), np.zeros((m, n), int)
    for step in range(1, n):
        left = int(np.searchsorted(-count, -step, "left"))  # clouds with a point still free
        t = np.arange(left)
        b, s, j_, o = best[:left], src[:left], joined[:left], open_[:left]
        j = np.where(b == b.min(1)[:, None], s, n).argmin(1)
        i = s[t, j]
        pid[t, j], j_[t, j], b[t, j] = i, True, np.inf
        acc[t, j] = acc[t, i] + d[t, i, j]
        kids[t, i] += 1
        if furcations != -1:
            full = (kids[t, i] >= furcations) & ~(exclude_soma & (i == 0))
            o[t[full], i[full]] = False
            k, lost = np.nonzero(~j_[full] & (s[full] == i[full, None]))
            if len(k):
                k = t[full][k]
                c = np.where(o[k], d[k, :, lost] + bf * acc[k], np.inf)
                low = c.argmin(1)
                b[k, lost], s[k, lost] = c[np.arange(len(k)), low], low
        o[t, j] = True
        c = d[t, j] + (bf * acc[t, j])[:, None]
        up = ~j_ & ((c < b) | ((c == b) & (j[:, None] < s)))
        np.copyto(b, c, where=up)
        np.copyto(s, j[:, None], where=up)
    return pid


def points_to_tree(clouds: DataFrame, bf: float = 0.4, *, sort: bool = True, exclude_soma: bool = True, furcations: int = 2) -> DataFrame:
    """Node tables of point clouds (cloud_id, pos, x, y, z): the first point is the soma, all radii are 1.

    bf balances total length against path length (0: a minimum spanning tree).
    """
    kind = dict(clouds.dtypes)["cloud_id"]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        xyz = np.stack([folds.numbers(t, c).astype(float) for c in "xyz"], 1)
        ends = np.append(starts[1:], len(xyz))
        kinds = np.full(len(xyz), GLIA)
        kinds[starts] = SOMA
        t = pa.table({"tree_id": t["cloud_id"], "type": pa.array(kinds, pa.int32()), **{c: pa.array(xyz[:, k]) for k, c in enumerate("xyz")}, "r": pa.array(np.ones(len(xyz)))})
        trees = dict(zip(starts.tolist(), spanning_trees([xyz[a:b] for a, b in zip(starts, ends)], bf, furcations, exclude_soma)))

        def one(at: slice):
            pid = trees[at.start]
            rows = np.arange(len(pid))
            order, up = _numbered(rows, pid) if sort else (rows, pid)
            return order, rows, up

        return _trees(t, starts, one, ["tree_id", "id", "type", "x", "y", "z", "r", "pid"])

    return folds.in_groups(clouds.select("cloud_id", "pos", "x", "y", "z"), ("cloud_id",), ("pos",), run, f"tree_id {kind}, {_NODE}", tasks=folds.spread(clouds))


def minimum_spanning_tree(clouds: DataFrame, furcations: int = 2, exclude_soma: bool = True) -> DataFrame:
    return points_to_tree(clouds, 0.0, furcations=furcations, exclude_soma=exclude_soma)


def assemble(xyz: np.ndarray, firsts: np.ndarray, thre: float = 0.2, undirected: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rows, pids) of one tree of polylines (points xyz, lines from ``firsts``): lines whose end lies within
    ``thre`` of the tree join it, one at a time; what is left forms further parts. Nodes are numbered in the order of rows.

    Each end keeps its nearest point of the part, so a step looks at new points alone.
    """
    n = len(firsts)
    lasts = np.append(firsts[1:], len(xyz)) - 1
    ends = xyz[np.stack([firsts, lasts], 1)]  # (lines, 2, 3)
    near, at = np.full((n, 2), np.inf), np.zeros((n, 2), np.int64)
    free = np.ones(n, bool)
    rows, pids = [], []
    size = 0

    def add(line: np.ndarray, pid: int) -> None:
        nonlocal size
        ids = size + np.arange(len(line))
        up = ids - 1
        if len(line):
            up[0] = pid
            rows.append(line)
            pids.append(up)
            size += len(line)
            left = np.flatnonzero(free)
            if len(left):
                d = xyz[line] - ends[left][:, :, None]
                d = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])
                low = d.argmin(2)
                d = np.take_along_axis(d, low[..., None], 2)[..., 0]
                up = d < near[left]
                near[left] = np.where(up, d, near[left])
                at[left] = np.where(up, ids[low], at[left])

    while free.any():
        first = int(free.argmax())
        free[first] = False
        near[:] = np.inf
        add(np.arange(firsts[first], lasts[first] + 1), -1)
        while True:
            close = (near <= thre) & free[:, None]
            if not undirected:
                close[:, 1] = False
            k, end = divmod(int(close.argmax()), 2)
            if not close[k, end]:
                break
            free[k] = False
            line = np.arange(firsts[k], lasts[k] + 1)
            if end:
                line = line[::-1]
            if near[k, end] < EPS:
                line = line[1:]
            add(line, int(at[k, end]))
    return (np.concatenate(rows), np.concatenate(pids)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def lines_to_tree(lines: DataFrame, thre: float = 0.2, undirected: bool = True) -> DataFrame:
    """Trees of polylines (tree_id, line_id, pos, type, x, y, z, r), numbered in preorder."""
    kind = dict(lines.dtypes)["tree_id"]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        xyz = np.stack([folds.numbers(t, c).astype(float) for c in "xyz"], 1)
        firsts = folds.starts_of(t, ("tree_id", "line_id"))
        t = t.select(["tree_id", "type", "x", "y", "z", "r"]).cast(pa.schema([t.schema.field("tree_id"), ("type", pa.int32()), *((c, pa.float64()) for c in "xyzr")]))

        def one(at: slice):
            own = firsts[np.searchsorted(firsts, at.start) : np.searchsorted(firsts, at.stop)] - at.start
            rows, pids = assemble(xyz[at], own, thre, undirected)
            order, up = _numbered(ids := np.arange(len(rows)), _linked(ids, pids, xyz[at][rows]))
            return rows[order], ids, up

        return _trees(t, starts, one, ["tree_id", "id", "type", "x", "y", "z", "r", "pid"])

    return folds.in_groups(lines.select("tree_id", "line_id", "pos", "type", "x", "y", "z", "r"), ("tree_id",), ("line_id", "pos"), run, f"tree_id {kind}, {_NODE}", tasks=folds.spread(lines))


def pair_ends(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Greedy matching of equally many points: the closest pair left over and over."""
    if len(a) != len(b):
        raise AssertionError("as many ends as nodes are needed")
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    out = []
    for _ in range(len(a)):
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        out.append((int(i), int(j)))
        d[i], d[:, j] = np.inf, np.inf
    return out


def traverse(nodes: DataFrame, schema: str, enter=None, leave=None) -> DataFrame:
    """An arbitrary fold over every tree: (tree_id, id, value) with value of type ``schema``.

    ``enter(row, parent's value)`` goes down, ``leave(row, children's values)`` comes up; with both, leave
    gets the value of enter as row["entered"]. Folds with a name are faster by ``topology.climb`` and
    ``gather``, which need no tree in one task.
    """
    kind = dict(nodes.dtypes)["tree_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        order = preorder(pdf.id.to_numpy(), pdf.pid.to_numpy())
        down, up, kids = {}, {}, {}
        if enter is not None:
            for k in order:
                down[rows[k]["id"]] = rows[k]["entered"] = enter(rows[k], down.get(rows[k]["pid"]))
        if leave is not None:
            for k in reversed(order):
                r = rows[k]
                up[r["id"]] = leave(r, [v for _, v in sorted(kids.get(r["id"], []))])
                kids.setdefault(r["pid"], []).append((r["id"], up[r["id"]]))
        values = up if leave is not None else down
        return pd.DataFrame({"tree_id": pdf.tree_id, "id": pdf.id, "value": [values.get(i) for i in pdf.id]})

    return nodes.groupBy("tree_id").applyInPandas(lambda p: run(p.sort_values("id", kind="stable")), f"tree_id {kind}, id int, value {schema}")


def enclosing_ellipsoid(points: np.ndarray, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(A, centre) of the smallest ellipsoid (x - c)' A (x - c) <= 1 about points (n, d), by Khachiyan's steps."""
    return enclosing_ellipsoids([points], tol)[0]


def enclosing_ellipsoids(clouds: list[np.ndarray], tol: float = 1e-3) -> list[tuple[np.ndarray, np.ndarray]]:
    """``enclosing_ellipsoid`` of many clouds of the same d, some thousand points at a time take each step together."""
    out: list = [None] * len(clouds)
    by_size = sorted(range(len(clouds)), key=lambda k: -len(clouds[k]))
    at = 0
    while at < len(by_size):
        some = by_size[at : at + max(1, 20_000 // len(clouds[by_size[at]]))]
        for k, u in zip(some, _weights([clouds[k] for k in some], tol)):
            p, u = clouds[k], u[: len(clouds[k])]
            c = p.T @ u
            out[k] = np.linalg.inv(p.T * u @ p - np.outer(c, c)) / p.shape[1], c
        at += len(some)
    return out


def _weights(clouds: list[np.ndarray], tol: float) -> np.ndarray:
    """Weights of the points (clouds, points of the largest, 0 beyond a cloud's own)."""
    m, n, d = len(clouds), max(len(p) for p in clouds), clouds[0].shape[1]
    q, u = np.zeros((m, d + 1, n)), np.zeros((m, n))
    for k, p in enumerate(clouds):
        q[k, :d, : len(p)], q[k, d, : len(p)], u[k, : len(p)] = p.T, 1, 1 / len(p)
    out, live = np.zeros((m, n)), np.arange(m)
    while len(live):
        w = np.einsum("tij,tij->tj", q, np.linalg.solve(q * u[:, None] @ q.transpose(0, 2, 1), q))
        t, j = np.arange(len(live)), w.argmax(1)
        top = w[t, j]
        step = (top - d - 1) / ((d + 1) * (top - 1))
        new = (1 - step)[:, None] * u
        new[t, j] += step
        err, u = np.linalg.norm(new - u, axis=1), new
        done = ~(err > tol)
        if done.any():
            out[live[done]] = u[done]
            live, q, u = live[~done], q[~done], u[~done]
    return out


def ellipse_of(a: np.ndarray) -> dict[str, float]:
    """Radii a >= b, eccentricity and tilt alpha of an ellipse matrix."""
    _, s, v = np.linalg.svd(a)
    r = 1 / np.sqrt(s)
    big, small = float(r.max()), float(r.min())
    axis = v[int(r.argmax())]
    return {"a": big, "b": small, "eccentricity": float(np.sqrt(1 - (small / big) ** 2)), "alpha": float(np.arctan2(axis[1], axis[0]))}


def ellipses(nodes: DataFrame, tol: float = 1e-3) -> DataFrame:
    """(tree_id, cx, cy, a, b, eccentricity, alpha): the smallest ellipse about x, y of every tree."""
    kind = dict(nodes.dtypes)["tree_id"]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        xy = np.stack([folds.numbers(t, c).astype(float) for c in "xy"], 1)
        rows, clouds = [], []
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), len(xy)]):
            p = np.unique(xy[first:last], axis=0)
            if len(p) >= 3 and np.linalg.matrix_rank(p - p[0]) >= 2:  # else no area
                rows.append(first)
                clouds.append(p)
        out = [(*c, *ellipse_of(m).values()) for m, c in enclosing_ellipsoids(clouds, tol)]
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table([t["tree_id"].take(pa.array(rows, pa.int64())), *(pa.array(c, pa.float64()) for c in cols)], ["tree_id", "cx", "cy", "a", "b", "eccentricity", "alpha"])

    return folds.in_groups(nodes.select("tree_id", "x", "y"), ("tree_id",), ("x", "y"), run, f"tree_id {kind}, cx double, cy double, a double, b double, eccentricity double, alpha double", tasks=folds.spread(nodes))


def florets(nodes: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trunk, florets): the trees without and the subtrees under the given nodes (tree_id, id)."""
    from . import surgery
    from . import topology as T

    return surgery.to_subtree(nodes, starts), T.subtree(nodes, starts)


def length_share(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(tree_id, start, share): length of each floret over that of its tree."""
    from . import topology as T

    e = T.edges(nodes).select("tree_id", "id", "length")
    total = e.groupBy("tree_id").agg(F.sum("length").alias("_all"))
    own = parts.where("id <> start").select("tree_id", "id", "start").join(e, ["tree_id", "id"]).groupBy("tree_id", "start").agg(F.sum("length").alias("_own"))
    return own.join(total, "tree_id").select("tree_id", "start", F.try_divide("_own", "_all").alias("share"))
