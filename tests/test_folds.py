"""Folds within tasks against folds by rounds, plans that send no nodes to the driver, and whole-tree operators of many trees at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.operators import folds, surgery
from arbora.operators import topology as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def wild(spark):
    """Trees with several roots, missing parents, a cycle and nulls."""
    rng = np.random.default_rng(5)
    out = []
    for t in range(9):
        for i in range(3 + 12 * t):
            pid = -1 if i == 0 or rng.random() < 0.05 else 9999 if rng.random() < 0.05 else int(rng.integers(0, i)) * 2
            out.append((str(t), i * 2, int(rng.integers(1, 5)), float(i), None if rng.random() < 0.2 else float(rng.integers(0, 9)), 0.0, 1.0, pid))
    out += [("o", i, 1, 0.0, 1.0, 0.0, 1.0, (i + 1) % 5) for i in range(5)]
    return spark.createDataFrame(out, "tree_id string, id int, type int, x double, y double, z double, r double, pid int")


def test_folds_in_tasks_equal_folds_by_rounds(wild, monkeypatch):
    up = {"s": (F.col("x"), "sum"), "n": (F.lit(1), "sum"), "hi": (F.col("y"), "max"), "lo": (F.col("y"), "min"), "any": (F.col("type") == 2, "or"), "all": (F.col("y") > 1, "and"), "near": (F.when(F.col("type") == 3, F.col("id")), "first"), "far": (F.col("y"), "last")}
    down = {k: v for k, v in up.items() if v[1] not in ("first", "last") and k != "all"} | {"all": (F.col("type") < 4, "and")}
    sound = wild.where("tree_id <> 'o'")
    tops = lambda: rows(T.climb(wild, {}))
    climbs = lambda: rows(T.climb(sound, up, stop=F.col("type") == 4).select("tree_id", "id", "top", *up))
    gathers = lambda: rows(T.gather(sound, down).select("tree_id", "id", *down))
    in_tasks = tops(), climbs(), gathers()
    mixed = []
    for most in (0, 40):  # 40: some trees fit, some don't
        monkeypatch.setattr(folds, "GROUP", most)
        mixed.append((tops(), climbs(), gathers(), rows(surgery.cut_by_type(sound, 2))))
    assert mixed[0] == mixed[1] and mixed[0][:3] == in_tasks
    monkeypatch.undo()
    assert rows(surgery.cut_by_type(sound, 2)) == mixed[0][3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folded_nodes_are_not_broadcast(wild):
    """A small compressed file of many rows looks small enough to send everywhere."""
    kept = T.gather(wild, {"k": (F.col("type") == 2, "or")}).where("k").select("tree_id", "id")
    assert "BroadcastHashJoin" not in plan(wild.join(kept, ["tree_id", "id"], "left_semi"))
    for df in (T.edges(wild), T.tips(wild), T.child_counts(wild), T.with_parent(wild, "x"), surgery.cut_dendrite(wild), surgery.densify(wild)):
        assert "BroadcastHashJoin" not in plan(df)


def test_pairs_of_near_nodes(wild, monkeypatch):
    """In tasks, in small blocks and by the join: all pairs, as by brute force."""
    from arbora.operators import graphs

    n = wild.withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("z", F.col("id") % 7 - 3.0)
    at = {}
    for r in n.collect():
        at.setdefault(r.tree_id, []).append((r.id, np.array([r.x, r.y, r.z])))
    want = {(t, a, b) for t, ps in at.items() for a, p in ps for b, q in ps if a < b and np.linalg.norm(p - q) <= 5}
    got = graphs.pair_distances(n, 5.0)
    assert "Broadcast" not in plan(got) and {tuple(r)[:3] for r in got.collect()} == want and got.count() == len(want)
    xyz, starts = np.concatenate([[p for _, p in ps] for ps in at.values()]), np.cumsum([0] + [len(ps) for ps in at.values()])[:-1]
    blocks = list(graphs.near_pairs(xyz, starts, 5.0, most=7))
    assert sum(len(a) for a, _, _ in blocks) == len(want) and max(len(a) for a, _, _ in blocks) < 100
    monkeypatch.setattr(folds, "GROUP", 40)
    assert rows(graphs.pair_distances(n, 5.0)) == rows(got)


def test_rounding_as_sql_does(spark):
    from arbora.plans.catalog import rounded

    got = rounded(spark.createDataFrame([(50.792677499999996,), (-0.0,), (2.5,), (None,)], "v double"), 6).collect()
    assert [r.v for r in got] == [50.792678, 0.0, 2.5, None]


def test_composed_distances_are_half_the_length_to_the_last_bit(make_nodes):
    """SQL's step / 2 - 9 * r is 9.000000000000004 - 9 here; by the coordinates of the middle it was 0, which is inside."""
    from arbora.plans import forms

    n = make_nodes([("s", 0, 1, 127.52, 13, 16, 1, -1), ("s", 1, 1, 135.52, 15, 32, 1, 0)])
    assert not forms._composed(n).first().inside


def test_many_spanning_trees_at_once_equal_single_ones():
    from arbora.operators import construct

    rng = np.random.default_rng(2)
    clouds = [rng.integers(0, 5, (int(n), 3)).astype(float) for n in rng.integers(1, 60, 40)] + [rng.random((300, 3)), np.zeros((0, 3))]
    for bf, furcations, soma in ((0.0, 2, True), (0.4, 2, True), (0.0, -1, True), (0.3, 1, False)):
        for p, pid in zip(clouds, construct.spanning_trees(clouds, bf, furcations, soma), strict=True):
            assert pid.tolist() == construct.spanning_tree(p, bf, furcations, soma).tolist()


def test_many_ellipsoids_at_once_enclose_their_points():
    from arbora.operators import construct

    rng = np.random.default_rng(4)
    clouds = [rng.random((int(n), 2)) * (3, 1) for n in rng.integers(4, 90, 30)]
    for p, (a, c) in zip(clouds, construct.enclosing_ellipsoids(clouds), strict=True):
        far = np.einsum("ij,jk,ik->i", p - c, a, p - c)
        assert 0.9 < far.max() < 1.1
        one = construct.enclosing_ellipsoid(p)
        assert np.allclose(a, one[0], rtol=1e-9) and np.allclose(c, one[1])


def test_assembly_of_lines_step_by_step(spark):
    """Against the plain way: the first line, in order, with an end near any point of the part, again and again."""
    from arbora.operators import construct

    rng = np.random.default_rng(6)
    for _ in range(30):
        xyz = rng.integers(0, 4, (25, 3)).astype(float)
        firsts = np.array([0, 3, 4, 9, 12, 18, 20])
        for thre, both in ((1.0, True), (1.0, False), (0.0, True), (9.0, True)):
            lines = [list(range(a, b)) for a, b in zip(firsts, [*firsts[1:], 25])]
            rows, pids = [], []
            while lines:
                start, line, pid = len(rows), lines.pop(0), -1
                while line is not None:
                    pids += [pid] * bool(line) + list(range(len(rows), len(rows) + len(line) - 1))
                    rows += line
                    line, pid = next(((k, e, int(d.argmin()) + start) for k, x in enumerate(lines) for e in ((0, len(x) - 1) if both else (0,)) if (d := np.linalg.norm(xyz[rows[start:]] - xyz[x[e]], axis=1)).min() <= thre), None), pid
                    if line is not None:
                        k, e, pid = line
                        line = lines.pop(k)[:: -1 if e else 1]
                        line = line[1:] if np.linalg.norm(xyz[line[0]] - xyz[rows[pid]]) < construct.EPS else line
            got = construct.assemble(xyz, firsts, thre, both)
            assert (got[0].tolist(), got[1].tolist()) == (rows, pids)


def test_whole_trees_take_no_pandas_group_each(spark, wild):
    """A call of pandas for every tree or branch costs more than the work on a small one."""
    from arbora.operators import branching, construct

    n = wild.where("tree_id <> 'o'").withColumn("pid", F.when(F.col("id") == 0, -1).otherwise(F.lit(0))).withColumn("y", F.coalesce("y", F.lit(0.0)))
    lines = n.select("tree_id", F.floor(F.col("id") / 6).cast("int").alias("line_id"), F.col("id").alias("pos"), "type", "x", "y", "z", "r")
    clouds = n.select(F.col("tree_id").alias("cloud_id"), F.col("id").alias("pos"), "x", "y", "z")
    for df in (construct.lines_to_tree(lines), construct.points_to_tree(clouds), construct.ellipses(n), construct.sort_nodes(n), branching.standardise(T.branches(n))):
        assert "FlatMapGroups" not in plan(df) and df.count()
    at = {r.branch_id: r for r in branching.standardise(T.branches(n.where("tree_id = '1'"))).where("pos = 1").collect()}
    assert all(abs(r.x - 1) < 1e-9 and abs(r.y) < 1e-9 and abs(r.z) < 1e-9 for r in at.values())


def test_overlaps_are_as_exact_as_a_million_points():
    """Two cylinders of radius 1 at a right angle: what they share outside the sphere is (16 / 3) / 4 - pi / 3; all angles, a thousand at once."""
    from arbora.operators import volume

    n = 1000
    one = np.ones(n)
    turn = np.linspace(0, 2 * np.pi, n)
    d = np.stack([np.zeros(n), np.cos(turn), np.sin(turn)], 1) * 9
    f = np.stack([0 * one, -np.sin(turn), np.cos(turn)], 1) * 50
    got = volume.overlaps(d, f, one, one, one, 1_000_000)
    assert np.allclose(got, 4 / 3 - np.pi / 3, rtol=4.6e-3)  # a standard error of a million points
    assert volume.overlaps(d[:1] * 0, f[:1], one[:1], one[:1], one[:1], 9)[0] == 0


def test_voxels_go_through_no_exchange(wild, monkeypatch):
    from arbora.operators import images

    n = wild.where("tree_id < '4' AND (pid = -1 OR pid < 9999)").withColumn("y", F.coalesce("y", F.lit(0.0)))
    got = images.voxelise(n)
    assert "HashAggregate" not in plan(got) and got.count() == got.distinct().count() > 0
    monkeypatch.setattr(images, "WHOLE", 500)  # the larger trees by edges
    assert rows(images.voxelise(n)) == rows(got)
