import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import solids as S
from arbora.functions import vector as V
from arbora.operators import branching, construct, geometry, lmeasure, population, volume
from arbora.operators import topology as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(float(x))


def test_matrices():
    q = V.rotate3d((0, 0, 2), math.pi / 2)
    assert np.allclose(np.array(q) @ [3, 0, 0, 1], [0, 3, 0, 1])
    m = V.matmul(V.translate3d(1, 2, 3), V.scale3d(2, 2, 2))
    assert np.allclose(np.array(m) @ [1, 1, 1, 1], [3, 4, 5, 1])
    with pytest.raises(ValueError):
        V.rotate3d((0, 0, 0), 1.0)


def test_solids(spark):
    assert value(spark, S.cap_volume(lit(1), lit(1))) == pytest.approx(2 / 3 * math.pi)
    assert value(spark, S.lens_volume(lit(1), lit(1), lit(0))) == pytest.approx(4 / 3 * math.pi)
    assert value(spark, S.lens_volume(lit(1), lit(1), lit(3))) == 0
    assert value(spark, S.lens_volume(lit(1), lit(1), lit(1))) == pytest.approx(5 / 12 * math.pi)
    # a cylinder as wide as the sphere holds its half
    assert value(spark, S.sphere_frustum_volume(lit(1), lit(1), lit(2))) == pytest.approx(2 / 3 * math.pi)


@pytest.mark.parametrize(("r1", "r2", "h"), [(1, 0.4, 2), (1, 0.9, 0.3), (1, 0.2, 0.5), (1, 2, 0.5), (2, 1, 5)])
def test_sphere_and_frustum_by_slices(spark, r1, r2, h):
    z = (np.arange(200_000) + 0.5) / 200_000 * h
    r = np.minimum(r1 + z / h * (r2 - r1), np.sqrt(np.maximum(r1**2 - z**2, 0)))
    want = float((math.pi * r**2).mean() * h)
    assert value(spark, S.sphere_frustum_volume(lit(r1), lit(r2), lit(h))) == pytest.approx(want, rel=1e-4)


def test_signed_distances(spark):
    o, a, b = V.const((0, 0, 0)), V.const((0, 0, 0)), V.const((4, 0, 0))
    assert value(spark, S.sdf_sphere(V.const((3, 0, 0)), o, lit(1))) == pytest.approx(2)
    assert value(spark, S.sdf_frustum(V.const((2, 3, 0)), a, b, lit(1), lit(1))) == pytest.approx(2)
    assert value(spark, S.sdf_frustum(V.const((2, 0, 0)), a, b, lit(1), lit(1))) == pytest.approx(-1)
    assert value(spark, S.sdf_round_cone(V.const((6, 0, 0)), a, b, lit(1), lit(1))) == pytest.approx(1)
    assert value(spark, S.sdf_round_cone(V.const((2, 2, 0)), a, b, lit(1), lit(1))) == pytest.approx(1)
    assert value(spark, S.sdf_round_cone(V.const((2, 0, 0)), a, a, lit(1), lit(2))) == pytest.approx(0)
    p = spark.range(1).select(V.sphere_line(o, lit(1), V.const((-2, 0, 0)), V.const((2, 0, 0))).alias("p")).first().p
    assert [(r.t, r.x) for r in p] == [(0.25, -1.0), (0.75, 1.0)]


def test_volumes(make_nodes):
    chain = make_nodes([("c", i, 1, 2 * i, 0, 0, 1, i - 1) for i in range(3)])
    for level in (3, 5):
        assert volume.tree_volume(chain, level).first().volume == pytest.approx(16 / 3 * math.pi, rel=1e-3)
    two = make_nodes([("t", 0, 1, 0, 0, 0, 1, -1), ("t", 1, 1, 2, 0, 0, 1, 0), ("t", 2, 1, 2, 0, 0, 1, 0)])
    assert volume.tree_volume(chain, 10, samples=40_000).first().volume == pytest.approx(16 / 3 * math.pi, rel=0.03)
    assert volume.tree_volume(two, 10, samples=40_000).first().volume == pytest.approx(10 / 3 * math.pi, rel=0.03)
    corner = make_nodes([("k", 0, 1, 0, 0, 0, 1, -1), ("k", 1, 1, 2, 0, 0, 1, 0), ("k", 2, 1, 0, 2, 0, 1, 0)])
    v = volume.tree_volume(corner, 5).first().volume
    assert 16 / 3 * math.pi - 1 < v < 16 / 3 * math.pi
    with pytest.raises(ValueError):
        volume.tree_volume(chain, "best")


def test_overlap_of_long_siblings(make_nodes):
    # two cylinders at a right angle: a quarter of both's common body less a quarter of the sphere
    long = make_nodes([("k", 0, 1, 0, 0, 0, 1, -1), ("k", 1, 1, 100, 100, 0, 1, 0), ("k", 2, 1, 100, -100, 0, 1, 0)])
    for samples, rel in ((20_000, 0.12), (1_000_000, 0.02)):
        assert volume.pair_overlaps(long, samples, 0).first().overlap == pytest.approx(4 / 3 - math.pi / 3, rel=rel)
    # narrowing cones at an acute angle, against points drawn in a box
    tips = np.array([[9.0, 2, 0], [9.0, -2, 1]])
    p = np.random.default_rng(4).random((2_000_000, 3)) * [13, 10, 8] - [2, 5, 4]
    both = volume._inside_frustum(p, np.zeros(3), tips[0], 2, 1) & volume._inside_frustum(p, np.zeros(3), tips[1], 2, 0.5) & ((p**2).sum(1) > 4)
    got = volume._overlap(tips[0], tips[1], 2, 1, 0.5, 1_000_000, np.random.default_rng(0))
    assert got == pytest.approx(both.mean() * 13 * 10 * 8, rel=0.03)


def test_transforms(fork):
    r = {x.id: x for x in geometry.rotate_z(fork, math.pi / 2).collect()}
    assert (r[4].x, r[4].y) == (pytest.approx(0), pytest.approx(6))
    s = {x.id: x for x in geometry.scale(geometry.translate(fork, 1, 0, 0), 2, 2, 2).collect()}
    assert (s[0].x, s[4].x) == (1, 13)
    assert geometry.translate_origin(geometry.translate(fork, 5, 5, 5)).where("pid = -1").first().x == 0
    assert geometry.normalise(fork).agg(F.max("x")).first()[0] == 1


def test_resampling_and_smoothing(fork):
    b = T.branches(fork)
    p = branching.resample_linear(b, 4).where("branch_id = 3").orderBy("pos").collect()
    assert [x.x for x in p] == pytest.approx([0, 2, 4, 6])
    q = branching.resample_isometric(b, 2.5).where("branch_id = 3").orderBy("pos").collect()
    assert [x.x for x in q] == pytest.approx([0, 2, 4, 6])
    q = branching.resample_isometric(b, 2.5, adjust_last_gap=False).where("branch_id = 3").orderBy("pos").collect()
    assert [x.x for x in q] == pytest.approx([0, 2.5, 5, 6])
    t = branching.resample_tree(fork, distance=1.0)
    assert t.count() == 1 + 3 + 4 + 6 and t.where("pid = -1").count() == 1
    assert sum(r.length for r in T.edges(t).collect()) == pytest.approx(13)
    s = branching.smooth(b, 3).where("branch_id = 3").orderBy("pos").collect()
    assert [x.x for x in s] == pytest.approx([0, 3, 6])
    r = branching.reverse(b).where("branch_id = 3").orderBy("pos").collect()
    assert [(x.x, x.type) for x in r] == [(6, 3), (3, 2), (0, 2)]


def test_standard_position():
    p = np.array([[1.0, 1, 1], [2, 3, 1], [4, 1, 1]])
    m = branching.standard_matrix(p)
    q = p @ m[:3, :3].T + m[:3, 3]
    assert np.allclose(q[0], 0) and np.allclose(q[2], [1, 0, 0]) and q[1][1] > 0 and abs(q[1][2]) < 1e-12


def test_lmeasure(fork):
    local = lmeasure.bifurcation_local(fork).first()
    assert local.ampl_local == pytest.approx(90) and local.tilt_local == pytest.approx(90)
    assert lmeasure.bifurcation_remote(fork).first().ampl_remote == pytest.approx(90)
    assert lmeasure.partition_asymmetry(fork).first().partition_asymmetry == 0
    m = {r.branch_id: r for r in lmeasure.branch_metrics(fork).collect()}
    assert m[3].fragmentation == 2 and m[3].contraction == pytest.approx(1) and m[3].terminal
    assert m[1].taper_1 == pytest.approx(2 / 3)
    assert {r.id: r.terminal_degree for r in lmeasure.node_orders(fork).collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1}
    assert lmeasure.tree_metrics(fork).first().soma_surface == pytest.approx(16 * math.pi)


def test_construction(spark, fork):
    s = construct.sort_nodes(fork).orderBy("id").collect()
    assert [(r.pid, r.x, r.y) for r in s] == [(-1, 0, 0), (0, 0, 0), (1, 3, 0), (2, 6, 0), (1, 0, 4)]
    pts = np.array([[0.0] * 3, [1, 0, 0], [2.5, 0, 0], [0, 5, 0]])
    assert construct.spanning_tree(pts).tolist() == [-1, 0, 1, 0]
    star = np.array([[0.0, 0, 0], [10, 0, 0], [10, 1, 0], [10, -1, 0], [11, 0, 0]])
    assert np.bincount(construct.spanning_tree(star, furcations=2)[1:], minlength=5).max() <= 2
    # a high balancing factor makes all hang on the root
    assert construct.spanning_tree(pts, bf=9.0).tolist() == [-1, 0, 0, 0]
    a, c = construct.enclosing_ellipsoid(np.array([[0.0, 0], [0, 1], [1, 1], [1, 0]]))
    assert np.allclose(c, 0.5, atol=1e-3) and construct.ellipse_of(a)["a"] == pytest.approx(math.sqrt(0.5), rel=1e-2)
    lines = [("t", 0, p, 2, float(p), 0.0, 0.0, 1.0) for p in range(3)] + [("t", 1, p, 2, 2.0, float(2 - p), 0.0, 1.0) for p in range(3)]
    df = spark.createDataFrame(lines, "tree_id string, line_id int, pos int, type int, x double, y double, z double, r double")
    t = construct.lines_to_tree(df).collect()
    assert len(t) == 5 and sum(r.pid == -1 for r in t) == 1


def test_traverse_both_ways(fork):
    down = construct.traverse(fork, "int", enter=lambda row, up: 0 if up is None else up + 1)
    assert {r.id: r.value for r in down.collect()} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 3}
    up = construct.traverse(fork, "int", leave=lambda row, kids: max(1, sum(kids)))
    assert {r.id: r.value for r in up.collect()} == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1}


def test_populations(fork, simple):
    u = population.union(fork, simple, labels=["a", "b"])
    assert population.count(u) == 2
    assert {r.label for r in population.nth(u, 0).collect()} == {"a", "b"}
    assert population.nth(population.flatten(u), -1).select("tree_id").distinct().first().tree_id == "1/s"
    assert population.intersect(fork, simple).count() == 0 and population.same_keys(fork, fork)
    chain = population.Transforms(population.identity, population.Transforms(lambda n: geometry.reset_radius(n, 3.0)))
    assert len(chain) == 2 and chain(fork).first().r == 3.0


def test_solids_put_together(spark):
    one = lambda p: S.sdf_sphere(p, V.const((0, 0, 0)), lit(1))
    two = lambda p: S.sdf_sphere(p, V.const((1, 0, 0)), lit(1))
    box = (-1, -1, -1), (2, 1, 1)
    lens, ball = 5 / 12 * math.pi, 4 / 3 * math.pi
    size = lambda f: volume.solid_volume(spark, f, *box, samples=200_000, seed=1)
    assert size(lambda p: S.sdf_intersection(one(p), two(p))) == pytest.approx(lens, rel=0.03)
    assert size(lambda p: S.sdf_union(one(p), two(p))) == pytest.approx(2 * ball - lens, rel=0.03)
    assert size(lambda p: S.sdf_difference(one(p), two(p))) == pytest.approx(ball - lens, rel=0.03)
