import math

import pytest
from pyspark.errors import PySparkException

from arbora.operators import features, surgery
from arbora.operators import topology as T


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_counts_of_a_small_tree(simple):
    s = features.tree_summary(simple).first()
    assert (s.n_nodes, s.n_edges, s.n_tips, s.n_furcations, s.n_stems) == (4, 3, 2, 1, 2)
    assert features.branch_count(simple).first().n_branches == 3  # two, and the root alone
    assert T.paths(simple).select("path_id").distinct().count() == 2
    assert ids(T.tips(simple)) == [3, 4]
    assert ids(T.furcations(simple)) == [1]


def test_counts_of_a_line(line):
    s = features.tree_summary(line).first()
    assert (s.n_edges, s.n_tips, s.n_furcations) == (3, 1, 0)
    assert features.branch_count(line).first().n_branches == 1
    b = T.branches(line, degenerate=True).orderBy("pos").collect()
    assert [(r.branch_id, r.pos, r.id) for r in b] == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_root_walk(fork):
    w = {r.id: r for r in T.root_walk(fork).collect()}
    assert [w[i].depth for i in range(5)] == [0, 1, 2, 2, 3]
    assert w[4].path_length == pytest.approx(9)
    assert [w[i].branch_order for i in range(5)] == [0, 1, 1, 1, 1]
    assert {r.root for r in w.values()} == {0}


def test_long_chain_and_bottom_up(make_nodes):
    n = 300
    nodes = make_nodes([("c", i, 1, i, 0, 0, 1, i - 1) for i in range(n)])
    w = {r.id: r.depth for r in T.root_walk(nodes).select("id", "depth").collect()}
    assert w == {i: i for i in range(n)}
    g = T.gather(nodes.selectExpr("*", "1L AS one"), {"k": (nodes["id"] * 0 + 1, "sum")})
    assert {r.id: r.k for r in g.collect()} == {i: n - i for i in range(n)}


def test_components_and_checks(make_nodes):
    nodes = make_nodes([("m", 1, 1, 0, 0, 0, 1, -1), ("m", 2, 1, 1, 0, 0, 1, 1), ("m", 10, 1, 5, 0, 0, 1, -1), ("m", 11, 1, 6, 0, 0, 1, 10), ("m", 12, 1, 7, 0, 0, 1, 10)])
    c = {r.id: r.component_id for r in T.components(nodes).collect()}
    assert c == {1: 0, 2: 0, 10: 1, 11: 1, 12: 1}
    k = T.checks(nodes).first()
    assert (k.n_components, k.single_root, k.sorted, k.cyclic) == (2, False, True, False)
    cyc = make_nodes([("o", 0, 1, 0, 0, 0, 1, 2), ("o", 1, 1, 0, 0, 0, 1, 0), ("o", 2, 1, 0, 0, 0, 1, 1)])
    assert T.checks(cyc).first().cyclic


def test_missing_parent_raises(make_nodes):
    with pytest.raises(PySparkException):
        T.components(make_nodes([("d", 1, 1, 0, 0, 0, 1, -1), ("d", 2, 1, 0, 0, 0, 1, 99)])).collect()


def test_empty_table(make_nodes):
    empty = make_nodes([])
    assert features.tree_summary(empty).count() == 0
    assert T.root_walk(empty).count() == 0
    assert T.branches(empty).count() == 0
    assert features.sholl(empty).count() == 0


def test_neurites_and_subtrees(fork, simple):
    assert {r.neurite_id for r in T.neurites(fork).collect()} == {1}
    assert {r.id: r.neurite_id for r in T.neurites(simple, (3,)).collect()} == {2: 2, 3: 3, 4: 2}
    assert ids(T.subtree(fork, fork.where("id = 3"))) == [3, 4]


def test_cuts(fork):
    assert ids(surgery.cut_by_type(fork, 2)) == [0, 1, 3, 4]
    assert ids(surgery.cut_by_furcation_order(fork, 1)) == [0]
    assert ids(surgery.cut_by_box(fork, (-1, -1, -1), (4, 5, 4))) == [0, 1, 2, 3]
    assert surgery.cut_by_box(fork, (5, 5, 5), (9, 9, 9)).count() == 0
    with pytest.raises(AssertionError):
        surgery.cut_by_box(fork, (0, 0, 0), (0, 1, 1))
    assert ids(surgery.cut_short_tips(fork, 5)) == [0, 1, 3, 4]
    assert ids(surgery.to_subtree(fork, fork.where("id = 3"))) == [0, 1, 2]


def test_renumbering(fork):
    d = surgery.densify(surgery.to_subtree(fork, fork.where("id = 2"))).orderBy("id").collect()
    assert [(r.id, r.pid, r.old_id) for r in d] == [(0, -1, 0), (1, 0, 1), (2, 1, 3), (3, 2, 4)]


def test_redirect(fork):
    r = {x.id: x for x in surgery.redirect(fork, fork.where("id = 4")).collect()}
    assert {i: x.pid for i, x in r.items()} == {4: -1, 3: 4, 1: 3, 0: 1, 2: 1}
    assert (r[4].type, r[0].type) == (1, 2)


def test_cat_drops_the_meeting_node(spark, fork, simple):
    pairs = spark.createDataFrame([("y", 4, "s", 1)], "tree_id string, node1 int, tree2_id string, node2 int")
    out = {r.id: r for r in surgery.cat(fork, simple, pairs).collect()}
    assert len(out) == 5 + 3
    assert sorted(r.pid for i, r in out.items() if i > 4).count(4) == 2
    assert (out[6].x, out[6].z) == (7, 3)


def test_roots_made_one(make_nodes):
    nodes = make_nodes([("m", 0, 1, 0, 0, 0, 1, -1), ("m", 5, 3, 1, 0, 0, 1, -1)])
    r = {x.id: (x.pid, x.type) for x in surgery.mark_roots_as_somas(nodes).collect()}
    assert r == {0: (-1, 1), 5: (0, 1)}


def test_paths_and_longest(fork):
    p = features.path_features(fork).orderBy("tip").collect()
    assert [(r.tip, r.length) for r in p] == [(2, 7), (4, 9)]
    assert p[0].tortuosity == pytest.approx(5 / 7)
    assert features.longest_path(fork).first().tip == 4
    assert ids(features.to_longest_path(fork)) == [0, 1, 3, 4]


def test_sholl_counts(fork):
    # radii of edges: 0-3, 3-5, 3-sqrt(18), sqrt(18)-sqrt(45)
    assert features.sholl_at(fork, 2.0).first().crossings == 1
    assert features.sholl_at(fork, 4.0).first().crossings == 2
    assert features.sholl_at(fork, math.sqrt(45)).first().crossings == 0
    s = features.sholl(fork, steps=2).orderBy("k").collect()
    assert [r.crossings for r in s] == [1, 2]


def test_unknown_feature(fork):
    with pytest.raises(ValueError):
        features.extract(fork, "no_such")
    p = features.padded(features.extract(fork, "tip_radial_distance", "path_count")).collect()
    assert {r.feature: len(r["values"]) for r in p} == {"tip_radial_distance": 2, "path_count": 1}


def test_node_branch_order(simple, fork):
    assert {r.id: r.branch_order for r in features.node_branch_order(simple).collect()} == {1: 0, 3: 1, 4: 1}
    assert {r.id: r.branch_order for r in features.node_branch_order(fork).collect()} == {0: 0, 1: 1, 2: 2, 4: 2}
