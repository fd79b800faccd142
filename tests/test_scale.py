"""Plans that have to hold for large trees: estimates over many rounds, deep chains, order by folds, files that go."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arbora import runtime
from arbora.operators import construct, features, surgery, volume
from arbora.operators import topology as T


def chain(spark, n):
    i = F.col("id").cast("int")
    return spark.range(n).select(F.lit("c").alias("tree_id"), i.alias("id"), F.lit(1).alias("type"), *(F.col("id").cast("double").alias(c) for c in "xyz"), F.lit(1.0).alias("r"), (i - 1).alias("pid"))


def bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def trees(spark):
    rng = np.random.default_rng(3)
    out = []
    for t in range(6):
        for i in range(40 + 10 * t):
            out.append((str(t), i * 3, 1, *map(float, rng.random(3)), 1.0, -1 if not i else int(rng.integers(0, i)) * 3))
    return spark.createDataFrame(out, "tree_id string, id int, type int, x double, y double, z double, r double, pid int")


def test_estimates_stay_true_over_many_rounds(spark):
    n = chain(spark, 1500)
    walk = T.climb(n, {"depth": (F.lit(1), "sum")})
    assert bits(walk) < 40 and walk.agg(F.max("depth")).first()[0] == 1500
    assert bits(T.gather(n, {"k": (F.lit(1), "sum")})) < 40


def test_cycles_end_after_few_rounds(make_nodes, monkeypatch):
    n = make_nodes([("o", i, 1, 0, 0, 0, 1, (i + 1) % 70) for i in range(70)] + [("o", 70, 1, 0, 0, 0, 1, 3), ("p", 1, 1, 0, 0, 0, 1, -1), ("p", 2, 1, 0, 0, 0, 1, 1)])
    c = {r.tree_id: r.cyclic for r in T.checks(n).collect()}
    assert c == {"o": True, "p": False}
    assert {r.id for r in T.climb(n, {}).where("tree_id = 'o' AND top IS NULL").collect()} == set(range(71))


def test_paths_of_a_deep_chain(spark):
    n = chain(spark, 2000)
    p = T.paths(n)
    assert p.agg(F.count("*"), F.max("pos"), F.sum((F.col("pos") == F.col("id")).cast("int"))).first()[0:3] == (2000, 1999, 2000)


def test_closure_lists_all_ancestors(trees):
    up = {(r.tree_id, r.id): r.pid for r in trees.collect()}
    want = set()
    for t, i in up:
        j = i
        while j != -1:
            want.add((t, i, j))
            j = up[t, j]
    assert set(map(tuple, T.closure(trees).collect())) == want


def test_order_by_folds_equals_order_by_groups(trees):
    assert rows(construct.sort_nodes(trees, 0)) == rows(construct.sort_nodes(trees)) == rows(construct.sort_nodes(trees, 60))
    two = trees.unionByName(trees.where("tree_id = '0' AND id = 0").withColumn("id", F.lit(999)))
    for limit in (0, 10**6):
        with pytest.raises(PySparkException, match="one root"):
            construct.sort_nodes(two, limit).collect()


def test_older_names(trees):
    assert rows(T.bifurcations(trees)) == rows(T.furcations(trees))
    assert rows(surgery.cut_by_bifurcation_order(trees, 1)) == rows(surgery.cut_by_furcation_order(trees, 1))
    assert features.extract(trees, "bifurcation_count").count() == 6
    assert T.check_single_root(trees).count() == trees.count()


def test_a_wide_soma_beside_thin_parts(make_nodes):
    """The sampled union of a sphere of radius 10 and a thin chain that leaves it."""
    n = make_nodes([("w", 0, 1, 0, 0, 0, 10, -1)] + [("w", i, 3, 9 + i, 0, 0, 0.5, i - 1) for i in range(1, 20)])
    inside = 4 / 3 * np.pi * 1000 + np.pi * 0.25 * 18 + 2 / 3 * np.pi * 0.125
    assert volume.sampled_volume(n, samples=400_000).first().volume == pytest.approx(inside, rel=0.06)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return type("Conf", (), {"get": staticmethod(lambda *_: None)})

    fake = type("Session", (), {"sparkContext": Context})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(fake)
    Context.master = "local[4]"
    assert runtime.shared_folder(fake).startswith("file:")
