import json

import pytest
from pyspark.sql import functions as F

from arbora.operators import construct, features, graphs, views
from arbora.operators import topology as T
from arbora.sources import archive


def test_graph_and_distances(fork):
    e, v = graphs.to_graph(fork, bidirected=True)
    assert e.count() == 8 and len(v.first().features) == 5
    near = {(r.a, r.b): r.distance for r in graphs.pair_distances(fork, 4.0).collect()}
    assert near == {(0, 1): 3, (1, 2): 4, (1, 3): 3, (3, 4): 3}
    p = {(r.i, r.j): r.v for r in graphs.product(graphs.edge_distances(fork), T.adjacency(fork)).collect()}
    assert p == {(0, 2): 3, (0, 3): 3, (1, 4): 3}


def test_clusters_and_tensors(fork):
    c = {r.id: r.cluster for r in graphs.clusters(fork, 2).collect()}
    assert set(c) == {0, 1, 2, 3, 4}
    t = {r.branch_id: r["values"] for r in graphs.branch_tensors(T.branches(fork), radius=False).collect()}
    assert t[3] == [[0, 3, 6], [0, 0, 0], [3, 3, 3]]
    u = {r.branch_id: r["values"] for r in graphs.branch_tensors(T.branches(fork), channels_first=False).collect()}
    assert u[2] == [[0, 0, 3, 1], [0, 4, 3, 1]]


def test_views(fork):
    s = {r.id: (r.x1, r.y1) for r in views.segments(fork).collect()}
    assert s[4] == (6, 0)
    assert {r.id: r.y1 for r in views.segments(fork, "xz").collect()}[1] == pytest.approx(3)
    assert views.rings(features.sholl(fork, 4)).agg(F.max("shade")).first()[0] == 1


def test_florets(fork):
    trunk, parts = construct.florets(fork, fork.where("id = 3"))
    assert trunk.count() == 3 and parts.count() == 2
    assert construct.length_share(fork, parts).first().share == pytest.approx(3 / 13)


def test_archive(spark, tmp_path):
    rows = [(1, b"1 1 0 0 0 1 -1", json.dumps({"species": "rat"})), (2, b"x", json.dumps({"species": "fly"})), (81062, b"y", json.dumps({"species": "rat"}))]
    df = archive.metadata(spark.createDataFrame(rows, "neuron_id long, content binary, json string"))
    archive.convert(df, str(tmp_path / "o"), where=F.col("meta.species") == "rat", group_by="species")
    out = spark.read.parquet(str(tmp_path / "o")).collect()
    assert [(r.neuron_id, r.species) for r in out] == [(1, "rat")]
    enc = spark.createDataFrame([("é".encode(),), ("é".encode("latin-1"),), (b"\xef\xbb\xbfa",)], "b binary").select(archive.detect_encoding(F.col("b")).alias("e"))
    assert [r.e for r in enc.collect()] == ["UTF-8", "ISO-8859-1", "UTF-8"]
