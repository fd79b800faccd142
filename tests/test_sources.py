import os

import numpy as np
import pytest
from pyspark.errors import PySparkException

from arbora.operators import images as I
from arbora.sources import asc, swc
from arbora.sources import images as M
from arbora.streaming import ingest

TEXT = "# a comment\n# id type x y z r pid\n1 1 0 0 0 1 -1\r\n2 3 1.5 -2 1e1 1 1 # inline\n\n3 3 .5 0 0 1 1\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.swc").write_text(TEXT)
    (tmp_path / "sub" / "b.swc").write_text("1 1 0 0 0 1 -1\n2 1 1 0 0 1 1\n10 1 5 0 0 1 -1\n11 1 6 0 0 1 10\n12 1 7 0 0 1 10\n")
    return tmp_path


def test_read_and_comments(spark, folder):
    n = swc.read_swc(spark, str(folder / "a.swc"), sort=False).orderBy("id").collect()
    assert [(r.id, r.x, r.z, r.pid) for r in n] == [(0, 0, 0, -1), (1, 1.5, 10, 0), (2, 0.5, 0, 0)]
    c = swc.comments(swc.swc_lines(spark, str(folder / "a.swc"))).first()
    assert c.comments == ["a comment"]
    assert swc.read_swc(spark, str(folder / "a.swc")).orderBy("id").first().pid == -1


def test_components(spark, folder):
    rows = swc.read_components(spark, str(folder / "sub" / "b.swc")).orderBy("tree_id", "id").collect()
    assert [(r.tree_id[-1], r.id, r.pid) for r in rows] == [("0", 0, -1), ("0", 1, 0), ("1", 0, -1), ("1", 1, 0), ("1", 2, 0)]
    with pytest.raises(PySparkException):
        swc.read_swc(spark, str(folder / "sub" / "b.swc")).collect()
    one = swc.read_swc(spark, str(folder / "sub" / "b.swc"), fix_roots="nearest")
    assert one.where("pid = -1").count() == 1
    assert swc.find_swcs(spark, str(folder), relative=True).count() == 2


def test_bad_rows(spark, tmp_path):
    (tmp_path / "x.swc").write_text("1 1 0 0 0 1 -1\n2 1 zero 0 0 1 1\n")
    lines = swc.swc_lines(spark, str(tmp_path / "x.swc"))
    with pytest.raises(PySparkException, match="line 2"):
        swc.parse(lines).collect()
    assert swc.parse(lines, mode="DROPMALFORMED").count() == 1
    assert [r._corrupt for r in swc.parse(lines, mode="PERMISSIVE").orderBy("pos").collect()] == [None, "2 1 zero 0 0 1 1"]
    (tmp_path / "empty.swc").write_text("# nothing\n")
    assert swc.read_swc(spark, str(tmp_path / "empty.swc")).count() == 0


def test_round_trip_by_the_named_source(spark, folder, fork):
    out = str(folder / "out")
    swc.write_swc(fork, out)
    swc.register(spark)
    back = spark.read.format("swc").load(out).orderBy("id").collect()
    assert [(r.id, r.type, r.x, r.pid) for r in back] == [(1, 1, 0, -1), (2, 3, 0, 1), (3, 3, 0, 2), (4, 2, 3, 2), (5, 2, 6, 4)]
    assert os.listdir(out) == ["y.swc"]


def test_extended(spark, tmp_path):
    (tmp_path / "e.eswc").write_text("1 1 0 0 0 1 -1 1 2 3 4 5\n")
    r = swc.read_eswc(spark, str(tmp_path / "e.eswc")).first()
    assert (r.level, r.mode, r.timestamp, r.teraflyindex, r.feature_value) == (1, 2, 3, 4, 5)


ASC = """
; made by hand
((Color Red) (Axon) ( 1 2 3 4 ) (2 2 3 4)
 ( (3 2 3 1) (4 2 3 1) | (Color Blue) (3 9 3 1) (4 9 3 1) ) )
"""


def test_asc(spark):
    top = asc.Parser(ASC).parse()
    assert [t.kind for t in top] == ["COMMENT", "TREE"] and top[1].value == "AXON"
    n = asc.nodes_of(ASC)
    assert [(i, t, p) for i, t, *_, p in n] == [(0, 2, -1), (1, 2, 0), (2, 2, 1), (3, 2, 2), (4, 2, 1), (5, 2, 4)]
    assert [t.value for t in asc.tokens("7 -1 2.25 1e3 -.5")] == [7, -1, 2.25, 1000, -0.5]
    with pytest.raises(asc.AscError, match="line 1"):
        asc.nodes_of("((Axon) (1 x))")
    deep = "(" * 3000 + "(1 2 3 4)" + ")" * 3000
    assert len(asc.nodes_of(deep)) == 1
    df = spark.createDataFrame([("t", ASC), ("e", ""), ("n", None)], "tree_id string, text string")
    assert asc.asc_nodes(df).count() == 6


@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_codecs(kind):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 200, (5, 4, 3, 2)).astype(kind)
    a[2:] = 7
    assert np.array_equal(M.decode_v3draw(M.encode_v3draw(a)), a)
    assert np.array_equal(M.decode_tiff(M.encode_tiff(a)), a)
    assert np.array_equal(M.decode_tiff(M.encode_tiff(a, False)), a)
    if kind == "u1":
        assert np.array_equal(M.decode_v3dpbd(M.encode_v3dpbd8(a)), a)


def test_packed_differences():
    head = M.PBD_KEY + b"L" + __import__("struct").pack("<h4i", 1, 8, 1, 1, 1)
    # literal 10, then differences +1 +2 -1 0 +1, then twice 9
    body = bytes([0, 10, 32 + 5, 0b00_11_10_01, 0b01, 129, 9])
    assert M.decode_v3dpbd(head + body).ravel().tolist() == [10, 11, 13, 12, 12, 13, 9, 9]
    head = M.PBD_KEY + b"L" + __import__("struct").pack("<h4i", 2, 4, 1, 1, 1)
    body = bytes([0, 232, 3, 31 + 2, 0b011_101_00, 223, 5, 0])  # 1000, +3, -1, then 5
    assert M.decode_v3dpbd(head + body).ravel().tolist() == [1000, 1003, 1002, 5]


def test_nrrd_and_npy(tmp_path):
    a = np.arange(24, dtype="u2").reshape(2, 3, 4)
    b = b"NRRD0004\ntype: uint16\nsizes: 2 3 4\nencoding: raw\nendian: little\n\n" + a.tobytes(order="F")
    assert np.array_equal(M.decode_nrrd(b)[..., 0], a)
    np.save(tmp_path / "a.npy", a)
    assert M.decode("a.npy", (tmp_path / "a.npy").read_bytes()).shape == (2, 3, 4, 1)
    with pytest.raises(ValueError):
        M.decode("a.xyz", b"nothing")


def test_stacks_and_tiles(spark, tmp_path):
    root = tmp_path / "pyramid"
    for name, size in (("RES(4x4x2)", 4), ("RES(2x2x1)", 2)):
        for y in range(0, size, 2):
            for x in range(0, size, 2):
                d = root / name / f"{y * 10:06d}" / f"{y * 10:06d}_{x * 10:06d}"
                d.mkdir(parents=True)
                a = np.full((2, 2, size // 2, 1), x + 10 * y, "u1")
                (d / f"{y * 10:06d}_{x * 10:06d}_000000.v3draw").write_bytes(M.encode_v3draw(a))
    t = M.tile_table(spark, str(root))
    assert [(r.level, r.nx) for r in M.resolutions(t).collect()] == [(0, 4), (1, 2)]
    p = M.patch(spark, t, (1, 1, 0), (3, 3, 1))
    assert (p[..., 0, 0] * 255).round().tolist() == [[0, 20], [2, 22]]
    pts = spark.createDataFrame([(3, 1, 0)], "x int, y int, z int")
    r = M.tile_at(t, pts).first()
    assert (r.dx, r.dy, r.dz) == (1, 1, 0) and r.path.endswith("000000_000020_000000.v3draw")
    stacks = M.read_images(spark, str(root), pattern="v3draw$")
    assert stacks.count() == 5
    v = I.voxels(stacks.limit(1))
    assert I.flip(v, "i").count() == v.count()


def test_stack_filters():
    a = np.random.default_rng(1).integers(0, 255, (6, 5, 4, 1)).astype(np.uint8)
    assert I.preprocess(a).shape == a.shape
    assert I.subtract_min_z(np.full((2, 2, 3, 1), 9, np.uint8)).max() == 0
    assert np.array_equal(I.augment(I.augment(a, 3), 3), a) and I.augment(a, -1) is a
    s = I.augmentation_schedule(3, 4, seed=1)
    assert s.shape == (2, 12) and all(len(set(s[1, i : i + 4])) == 4 for i in (0, 4, 8))


def test_voxelise(spark, make_nodes):
    n = make_nodes([("v", 0, 1, 0, 0, 0, 2, -1), ("v", 1, 1, 6, 0, 0, 2, 0)])
    v = I.voxelise(n)
    assert v.count() == pytest.approx(np.pi * 4 * 6 + 4 / 3 * np.pi * 8, rel=0.1)
    s = I.to_stacks(v).first()
    assert s["shape"] == [10, 4, 4, 1]


def test_streamed_files(spark, folder, tmp_path):
    q = ingest.stream_summaries(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
