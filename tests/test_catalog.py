"""A sample of the registered queries against DuckDB, and the contract of the entry module."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from arbora.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["tree_summary", "sholl", "bif_local", "volume_acc3", "branch_features", "redirect_tree", "feature_histogram", "image_equalise", "swc_roundtrip", "checks_knots", "components_many", "swc_files", "asc_branches", "stack_files", "stack_v3dpbd", "spanning_length", "sphere_line", "standardise"]


def canon(df):
    rows = df[sorted(df.columns)].itertuples(index=False)
    return sorted(tuple("None" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) and canon(mine) == canon(theirs)


def test_voxelise_lists_every_voxel(spark):
    """Of two trees: each node's own voxel is there, and all are as by the distance of the Spark expressions."""
    n = catalog.forest(spark, SF).where("tree_id < 3 AND id < 12").cache()
    got = catalog.QUERIES["voxelise"](spark, SF)
    assert got.columns == ["tree_id", "i", "j", "k"]
    own = catalog.forest(spark, SF).selectExpr("tree_id", *(f"CAST(floor({x}) AS LONG) AS {i}" for x, i in zip("xyz", "ijk"))).distinct()
    assert own.join(got, own.columns, "left_anti").count() == 0
    grid = catalog.T.edges(n)
    for x, i in zip("xyz", "ijk"):
        grid = grid.selectExpr("*", f"explode(sequence(CAST(floor(least(p_{x}, c_{x})) AS INT) - 3, CAST(ceil(greatest(p_{x}, c_{x})) AS INT) + 3)) AS {i}")
    at = tuple(catalog.F.col(i) + 0.5 for i in "ijk")
    inside = catalog.S.sdf_round_cone(at, catalog.V.vec("p_"), catalog.V.vec("c_"), catalog.F.col("p_r"), catalog.F.col("c_r")) <= 0
    want = {tuple(r) for r in grid.where("length < 60").where(inside).select("tree_id", "i", "j", "k").distinct().collect()}
    some = catalog.images.voxelise(n)
    assert want and want <= {tuple(r) for r in some.collect()}


def test_entry_imports_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) > 100, done.stderr[-500:]


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and catalog.FLAGSHIP in q
    assert entry.entry(spark).columns[0] == "tree_id"
