import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def make_nodes(spark):
    """Node table of rows (tree_id, id, type, x, y, z, r, pid)."""
    schema = "tree_id string, id int, type int, x double, y double, z double, r double, pid int"
    return lambda rows: spark.createDataFrame([(str(t), i, k, float(x), float(y), float(z), float(r), p) for t, i, k, x, y, z, r, p in rows], schema)


#: A root, a chain of two and a fork: 1-2, 1-3, 2-4.
SIMPLE = [("s", 1, 1, 0, 0, 0, 1, -1), ("s", 2, 3, 1, 0, 0, 1, 1), ("s", 3, 3, 0, 1, 0, 1, 1), ("s", 4, 3, 2, 1, 0, 1, 2)]
#: A chain of four.
LINE = [("l", i, 1 if i == 0 else 2, i, 0, 0, 1, i - 1) for i in range(4)]
#: A root with a stem that forks into two tips.
Y = [("y", 0, 1, 0, 0, 0, 2, -1), ("y", 1, 3, 0, 0, 3, 1, 0), ("y", 2, 3, 0, 4, 3, 1, 1), ("y", 3, 2, 3, 0, 3, 0.5, 1), ("y", 4, 2, 6, 0, 3, 0.5, 3)]


@pytest.fixture
def simple(make_nodes):
    return make_nodes(SIMPLE)


@pytest.fixture
def line(make_nodes):
    return make_nodes(LINE)


@pytest.fixture
def fork(make_nodes):
    return make_nodes(Y)
