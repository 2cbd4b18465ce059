import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("OMP_NUM_THREADS", "1")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.fixture
def basic(spark):
    rows = [(1, "Alice", 25, 50000.0, True), (2, "Bob", 30, 60000.0, True), (3, "Charlie", 35, 70000.0, False), (4, "Diana", 40, 80000.0, True), (5, "Eve", 45, 90000.0, False)]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, salary double, active boolean").coalesce(1)


@pytest.fixture
def with_nulls(spark):
    rows = [(1, "Alice", 25, 50000.0, True), (2, None, 30, None, True), (3, "Charlie", None, 70000.0, None), (4, "Diana", 40, None, True), (5, None, 45, 90000.0, False)]
    return spark.createDataFrame(rows, "id bigint, name string, age bigint, salary double, active boolean").coalesce(1)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "id bigint, name string, value double")
