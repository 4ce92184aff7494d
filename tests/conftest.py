import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidegrid-test-"))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection with every table of the smallest scale as a view."""
    import duckdb

    connection = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_rows(spark, sf, oracle):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        df = query(spark, sf)
        columns = sorted(df.columns)
        found = oracle.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        expected = [dict(zip(names, row)) for row in found.fetchall()]
        left = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        right = sorted((tuple(plain(r[c]) for c in columns) for r in expected), key=repr)
        assert left == right

    return check
