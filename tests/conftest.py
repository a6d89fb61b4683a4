import os

os.environ.setdefault("TZ", "UTC")

import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def _plain(value):
    """A value as text: floats to nine digits, every null and NaN alike."""
    if isinstance(value, list):
        return "[" + ",".join(map(_plain, value)) + "]"
    if value is None or value != value:
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Compares a registered query with its SQL over the same tables, without order."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def rows(table):
        names = sorted(table.column_names)
        return names, sorted("|".join(map(_plain, r)) for r in zip(*(table[n].to_pylist() for n in names)))

    def check(query, sql):
        assert rows(query(spark, sf_dir).toArrow()) == rows(con.sql(sql).to_arrow_table())

    return check
