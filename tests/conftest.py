import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df):
    """The rows as a sorted list of tuples; nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def same_as_sql(spark, query, sql, folder="/root/testdata/sf0.001"):
    """Asserts that a query gives the rows of its SQL on DuckDB, with columns by name."""
    import duckdb

    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    expected = connection.sql(sql)
    frame = query(spark, folder)
    assert sorted(frame.columns) == sorted(expected.columns)
    order = [frame.columns.index(c) for c in sorted(frame.columns)]
    other = [expected.columns.index(c) for c in sorted(expected.columns)]
    got = sorted(repr(tuple(r[i] for i in order)) for r in frame.collect())
    assert got == sorted(repr(tuple(r[i] for i in other)) for r in expected.fetchall())
