import pytest

from papyrion.dialect.lexer import DialectError
from papyrion.engine import Engine
from papyrion.streaming.continuous import files, start
from tests.conftest import rows

SCHEMA = "user_id bigint, event_type string, value double"


def test_grouped_query_over_arriving_files(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "click", 2.0), (2, "view", 3.0)], SCHEMA).write.parquet(source)
    engine = Engine(spark)
    engine.register("events", files(spark, source, SCHEMA))
    engine.register("users", spark.createDataFrame([(1, "ann"), (2, "bob")], "id bigint, name string"))
    text = "SELECT u.name AS name, Count(0) AS n, Sum(e.value) AS total FROM events AS e INNER JOIN users AS u ON u.id = e.user_id WHERE e.value > 1 GROUP BY u.name"
    query = start(engine, text, "memory", "totals", "complete", progress=str(tmp_path / "progress"))
    try:
        query.processAllAvailable()
        spark.createDataFrame([(1, "click", 5.0), (2, "view", 0.5)], SCHEMA).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert rows(spark.table("totals")) == [("ann", 2, 7.0), ("bob", 1, 3.0)]
    finally:
        query.stop()


def test_filtered_query_into_files(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "CLICK", 2.0), (2, "view", 3.0)], SCHEMA).write.parquet(source)
    engine = Engine(spark)
    engine.register("events", files(spark, source, SCHEMA, at_once=1))
    query = start(engine, "SELECT user_id FROM events WHERE event_type = 'click'", "parquet", str(tmp_path / "out"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1,)]


def test_a_query_without_a_stream_is_refused(spark):
    with pytest.raises(DialectError):
        start(Engine(spark), "SELECT value FROM Single", "memory", "x")
