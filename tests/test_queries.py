import subprocess
import sys
from pathlib import Path

import pytest

from papyrion import dialect_queries, problem_queries, session_queries
from tests.conftest import same_as_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = dialect_queries.QUERIES | problem_queries.QUERIES | session_queries.QUERIES
SQL = dialect_queries.SQL | problem_queries.SQL | session_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_without_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert frame.count() > 0 and frame.columns


def test_wide_rows_hold_the_cells_found(spark):
    wide = problem_queries.p6_wide(spark, FOLDER)
    filled = sum(v is not None for r in wide.collect() for v in r[2:])
    assert filled == problem_queries.p6_found(spark, FOLDER).count()


def test_unified_cells_are_those_of_the_documents(spark):
    schemas = problem_queries.p4_file_schemas(spark, FOLDER)
    unified = problem_queries.p4_unified(spark, FOLDER)
    counted = {(r[0], r[1], r[2]): r[3] for r in unified.groupBy("schemapath", "fileseq", "field").count().collect()}
    assert counted.keys() == {(r["schemapath"], r["fileseq"], r["field"]) for r in schemas.collect() if r["filled"]}
    renamed = {(r["schemapath"], r["newfield"]) for r in problem_queries.p4_found(spark, FOLDER).where("changetype = 'renamed'").collect()}
    assert {(r["schemapath"], r["field"]) for r in unified.where("column <> field").collect()} <= renamed


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_workers_need_no_package_on_their_path(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from papyrion.problem_queries import p5_found
print("rows", p5_found(spark, {FOLDER!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_without_the_packages_of_the_text_queries():
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r}); sys.modules["ahocorasick"] = None
import __spark_entry__
names = set(__spark_entry__.queries())
assert "p1_found" in names and "p7_found" not in names, names
assert set(__spark_entry__.oracle_sql()) <= names
print("kept", len(names))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert f"kept {len(QUERIES)}" in done.stdout, done.stderr[-2000:]
