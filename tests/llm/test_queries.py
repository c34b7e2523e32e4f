import pytest

from papyrion.llm.queries import QUERIES, SQL
from tests.conftest import same_as_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same_as_sql(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_mix_reaches_its_shares(spark):
    shares = QUERIES["p8_shares"](spark, "/root/testdata/sf0.01").collect()
    assert len(shares) == 12 and all(abs(r["share"] - r["targetshare"]) < 0.01 for r in shares)
    caps = {r["source"]: r["maxrepeats"] for r in spark.read.parquet("/root/testdata/sf0.01/mixtarget.parquet").collect()}
    assert all(r["mostrepeats"] <= caps[r["source"]] for r in shares)
