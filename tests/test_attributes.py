from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from papyrion.operators import attributes as attributes_module
from papyrion.operators.attributes import filled_cells, read_bigint, read_boolean, read_date, read_double, widen
from tests.conftest import rows

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
TYPES = [("P", "Id", "bigint"), ("P", "Born", "date"), ("P", "Height", "double"), ("P", "Active", "boolean"), ("P", "Name", "string"), ("O", "Id", "bigint"), ("O", "Name", "bigint"), ("O", None, "bigint"), (None, "x", "bigint"), ("O", "odd", "blob")]


def tables(spark, data, types=TYPES):
    elements = spark.createDataFrame([(*d, "clash", "clash") for d in data], "documentid bigint, schemapath string, elementname string, elementvalue string, created timestamp, modified timestamp, id string, `__cell` string")
    return elements, spark.createDataFrame(types, "schemapath string, elementname string, typename string")


def test_typed_wide_rows(spark):
    data = [(1, "P", " ID ", "007", T1, T1), (1, "P", "born", "2 Feb 2020", T1, T1), (1, "P", "HEIGHT", "1.234,5", T1, T1), (1, "P", "active", "Y", T1, T1), (1, "P", "name", "\tAnn ", T1, T1), (1, "P", "other", "x", T1, T1), (2, "O", "name", "12", T1, T1), (3, "O", "zzz", "1", T1, T1)]
    wide = {r["documentid"]: r for r in widen(*tables(spark, data)).collect()}
    assert (wide[1]["id"], wide[1]["born"], wide[1]["height"], wide[1]["active"], wide[1]["name_string"]) == (7, date(2020, 2, 2), 1234.5, True, "Ann")
    assert wide[2]["name_bigint"] == 12 and wide[2]["name_string"] is None
    assert all(wide[3][c] is None for c in ("id", "born", "name_bigint"))


def test_the_latest_row_decides_even_if_unreadable(spark):
    data = [(1, "P", "Id", "5", T1, T1), (1, "P", "id", "what", T1, T2), (2, "P", "Id", "5", T1, T2), (2, "P", "Id", None, T1, T1), (3, "P", "Id", "5", T1, None), (3, "P", "Id", "6", T1, T1), (4, "P", "Id", "5", T1, T1), (4, "P", "Id", "5", T1, T1), (5, "P", "Id", "1", T1, T1), (5, "P", "Id", "2", T2, T1)]
    elements, types = tables(spark, data)
    assert rows(filled_cells(widen(elements, types), types)) == [("P", 2, "id", "5"), ("P", 3, "id", "6"), ("P", 4, "id", "5"), ("P", 5, "id", "2")]


def test_nulls_empty_tables_and_no_declarations(spark):
    elements, types = tables(spark, [(None, "P", "Id", "1", T1, T1), (1, None, "Id", "1", T1, T1), (1, "P", None, "1", T1, T1), (1, "P", "Name", None, None, None)])
    assert [r[:2] for r in rows(widen(elements, types))] == [("P", 1)]
    assert rows(filled_cells(widen(elements, types), types)) == []
    none, nothing = tables(spark, [], [])
    assert rows(widen(none, types)) == [] and rows(filled_cells(widen(elements, nothing), nothing)) == []
    assert rows(widen(elements, nothing)) == [("P", 1)]


def read(spark, reader, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reader(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("reader", "cases"),
    [
        (read_bigint, {"12": 12, " +7\t": 7, "-1,234,567": -1234567, "1.234.567": 1234567, "6985.0": 6985, "12.5": None, "1,2": None, "1e3": None, "": None, "99999999999999999999": None, "seven": None}),
        (read_double, {"5779.930": 5779.93, "550.090": 550.09, "4891,41": 4891.41, "1,539.33": 1539.33, "3.802,22": 3802.22, "6.396670e+03": 6396.67, "1,234": 1234.0, "1.234": 1234.0, "-0.5": -0.5, "12..5": None, "1,2,3": None, "n/a": None, "1e999": None, "1.234.567": 1234567.0}),
        (read_boolean, {"TRUE ": True, "y": True, "on": True, "1": True, "off": False, "N": False, "2": None, "maybe": None, " ": None}),
        (read_date, {"2020-02-29": date(2020, 2, 29), "2021-02-29": None, "31.12.1999": date(1999, 12, 31), "1988/06/09": date(1988, 6, 9), "20040315": date(2004, 3, 15), "2 Jul 1968": date(1968, 7, 2), "16 JUL 1978": date(1978, 7, 16), "1967-01-28T00:00:00": date(1967, 1, 28), "0000-00-00": None, "2021-13-45": None, "soon": None}),
    ],
)
def test_notations(spark, reader, cases):
    assert read(spark, reader, [*cases, None]) == [*cases.values(), None]


def test_more_attributes_than_one_aggregation_takes(spark, monkeypatch):
    types = [("P", f"a{i}", "bigint") for i in range(7)]
    data = [(d, "P", f"a{i}", str(10 * d + i), T1, T1) for d in (1, 2) for i in range(7)] + [(3, "P", "zzz", "1", T1, T1)]
    whole = rows(widen(*tables(spark, data, types)))
    monkeypatch.setattr(attributes_module, "BLOCK", 3)
    assert rows(widen(*tables(spark, data, types))) == whole and len(whole) == 3
