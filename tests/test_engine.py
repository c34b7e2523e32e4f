from dataclasses import dataclass
from datetime import datetime

import pytest

from papyrion.dialect.lexer import DialectError
from papyrion.engine import Engine
from tests.conftest import rows

# Rows of the small order tables and what the queries below give on them.
PEOPLE = [(1, "John", "Doe"), (2, "Jane", "Smith"), (3, "Emily", "Johnson"), (4, "Michael", "Brown"), (5, "Emma", "Davis")]
ORDERS = [(1, 1, "2024-01-01", 150.75), (2, 1, "2024-01-05", 220.10), (3, 2, "2024-01-07", 99.99), (4, 3, "2024-01-10", 305.60), (5, 4, "2024-01-12", 180.40), (6, 4, "2024-01-15", 75.00)]


@pytest.fixture(params=[False, True], ids=["typed", "document"])
def engine(request, spark):
    e = Engine(spark, document=request.param)
    people, orders = spark.createDataFrame(PEOPLE, "PersonID int, FirstName string, LastName string"), spark.createDataFrame(ORDERS, "OrderID int, PersonID int, OrderDate string, TotalAmount double")
    if request.param:
        people, orders = (f.select(*(f[c].cast("string") for c in f.columns)) for f in (people, orders))
    e.register("ERP:Person", people)
    e.register("ERP:SalesOrder", orders)
    return e


def text(engine, query, **parameters):
    """Rows as text, numbers without a needless fraction, so that both modes compare."""

    def show(v):
        return None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    return [tuple(show(v) for v in r) for r in engine.sql(query, parameters).collect()]


def test_joins_groups_and_parameters(engine):
    q = "SELECT p.PersonID, p.FirstName, Count(o.TotalAmount) AS n, SUM(o.TotalAmount) AS spent FROM ERP:Person AS p INNER JOIN ERP:SalesOrder AS o ON p.PersonID = o.PersonID GROUP BY p.PersonID, p.FirstName ORDER BY p.PersonID"
    assert text(engine, q) == [("1", "John", "2", "370.85"), ("2", "Jane", "1", "99.99"), ("3", "Emily", "1", "305.6"), ("4", "Michael", "2", "255.4")]
    assert text(engine, "SELECT p.PersonID, o.OrderId FROM ERP:Person AS p OUTER JOIN ERP:SalesOrder AS o ON o.PersonID = p.PersonID WHERE IsNull(o.OrderID) = true") == [("5", None)]
    assert text(engine, "SELECT OrderID FROM ERP:SalesOrder WHERE PersonID = @PersonId ORDER BY OrderID", PersonId=1) == [("1",), ("2",)]


def test_constants_concatenation_and_null_propagation(engine):
    assert text(engine, "SELECT 10 + 10 + 'Text' AS a, 'Text' + 10 + 10 AS b, 10 + 10 + (11 ^ 3) + 10 + '->' AS c, 11 ^ (2 + 1) + 'ten' + (Length('A10CharStr') * 10 + 2) AS d, 10 + 10 + 'ten' + 10 * 10 AS e, 'ten (' + 10 * 10 + ')' AS f, 6 * -1 AS g FROM Single") == [("20Text", "Text20", "2810->", "8ten102", "20ten100", "ten (100)", "-6")]
    assert text(engine, "SELECT 'Prefix' + 10 + ToString(50) + 10 + 'Suffix' AS a, 'Prefix' + 10 + ToNumeric(50) + 10 + 'Suffix' AS b, null + 'x' AS c, 1 + null AS d, Concat('a', null, 'b') AS e FROM Single") == [("Prefix105010Suffix", "Prefix70Suffix", None, None, "ab")]
    assert text(engine, "SELECT 7 / 0 AS a, 7 % 0 AS b, 7 % 4 AS c, 2 + 3 * 4 AS d, (2 + 3) * 4 AS e, 6 & 3 AS f, 6 | 3 AS g, -2 - -3 AS h FROM Single") == [(None, None, "3", "14", "20", "2", "7", "1")]


def test_text_that_is_a_number_joins_the_run_in_document_mode(spark):
    e = Engine(spark, document=True)
    e.store("D", [{"a": "5", "b": "x"}, {"a": "y", "b": "7"}])
    assert text(e, "SELECT 'p' + a + 10 AS v FROM D ORDER BY v") == [("p15",), ("py10",)]
    assert sorted(text(e, "SELECT a + 1 AS v FROM D")) == [("6",), ("y1",)]


def test_comparison_rules(spark, engine):
    engine.register("N", spark.createDataFrame([("A", None), (None, None), ("b", "B")], "x string, y string"))
    n = lambda where: len(text(engine, f"SELECT x FROM N WHERE {where}"))
    assert n("x = 'a'") == 1 and n("x = y") == 2 and n("x != 'a'") == 2 and n("x = null") == 1 and n("x != null") == 2
    assert n("x LIKE '%'") == 2 and n("x NOT LIKE 'a%'") == 1 and n("x LIKE '_'") == 2 and n("x > 1") == 0
    assert n("nothing = null") == 3 and n("nothing = 'x'") == 0 and n("x = 'a' OR nothing = 1") == 1
    o = lambda where: [r[0] for r in text(engine, f"SELECT OrderID FROM ERP:SalesOrder WHERE {where} ORDER BY OrderID")]
    assert o("TotalAmount BETWEEN '99:151'") == ["1", "3"] and o("TotalAmount NOT BETWEEN 76 AND 300") == ["4", "6"] and o("TotalAmount <= 75") == ["6"]
    assert o("(OrderID > 4 OR OrderID < 2) AND PersonID != 4") == ["1"]


def test_star_names_and_expressions(engine):
    result = engine.execute("SELECT * FROM ERP:Person")[0]
    assert result.fields == ["FirstName", "LastName", "PersonID"]
    assert engine.execute("SELECT o.*, p.FirstName, 1 + 1, p.LastName + '!' FROM ERP:Person AS p INNER JOIN ERP:SalesOrder AS o ON o.PersonID = p.PersonID")[0].fields == ["o.OrderDate", "o.OrderID", "o.PersonID", "o.TotalAmount", "FirstName", "Expression0", "Expression1"]


def test_order_top_offset_and_distinct(spark, engine):
    engine.register("L", spark.createDataFrame([("b", "10"), ("A", "9"), ("a", "x"), (None, "2")], "k string, v string"))
    assert [r[0] for r in text(engine, "SELECT k FROM L ORDER BY k")][0] is None
    assert len(text(engine, "SELECT DISTINCT k FROM L")) == 3
    assert text(engine, "SELECT TOP 2 OrderID FROM ERP:SalesOrder ORDER BY TotalAmount DESC OFFSET 1") == [("2",), ("5",)]
    assert text(engine, "SELECT OrderID FROM ERP:SalesOrder ORDER BY OrderID OFFSET 9") == []
    assert len(text(engine, "SELECT TOP 2 DISTINCT PersonID FROM ERP:SalesOrder ORDER BY OrderID")) == 1
    if engine.document:
        assert [r[0] for r in text(engine, "SELECT v FROM L ORDER BY v")] == ["2", "9", "10", "x"]
    assert text(engine, "SELECT PersonID AS who FROM ERP:Person ORDER BY who DESC")[0] == ("5",)


def test_aggregates(engine):
    assert text(engine, "SELECT Count(*) AS a, Min(TotalAmount) AS b, Max(TotalAmount) AS c, Median(PersonID) AS d, Mode(PersonID) AS e, MinString(OrderDate) AS f, CountDistinct(PersonID) AS g, Round(GeometricMean(OrderID), 4) AS h, Round(Variance(OrderID), 4) AS i FROM ERP:SalesOrder") == [("6", "75", "305.6", "2.5", "1", "2024-01-01", "4", "2.9938", "2.9167")]
    assert text(engine, "SELECT Avg(OrderID) AS a FROM ERP:SalesOrder WHERE OrderID > 99") == []
    assert text(engine, "SELECT Sum(nothing) AS a, Count(nothing) AS b, Max(nothing) AS c FROM ERP:SalesOrder") == [("0", "0", None)]
    assert text(engine, "SELECT FormatNumeric(Avg(TotalAmount), 'n2') AS a, Avg(Round(TotalAmount)) + 1 AS b FROM ERP:SalesOrder") == [("171.97", "173")]
    assert text(engine, "SELECT ToUpper(Left(LastName, 1)) AS a, Count(0) AS n FROM ERP:Person GROUP BY ToUpper(Left(LastName, 1)) ORDER BY Count(0) DESC, MinString(LastName)")[0] == ("D", "2")
    with pytest.raises(DialectError):
        engine.sql("SELECT FirstName, Count(0) AS n FROM ERP:Person GROUP BY LastName")
    assert text(engine, "SELECT nope, Count(0) AS n FROM ERP:Person GROUP BY nope") == [(None, "5")]


def test_case_insensitive_groups_in_document_mode(spark):
    e = Engine(spark, document=True)
    e.store("D", [{"k": "Cat"}, {"k": "cat"}, {"k": "dog"}])
    assert sorted(text(e, "SELECT k, Count(0) AS n FROM D GROUP BY k")) == [("Cat", "2"), ("dog", "1")]


def test_date_functions(spark):
    e = Engine(spark)
    one = lambda call: e.scalar(f"SELECT {call} AS v FROM Single")
    assert one("DateAdd('2024-01-31', 'month', 1)") == datetime(2024, 2, 29) and one("DateAdd('2024-02-29', 'year', 1)") == datetime(2025, 2, 28)
    assert one("DateAdd('2024-01-05', 'weekday', 1)") == datetime(2024, 1, 8) and one("DateAdd('2024-01-06', 'weekday', 1)") == datetime(2024, 1, 8)
    assert one("DateAdd('2024-01-08', 'weekday', -1)") == datetime(2024, 1, 5) and one("DateAdd('2024-01-07', 'weekday', -2)") == datetime(2024, 1, 4) and one("DateAdd('2024-01-10', 'dw', 8)") == datetime(2024, 1, 22)
    assert one("DateAdd('2024-01-01 10:00:00.900', 'ms', 50)") == datetime(2024, 1, 1, 10, 0, 0) and one("DateAdd('no date', 'day', 1)") is None
    assert one("DateDiff('2024-01-01', '2024-01-10', 'weekday')") == 8 and one("DateDiff('2024-01-06', '2024-01-07', 'weekday')") == 0 and one("DateDiff('2024-01-10', '2024-01-01', 'weekday')") == 8
    assert one("DateDiff('2024-01-31', '2024-02-29', 'month')") == 0 and one("DateDiff('2020-05-05', '2024-05-04', 'year')") == 3 and one("DateDiff('2024-01-15', '2024-07-14', 'quarter')") == 1
    assert one("DateDiff('2024-01-01', '2024-01-02 12:00', 'day')") == 1.5 and one("DateDiff('2024-01-02', '2024-01-01', 'hh')") == -24
    assert one("FormatDateTime('2024-03-05 15:04:05.678', 'dddd d MMM yy h:mm:ss.fff tt')") == "Tuesday 5 Mar 24 3:04:05.678 PM"
    with pytest.raises(DialectError):
        one("DateAdd('2024-01-01', 'eon', 1)")


def test_string_and_number_functions(spark):
    e = Engine(spark)
    one = lambda call: e.scalar(f"SELECT {call} AS v FROM Single")
    cases = {
        "Checksum('hello world')": 43636, "LastIndexOf('lamp', 'A lamp stood by another lamp in the hall')": 24, "IndexOf('lamp', 'A lamp stood by another lamp in the hall')": 2, "SubString('Seven small boats', 6, 5)": "small",
        "Trim('hello world', 'dhle')": "o wor", "Left('ab', 5)": "ab", "Right('abc', 2)": "bc", "ToProper('hello cruel WORLD')": "Hello Cruel WORLD", "Round(2.5)": 2.0, "Round(-1.25, 1)": -1.2, "FormatNumeric(123456.456789, 'n1')": "123,456.5",
        "FormatNumeric(-1234.5, 'c')": "($1,234.50)", "FormatNumeric(0.256, 'p1')": "25.6 %", "FormatNumeric(7, 'd3')": "007", "FormatNumeric(1234.567, '#,##0.0')": "1,234.6", "FormatNumeric(1234.5, 'f0')": "1235", "IsInteger('123456')": 0, "IsInteger('x')": 1,
        "IsDouble('1e5')": 1, "IsDouble('NaN')": 0, "IsString('abc')": 1, "IsNull(null)": 1, "IIF(null, 'a', 'b')": "b", "NullIfNumeric(10, false)": 10.0, "Pow(2, 10)": 1024.0, "Length(Guid())": 36, "DocumentID('x')": None, "IsNotBetween(null, 1, 2)": 1, "IsLike(null, 'x')": 0,
        "Sha1('t')": "8efd86fb78a56a5145ed7739dcb00c78581c5375", "IfNull(null, 'd')": "d", "LastIndexOf('zz', 'abc')": -1, "Length(null)": None, "Ceil(1.2)": 2.0, "Floor(-1.2)": -2.0, "IsLike('50%', '50\\%')": 0,
    }
    assert {c: one(c) for c in cases} == cases
    for bad in ("Length()", "Length('a', 'b')", "NoSuch(1)", "Guid(1)"):
        with pytest.raises(DialectError):
            one(bad)


def test_insert_update_delete(engine):
    assert engine.execute_non_query("INSERT INTO T:P (Id, Name) VALUES (1, 'a'), (2, 'b' + 'c'), (3, null)") == 3
    assert engine.execute_non_query("INSERT INTO T:P (name: 'd', Extra: Sha1('x'))") == 1
    assert sorted(text(engine, "SELECT Id, Name FROM T:P"), key=str) == sorted([("1", "a"), ("2", "bc"), ("3", None), (None, "d")], key=str)
    assert engine.execute_non_query("UPDATE T:P SET Name = Name + '!', Flag = 1 WHERE Id <= 2") == 2
    assert sorted(r for r in text(engine, "SELECT Name, Flag FROM T:P") if r[1]) == [("a!", "1"), ("bc!", "1")]
    assert engine.execute_non_query("UPDATE u SET Name = p.FirstName FROM ERP:Person AS p INNER JOIN T:P AS u ON u.Id = p.PersonID WHERE p.PersonID = 3") == 1
    assert ("Emily",) in text(engine, "SELECT Name FROM T:P")
    assert engine.execute_non_query("DELETE d FROM ERP:Person AS p INNER JOIN T:P AS d ON d.Id = p.PersonID WHERE p.LastName = 'DOE'") == 1
    assert engine.execute_non_query("DELETE FROM T:P WHERE Id = 2 OR Name = 'D'") == 2
    assert text(engine, "SELECT Id FROM T:P") == [("3",)]
    assert engine.execute_non_query("INSERT INTO T:P (Id) SELECT PersonID FROM ERP:Person") == 5
    with pytest.raises(DialectError):
        engine.execute("INSERT INTO T:P (Id, Name) SELECT PersonID FROM ERP:Person")
    with pytest.raises(DialectError):
        engine.execute("INSERT INTO T:P (Id, id) VALUES (1, 2)")


def test_update_of_a_row_that_matches_several_times(engine):
    engine.execute("INSERT INTO T (Id, V) VALUES (1, 'x'), (2, 'y')")
    assert engine.execute_non_query("UPDATE t SET V = o.OrderDate FROM ERP:SalesOrder AS o INNER JOIN T AS t ON t.Id = o.PersonID") == 2
    assert sorted(text(engine, "SELECT Id, V FROM T")) == [("1", "2024-01-05"), ("2", "2024-01-07")]


def test_unique_keys(engine):
    engine.execute("CREATE UNIQUEKEY uk(LastName) ON ERP:Person")
    for bad in ("INSERT INTO ERP:Person (LastName) VALUES ('doe')", "UPDATE ERP:Person SET LastName = 'Doe' WHERE PersonID < 3", "CREATE UNIQUEKEY uk2(PersonID) ON ERP:SalesOrder", "CREATE INDEX uk(x) ON ERP:Person"):
        with pytest.raises(DialectError):
            engine.execute(bad)
    assert len(text(engine, "SELECT LastName FROM ERP:Person")) == 5
    engine.execute("INSERT INTO ERP:Person (FirstName) VALUES ('No'), ('Key')")
    assert text(engine, "ANALYZE INDEX uk ON ERP:Person")[0][:2] == ("5", "5")
    engine.execute("REBUILD UNIQUEKEY uk ON ERP:Person DROP UNIQUEKEY uk ON ERP:Person INSERT INTO ERP:Person (LastName) VALUES ('doe')")


def test_select_into_and_temporary_schemas(engine):
    engine.execute("BEGIN TRANSACTION SELECT PersonID, LastName INTO #t FROM ERP:Person WHERE PersonID > 3")
    assert sorted(text(engine, "SELECT LastName FROM #t")) == [("Brown",), ("Davis",)]
    engine.execute("COMMIT TRANSACTION")
    with pytest.raises(DialectError):
        engine.sql("SELECT LastName FROM #t")
    with pytest.raises(DialectError):
        engine.execute("SELECT PersonID, personid INTO X FROM ERP:Person")
    engine.execute("SELECT nothing, PersonID INTO N FROM ERP:Person SELECT nothing, PersonID INTO N FROM ERP:Person")
    assert len(text(engine, "SELECT * FROM N")) == 10


def test_transactions(engine):
    engine.execute("BEGIN TRANSACTION DELETE FROM ERP:Person WHERE PersonID = 1 BEGIN TRANSACTION DELETE FROM ERP:Person ROLLBACK TRANSACTION")
    assert len(text(engine, "SELECT PersonID FROM ERP:Person")) == 5
    engine.execute("BEGIN TRANSACTION DELETE FROM ERP:Person WHERE PersonID = 1 COMMIT TRANSACTION")
    assert len(text(engine, "SELECT PersonID FROM ERP:Person")) == 4
    other = engine.session("admin")
    engine.execute("BEGIN TRANSACTION DELETE FROM ERP:Person")
    engine.close()
    assert len(text(other, "SELECT PersonID FROM ERP:Person")) == 4
    for bad in ("COMMIT TRANSACTION", "ROLLBACK TRANSACTION"):
        with pytest.raises(DialectError):
            engine.execute(bad)


def test_schemas_and_lists(engine):
    engine.execute("CREATE SCHEMA A:B:C WITH (PageSize = 7) CREATE SCHEMA A:B")
    assert text(engine, "LIST SCHEMAS A") == [("B", "A:B")] and text(engine, "LIST SCHEMAS : SIZE 1") == [("A", "A")]
    assert text(engine, "SELECT * FROM A:B:C") == [] and text(engine, "SELECT x FROM A:B:C") == []
    engine.execute("ALTER SCHEMA A:B:C WITH (PageSize = 2)")
    engine.store("A:B:C", [{"x": 1}, {"x": 2, "y": 3}, {}])
    assert text(engine, "ANALYZE SCHEMA A:B:C")[0][:3] == ("3", "2", "2")
    engine.execute("DROP SCHEMA A DROP SCHEMA A")
    with pytest.raises(DialectError):
        engine.sql("SELECT * FROM A:B:C")
    assert len(text(engine, "SAMPLE ERP:Person SIZE 3")) == 3 and len(text(engine, "LIST DOCUMENTS ERP:Person")) == 5


def test_session_statements_and_system_functions(engine):
    assert text(engine, "DECLARE @x = '5' SELECT @x + 1 AS v FROM Single") == [("6",)]
    engine.execute("SET WarnMissingFields true")
    assert engine.execute("SELECT nope FROM ERP:Person")[0].warnings == ["field 'nope' was not found"]
    engine.execute("SET WarnNullPropagation true")
    assert engine.execute("SELECT FirstName, null + PersonID AS v, PersonID + 1 FROM ERP:Person")[0].warnings == ["'v' is null in 5 rows, as an operand is"]
    assert engine.execute("EXEC Print('hello')")[0].messages == ["hello"]
    assert len(text(engine, "EXEC ShowScalarFunctions()")) == 52 and len(text(engine, "EXEC ShowAggregateFunctions()")) == 16 and len(text(engine, "EXEC ShowSystemFunctions()")) == 24
    for name in ("ShowBlocks", "ShowBlockTree", "ShowLocks", "ShowWaitingLocks", "ShowMemoryUtilization", "ShowProcesses", "ShowThreadPools", "ShowTransactions", "ShowHealthCounters", "RefreshMyRoles"):
        engine.sql(f"EXEC {name}()").collect()
    for name in ("CheckpointHealthCounters()", "ClearHealthCounters()", "ClearCacheAllocations()", "ReleaseCacheAllocations()", "Sleep(1)", "Cancel(9)", "Terminate(9)", "ShowVersion(true)", "ShowMySchemaPolicy('ERP')", "ShowSchemaPolicy('ERP')"):
        engine.execute(f"EXEC {name}")
    engine.execute("ALTER CONFIGURATION WITH (DefaultDocumentPageSize = 30, HealthMonitoringEnabled = false) CREATE SCHEMA Paged KILL 999999")
    assert engine.configuration == {"defaultdocumentpagesize": 30, "healthmonitoringenabled": False} and engine.catalog.get("Paged").page_size == 30
    engine.execute("ALTER CONFIGURATION WITH (HealthMonitoringEnabled = true) SET TraceWaitTimes true")
    assert "select: " in engine.execute("SELECT 1 FROM Single")[0].messages[0] and engine.counters["statements: select"] > 0
    for bad in ("ALTER CONFIGURATION WITH (Depth = 3)", "CREATE SCHEMA x WITH (PageSize = 'a')", "CREATE SCHEMA x WITH (PageSize = 0)", "CREATE SCHEMA x WITH (Partitions = 3)", "ANALYZE SCHEMA ERP WITH (IncludePhysicalPages = 7)"):
        with pytest.raises(DialectError):
            engine.execute(bad)
    for bad in ("SET Nope 1", "EXEC Nope()", "SELECT @nope FROM Single", "SELECT z.a FROM ERP:Person AS p", "CREATE PROCEDURE x"):
        with pytest.raises(DialectError):
            engine.execute(bad)


def test_policies(engine):
    engine.execute("CREATE ACCOUNT ann WITH (Password = 'p') CREATE ROLE readers ALTER ROLE readers ADD ann")
    ann = engine.session("ann")
    with pytest.raises(DialectError):
        ann.sql("SELECT PersonID FROM ERP:Person")
    engine.execute("GRANT READ ON ERP TO readers WITH (Recursive = true)")
    assert len(ann.sql("SELECT PersonID FROM ERP:Person").collect()) == 5
    for bad in ("DELETE FROM ERP:Person", "CREATE ROLE x", "EXEC ShowLocks()"):
        with pytest.raises(DialectError):
            ann.execute(bad)
    engine.execute("DENY READ ON ERP:Person TO readers")
    with pytest.raises(DialectError):
        ann.sql("SELECT PersonID FROM ERP:Person")
    assert len(ann.sql("SELECT OrderID FROM ERP:SalesOrder").collect()) == 6
    engine.execute("REVOKE READ ON ERP:Person FROM readers")
    assert len(ann.sql("SELECT PersonID FROM ERP:Person").collect()) == 5
    engine.execute("ALTER ROLE readers REMOVE ann DROP ROLE readers DROP ACCOUNT ann")


def test_api(engine, tmp_path):
    @dataclass
    class Person:
        PersonID: object
        FirstName: str

    assert engine.fetch("SELECT PersonID, FirstName FROM ERP:Person WHERE PersonID = 1", into=Person)[0].FirstName == "John"
    assert engine.first("SELECT FirstName FROM ERP:Person WHERE PersonID = 9") is None and engine.scalar("SELECT FirstName FROM ERP:Person WHERE PersonID = 9") is None
    assert engine.single("SELECT FirstName FROM ERP:Person WHERE PersonID = 1") == {"FirstName": "John"}
    with pytest.raises(DialectError):
        engine.single("SELECT FirstName FROM ERP:Person")
    assert "Filter" in engine.explain_plan("SELECT FirstName FROM ERP:Person WHERE PersonID = 1")
    assert engine.explain_operations("SELECT a FROM b WHERE x = 1 AND (y LIKE 'z' OR w > 2)") == "where\n  AND\n    x = 1\n    OR\n      y like \"z\"\n      w > 2"
    (tmp_path / "t.tsv").write_text("Id\tText\n1\ta b\n2\t\n")
    engine.import_tsv("T", str(tmp_path / "t.tsv"))
    assert text(engine, "SELECT Text FROM T ORDER BY Id") == [("a b",), (None,)]
    (tmp_path / "j.json").write_text('{"a": 1}\n{"b": "x"}\n')
    engine.import_json("J", str(tmp_path / "j.json"))
    assert len(text(engine, "SELECT a, b FROM J")) == 2 and engine.field_sample("J") == ["a", "b"]
    engine.export_csv("SELECT FirstName FROM ERP:Person", str(tmp_path / "out"))
    assert sum(len(p.read_text().splitlines()) - 1 for p in (tmp_path / "out").glob("*.csv")) == 5


def test_storage_folder(spark, tmp_path):
    e = Engine(spark, storage=str(tmp_path))
    e.execute("INSERT INTO A:B (x) VALUES (1), (2) DELETE FROM A:B WHERE x = 1")
    assert rows(e.sql("SELECT x FROM A:B")) == [(2,)] and list((tmp_path / "a" / "b").iterdir())
    assert e.execute_non_query("SELECT x, null AS y INTO C FROM A:B INSERT INTO C (x) SELECT x FROM A:B") == 2
    assert rows(e.sql("SELECT x, y FROM C")) == [(2, None), (2, None)]


def test_many_changes_keep_the_lineage_short(spark):
    e = Engine(spark)
    for i in range(10):
        e.execute(f"INSERT INTO T (x) VALUES ({i})")
    assert sorted(r[0] for r in e.sql("SELECT x FROM T").collect()) == list(range(10))


def test_a_filter_and_the_columns_reach_the_scan(spark):
    e = Engine(spark)
    e.register_folder("/root/testdata/sf0.001", ["lineitem"])
    plan = e.explain_plan("SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
    assert "GreaterThan(l_quantity,45.0)" in plan.replace(" ", "") or "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_schema_and_index_api(engine):
    engine.create_schema("X:Y:Z")
    assert engine.schema_exists("x:y") and engine.schemas("X") == ["X:Y"] and not engine.schema_exists("X:Q")
    engine.create_index("ERP:Person", "uk", ["PersonID"], unique=True, partitions=7)
    engine.rebuild_index("ERP:Person", "uk", 9)
    assert engine.index("ERP:Person", "UK").partitions == 9 and [i.name for i in engine.indexes("ERP:Person")] == ["uk"]
    engine.drop_index("ERP:Person", "uk")
    assert engine.index("ERP:Person", "uk") is None
    engine.drop_schema("X")
    with pytest.raises(DialectError):
        engine.drop_schema("X", if_exists=False)


def test_null_keys_in_joins(spark):
    text_ = "SELECT a.v, b.w FROM A AS a INNER JOIN B AS b ON a.k = b.k"
    for null_keys, n in ((True, 2), (False, 1)):
        e = Engine(spark, null_keys=null_keys)
        e.register("A", spark.createDataFrame([(1, 1), (None, 2)], "k int, v int"))
        e.register("B", spark.createDataFrame([(1, 1), (None, 2)], "k int, w int"))
        assert e.sql(text_).count() == n


def test_two_sessions(engine):
    other = engine.session("admin")
    count = lambda e: len(text(e, "SELECT PersonID FROM ERP:Person"))
    engine.execute("BEGIN TRANSACTION DELETE FROM ERP:Person WHERE PersonID = 1")
    assert (count(engine), count(other)) == (4, 5)
    assert text(other, "EXEC ShowLocks()") == [(str(engine.process), "Schema", "Write", "erp:person")]
    assert text(other, "EXEC ShowTransactions()") == [(str(engine.process), "1", "1")]
    assert {r[0] for r in text(other, "EXEC ShowProcesses()")} >= {str(engine.process), str(other.process)}
    other.execute("SET ReadUncommitted true")
    assert count(other) == 4
    other.execute("SET ReadUncommitted false INSERT INTO Elsewhere (x) VALUES (1)")
    engine.execute("ROLLBACK TRANSACTION")
    assert count(engine) == count(other) == 5 and len(text(engine, "SELECT x FROM Elsewhere")) == 1  # what the other session did stays
    engine.execute("BEGIN TRANSACTION DELETE FROM ERP:Person WHERE PersonID = 1")
    other.execute("DELETE FROM ERP:Person WHERE PersonID = 2")
    with pytest.raises(DialectError):
        engine.execute("COMMIT TRANSACTION")
    assert count(engine) == count(other) == 4
    other.execute(f"KILL {engine.process}")
    with pytest.raises(DialectError):
        engine.execute("SELECT 1 FROM Single")


def test_kill_stops_a_running_query(spark):
    import threading
    import time

    from pyspark.sql import functions as F

    engine = Engine(spark)
    engine.register("Slow", spark.range(0, 4, 1, 4).select(F.expr("java_method('java.lang.Thread', 'sleep', 60000L + id)").alias("x"), "id"))
    failed = []

    def work():
        try:
            engine.fetch("SELECT x FROM Slow")
        except Exception as error:
            failed.append(error)

    thread = threading.Thread(target=work)
    thread.start()
    time.sleep(4)
    started = time.monotonic()
    engine.session("admin").execute(f"EXEC Cancel({engine.process})")
    thread.join(40)
    assert failed and time.monotonic() - started < 40 and engine.scalar("SELECT 1 FROM Single") == 1


def test_bare_keys_anti_joins_and_pushed_text_filters(spark, tmp_path):
    spark.createDataFrame([(1, "Kilo"), (2, "\u212aILO"), (3, "kilometre"), (4, None), (5, "\u0130x"), (6, "%a"), (None, "kilo")], "id int, name string").write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([(1, 10), (3, 30), (3, 31)], "aid int, v int").write.parquet(str(tmp_path / "b.parquet"))
    spark.createDataFrame([(1, 10), (None, 30)], "aid int, v int").write.parquet(str(tmp_path / "c.parquet"))
    engine = Engine(spark)
    engine.register_folder(str(tmp_path), ["a", "b", "c"])
    plan = lambda q: engine.explain_plan(q)
    ids = lambda q: sorted((r[0] for r in engine.sql(q).collect()), key=lambda x: (x is not None, x))
    inner = "SELECT a.id FROM a AS a INNER JOIN {} AS b ON b.aid = a.id"
    assert "coalesce" not in plan(inner.format("b")) and "IsNotNull(id)" in plan(inner.format("b")) and ids(inner.format("b")) == [1, 3, 3]
    assert "<=>" in plan(inner.format("c")) or "coalesce" in plan(inner.format("c"))
    assert ids(inner.format("c")) == [None, 1]  # a null key matches null keys
    anti = "SELECT a.id FROM a AS a OUTER JOIN {} AS b ON b.aid = a.id WHERE IsNull(b.{}) = true AND a.id != 6"
    assert "LeftAnti" in plan(anti.format("b", "v")) and ids(anti.format("b", "v")) == [None, 2, 4, 5]
    assert "LeftAnti" not in plan(anti.format("c", "aid")) and ids(anti.format("c", "aid")) == [None, 2, 3, 4, 5]
    assert "LeftAnti" not in plan("SELECT a.id, b.v FROM a AS a OUTER JOIN b AS b ON b.aid = a.id WHERE IsNull(b.v) = true")
    after = "SELECT a.id FROM a AS a OUTER JOIN b AS b ON b.aid = a.id INNER JOIN b AS d ON d.v = b.v"
    assert ids(after) == [1, 3, 3]
    assert ids("SELECT id FROM a WHERE name = 'KILO'") == [None, 1, 2] and "StringStartsWith(name" in plan("SELECT id FROM a WHERE name = 'KILO'")
    assert ids("SELECT id FROM a WHERE name LIKE 'kilo%'") == [None, 1, 2, 3] and ids("SELECT id FROM a WHERE name LIKE 'i%x'") == [5]
    assert ids("SELECT id FROM a WHERE name LIKE '%a'") == [6] and ids("SELECT id FROM a WHERE name NOT LIKE 'k%'") == [5, 6]
    assert "In(name, [" in plan("SELECT id FROM a WHERE name = 'K'") and ids("SELECT id FROM a WHERE name = ''") == []


def test_pages_and_samples(spark):
    engine = Engine(spark)
    engine.store("T", [{"a": i} for i in range(25)])
    engine.execute("ALTER SCHEMA T WITH (PageSize = 4)")
    pages = engine.fetch("ANALYZE SCHEMA T WITH (IncludePhysicalPages = true)")
    assert sum(p["documents"] for p in pages) == 25 and max(p["documents"] for p in pages) <= 4
    assert engine.fetch("ANALYZE SCHEMA T WITH (IncludePhysicalPages = false)")[0]["documents"] == 25
    assert len(engine.sample("T", 60).collect()) == 60 and engine.sample("T", 0).collect() == [] and engine.sample("Single", 5).count() == 5
    assert len({r[0] for r in engine.sample("T", 200).collect()}) == 25


def test_digests_of_groups(spark):
    import hashlib

    data = [(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (None, "é"), (None, ""), (3, "")]
    engine = Engine(spark)
    engine.register("T", spark.createDataFrame(data, "k int, v string"))
    digest = lambda kind, text_: hashlib.new(kind, text_.encode()).hexdigest()
    got = {r[0]: tuple(r[1:]) for r in engine.sql("SELECT k, Sha1Agg(v) AS a, Sha512Agg(v) AS b, Count(0) AS n FROM T GROUP BY k").collect()}
    assert got == {1: (digest("sha1", "abb"), digest("sha512", "abb"), 4), 2: (None, None, 1), None: (digest("sha1", "é"), digest("sha512", "é"), 2), 3: (digest("sha1", ""), digest("sha512", ""), 1)}
    assert engine.scalar("SELECT Sha256Agg(v) AS a FROM T") == digest("sha256", "abbé") and engine.sql("SELECT Sha256Agg(v) AS a FROM T WHERE k = 9").count() == 0
    many = Engine(spark)
    many.register("T", spark.range(30_000).selectExpr("id % 7000 AS k", "CASE WHEN id % 3 = 0 THEN 'same' ELSE CAST(id AS string) END AS v"))
    rows = {}
    for i in range(30_000):
        rows.setdefault(i % 7000, []).append("same" if i % 3 == 0 else str(i))
    assert dict(map(tuple, many.sql("SELECT k, Sha256Agg(v) AS a FROM T GROUP BY k").collect())) == {k: digest("sha256", "".join(sorted(v))) for k, v in rows.items()}


def test_changes_by_join_with_repeated_and_null_rows(spark):
    engine = Engine(spark)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    engine.register("T", table([(1, "a"), (1, "a"), (1, "b"), (None, "n"), (None, None), (5, "z")], "k int, v string"))
    engine.register("S", table([(1, 10), (1, 20), (None, 30), (7, 70)], "k int, w int"))
    result = engine.execute("UPDATE t SET v = s.w FROM S AS s INNER JOIN T AS t ON t.k = s.k")[0]
    assert result.affected == 5 and sorted(map(str, engine.catalog.frame("T").collect())) == sorted(map(str, table([(1, "20"), (1, "20"), (1, "20"), (None, "30"), (None, "30"), (5, "z")], "k int, v string").collect()))
    assert engine.execute("DELETE t FROM S AS s OUTER JOIN T AS t ON t.k = s.k WHERE s.w = 70")[0].affected == 0
    assert engine.execute("DELETE t FROM T AS t INNER JOIN S AS s ON s.w = 70 WHERE t.v = 'Z'")[0].affected == 1
    assert engine.execute("UPDATE t SET v = 'all' FROM T AS t INNER JOIN S AS s ON s.w = 70")[0].affected == 5
    assert engine.execute("UPDATE t SET v = 'none' FROM T AS t INNER JOIN S AS s ON s.w = 71")[0].affected == 0
    assert engine.execute("DELETE t FROM T AS t INNER JOIN S AS s ON s.w = 30")[0].affected == 5
    assert engine.catalog.frame("T").count() == 0
