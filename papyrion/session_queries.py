"""Queries that exercise schemas, indexes, transactions, policies, system functions and the API, and the SQL they are checked with.

What they show is mostly metadata, which SQL states as VALUES; where tables are read, they are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion import __version__
from papyrion.dialect.lexer import DialectError
from papyrion.engine import Engine
from papyrion.stable import checkpoint_folder


def _engine(spark: SparkSession, folder: str, *tables: str) -> Engine:
    engine = Engine(spark)
    engine.register_folder(folder, list(tables))
    return engine


def _rows(engine: Engine, fields: str, rows: list[tuple]) -> DataFrame:
    return engine.spark.createDataFrame(rows, fields)


def _outcome(engine: Engine, text: str) -> str:
    try:
        engine.execute(text)
    except DialectError:
        return "refused"
    return "done"


def _own_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def create_schema(spark, d):
    return Engine(spark).sql("CREATE SCHEMA A:B:C WITH (PageSize = 7) CREATE SCHEMA A:B CREATE SCHEMA A:D LIST SCHEMAS A")


def drop_schema(spark, d):
    return Engine(spark).sql("CREATE SCHEMA A:B:C CREATE SCHEMA A:D DROP SCHEMA A:B DROP SCHEMA A:B LIST SCHEMAS A")


def alter_schema(spark, d):
    return _engine(spark, d, "nation").sql("ALTER SCHEMA nation WITH (PageSize = 4) ANALYZE SCHEMA nation")


def analyze_pages(spark, d):
    return _engine(spark, d, "nation").sql("ALTER SCHEMA nation WITH (PageSize = 10) ANALYZE SCHEMA nation WITH (IncludePhysicalPages = true)")


def list_schemas_api(spark, d):
    engine = Engine(spark)
    engine.create_schema("X:Y")
    engine.create_schema("X:Z")
    engine.drop_schema("X:Y")
    return _rows(engine, "path string, there boolean", [(p, engine.schema_exists(p)) for p in ("X", "X:Y", "X:Z")])


def create_uniquekey(spark, d):
    engine = _engine(spark, d, "customer", "orders")
    tried = [("customer", _outcome(engine, "CREATE UNIQUEKEY uk(c_custkey) ON customer")), ("orders", _outcome(engine, "CREATE UNIQUEKEY uk(o_custkey) ON orders"))]
    tried.append(("again", _outcome(engine, "INSERT INTO customer (c_custkey, c_name) SELECT c_custkey, c_name FROM customer")))
    return _rows(engine, "change string, outcome string", tried)


def drop_index(spark, d):
    engine = _engine(spark, d, "customer")
    engine.execute("CREATE INDEX ix(c_nationkey) ON customer CREATE INDEX other(c_name, c_custkey) ON customer WITH (PARTITIONS = 9) DROP INDEX ix ON customer")
    return _rows(engine, "name string, fields string, isunique boolean, partitions int", [(i.name, ",".join(i.fields), i.unique, i.partitions) for i in engine.indexes("customer")])


def rebuild_index(spark, d):
    engine = _engine(spark, d, "customer")
    engine.create_index("customer", "uk", ["c_custkey"], unique=True)
    engine.execute("REBUILD UNIQUEKEY uk ON customer WITH (PARTITIONS = 12)")
    return _rows(engine, "name string, partitions int", [(i.name, i.partitions) for i in engine.indexes("customer")])


def transaction_commit(spark, d):
    return _engine(spark, d, "region").sql("BEGIN TRANSACTION DELETE FROM region WHERE r_regionkey > 2 BEGIN TRANSACTION DELETE FROM region WHERE r_regionkey > 1 COMMIT TRANSACTION COMMIT TRANSACTION SELECT r_name FROM region")


def transaction_two_sessions(spark, d):
    engine = _engine(spark, d, "region", "nation")
    other = engine.session("admin")
    seen = lambda who, e: [(who, table, e.scalar(f"SELECT Count(*) AS n FROM {table}")) for table in ("region", "nation")]
    engine.execute("BEGIN TRANSACTION DELETE FROM region WHERE r_regionkey > 1")
    out = seen("within", engine) + seen("beside", other)
    other.execute("DELETE FROM nation WHERE n_regionkey = 0")
    engine.execute("ROLLBACK TRANSACTION")
    return _rows(engine, "who string, tablename string, n bigint", out + seen("after", engine))


def transaction_conflict(spark, d):
    engine = _engine(spark, d, "region")
    other = engine.session("admin")
    engine.execute("BEGIN TRANSACTION DELETE FROM region WHERE r_regionkey = 1")
    locks = other.fetch("EXEC ShowLocks()")
    other.execute("DELETE FROM region WHERE r_regionkey = 2")
    outcome = _outcome(engine, "COMMIT TRANSACTION")
    return _rows(engine, "outcome string, locked string, n bigint", [(outcome, locks[0]["Object"], engine.scalar("SELECT Count(*) AS n FROM region"))])


def affected_rows(spark, d):
    engine = _engine(spark, d, "orders", "customer")
    text = "DELETE FROM orders WHERE o_orderstatus = 'F' UPDATE customer SET c_name = 'x' WHERE c_acctbal < 0 INSERT INTO customer (c_custkey, c_name) VALUES (-1, 'a'), (-2, 'b') SELECT c_custkey INTO Copy FROM customer WHERE c_custkey < 0"
    return _rows(engine, "statement int, affected bigint", [(i, r.affected) for i, r in enumerate(engine.execute(text))])


def settings_and_warnings(spark, d):
    engine = _engine(spark, d, "region")
    results = engine.execute("SET WarnMissingFields true SET WarnNullPropagation true SELECT r_name, nope, null + r_regionkey AS v FROM region")
    return _rows(engine, "warning string", [(w,) for w in results[-1].warnings])


def configuration(spark, d):
    engine = Engine(spark)
    engine.execute("ALTER CONFIGURATION WITH (DefaultDocumentPageSize = 30) CREATE SCHEMA Paged")
    tried = [("page size", str(engine.catalog.get("Paged").page_size)), ("unknown", _outcome(engine, "ALTER CONFIGURATION WITH (Nope = 1)")), ("no number", _outcome(engine, "CREATE SCHEMA Q WITH (PageSize = 'x')"))]
    return _rows(engine, "what string, outcome string", tried)


def policies(spark, d):
    engine = _engine(spark, d, "region", "nation")
    engine.execute("CREATE ACCOUNT ann WITH (Password = 'p') CREATE ROLE readers ALTER ROLE readers ADD ann")
    ann, out = engine.session("ann"), []
    for step, change in enumerate(("", "GRANT READ ON nation TO readers", "DENY READ ON nation TO readers", "REVOKE READ ON nation FROM readers", "GRANT READ ON : TO readers WITH (Recursive = true)", "ALTER ROLE readers REMOVE ann")):
        if change:
            engine.execute(change)
        out.append((step, _outcome(ann, "SELECT n_name FROM nation"), _outcome(ann, "DELETE FROM region")))
    return _rows(engine, "step int, reading string, changing string", out)


def roles(spark, d):
    engine = Engine(spark)
    engine.execute("CREATE ACCOUNT ann CREATE ROLE readers CREATE ROLE gone ALTER ROLE readers ADD ann ALTER ROLE gone ADD ann DROP ROLE gone")
    return engine.session("ann").sql("EXEC RefreshMyRoles()")


def schema_policy(spark, d):
    engine = _engine(spark, d, "nation")
    engine.execute("CREATE ROLE readers GRANT READ ON nation TO readers WITH (Recursive = true) CREATE ACCOUNT ann ALTER ROLE readers ADD ann")
    return engine.sql("EXEC ShowSchemaPolicy('nation')").unionAll(engine.session("ann").sql("EXEC ShowMySchemaPolicy('nation')"))


def show_version(spark, d):
    return Engine(spark).sql("EXEC ShowVersion()")


def show_sessions(spark, d):
    engine = _engine(spark, d, "region")
    other = engine.session("admin")
    other.execute("BEGIN TRANSACTION DELETE FROM region SELECT r_name FROM region")
    processes = engine.sql("EXEC ShowProcesses()").select("Account", "Statements", "InTransaction")
    transactions = engine.sql("EXEC ShowTransactions()").select("Depth", "Schemas")
    out = processes.crossJoin(transactions)  # a row a session each
    other.close()
    return out


def show_locks(spark, d):
    engine = _engine(spark, d, "region", "nation")
    engine.execute("BEGIN TRANSACTION DELETE FROM nation DROP SCHEMA region")
    out = engine.sql("EXEC ShowLocks()").select("Granularity", "Operation", "Object")
    waiting = [engine.sql(f"EXEC {name}()").count() for name in ("ShowBlocks", "ShowBlockTree", "ShowWaitingLocks")]
    return out.withColumn("Waiting", F.lit(sum(waiting)))


def health_counters(spark, d):
    engine = _engine(spark, d, "region")
    engine.execute("EXEC ClearHealthCounters() SELECT r_name FROM region SELECT r_name FROM region EXEC CheckpointHealthCounters() DELETE FROM region WHERE r_regionkey > 2")
    frame = engine.sql("EXEC ShowHealthCounters()")
    return frame.where("Counter IN ('statements: select', 'statements: delete', 'rows changed')")


def print_and_caches(spark, d):
    engine = Engine(spark)
    results = engine.execute("EXEC Print('hello') EXEC ClearCacheAllocations() EXEC ReleaseCacheAllocations() EXEC Sleep(1) EXEC Cancel(999999) EXEC Terminate(999999) KILL 999999")
    return _rows(engine, "statement int, messages string", [(i, ",".join(r.messages)) for i, r in enumerate(results)])


def memory_and_threads(spark, d):
    engine = Engine(spark)
    return engine.sql("EXEC ShowMemoryUtilization()").selectExpr("Component", "CAST(Bytes AS bigint) > 0 AS sensible").unionAll(engine.sql("EXEC ShowThreadPools()").selectExpr("Pool", "CAST(Threads AS bigint) > 0"))


def explain_operations(spark, d):
    engine = Engine(spark)
    lines = engine.explain_operations("SELECT c.c_name FROM customer AS c INNER JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5 AND (c.c_name LIKE 'x%' OR c.c_nationkey = 3)").split("\n")
    return _rows(engine, "line int, operation string", list(enumerate(lines)))


def explain_plan(spark, d):
    plan = _engine(spark, d, "orders").explain_plan("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'f'")
    return _rows(Engine(spark), "scan boolean, pushed boolean", [("Scan parquet" in plan, "In(o_orderstatus, [" in plan)])


def store_documents(spark, d):
    engine = Engine(spark)
    engine.store("T", [{"Id": 1, "Name": "a"}, {"Id": 2, "Extra": 1.5}])
    engine.store("T", {"id": 3, "name": "c"})
    return engine.sql("SELECT Id, Name, Extra FROM T")


def json_ingest(spark, d):
    folder = _own_folder(spark, "json")
    _engine(spark, d, "customer").catalog.frame("customer").write.json(folder)
    engine = Engine(spark)
    engine.import_json("Copy", folder)
    return engine.sql("SELECT c_custkey, c_name, c_mktsegment FROM Copy")


def tsv_and_csv(spark, d):
    """A table exported as CSV, written as TSV and imported again."""
    folder = _own_folder(spark, "csv")
    _engine(spark, d, "supplier").export_csv("SELECT s_suppkey, s_name FROM supplier", folder)
    spark.read.option("header", True).csv(folder).write.option("header", True).option("sep", "\t").csv(folder + "-tsv")
    engine = Engine(spark)
    engine.import_tsv("Copy", folder + "-tsv")
    return engine.sql("SELECT ToNumeric(s_suppkey) AS suppkey, s_name FROM Copy")


@dataclass
class Region:
    r_regionkey: int
    R_Name: str


def typed_results(spark, d):
    engine = _engine(spark, d, "region")
    found = engine.fetch("SELECT * FROM region WHERE r_regionkey < @most", {"most": 3}, Region)
    single = engine.single("SELECT r_name FROM region WHERE r_regionkey = 4")
    return _rows(engine, "r_regionkey int, r_name string", [(int(r.r_regionkey), r.R_Name) for r in found] + [(4, single["r_name"])])


def field_sample(spark, d):
    engine = _engine(spark, d, "region")
    return _rows(engine, "field string", [(f,) for f in engine.field_sample("region")])


# Names of the dialect's functions.
SCALARS = (
    "LastIndexOf Length Concat FormatNumeric IndexOf Left Right SubString ToLower ToProper ToString ToUpper Trim Abs Ceil Floor Pow Round ToNumeric DateAdd DateDiff DateTime DateTimeUTC FormatDateTime IfNullNumeric NullIfNumeric "
    "Coalesce IfNull IIF NullIf IsBetween IsDouble IsEqual IsGreater IsGreaterOrEqual IsInteger IsLess IsLessOrEqual IsLike IsNotBetween IsNotEqual IsNotLike IsNull IsString Checksum Sha1 Sha256 Sha512 DocumentID DocumentPage DocumentUID Guid"
).split()
AGGREGATES = "Avg Count CountDistinct GeometricMean Max Mean Median Min Mode Sum Variance MinString MaxString Sha1Agg Sha256Agg Sha512Agg".split()
SYSTEMS = (
    "Cancel CheckpointHealthCounters ClearCacheAllocations ClearHealthCounters Print RefreshMyRoles ReleaseCacheAllocations ShowAggregateFunctions ShowBlocks ShowBlockTree ShowHealthCounters ShowLocks "
    "ShowMemoryUtilization ShowMySchemaPolicy ShowProcesses ShowScalarFunctions ShowSchemaPolicy ShowSystemFunctions ShowThreadPools ShowTransactions ShowVersion ShowWaitingLocks Sleep Terminate"
).split()


def scalar_functions(spark, d):
    return Engine(spark).sql("EXEC ShowScalarFunctions()").select("Name")


def aggregate_functions(spark, d):
    return Engine(spark).sql("EXEC ShowAggregateFunctions()").select("Name")


def system_functions(spark, d):
    return Engine(spark).sql("EXEC ShowSystemFunctions()").select("Name")


def _values(columns: str, *rows: tuple) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({columns})"


_LENGTHS = "(SELECT length(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey})::VARCHAR)::INTEGER AS n, row_number() OVER () - 1 AS place FROM nation)"
_SCHEMA = "SELECT count(*) AS documents, ceil(count(*) / 4)::BIGINT AS pages, 4 AS page_size, min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length FROM " + _LENGTHS

#: query -> SQL
CHECKED: dict[Callable, str] = {
    create_schema: _values('"Name", "Path"', ("B", "A:B"), ("D", "A:D")),
    drop_schema: _values('"Name", "Path"', ("D", "A:D")),
    alter_schema: _SCHEMA,
    analyze_pages: 'SELECT 0 AS partition, place // 10 AS page, count(*) AS documents, min(n) AS min_length, max(n) AS max_length, avg(n) AS avg_length FROM ' + _LENGTHS + " GROUP BY place // 10",
    list_schemas_api: _values("path, there", ("X", True), ("X:Y", False), ("X:Z", True)),
    create_uniquekey: _values("change, outcome", ("customer", "done"), ("orders", "refused"), ("again", "refused")),
    drop_index: _values("name, fields, isunique, partitions", ("other", "c_name,c_custkey", False, 9)),
    rebuild_index: _values("name, partitions", ("uk", 12)),
    transaction_commit: "SELECT r_name FROM region WHERE r_regionkey <= 1",
    transaction_two_sessions: "SELECT 'within' AS who, 'region' AS tablename, count(*) AS n FROM region WHERE r_regionkey <= 1 UNION ALL SELECT 'within', 'nation', count(*) FROM nation UNION ALL SELECT 'beside', 'region', count(*) FROM region UNION ALL SELECT 'beside', 'nation', count(*) FROM nation"
    " UNION ALL SELECT 'after', 'region', count(*) FROM region UNION ALL SELECT 'after', 'nation', count(*) FROM nation WHERE n_regionkey <> 0",
    transaction_conflict: "SELECT 'refused' AS outcome, 'region' AS locked, count(*) AS n FROM region WHERE r_regionkey <> 2",
    affected_rows: "SELECT 0 AS statement, count(*) AS affected FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, 2 UNION ALL SELECT 3, 2",
    settings_and_warnings: "SELECT 'field ''nope'' was not found' AS warning UNION ALL SELECT '''v'' is null in ' || count(*) || ' rows, as an operand is' FROM region",
    configuration: _values("what, outcome", ("page size", "30"), ("unknown", "refused"), ("no number", "refused")),
    policies: _values("step, reading, changing", *((i, "done" if i in (1, 4) else "refused", "refused") for i in range(6))),
    roles: _values('"Role"', ("default",), ("readers",)),
    schema_policy: _values('"Role", "Schema", "Permission", "Rule", "Recursive"', *[("readers", "nation", "read", "grant", "True")] * 2),
    show_version: _values('"Component", "Version"', ("papyrion", __version__)),
    show_sessions: _values('"Account", "Statements", "InTransaction", "Depth", "Schemas"', ("admin", "1", "False", "1", "1"), ("admin", "3", "True", "1", "1")),
    show_locks: _values('"Granularity", "Operation", "Object", "Waiting"', ("Schema", "Write", "nation", 0), ("Schema", "Delete", "region", 0)),
    health_counters: "SELECT 'statements: select' AS \"Counter\", '2' AS \"Value\", '0' AS \"SinceCheckpoint\" UNION ALL SELECT 'statements: delete', '1', '1' UNION ALL SELECT 'rows changed', count(*)::VARCHAR, count(*)::VARCHAR FROM region WHERE r_regionkey > 2",
    print_and_caches: _values("statement, messages", *((i, "hello" if i == 0 else "") for i in range(7))),
    memory_and_threads: _values('"Component", sensible', *((c, True) for c in ("driver Python", "driver JVM in use", "driver JVM at most", "executor cores", "driver threads"))),
    explain_operations: _values("line, operation", *enumerate(("inner join orders as o", "  o.o_custkey = c.c_custkey", "where", "  AND", "    c.c_acctbal > 5", "    OR", '      c.c_name like "x%"', "      c.c_nationkey = 3"))),
    explain_plan: _values("scan, pushed", (True, True)),
    store_documents: "SELECT 1 AS \"Id\", 'a' AS \"Name\", NULL::DOUBLE AS \"Extra\" UNION ALL SELECT 2, NULL, 1.5 UNION ALL SELECT 3, 'c', NULL",
    json_ingest: "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    tsv_and_csv: "SELECT s_suppkey::DOUBLE AS suppkey, s_name FROM supplier",
    typed_results: "SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3 OR r_regionkey = 4",
    field_sample: _values("field", ("r_regionkey",), ("r_name",)),
    scalar_functions: _values('"Name"', *((n,) for n in SCALARS)),
    aggregate_functions: _values('"Name"', *((n,) for n in AGGREGATES)),
    system_functions: _values('"Name"', *((n,) for n in SYSTEMS)),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in CHECKED}
SQL: dict[str, str] = {f.__name__: sql for f, sql in CHECKED.items()}
