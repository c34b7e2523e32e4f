"""The engine: a session that runs batches of statements over a catalog."""

from __future__ import annotations

import itertools
import json
import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.dialect.lexer import DialectError
from papyrion.dialect.nodes import Call, Chain, Compare, Delete, Group, Insert, Logic, Number, Select, Statement, Unary, Update
from papyrion.dialect.parser import parse
from papyrion.functions import system
from papyrion.functions.values import literal
from papyrion.plans import changes
from papyrion.plans.expressions import Lowering
from papyrion.plans.scope import Scope
from papyrion.plans.select import Output, build
from papyrion.policy import ADMINISTRATORS, Policies
from papyrion.sources.catalog import Catalog, Index, normal
from papyrion.stable import settle

_PROCESSES = itertools.count(1)
#: Changes of a table after which its lineage is cut.
CHANGES_KEPT = 8
SETTINGS = ("tracewaittimes", "warnmissingfields", "warnnullpropagation", "readuncommitted")
#: Options of WITH by statement, and their types.
OPTIONS = {
    "create schema": {"pagesize": int}, "alter schema": {"pagesize": int}, "create index": {"partitions": int}, "create uniquekey": {"partitions": int}, "rebuild index": {"partitions": int}, "rebuild uniquekey": {"partitions": int},
    "analyze schema": {"includephysicalpages": bool}, "create account": {"password": str}, "grant": {"recursive": bool}, "deny": {"recursive": bool},
}
#: What ALTER CONFIGURATION takes: fields a page of new schemas, tasks after a shuffle, whether statements are counted.
CONFIGURATION = {"defaultdocumentpagesize": int, "shufflepartitions": int, "healthmonitoringenabled": bool}


@dataclass
class QueryResult:
    """What a statement gives: rows as a lazy DataFrame, or a number of affected rows, and messages."""

    frame: DataFrame | None = None
    fields: list[str] = field(default_factory=list)
    affected: int | None = None
    messages: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []


def _is_volatile(node) -> bool:
    """Whether an expression may differ from run to run."""
    if isinstance(node, Call):
        return node.name in ("guid", "datetime", "datetimeutc") or any(map(_is_volatile, node.args))
    if isinstance(node, Chain):
        return any(map(_is_volatile, node.operands))
    if isinstance(node, Group):
        return _is_volatile(node.inner)
    if isinstance(node, Unary):
        return _is_volatile(node.operand)
    if isinstance(node, Compare):
        return _is_volatile(node.left) or _is_volatile(node.right) or _is_volatile(node.upper)
    if isinstance(node, Logic):
        return any(map(_is_volatile, node.parts))
    return False


class Engine:
    """One session. `document` treats all text as that of schemaless documents and gives results as text.

    `storage` is a folder (shared, on a cluster) to which changed tables are written as Parquet;
    without it they stay plans over their sources, cut by checkpoints every few changes. In SELECTs'
    joins a null key matches null keys, as `=` does elsewhere; `null_keys=False` turns that off for joins
    of large tables with many null keys, and lets Spark join on the bare columns.
    """

    def __init__(self, spark: SparkSession, document: bool = False, storage: str | None = None, account: str = "admin", catalog: Catalog | None = None, policies: Policies | None = None, sticky_sort: bool = False, null_keys: bool = True) -> None:
        self.spark, self.document, self.storage, self.account, self.sticky_sort = spark, document, storage, account, sticky_sort
        self.null_keys = null_keys
        self.catalog = (catalog or Catalog(spark)).view()
        self.policies = policies or Policies()
        self.variables: dict[str, object] = {}
        self.settings: dict[str, object] = {}
        self.configuration: dict[str, object] = {}
        self.counters: Counter = Counter()
        self.messages: list[str] = []
        self.process = next(_PROCESSES)
        self.closed = False
        self.catalog.sessions[self.process] = self

    # -- API: tables

    def register(self, path: str, frame: DataFrame) -> None:
        self.catalog.put(path, frame)

    def register_folder(self, folder: str, names: list[str], parent: str = "") -> None:
        """Parquet tables of a folder as schemas."""
        for name in names:
            self.register(f"{parent}:{name}".strip(":"), self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def store(self, path: str, documents: list[dict] | dict) -> int:
        """Adds documents, whose fields may differ; returns their number. A missing schema is created."""
        documents = [documents] if isinstance(documents, dict) else documents
        self._permit("write", path)
        names = list({k.lower(): k for d in documents for k in d}.values())
        rows = [tuple({k.lower(): v for k, v in d.items()}.get(n.lower()) for n in names) for d in documents]
        if self.document:
            rows = [tuple(None if v is None else str(v) for v in r) for r in rows]
        types = [T.StructField(n, T.StringType()) if self.document or all(r[i] is None for r in rows) else None for i, n in enumerate(names)]
        frame = self.spark.createDataFrame(rows, T.StructType(types)) if all(types) else self.spark.createDataFrame([dict(zip(names, r)) for r in rows]).select(*(f"`{n}`" for n in names))
        self.catalog.create(path)
        self._store(path, changes.appended(self.catalog.frame(path), frame))
        return len(documents)

    def sample(self, path: str, size: int = 100) -> DataFrame:
        """`size` rows drawn at random, each draw from all rows, so that a row may come twice. The table is counted first."""
        self._permit("read", path)
        frame = self.catalog.frame(path)
        n = frame.count()
        if not n or not size:
            return frame.limit(0)
        return frame.sample(True, (size + 6 * size**0.5 + 12) / n).orderBy(F.rand()).limit(size)

    def list(self, path: str, size: int = 100) -> DataFrame:
        self._permit("read", path)
        return self.catalog.frame(path).limit(size)

    def field_sample(self, path: str) -> list[str]:
        return self.catalog.frame(path).columns

    def import_tsv(self, path: str, file: str) -> None:
        """A tab-separated file with a header row, all fields as text."""
        self.register(path, self.spark.read.option("sep", "\t").option("header", True).csv(file))

    def import_jdbc(self, path: str, url: str, table: str, **options) -> None:
        self.register(path, self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())

    def import_json(self, path: str, source: str) -> None:
        """Documents, one JSON object a line; fields keep their JSON types, or all become text in document mode."""
        frame = self.spark.read.option("primitivesAsString", self.document).json(source)
        self.register(path, frame)

    def export_csv(self, query: str, folder: str) -> None:
        output = self.sql(query)
        names = [n if output.columns.count(n) == 1 else f"{n}_{i}" for i, n in enumerate(output.columns)]
        output.toDF(*names).write.mode("overwrite").option("header", True).csv(folder)

    # -- API: schemas and indexes

    def create_schema(self, path: str, page_size: int | None = None) -> None:
        """Creates a schema with its parents."""
        self._permit("manage", path)
        self.catalog.create(path, page_size)

    def schema_exists(self, path: str) -> bool:
        return self.catalog.exists(path)

    def drop_schema(self, path: str, if_exists: bool = True) -> None:
        self._permit("manage", path)
        if not if_exists:
            self.catalog.get(path)
        self.catalog.drop(path)

    def schemas(self, path: str = ":") -> list[str]:
        """Paths of the schemas right below one."""
        return [s.path for s in self.catalog.children(path)]

    def create_index(self, path: str, name: str, fields: list[str], unique: bool = False, partitions: int = 100) -> None:
        self._do_create_index(Statement("create index", name, path, list(fields), {"partitions": Number(float(partitions), str(partitions))}), unique)

    def index(self, path: str, name: str) -> Index | None:
        return self.catalog.get(path).indexes.get(name.lower())

    def indexes(self, path: str) -> list[Index]:
        return list(self.catalog.get(path).indexes.values())

    def drop_index(self, path: str, name: str) -> None:
        self._do_drop_index(Statement("drop index", name, path))

    def rebuild_index(self, path: str, name: str, partitions: int | None = None) -> None:
        options = {"partitions": Number(float(partitions), str(partitions))} if partitions else {}
        self._do_rebuild_index(Statement("rebuild index", name, path, options=options))

    # -- API: queries

    def execute(self, text: str, parameters: dict | None = None) -> list[QueryResult]:
        """Runs a batch; one result per statement."""
        self.variables |= {k.lstrip("@").lower(): v for k, v in (parameters or {}).items()}
        return [self._run(s) for s in parse(text)]

    def sql(self, text: str, parameters: dict | None = None) -> DataFrame:
        """The rows of the batch's last statement that gives rows."""
        frames = [r.frame for r in self.execute(text, parameters) if r.frame is not None]
        if not frames:
            raise DialectError("the batch gives no rows")
        return frames[-1]

    def fetch(self, text: str, parameters: dict | None = None, into: type | None = None) -> list:
        """Rows as dictionaries, or as objects of a class that takes the fields by name, case ignored."""
        frame = self._own(self.sql(text, parameters))
        rows = [dict(zip(frame.columns, r)) for r in frame.collect()]
        if into is None:
            return rows
        known = {n.lower(): n for n in getattr(into, "__annotations__", {})}
        return [into(**{known[k.lower()]: v for k, v in r.items() if k.lower() in known}) for r in rows]

    def first(self, text: str, parameters: dict | None = None) -> dict | None:
        frame = self._own(self.sql(text, parameters))
        row = frame.first()
        return None if row is None else dict(zip(frame.columns, row))

    def single(self, text: str, parameters: dict | None = None) -> dict:
        """The only row; none or several raise."""
        frame = self._own(self.sql(text, parameters))
        rows = frame.take(2)
        if len(rows) != 1:
            raise DialectError(f"expected one row, found {'none' if not rows else 'several'}")
        return dict(zip(frame.columns, rows[0]))

    def scalar(self, text: str, parameters: dict | None = None):
        """The first field of the first row, None without rows."""
        row = self._own(self.sql(text, parameters)).first()
        return None if row is None else row[0]

    def execute_non_query(self, text: str, parameters: dict | None = None) -> int:
        return sum(r.affected or 0 for r in self.execute(text, parameters))

    def explain_plan(self, text: str, parameters: dict | None = None) -> str:
        """Spark's formatted plan of a SELECT."""
        frame = self.sql(text, parameters)
        return frame._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def explain_operations(self, text: str) -> str:
        """The conditions of a batch's statements as a tree."""
        out = []

        def walk(node, depth: int) -> None:
            if isinstance(node, Logic):
                out.append("  " * depth + node.operator.upper())
                for part in node.parts:
                    walk(part, depth + 1)
            elif isinstance(node, Compare):
                out.append("  " * depth + f"{_written(node.left)} {node.operator} {_written(node.right)}" + (f" and {_written(node.upper)}" if node.upper is not None else ""))

        for statement in parse(text):
            for source in getattr(statement, "sources", []):
                if source.on is not None:
                    out.append(f"{source.join} join {source.path} as {source.alias}")
                    walk(source.on, 1)
            if getattr(statement, "where", None) is not None:
                out.append("where")
                walk(statement.where, 1)
        return "\n".join(out)

    def begin(self) -> None:
        """Opens a transaction, or one inside it. Until the outermost ends, other sessions do not see its changes, and it sees theirs."""
        self.catalog.schemas.depth += 1

    def commit(self) -> None:
        """Ends a transaction; with the outermost its changes count. If another session changed one of the same schemas meanwhile, none does and an error is raised."""
        schemas = self.catalog.schemas
        if not schemas.depth:
            raise DialectError("no transaction is open")
        if schemas.depth > 1:
            schemas.depth -= 1
            return
        schemas.end(True)
        self.catalog.drop(f"Temporary_{self.process}")

    def rollback(self) -> None:
        """Forgets what this session changed since the outermost BEGIN; what others changed stays."""
        if not self.catalog.schemas.depth:
            raise DialectError("no transaction is open")
        self.catalog.schemas.end(False)

    def close(self) -> None:
        """Ends the session: an open transaction is rolled back and temporary schemas go."""
        self.catalog.schemas.end(False)
        self.catalog.drop(f"Temporary_{self.process}")
        self.catalog.sessions.pop(self.process, None)
        self.closed = True

    def cancel(self, process) -> None:
        """Stops the running jobs of a session's statements; the session goes on."""
        self.spark.sparkContext.cancelJobGroup(_job_group(process))

    def terminate(self, process) -> None:
        """Stops a session's jobs and ends it."""
        self.cancel(process)
        if (other := self.catalog.sessions.get(int(float(process)))) is not None:
            other.close()

    def _own(self, frame: DataFrame) -> DataFrame:
        """The frame, with jobs of this thread counted as this session's from now on."""
        self.spark.sparkContext.setJobGroup(_job_group(self.process), f"session {self.process} of {self.account}", interruptOnCancel=True)
        return frame

    @property
    def is_administrator(self) -> bool:
        return self.account.lower() in self.policies.roles[ADMINISTRATORS]

    # -- statements

    def _permit(self, permission: str, *paths: str) -> None:
        for path in paths:
            if not self.policies.allows(self.account, permission, path):
                raise DialectError(f"{self.account} may not {permission} {path!r}")

    def _administrate(self) -> None:
        if not self.is_administrator:
            raise DialectError(f"{self.account} is no administrator")

    def _real(self, path: str) -> str:
        """A temporary schema's path (#name) is this session's own."""
        return f"Temporary_{self.process}:{path[1:]}" if path.startswith("#") else path

    def _run(self, statement) -> QueryResult:
        if self.closed:
            raise DialectError("the session has ended")
        started = time.monotonic()
        kind = statement.verb if isinstance(statement, Statement) else type(statement).__name__.lower()
        if self.configuration.get("healthmonitoringenabled", True):
            self.counters.update(("statements", f"statements: {kind}"))
        self.messages = []
        self._own(None)
        if isinstance(statement, Statement):
            result = self._other(statement)
        else:
            for source in statement.sources if not isinstance(statement, Insert) else statement.select.sources if statement.select else []:
                source.path = self._real(source.path)
            result = {Select: self._select, Insert: self._insert, Update: self._update, Delete: self._delete}[type(statement)](statement)
        result.messages += self.messages
        result.seconds = time.monotonic() - started
        if self.configuration.get("healthmonitoringenabled", True):
            self.counters[f"milliseconds: {kind}"] += round(1000 * result.seconds)
            self.counters["rows changed"] += result.affected or 0
        if self.settings.get("tracewaittimes"):
            result.messages.append(f"{kind}: {1000 * result.seconds:.0f} ms until its rows can be asked for")
        return result

    def _select(self, select: Select) -> QueryResult:
        self._permit("read", *(s.path for s in select.sources))
        output = build(self.catalog, select, self.variables, self.document, self.sticky_sort, self.null_keys)
        if select.into is None:
            return QueryResult(output.frame, output.names, warnings=self._warnings(output) + self._null_warnings(select, output))
        path = self._real(select.into)
        self._permit("write", path)
        if len({n.lower() for n in output.names}) < len(output.names):
            raise DialectError("a field is selected twice into a schema")
        self.catalog.create(path)
        rows = self._written(path, output.frame)
        self._store(path, changes.appended(self.catalog.frame(path), rows))
        return QueryResult(affected=rows.count(), warnings=self._warnings(output))

    def _written(self, path: str, rows: DataFrame) -> DataFrame:
        """Rows computed once: to the storage folder, or to a checkpoint. Counting them is then cheap."""
        if not self.storage:
            return settle(rows)
        nulls = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NullType)]
        rows = rows.withColumns({n: F.col(f"`{n}`").cast("string") for n in nulls}) if nulls else rows
        folder = f"{self.storage}/{normal(path).replace(':', '/')}/__rows_{time.time_ns()}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _warnings(self, output: Output) -> list[str]:
        return [f"field {m!r} was not found" for m in output.missing] if self.settings.get("warnmissingfields") else []

    def _null_warnings(self, select: Select, output: Output) -> list[str]:
        """Which computed fields are null in how many rows, if the session asks for it; this runs the query once."""
        computed = [i for i, f in enumerate(select.fields) if isinstance(getattr(f, "value", None), (Chain, Unary))]
        if not self.settings.get("warnnullpropagation") or not computed or len(output.names) != len(select.fields):
            return []
        frame = output.frame.toDF(*(f"c{i}" for i in range(len(output.names))))
        counts = frame.agg(*(F.count(F.when(F.col(f"c{i}").isNull(), 1)).alias(f"c{i}") for i in computed)).first()
        return [f"{output.names[i]!r} is null in {counts[f'c{i}']} rows, as an operand is" for i in computed if counts[f"c{i}"]]

    def _insert(self, insert: Insert) -> QueryResult:
        path = self._real(insert.path)
        self._permit("write", path)
        if insert.select is not None:
            self._permit("read", *(s.path for s in insert.select.sources))
        rows = changes.inserted(self.catalog, insert, self.variables, self.document)
        volatile = any(_is_volatile(v) for row in insert.rows or [] for _, v in row) or insert.select is not None
        rows = self._written(path, rows) if volatile else rows
        self.catalog.create(path)
        self._store(path, changes.appended(self.catalog.frame(path), rows))
        return QueryResult(affected=len(insert.rows) if insert.rows is not None else rows.count())

    def _update(self, update: Update) -> QueryResult:
        update.target = self._real(update.target)
        path, frame, hit = changes.updated(self.catalog, update, self.variables, self.document)
        self._permit("write", path)
        affected = hit.count()
        self._store(path, frame, any(_is_volatile(v) for _, v in update.assignments))
        return QueryResult(affected=affected)

    def _delete(self, delete: Delete) -> QueryResult:
        delete.target = self._real(delete.target)
        path, frame, hit = changes.deleted(self.catalog, delete, self.variables, self.document)
        self._permit("write", path)
        affected = hit.count()
        self._store(path, frame)
        return QueryResult(affected=affected)

    def _store(self, path: str, frame: DataFrame, settled: bool = False) -> None:
        """Makes `frame` the table, if no unique key is violated."""
        schema = self.catalog.get(path)
        number = schema.changes + 1
        if self.storage:
            folder = f"{self.storage}/{normal(path).replace(':', '/')}/__version_{number}_{time.time_ns()}"
            frame.write.parquet(folder)
            frame = self.spark.read.schema(frame.schema).parquet(folder)
        elif settled or number % CHANGES_KEPT == 0:
            frame = settle(frame)
        for index in schema.indexes.values():
            if index.unique:
                self._assert_unique(frame, index, path)
        self.catalog.update(path, frame=frame, changes=number)

    def _assert_unique(self, frame: DataFrame, index: Index, path: str) -> None:
        if not changes.duplicates(frame, index).isEmpty():
            raise DialectError(f"duplicate key in {index.name} on {path}")

    def _other(self, s: Statement) -> QueryResult:
        run = getattr(self, "_do_" + s.verb.replace(" ", "_"), None)
        if run is None:
            raise DialectError(f"{s.verb.upper()} is not supported")
        s.path = self._real(s.path)
        known = CONFIGURATION if s.verb == "alter configuration" else OPTIONS.get(s.verb, {})
        for name, node in s.options.items():
            if name not in known:
                raise DialectError(f"{s.verb.upper()} has no option {name!r}")
            s.options[name] = self._option(name, node, known[name])
        return run(s) or QueryResult(affected=0)

    def _constant(self, node):
        """The value of an expression without fields."""
        value = Lowering(Scope(self.document, self.variables)).value(node)
        if value.literal is not None or value.kind == "null":
            return value.literal
        return self.spark.range(1).select(value.column).first()[0]

    def _option(self, name: str, node, kind: type):
        """An option's node, with a constant of its type in it; what does not read as one is an error."""
        value = self._constant(node)
        if kind is int:
            try:
                number = float(value)
            except (TypeError, ValueError):
                number = 0.5
            if not number.is_integer() or number < 1:
                raise DialectError(f"{name!r} takes a whole number above 0, not {value!r}")
            return Number(number, str(int(number)))
        if kind is bool:
            if str(value).lower() not in ("0", "1", "0.0", "1.0", "true", "false"):
                raise DialectError(f"{name!r} takes true or false, not {value!r}")
            return Number(float(str(value).lower() in ("1", "1.0", "true")), str(value))
        return node

    def _rows(self, fields: list[str], rows: list[tuple]) -> QueryResult:
        if not fields:
            return QueryResult(affected=0)
        return QueryResult(self.spark.createDataFrame(rows, T.StructType([T.StructField(f, T.StringType()) for f in fields])), fields)

    def _size(self, s: Statement) -> int:
        return max(0, int(float(self._constant(s.values[0])))) if s.values else 100

    def _do_create_schema(self, s):
        self._permit("manage", s.path)
        size = s.options.get("pagesize")
        self.catalog.create(s.path, int(self._constant(size)) if size is not None else None)

    def _do_drop_schema(self, s):
        self._permit("manage", s.path)
        self.catalog.drop(s.path)

    def _do_alter_schema(self, s):
        self._permit("manage", s.path)
        if "pagesize" in s.options:
            self.catalog.update(s.path, page_size=int(self._constant(s.options["pagesize"])))

    def _do_create_index(self, s, unique: bool = False):
        self._permit("manage", s.path)
        schema = self.catalog.get(s.path)
        if s.name.lower() in schema.indexes:
            raise DialectError(f"{s.name!r} exists on {s.path!r}")
        partitions = s.options.get("partitions")
        index = Index(s.name, tuple(s.names), unique, int(self._constant(partitions)) if partitions is not None else 100)
        if unique and schema.frame is not None:
            self._assert_unique(schema.frame, index, s.path)
        self.catalog.update(s.path, indexes=schema.indexes | {s.name.lower(): index})

    def _do_create_uniquekey(self, s):
        self._do_create_index(s, unique=True)

    def _index(self, s) -> Index:
        try:
            return self.catalog.get(s.path).indexes[s.name.lower()]
        except KeyError:
            raise DialectError(f"no index {s.name!r} on {s.path!r}") from None

    def _do_drop_index(self, s):
        self._permit("manage", s.path)
        self._index(s)
        self.catalog.update(s.path, indexes={k: i for k, i in self.catalog.get(s.path).indexes.items() if k != s.name.lower()})

    _do_drop_uniquekey = _do_drop_index

    def _do_rebuild_index(self, s):
        self._permit("manage", s.path)
        old = self._index(s)
        partitions = int(self._constant(s.options["partitions"])) if "partitions" in s.options else old.partitions
        if old.unique:
            self._assert_unique(self.catalog.frame(s.path), old, s.path)
        self.catalog.update(s.path, indexes=self.catalog.get(s.path).indexes | {s.name.lower(): Index(old.name, old.fields, old.unique, partitions)})

    _do_rebuild_uniquekey = _do_rebuild_index

    def _do_analyze_index(self, s):
        self._permit("read", s.path)
        from papyrion.operators.maintenance import analyze_index

        frame = analyze_index(self.catalog.frame(s.path), list(self._index(s).fields))
        return QueryResult(frame, frame.columns)

    def _do_analyze_schema(self, s):
        self._permit("read", s.path)
        from papyrion.operators.maintenance import analyze_pages, analyze_schema

        pages = s.options.get("includephysicalpages")
        frame = (analyze_pages if pages is not None and pages.value else analyze_schema)(self.catalog.frame(s.path), self.catalog.get(s.path).page_size)
        return QueryResult(frame, frame.columns)

    def _do_list_documents(self, s):
        frame = self.list(s.path, self._size(s))
        return QueryResult(frame, frame.columns)

    def _do_sample(self, s):
        frame = self.sample(s.path, self._size(s))
        return QueryResult(frame, frame.columns)

    def _do_list_schemas(self, s):
        return self._rows(["Name", "Path"], [(c.path.rpartition(":")[2], c.path) for c in self.catalog.children(s.path)][: self._size(s)])

    def _do_begin_transaction(self, s):
        self.begin()

    def _do_commit_transaction(self, s):
        self.commit()

    def _do_rollback_transaction(self, s):
        self.rollback()

    def _do_declare(self, s):
        value = self._constant(s.values[0])
        if isinstance(value, str):
            try:
                value = float(value)
            except ValueError:
                pass
        self.variables[s.name] = literal(value).literal

    def _do_set(self, s):
        if s.name not in SETTINGS:
            raise DialectError(f"no setting {s.name!r}")
        node = s.values[0]
        value = self._constant(node) if not hasattr(node, "alias") else node.name
        self.settings[s.name] = str(value).lower() in ("1", "true", "on")
        self.catalog.schemas.dirty = bool(self.settings.get("readuncommitted"))

    def _do_alter_configuration(self, s):
        self._administrate()
        for name, node in s.options.items():
            value = bool(node.value) if CONFIGURATION[name] is bool else int(node.value)
            self.configuration[name] = value
            if name == "defaultdocumentpagesize":
                self.catalog.page_size = value
            elif name == "shufflepartitions":
                self.spark.conf.set("spark.sql.shuffle.partitions", value)

    def _do_exec(self, s):
        fields, rows = system.run(self, s.name, [self._constant(a) for a in s.values])
        return self._rows(fields, rows)

    def _do_kill(self, s):
        self._administrate()
        self.terminate(self._constant(s.values[0]))

    def _do_create_account(self, s):
        self._administrate()
        password = s.options.get("password")
        self.policies.create_account(s.name, str(self._constant(password) or "") if password is not None else "")

    def _do_drop_account(self, s):
        self._administrate()
        self.policies.drop_account(s.name)

    def _do_create_role(self, s):
        self._administrate()
        self.policies.create_role(s.name)

    def _do_drop_role(self, s):
        self._administrate()
        self.policies.drop_role(s.name)

    def _do_alter_role_add(self, s):
        self._administrate()
        self.policies.member(s.name, s.names[0], True)

    def _do_alter_role_remove(self, s):
        self._administrate()
        self.policies.member(s.name, s.names[0], False)

    def _rule(self, s, allowed: bool):
        self._administrate()
        recursive = s.options.get("recursive")
        self.policies.rule(s.name, s.path, s.names[0], allowed, recursive is None or str(self._constant(recursive)).lower() in ("1", "true"))

    def _do_grant(self, s):
        self._rule(s, True)

    def _do_deny(self, s):
        self._rule(s, False)

    def _do_revoke(self, s):
        self._administrate()
        self.policies.revoke(s.name, s.path, s.names[0])

    def session(self, account: str) -> Engine:
        """Another session over the same schemas, with variables, settings and transactions of its own."""
        return Engine(self.spark, self.document, self.storage, account, self.catalog, self.policies, self.sticky_sort, self.null_keys)


def _job_group(process) -> str:
    return f"papyrion session {int(float(process))}"


def _written(node) -> str:
    """An expression as text."""
    if isinstance(node, Chain):
        return _written(node.operands[0]) + "".join(f" {o} {_written(x)}" for o, x in zip(node.operators, node.operands[1:]))
    if isinstance(node, Call):
        return f"{node.name}({', '.join(map(_written, node.args))})"
    if isinstance(node, Group):
        return f"({_written(node.inner)})"
    if isinstance(node, Unary):
        return node.operator + _written(node.operand)
    if hasattr(node, "alias"):
        return f"{node.alias}.{node.name}" if node.alias else node.name
    if hasattr(node, "text"):
        return node.text
    return json.dumps(node.value) if hasattr(node, "value") else f"@{node.name}" if type(node).__name__ == "Variable" else node.name
