"""Hierarchical schemas, their tables as immutable snapshots, and metadata on them."""

from __future__ import annotations

import weakref
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papyrion.dialect.lexer import DialectError

DEFAULT_PAGE_SIZE = 100


@dataclass(frozen=True)
class Index:
    """Named fields of a table. It steers no plan (Parquet statistics do that) but may state uniqueness."""

    name: str
    fields: tuple[str, ...]
    unique: bool = False
    partitions: int = 100


@dataclass(frozen=True)
class Schema:
    """A node of the tree: perhaps a table, perhaps the parent of others."""

    path: str
    frame: DataFrame | None = None
    page_size: int = DEFAULT_PAGE_SIZE
    indexes: dict[str, Index] = field(default_factory=dict)
    changes: int = 0


def normal(path: str) -> str:
    return path.strip().strip(":").lower()


class Overlay(MutableMapping):
    """One session's view of the shared schemas: outside a transaction a window, inside one its changes stay here.

    `local` holds what the open transaction wrote (None for what it dropped), `seen` what was there before. A
    commit succeeds if all that is still there; else another session came first. With `dirty` on,
    reading also sees what other sessions have not committed yet.
    """

    def __init__(self, shared: dict[str, Schema], others: weakref.WeakSet) -> None:
        self.shared, self.others = shared, others
        self.depth, self.dirty = 0, False
        self.local: dict[str, Schema | None] = {}
        self.seen: dict[str, Schema | None] = {}
        others.add(self)

    __hash__ = object.__hash__

    def _found(self, key: str) -> Schema | None:
        if key in self.local:
            return self.local[key]
        if self.dirty:
            for other in self.others:
                if key in other.local:
                    return other.local[key]
        return self.shared.get(key)

    def __getitem__(self, key: str) -> Schema:
        found = self._found(key)
        if found is None:
            raise KeyError(key)
        return found

    def _put(self, key: str, schema: Schema | None) -> None:
        if self.depth:
            if key not in self.local:
                self.seen[key] = self.shared.get(key)
            self.local[key] = schema
        elif schema is None:
            self.shared.pop(key, None)
        else:
            self.shared[key] = schema

    def __setitem__(self, key: str, schema: Schema) -> None:
        self._put(key, schema)

    def __delitem__(self, key: str) -> None:
        self._put(key, None)

    def __iter__(self) -> Iterator[str]:
        keys = {**self.shared, **self.local, **({k: v for o in self.others for k, v in o.local.items()} if self.dirty else {})}
        return (k for k in keys if self._found(k) is not None)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def end(self, keep: bool) -> None:
        """Ends the transaction; with `keep` its changes become everybody's, or none does."""
        local, seen = self.local, self.seen
        self.depth, self.local, self.seen = 0, {}, {}
        if not keep:
            return
        if late := sorted(k for k, v in seen.items() if self.shared.get(k) is not v):
            raise DialectError(f"another session has changed {', '.join(map(repr, late))}; the transaction is rolled back")
        for key, schema in local.items():
            self._put(key, schema)


class Catalog:
    """Schemas by path (`a:b:c`, case ignored), as one session sees them. Frames are never changed in place."""

    def __init__(self, spark: SparkSession, shared: Catalog | None = None) -> None:
        self.spark = spark
        self.sessions: weakref.WeakValueDictionary = shared.sessions if shared else weakref.WeakValueDictionary()
        self.page_size = shared.page_size if shared else DEFAULT_PAGE_SIZE
        self.schemas = Overlay(shared.schemas.shared, shared.schemas.others) if shared else Overlay({}, weakref.WeakSet())
        if not shared:
            self.put("Single", spark.createDataFrame([(None,)], T.StructType([T.StructField("value", T.StringType())])))

    def view(self) -> Catalog:
        """The same schemas for another session."""
        return Catalog(self.spark, self)

    def create(self, path: str, page_size: int | None = None) -> None:
        """Creates a schema and its parents; an existing one stays as it is."""
        parts = path.strip(":").split(":")
        for i in range(1, len(parts) + 1):
            part = ":".join(parts[:i])
            if normal(part) and normal(part) not in self.schemas:
                self.schemas[normal(part)] = Schema(part, page_size=page_size or self.page_size)

    def exists(self, path: str) -> bool:
        return normal(path) in self.schemas or normal(path) == ""

    def get(self, path: str) -> Schema:
        try:
            return self.schemas[normal(path)]
        except KeyError:
            raise DialectError(f"schema {path!r} does not exist") from None

    def put(self, path: str, frame: DataFrame) -> None:
        """Makes `frame` the table of a schema, which is created if need be."""
        self.create(path)
        self.schemas[normal(path)] = replace(self.get(path), frame=frame)

    def update(self, path: str, **changes) -> None:
        self.schemas[normal(path)] = replace(self.get(path), **changes)

    def drop(self, path: str) -> None:
        """Drops a schema with all below it; a missing one is no error."""
        gone = normal(path)
        for key in [k for k in self.schemas if k == gone or k.startswith(gone + ":")]:
            del self.schemas[key]

    def children(self, path: str) -> list[Schema]:
        above = normal(path)
        depth = above.count(":") + 1 if above else 0
        return sorted((s for k, s in self.schemas.items() if k.count(":") == depth and (not above or k.startswith(above + ":"))), key=lambda s: s.path.lower())

    def frame(self, path: str) -> DataFrame:
        """The table of a schema; one that has none yet has no rows and no fields."""
        schema = self.get(path)
        return schema.frame if schema.frame is not None else self.spark.createDataFrame([], T.StructType([]))


#: (files as they lie there, column) -> whether the column holds no null; what was looked up in this process.
_NULL_FREE: dict[tuple[str, str], bool] = {}


def never_null(frame: DataFrame, column: str) -> bool:
    """Whether a column surely holds no null: by its type, or, for a table read straight from files, by a look.

    The look asks the files for one row with a null there, which Parquet answers from its statistics where
    there is none; it is kept for as long as the files are the same. Of other frames nothing is run, and False is given.
    """
    if frame.isStreaming:
        return False
    if not frame.schema[column].nullable:
        return True
    plan = frame._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    files = plan.relation().location().allFiles().toString()  # names, sizes and times
    key = (str(hash(files)) + files[:200], column)
    if key not in _NULL_FREE:
        _NULL_FREE[key] = frame.where(frame[f"`{column}`"].isNull()).select(f"`{column}`").isEmpty()
    return _NULL_FREE[key]
