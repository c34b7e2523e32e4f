"""INSERT, UPDATE and DELETE: from a table's snapshot to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.dialect.lexer import DialectError
from papyrion.dialect.nodes import Delete, Insert, Source, Update
from papyrion.functions.values import Value, text
from papyrion.plans.expressions import Lowering, fields_in
from papyrion.plans.scope import Scope
from papyrion.plans.select import build, joined
from papyrion.sources.catalog import Catalog, Index, never_null

_THERE = "__there"


def with_names(frame: DataFrame, target: DataFrame) -> DataFrame:
    """`frame` with the spelling of the target's fields, and values cast to their types where they can be."""
    types = {f.name.lower(): f for f in target.schema.fields}
    columns, seen = [], set()
    for f in frame.schema.fields:
        if f.name.lower() in seen:
            raise DialectError(f"field {f.name!r} is given twice")
        seen.add(f.name.lower())
        known = types.get(f.name.lower())
        column = F.col(f"`{f.name}`")
        if known is not None and known.dataType != f.dataType:
            column = column.cast("string") if isinstance(known.dataType, T.StringType) else column.try_cast(known.dataType)
        elif isinstance(f.dataType, T.NullType):
            column = column.cast("string")
        columns.append(column.alias(known.name if known is not None else f.name))
    return frame.select(*columns)


def appended(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; fields that one side lacks are null there."""
    rows = with_names(rows, target)
    return target.unionByName(rows, allowMissingColumns=True) if target.columns else rows


def inserted(catalog: Catalog, insert: Insert, variables: dict, document: bool) -> DataFrame:
    """The rows an INSERT adds."""
    if insert.select is not None:
        output = build(catalog, insert.select, variables, document)
        if len(output.names) != len(insert.names):
            raise DialectError(f"{len(insert.names)} fields but {len(output.names)} selected")
        return output.frame.toDF(*insert.names)
    lowering = Lowering(Scope(document, variables))
    fields: dict[str, str] = {}
    rows = []
    for row in insert.rows:
        values = {}
        for name, node in row:
            if name.lower() in values:
                raise DialectError(f"field {name!r} is given twice")
            fields.setdefault(name.lower(), name)
            values[name.lower()] = lowering.value(node)
        rows.append(values)
    texts = {k for k in fields if document or len({r[k].kind for r in rows if k in r} - {"null"}) != 1}
    as_column = lambda v, k: F.lit(None) if v is None or v.kind == "null" else text(v) if k in texts else v.column.cast("double") if v.kind == "numeric" and mixed[k] else v.column
    mixed = {k: any(isinstance(r[k].literal, float) or r[k].literal is None for r in rows if k in r and r[k].kind == "numeric") for k in fields}
    structs = [F.struct(*(as_column(r.get(k), k).alias(fields[k]) for k in fields)) for r in rows]
    frame = catalog.spark.range(1).select(F.inline(F.array(*structs)))
    return frame.select(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in frame.schema.fields))


def updated(catalog: Catalog, update: Update, variables: dict, document: bool) -> tuple[str, DataFrame, DataFrame]:
    """(path, the next table, the rows that matched)."""
    if not update.sources:
        scope = Scope(document, variables)
        frame = catalog.frame(update.target)
        df = joined(catalog, [Source(update.target)], scope)
        hit = F.coalesce(Lowering(scope).condition(update.where), F.lit(False)) if update.where is not None else F.lit(True)
        new = {n.lower(): (n, Lowering(scope).value(node)) for n, node in update.assignments}
        return update.target, df.select(*_assigned(frame, scope, "", hit, new)), df.where(hit)
    path, frame, scope, matched, keys = _matched(catalog, update.target, update.sources, update.where, [v for _, v in update.assignments], variables, document)
    new = {n.lower(): (n, Lowering(scope).value(node)) for n, node in update.assignments}
    names = list(new)
    # Where several rows match one target row, the greatest values win, so that the result is the same each time.
    values = matched.groupBy(*(c.alias(f"__k{i}") for i, (_, c, _) in enumerate(keys))).agg(F.max(F.struct(*(_stored(new[n][1], document).alias(f"v{i}") for i, n in enumerate(names)))).alias("__new"))
    if keys:
        both = _beside(frame, values, keys, "left")
    else:  # the same values for all rows, or none
        values = values.where("__new IS NOT NULL")
        both = frame.withColumn("__new", F.lit(None).cast(values.schema["__new"].dataType)) if values.isEmpty() else frame.crossJoin(F.broadcast(values))  # one row
    types = {f.name.lower(): f.dataType for f in frame.schema.fields}
    columns = []
    for f in frame.schema.fields:
        old = F.col(f"`{f.name}`")
        if f.name.lower() in new:
            fresh = F.col(f"__new.v{names.index(f.name.lower())}")
            fresh = fresh.cast("string") if isinstance(f.dataType, T.StringType) else fresh.try_cast(f.dataType)
            old = F.when(F.col("__new").isNotNull(), fresh).otherwise(old)
        columns.append(old.alias(f.name))
    columns += [F.col(f"__new.v{i}").alias(new[n][0]) for i, n in enumerate(names) if n not in types]
    return path, both.select(*columns), both.where("__new IS NOT NULL")


def _stored(value: Value, document: bool) -> F.Column:
    return text(value) if document or value.kind == "null" else value.column


def _assigned(frame: DataFrame, scope: Scope, alias: str, hit, new: dict) -> list:
    columns, known = [], set()
    for f in frame.schema.fields:
        known.add(f.name.lower())
        old = scope.value(alias, f.name).column
        if f.name.lower() in new:
            fresh = _stored(new[f.name.lower()][1], scope.document)
            fresh = fresh.cast("string") if isinstance(f.dataType, T.StringType) else fresh.try_cast(f.dataType)
            old = F.when(hit, fresh).otherwise(old)
        columns.append(old.alias(f.name))
    return columns + [F.when(hit, _stored(v, scope.document)).alias(n) for k, (n, v) in new.items() if k not in known]


def _matched(catalog: Catalog, target: str, sources: list[Source], where, more: list, variables: dict, document: bool):
    """(path, the target, scope, joined rows, keys) of a change by alias.

    Keys are the target's fields that conditions or `more` expressions read, as (name, column of the joined
    rows, whether it never is null): rows that agree in them meet the same fate, so that they alone lead back from
    the joined rows to the target, and its rows need no numbers.
    """
    own = [s for s in sources if s.alias.lower() == target.lower()]
    if not own:
        raise DialectError(f"no schema has the alias {target!r}")
    frame = catalog.frame(own[0].path)
    scope = Scope(document, variables)
    df = joined(catalog, sources, scope, {target.lower(): lambda f: f.withColumn(_THERE, F.lit(True))})
    if where is not None:
        df = df.where(Lowering(scope).condition(where))
    keys: dict[str, tuple] = {}
    for field in [f for node in (*(s.on for s in sources), where, *more) if node is not None for f in fields_in(node)]:
        alias = field.alias.lower() or next((a for a in scope.fields if field.name.lower() in scope.fields[a]), "")
        if alias == target.lower() and field.name.lower() in scope.frames[alias][1] and field.name.lower() != _THERE:
            name = scope.frames[alias][1][field.name.lower()]
            keys.setdefault(name, (name, scope.value(alias, name).column, never_null(frame, name)))
    return own[0].path, frame, scope, df.where(F.col(f"`{target.lower()}.{_THERE}`").isNotNull()), list(keys.values())


def _beside(frame: DataFrame, found: DataFrame, keys: list[tuple], how: str) -> DataFrame:
    """The target joined with rows that have its keys as `__k0`, `__k1`, ...; these go."""
    same = [F.col(f"`{name}`") == F.col(f"__k{i}") if sure else F.col(f"`{name}`").eqNullSafe(F.col(f"__k{i}")) for i, (name, _, sure) in enumerate(keys)]
    return frame.join(found, same, how).drop(*(f"__k{i}" for i in range(len(keys))))


def deleted(catalog: Catalog, delete: Delete, variables: dict, document: bool) -> tuple[str, DataFrame, DataFrame]:
    """(path, the next table, the rows that went)."""
    if len(delete.sources) < 2:
        source = delete.sources[0] if delete.sources else Source(delete.target)
        scope = Scope(document, variables)
        frame = catalog.frame(source.path)
        df = joined(catalog, [source], scope)
        hit = F.coalesce(Lowering(scope).condition(delete.where), F.lit(False)) if delete.where is not None else F.lit(True)
        return source.path, df.where(~hit).toDF(*frame.columns), df.where(hit)
    path, frame, _, matched, keys = _matched(catalog, delete.target, delete.sources, delete.where, [], variables, document)
    if not keys:  # a condition on other schemas only: all rows or none
        hit = not matched.isEmpty()
        return path, frame.where(F.lit(not hit)), frame.where(F.lit(hit))
    found = matched.select(*(c.alias(f"__k{i}") for i, (_, c, _) in enumerate(keys))).distinct()
    return path, _beside(frame, found, keys, "left_anti"), _beside(frame, found, keys, "left_semi")


def duplicates(frame: DataFrame, index: Index) -> DataFrame:
    """Keys that occur more than once, case ignored; keys with a null in them are no keys."""
    spelled = {c.lower(): c for c in frame.columns}
    if not all(f.lower() in spelled for f in index.fields):
        return frame.sparkSession.createDataFrame([], "n bigint")
    columns = [F.lower(F.col(f"`{spelled[f.lower()]}`").cast("string")).alias(f"k{i}") for i, f in enumerate(index.fields)]
    keys = frame.select(*columns).na.drop()
    return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
