"""SELECT to a DataFrame: joins, filter, projection or grouping, distinct, order, offset and top."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.dialect.lexer import DialectError
from papyrion.dialect.nodes import Call, Chain, Compare, Field, Group, Logic, Named, Number, Select, SelectField, Source, Star, Text, Unary, Variable
from papyrion.functions import aggregate
from papyrion.functions.values import Value, number, text
from papyrion.plans.expressions import Lowering, aggregates_in, fields_in, simplified
from papyrion.plans.scope import Scope
from papyrion.sources.catalog import Catalog, never_null


@dataclass
class Output:
    """A result's frame with the names of its columns (names may repeat) and the fields nobody knew."""

    frame: DataFrame
    names: list[str]
    missing: list[str]


def joined(catalog: Catalog, sources: list[Source], scope: Scope, row_ids: dict[str, str] | None = None, absent: frozenset[str] = frozenset()) -> DataFrame:
    """The sources joined in the order of the text; Catalyst may reorder them.

    `row_ids` names a column to number rows by, per alias; of the aliases in `absent` no row may match.
    """
    df: DataFrame | None = None
    scope.written = [s.alias for s in sources]
    for source in sources:
        frame = catalog.frame(source.path)
        if row_ids and source.alias.lower() in row_ids:
            frame = row_ids[source.alias.lower()](frame)
        right = scope.add(source.alias, frame)
        if df is None:
            df = right
        else:
            kind = "inner" if source.join == "inner" else "left_anti" if source.alias.lower() in absent else "left"
            df = df.join(right, Lowering(scope, null_equal=scope.null_keys).condition(source.on), kind)
            if kind == "left":
                scope.extended.add(source.alias.lower())
    return df


def limit_of(node, scope: Scope) -> int | None:
    if node is None:
        return None
    value = Lowering(scope).value(node).literal
    try:
        return max(0, int(float(value)))
    except (TypeError, ValueError):
        raise DialectError(f"a number of rows cannot be {value!r}") from None


def build(catalog: Catalog, select: Select, variables: dict, document: bool = False, sticky_sort: bool = False, null_keys: bool = True) -> Output:
    """The plan of a SELECT. Nothing runs."""
    scope = Scope(document, variables, null_keys=null_keys)
    absent, where = _absent(catalog, select)
    df = joined(catalog, select.sources, scope, absent=absent)
    if where is not None:
        df = df.where(Lowering(scope).condition(where))
    fields = _named(select.fields, scope)
    sorts = select.order_by
    calls = {simplified(c): c for node in [f for _, f in fields] + [s.value for s in sorts] for c in aggregates_in(node)}
    if calls or select.group_by:
        df, lowering, sort_lowering = _grouped(df, select, fields, calls, scope)
    else:
        lowering = sort_lowering = Lowering(scope)
    outputs = [lowering.value(node) for _, node in fields]
    if document:
        outputs = [Value(text(v), "open") for v in outputs]
    names = [name for name, _ in fields]
    order = _order(sorts, sort_lowering, scope, dict(zip([n.lower() for n in names], outputs)), sticky_sort)
    columns = [v.column.alias(f"o{i}") for i, v in enumerate(outputs)]
    df = df.select(*columns, *(c.alias(f"s{i}") for i, (c, _) in enumerate(order)))
    keep = [f"o{i}" for i in range(len(columns))]
    if select.distinct == "before":
        df = distinct(df, keep)
    if order:
        df = df.orderBy(*(F.desc_nulls_last(f"s{i}") if down else F.asc_nulls_first(f"s{i}") for i, (_, down) in enumerate(order)))
    if skip := limit_of(select.offset, scope):
        df = df.offset(skip)
    top = limit_of(select.top, scope)
    if top is not None:
        df = df.limit(top)
    df = df.select(*keep)
    if select.distinct == "after":
        df = distinct(df, keep)
    return Output(df.toDF(*names), names, list(dict.fromkeys(scope.missing)))


def _absent(catalog: Catalog, select: Select) -> tuple[frozenset[str], object]:
    """(aliases joined by OUTER JOIN that the WHERE wants unmatched and nothing else uses, the rest of the WHERE).

    `OUTER JOIN b ... WHERE IsNull(b.f) = true` keeps exactly the rows without a match if `b.f` itself is never null.
    """
    where = select.where
    parts = list(where.parts) if isinstance(where, Logic) and where.operator == "and" else [where]
    absent = set()
    for part in parts:
        tests = isinstance(part, Compare) and part.operator == "=" and isinstance(part.left, Call) and part.left.name == "isnull" and len(part.left.args) == 1 and part.right in (Named("true"), Number(1.0, "1"))
        field = part.left.args[0] if tests else None
        if not isinstance(field, Field) or not field.alias:
            continue
        alias = field.alias.lower()
        source = next((s for s in select.sources[1:] if s.alias.lower() == alias and s.join != "inner"), None)
        if source is None or alias in absent:
            continue
        others = [n for f in select.fields if not isinstance(f, Star) for n in fields_in(f.value)] + [n for p in parts if p is not part for n in fields_in(p)]
        others += [n for s in select.sources if s is not source and s.on is not None for n in fields_in(s.on)] + [n for g in select.group_by for n in fields_in(g)] + [n for o in select.order_by for n in fields_in(o.value)]
        stars = any(isinstance(f, Star) and (f.alias or alias).lower() == alias for f in select.fields)
        if stars or any(not n.alias or n.alias.lower() == alias for n in others):
            continue
        frame = catalog.frame(source.path)
        name = next((c for c in frame.columns if c.lower() == field.name.lower()), None)
        if name is not None and never_null(frame, name):
            absent.add(alias)
            parts = [p for p in parts if p is not part]
    if not absent:
        return frozenset(), where
    rest = None if not parts else parts[0] if len(parts) == 1 else Logic("and", tuple(parts))
    return frozenset(absent), rest


def _named(fields: list, scope: Scope) -> list[tuple[str, object]]:
    """(output name, expression) of the select list: an alias, a field's bare name, or Expression0, Expression1, ..."""
    out, unnamed = [], 0
    for f in fields:
        if isinstance(f, Star):
            out += [(shown, Field(alias, name)) for alias, name, shown in scope.stars(f.alias)]
        elif f.alias is not None:
            out.append((f.alias, f.value))
        elif isinstance(f.value, Field):
            out.append((f.value.name, f.value))
        else:
            out.append((f"Expression{unnamed}", f.value))
            unnamed += 1
    return out


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that differ in `columns`, case ignored; of equal ones the first in order of all values stays."""
    kinds = dict(df.dtypes)
    keys = [F.lower(c).alias(f"k{i}") if kinds[c] == "string" else F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]
    if not any(kinds[c] == "string" for c in columns) and len(columns) == len(df.columns):
        return df.distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*df.columns)).alias("row")).select("row.*")


def _fields_outside(node, known: dict) -> list[Field]:
    """Fields of an expression that stand outside aggregates and grouping keys."""
    if simplified(node) in known:
        return []
    if isinstance(node, Field):
        return [node]
    if isinstance(node, Call):
        return [] if node.name in aggregate.REGISTRY else [f for a in node.args for f in _fields_outside(a, known)]
    if isinstance(node, Chain):
        return [f for a in node.operands for f in _fields_outside(a, known)]
    if isinstance(node, Group):
        return _fields_outside(node.inner, known)
    if isinstance(node, Unary):
        return _fields_outside(node.operand, known)
    return []


def _grouped(df: DataFrame, select: Select, fields: list, calls: dict, scope: Scope) -> tuple[DataFrame, Lowering, Lowering]:
    plain = Lowering(scope)
    keys, replaced, aggregates = [], {}, []
    resolved: dict[str, Value] = {}
    for i, node in enumerate(select.group_by):
        value = plain.value(node)
        if scope.document and value.kind in ("open", "string"):
            keys.append(F.lower(text(value)).alias(f"k{i}"))
            aggregates.append(F.min(text(value)).alias(f"first{i}"))
            stands = Value(F.col(f"first{i}"), value.kind)
        else:
            keys.append(value.column.alias(f"k{i}"))
            stands = Value(F.col(f"k{i}"), value.kind)
        replaced[simplified(node)] = stands
        if isinstance(node, Field):
            resolved[str(value.column)] = stands
    apart: list[tuple[str, str, Column]] = []  # digests, whose groups are not gathered
    for i, (key, call) in enumerate(calls.items()):
        args = [plain.value(a) for a in call.args]
        value = aggregate.build(call.name, args)
        if call.name in aggregate.DIGESTS and not df.isStreaming:
            apart.append((f"a{i}", aggregate.DIGESTS[call.name], text(args[0])))
        else:
            aggregates.append(value.column.alias(f"a{i}"))
        replaced[key] = Value(F.col(f"a{i}"), value.kind)

    def same_key(node: Field) -> Value | None:
        return resolved.get(str(scope.value(node.alias, node.name).column)) if scope.knows(node.alias, node.name) else None

    extra: dict[Field, Value] = {}
    aliases = {name.lower() for name, _ in fields}
    for sort in select.order_by:
        for node in _fields_outside(sort.value, replaced):
            if same_key(node) is None and node not in extra and (scope.knows(node.alias, node.name) or node.alias or node.name.lower() not in aliases):
                value = scope.value(node.alias, node.name)
                aggregates.append(F.min(value.column).alias(f"x{len(extra)}"))
                extra[node] = Value(F.col(f"x{len(extra)}"), value.kind)

    def in_list(node: Field) -> Value:
        if (found := same_key(node)) is not None:
            return found
        if not scope.knows(node.alias, node.name) and (not node.alias or node.alias.lower() in scope.fields):
            return scope.value(node.alias, node.name)
        raise DialectError(f"{node.alias + '.' if node.alias else ''}{node.name} must be in GROUP BY or an aggregate")

    def in_order(node: Field) -> Value:
        return extra[node] if node in extra else in_list(node)

    if select.group_by:
        out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    else:
        out = df.agg(*aggregates, F.count(F.lit(1)).alias("rows")).where("rows > 0")  # no input, no row
    names = [f"k{i}" for i in range(len(keys))]
    for name, kind, column in apart:
        found = aggregate.digests(df.select(*keys, column.alias("__value")), names, "__value", kind).toDF(*(f"__{n}" for n in names), name)
        out = out.join(found, [out[n].eqNullSafe(found[f"__{n}"]) for n in names] or F.lit(True), "left").drop(*(f"__{n}" for n in names))
    return out, Lowering(scope, replaced, in_list), Lowering(scope, replaced, in_order)


def _order(sorts: list, lowering: Lowering, scope: Scope, outputs: dict[str, Value], sticky: bool) -> list[tuple[Column, bool]]:
    """(key, descending) in order. Constants order nothing. A name is a source's field, else an output's."""
    keys, last = [], False
    for sort in sorts:
        node = sort.value
        last = sort.descending or (sticky and last)
        if isinstance(node, (Number, Text, Named, Variable)):
            continue
        if isinstance(node, Field) and not node.alias and not scope.knows("", node.name) and node.name.lower() in outputs:
            value = outputs[node.name.lower()]
        else:
            value = lowering.value(node)
        if value.kind == "open":
            numeric = number(value)
            parts = [F.when(value.column.isNull(), 0).when(numeric.isNotNull(), 1).otherwise(2), numeric, F.lower(text(value))]
        elif value.kind == "string":
            parts = [F.lower(value.column), value.column]
        else:
            parts = [value.column]
        keys += [(p, last) for p in parts]
    return keys


__all__ = ["Output", "SelectField", "build", "distinct", "joined", "limit_of"]
