"""Typed column expressions and the conversions between the dialect's kinds of value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Value:
    """A column with its kind.

    `numeric`, `string`, `time` (date or timestamp), `null`, or `open`: text of a schemaless document,
    which counts as a number wherever it reads as one. `literal` is a constant's Python value.
    """

    column: Column
    kind: str
    literal: object = None


def kind_of_type(data_type: T.DataType, document: bool) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(data_type, T.NullType):
        return "null"
    return "open" if document else "string"


def literal(value) -> Value:
    if value is None:
        return Value(F.lit(None), "null")
    if isinstance(value, bool):
        return Value(F.lit(int(value)), "numeric", int(value))
    if isinstance(value, (int, float)):
        whole = float(value).is_integer() and abs(value) < 2**53
        value = int(value) if whole else float(value)
        return Value(F.lit(value), "numeric", value)
    if hasattr(value, "year"):
        return Value(F.lit(value), "time", value)
    return Value(F.lit(str(value)), "string", str(value))


def number(value: Value) -> Column:
    """As a double; text that is no number gives null."""
    if isinstance(value.literal, (int, float)):
        return F.lit(float(value.literal))
    if value.kind == "numeric":
        return value.column.cast("double")
    if value.kind == "time":
        return F.lit(None).cast("double")
    return plain_number(value.column)


def plain_number(text: Column) -> Column:
    """Text as a double if it is written as a plain number; NaN, Infinity and type suffixes are no numbers."""
    return F.when(F.rlike(text, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")), text.try_cast("double"))


def whole(value: Value) -> Column:
    """As a bigint, the fraction cut off."""
    if isinstance(value.literal, (int, float)):
        return F.lit(int(value.literal)).cast("bigint")
    return number(value).try_cast("bigint")


def shown(x: Column) -> Column:
    """A double as text the short way: no fraction if it has none, no exponent below 1e15."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.try_cast("bigint").cast("string")).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))


def text(value: Value) -> Column:
    if isinstance(value.literal, (int, float)):
        v = value.literal
        return F.lit(str(int(v)) if float(v).is_integer() else repr(float(v)))
    if value.kind == "numeric":
        return shown(value.column.cast("double"))
    if value.kind == "time":
        return F.regexp_replace(value.column.cast("string"), r" 00:00:00$", "")
    return value.column.cast("string")


def moment(value: Value) -> Column:
    """As a timestamp without zone; text that is none gives null."""
    if value.kind == "time":
        return value.column.cast("timestamp_ntz")
    if value.kind == "numeric":
        return F.lit(None).cast("timestamp_ntz")
    t = F.trim(value.column.cast("string"))
    us = F.try_to_timestamp(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t), F.lit("M/d/yyyy HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(t.try_cast("timestamp_ntz"), F.when(t.rlike(r"^\d{1,2}/"), us))


def truth(value: Value) -> Column:
    """As a condition: a number other than 0; null is null."""
    return number(value) != 0
