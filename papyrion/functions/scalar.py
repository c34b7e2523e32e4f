"""The dialect's scalar functions.

Each is registered with its parameters (name, kind, default) and a builder from argument values to a
column; every builder uses built-in Spark expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrion.dialect.lexer import DialectError
from papyrion.functions.formats import date_pattern, formatted_number
from papyrion.functions.values import Value, literal, moment, number, text, truth, whole

_REQUIRED = object()
NOW_FORMAT = "yyyy-MM-dd HH:mm:ss.fff"


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str
    default: object = _REQUIRED
    many: bool = False


@dataclass(frozen=True)
class ScalarFunction:
    name: str
    parameters: tuple[Parameter, ...]
    returns: str  # numeric, boolean, string or time
    build: Callable[..., Column]
    summary: str

    def bind(self, args: list[Value]) -> list[Value]:
        """Arguments with defaults filled in; a wrong number raises."""
        many = bool(self.parameters) and self.parameters[-1].many
        least = sum(p.default is _REQUIRED for p in self.parameters)
        if len(args) < least or not many and len(args) > len(self.parameters):
            raise DialectError(f"{self.name} takes {least if not many else f'at least {least}'} to {'any number of' if many else len(self.parameters)} arguments, not {len(args)}")
        return args + [literal(p.default) for p in self.parameters[len(args) :] if not p.many]


REGISTRY: dict[str, ScalarFunction] = {}


def _register(name: str, signature: str, returns: str, summary: str):
    """`signature` is like "string text, numeric length=5, string... more"."""

    def add(build):
        parameters = []
        for part in filter(None, (p.strip() for p in signature.split(","))):
            head, has_default, default = part.partition("=")
            kind, _, own = head.strip().partition(" ")
            value = _REQUIRED
            if has_default:
                default = default.strip()
                value = None if default == "null" else default.strip("'") if default.startswith("'") else float(default)
            parameters.append(Parameter(own, kind.removesuffix("..."), value, kind.endswith("...")))
        REGISTRY[name.lower()] = ScalarFunction(name, tuple(parameters), returns, build, summary)
        return build

    return add


def _flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def constant(value: Value, what: str):
    """The value of an argument that must be a constant."""
    if value.literal is None and value.kind != "null":
        raise DialectError(f"{what} must be a constant")
    return value.literal


# -- strings


@_register("LastIndexOf", "string textToFind, string textToSearch, numeric offset=-1", "numeric", "last place of a text, from 0, -1 if absent, case ignored; an offset above 0 is the last place looked at")
def _last_index_of(find, within, offset):
    f, s = F.lower(text(find)), F.lower(text(within))
    limit = whole(offset)
    part = F.when(limit > 0, F.substring(s, F.lit(1), (limit + 1).cast("int"))).otherwise(s)
    at = F.call_function("locate", F.reverse(f), F.reverse(part))
    return F.when(f.isNull() | s.isNull(), None).when(at == 0, -1).otherwise(F.length(part) - F.length(f) - (at - 1))


@_register("Length", "string value", "numeric", "number of characters")
def _length(value):
    return F.length(text(value))


@_register("Concat", "string... text", "string", "texts one after another; nulls are skipped")
def _concat(*values):
    return F.concat_ws("", *(text(v) for v in values))


@_register("FormatNumeric", "numeric value, string format='N'", "string", "a number in a format: n, f, d, c, p, e, g with digits, or 0 and # patterns")
def _format_numeric(value, pattern):
    return formatted_number(number(value), str(constant(pattern, "the format")))


@_register("IndexOf", "string textToFind, string textToSearch, numeric offset=0", "numeric", "first place of a text, from 0, -1 if absent, case ignored")
def _index_of(find, within, offset):
    start = F.greatest(whole(offset).cast("int"), F.lit(0)) + 1
    return F.call_function("locate", F.lower(text(find)), F.lower(text(within)), start) - 1


@_register("Left", "string text, numeric length", "string", "the first characters; all if there are fewer")
def _left(value, length):
    return F.left(text(value), whole(length).cast("int"))


@_register("Right", "string text, numeric length", "string", "the last characters; all if there are fewer")
def _right(value, length):
    return F.right(text(value), whole(length).cast("int"))


@_register("SubString", "string text, numeric startIndex, numeric length", "string", "characters from a place counted from 0; cut off at the end")
def _substring(value, start, length):
    return F.call_function("substring", text(value), (whole(start) + 1).cast("int"), whole(length).cast("int"))


@_register("ToLower", "string text", "string", "in lower case")
def _to_lower(value):
    return F.lower(text(value))


@_register("ToUpper", "string text", "string", "in upper case")
def _to_upper(value):
    return F.upper(text(value))


@_register("ToProper", "string text", "string", "each word with a capital; words all in capitals stay")
def _to_proper(value):
    words = F.split(text(value), " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w), w).otherwise(F.initcap(w))), " ")


@_register("ToString", "numeric value", "string", "a number as text")
def _to_string(value):
    return text(value)


@_register("Trim", "string text, string characters=null", "string", "without white space, or the given characters, at both ends")
def _trim(value, characters):
    if characters.kind == "null":
        return F.regexp_replace(text(value), r"^\s+|\s+$", "")
    return F.btrim(text(value), text(characters))


# -- numbers


@_register("Abs", "numeric value", "numeric", "without sign")
def _abs(value):
    return F.abs(number(value))


@_register("Ceil", "numeric value", "numeric", "the next whole number up")
def _ceil(value):
    return F.ceil(number(value)).cast("double")


@_register("Floor", "numeric value", "numeric", "the next whole number down")
def _floor(value):
    return F.floor(number(value)).cast("double")


@_register("Pow", "numeric x, numeric y", "numeric", "x to the power y")
def _pow(x, y):
    return F.pow(number(x), number(y))


@_register("Round", "numeric value, numeric decimalPlaces=0", "numeric", "rounded, halves to the even digit")
def _round(value, places):
    return F.bround(number(value).try_cast("decimal(38,12)"), int(constant(places, "the number of decimals") or 0)).cast("double")


@_register("ToNumeric", "string value", "numeric", "text as a number, null if it is none")
def _to_numeric(value):
    return number(value)


# -- dates

# Names of intervals.
UNITS = {
    "dayofyear": "dayofyear", "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month", "weekday": "weekday", "dw": "weekday",
    "week": "week", "ww": "week", "wk": "week", "day": "day", "dy": "day", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "second": "second", "s": "second", "millisecond": "millisecond", "ms": "millisecond",
}


def unit(value: Value) -> str:
    name = str(constant(value, "the interval")).lower()
    if name not in UNITS:
        raise DialectError(f"no interval {name!r}")
    return UNITS[name]


@_register("DateAdd", "string dateTime, string interval, numeric offset", "time", "a time moved by intervals, in whole seconds")
def _date_add(when, interval, offset):
    t, n, name = moment(when), number(offset), unit(interval)
    if name in ("year", "quarter", "month"):
        moved = F.timestamp_add("MONTH", (n.try_cast("int") * {"year": 12, "quarter": 3, "month": 1}[name]), t)
    elif name == "weekday":
        moved = F.timestamp_add("DAY", _working_days(F.weekday(t), n.try_cast("int")), t)
    else:
        micros = {"dayofyear": 86_400_000_000, "day": 86_400_000_000, "week": 604_800_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000}[name]
        moved = F.timestamp_add("MICROSECOND", F.round(n * micros).try_cast("bigint"), t)
    return F.date_trunc("SECOND", moved).cast("timestamp_ntz")


def _working_days(day: Column, n: Column) -> Column:
    """Days to move from weekday `day` (0 is Monday) by `n` steps over working days, in closed form."""
    weekend = day >= 5
    on, back = F.when(weekend, F.lit(4)).otherwise(day), F.when(weekend, F.lit(0)).otherwise(day)
    forward = n + 2 * F.floor((on + n) / 5) - F.when(weekend, day - 4).otherwise(0)
    behind = F.when(weekend, 7 - day).otherwise(0) - (-n + 2 * F.floor((4 - back - n) / 5))
    return F.when(n > 0, forward).when(n < 0, behind).otherwise(0).cast("int")


@_register("DateDiff", "string date1, string date2, string interval", "numeric", "date2 less date1 in intervals: whole for years, quarters, months, working days and days of the year, else with fraction")
def _date_diff(first, second, interval):
    a, b, name = moment(first), moment(second), unit(interval)
    if name in ("year", "quarter", "month"):
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        if name == "month":
            return (months - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")).cast("double")
        if name == "quarter":
            quarters = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
            into = lambda t: F.timestamp_diff("MICROSECOND", F.date_trunc("QUARTER", t).cast("timestamp_ntz"), t)
            return (quarters - (into(b) < into(a)).cast("int")).cast("double")
        years = F.year(b) - F.year(a)
        return (years - (b < F.timestamp_add("MONTH", years * 12, a)).cast("int")).cast("double")
    if name == "dayofyear":
        return F.datediff(b, a).cast("double")
    if name == "weekday":
        low, high = F.least(a, b), F.greatest(a, b)
        since = lambda t, more: F.datediff(t, F.lit("1600-01-03").cast("date")) + more  # noqa: E731  days since a Monday
        upto = lambda x: 5 * F.floor(x / 7) + F.least(F.pmod(x, F.lit(7)), F.lit(5))
        return F.when(a.isNotNull() & b.isNotNull(), upto(since(high, 1)) - upto(since(low, 0))).cast("double")
    per = {"week": 6.048e11, "day": 8.64e10, "hour": 3.6e9, "minute": 6e7, "second": 1e6, "millisecond": 1e3}[name]
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(per)


@_register("DateTime", f"string format='{NOW_FORMAT}'", "string", "the present local time")
def _date_time(pattern):
    return F.date_format(F.current_timestamp(), date_pattern(str(constant(pattern, "the format"))))


@_register("DateTimeUTC", f"string format='{NOW_FORMAT}'", "string", "the present time in UTC")
def _date_time_utc(pattern):
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(now, date_pattern(str(constant(pattern, "the format"))))


@_register("FormatDateTime", f"string datetime, string format='{NOW_FORMAT}'", "string", "a time in a format")
def _format_date_time(when, pattern):
    return F.date_format(moment(when), date_pattern(str(constant(pattern, "the format"))))


# -- nulls and choices


@_register("IfNullNumeric", "numeric value=null, numeric defaultValue=0", "numeric", "a default for null")
def _if_null_numeric(value, default):
    return F.coalesce(number(value), number(default))


@_register("NullIfNumeric", "numeric value, boolean conditional", "numeric", "null if the condition is true")
def _null_if_numeric(value, condition):
    return F.when(~F.coalesce(truth(condition), F.lit(False)), number(value))


@_register("Coalesce", "string... text", "string", "the first that is not null")
def _coalesce(*values):
    return F.coalesce(*(text(v) for v in values)) if values else F.lit(None).cast("string")


@_register("IfNull", "string value=null, string defaultValue=''", "string", "a default for null")
def _if_null(value, default):
    return F.coalesce(text(value), text(default))


@_register("IIF", "boolean condition, string whenTrue, string whenFalse", "string", "one of two values; a null condition is false")
def _iif(condition, yes, no):
    return F.when(F.coalesce(truth(condition), F.lit(False)), text(yes)).otherwise(text(no))


@_register("NullIf", "string value, boolean conditional", "string", "null if the condition is true")
def _null_if(value, condition):
    return F.when(~F.coalesce(truth(condition), F.lit(False)), text(value))


# -- predicates


@_register("IsBetween", "numeric value, numeric rangeLow, numeric rangeHigh", "boolean", "in a range with both its ends")
def _is_between(value, low, high):
    return _flag(number(value).between(number(low), number(high)))


@_register("IsNotBetween", "numeric value, numeric rangeLow, numeric rangeHigh", "boolean", "outside a range; null is outside")
def _is_not_between(value, low, high):
    return 1 - _flag(number(value).between(number(low), number(high)))


@_register("IsEqual", "string text1, string text2", "boolean", "equal, with case; null equals null")
def _is_equal(a, b):
    return text(a).eqNullSafe(text(b)).cast("int")


@_register("IsNotEqual", "string text1, string text2", "boolean", "not equal, with case")
def _is_not_equal(a, b):
    return (~text(a).eqNullSafe(text(b))).cast("int")


@_register("IsGreater", "numeric value1, numeric value2", "boolean", "above")
def _is_greater(a, b):
    return _flag(number(a) > number(b))


@_register("IsGreaterOrEqual", "numeric value1, numeric value2", "boolean", "above or equal")
def _is_greater_or_equal(a, b):
    return _flag(number(a) >= number(b))


@_register("IsLess", "numeric value1, numeric value2", "boolean", "below")
def _is_less(a, b):
    return _flag(number(a) < number(b))


@_register("IsLessOrEqual", "numeric value1, numeric value2", "boolean", "below or equal")
def _is_less_or_equal(a, b):
    return _flag(number(a) <= number(b))


def like(value: Column, pattern: Column) -> Column:
    """LIKE with % and _, case ignored; a backslash is an ordinary character."""
    return F.call_function("like", F.lower(value), F.lower(F.replace(pattern, F.lit("\\"), F.lit("\\\\"))))


@_register("IsLike", "string text, string pattern", "boolean", "like a pattern, case ignored")
def _is_like(value, pattern):
    return _flag(like(text(value), text(pattern)))


@_register("IsNotLike", "string text, string pattern", "boolean", "not like a pattern; null is 0")
def _is_not_like(value, pattern):
    return _flag(~like(text(value), text(pattern)))


@_register("IsNull", "string value=null", "boolean", "null")
def _is_null(value):
    return value.column.isNull().cast("int")


@_register("IsDouble", "string value", "boolean", "a number; null is null")
def _is_double(value):
    return F.when(value.column.isNotNull(), number(value).isNotNull().cast("int"))


@_register("IsInteger", "string value", "boolean", "1 for what is no 32-bit whole number, as the dialect has it; null is null")
def _is_integer(value):
    return F.when(value.column.isNotNull(), (~_reads_as_int(text(value))).cast("int"))


def _reads_as_int(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(value).try_cast("int").isNotNull(), F.lit(False))


@_register("IsString", "string value", "boolean", "not a number; null is null")
def _is_string(value):
    return F.when(value.column.isNotNull(), number(value).isNull().cast("int"))


# -- hashes and identity


@_register("Checksum", "string text", "numeric", "16-bit rolling sum over ASCII bytes, other characters counting as ?")
def _checksum(value):
    codes = F.transform(F.split(text(value), ""), lambda c: F.when(F.ascii(c) > 127, 63).otherwise(F.ascii(c)))
    return F.aggregate(codes, F.lit(0), lambda total, b: (total + total.bitwiseXOR(b)) % 65536)


@_register("Sha1", "string text", "string", "SHA-1 in hex")
def _sha1(value):
    return F.sha1(text(value))


@_register("Sha256", "string text", "string", "SHA-256 in hex")
def _sha256(value):
    return F.sha2(text(value), 256)


@_register("Sha512", "string text", "string", "SHA-512 in hex")
def _sha512(value):
    return F.sha2(text(value), 512)


@_register("DocumentID", "string schemaAlias", "string", "always null: rows have no stored identity")
def _document_id(_):
    return F.lit(None).cast("string")


@_register("DocumentPage", "string schemaAlias", "string", "always null")
def _document_page(_):
    return F.lit(None).cast("string")


@_register("DocumentUID", "string schemaAlias", "string", "always null")
def _document_uid(_):
    return F.lit(None).cast("string")


@_register("Guid", "", "string", "a random identifier")
def _guid():
    return F.expr("uuid()")
