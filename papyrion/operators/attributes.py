"""Attribute-value rows to wide, typed rows.

The attribute list and types come first, from the table of declarations; that table, not the data,
bounds the number of columns. Then one aggregation per entity holds one conditional aggregate for
each attribute, which keeps the row that decides. States are combined before the shuffle, so an
entity with very many rows sends one state per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")
#: (regular expression, date pattern) of the date notations that are read.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.y"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"),
)
_BLANK = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


def bare(text: Column) -> Column:
    """`text` without white space around; null if nothing is left."""
    cut = F.regexp_replace(text, _BLANK, "")
    return F.when(cut != "", cut)


def read_bigint(text: Column) -> Column:
    """A whole number: sign, leading zeros, grouped digits (1,234 or 1.234.567) and a fraction of zeros are allowed."""
    t = bare(text)
    whole = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.0*)?$"), F.regexp_replace(F.regexp_replace(t, r"\.0*$", ""), ",", "")).when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,0*)?$"), F.regexp_replace(F.regexp_replace(t, ",0*$", ""), r"\.", "")).when(t.rlike(r"^[+-]?\d+([.,]0*)?$"), F.regexp_replace(t, r"[.,]0*$", ""))
    return whole.try_cast("bigint")


def read_double(text: Column) -> Column:
    """A number of two decimals.

    Of two different marks the last is the decimal one and the other groups. A single mark is the
    decimal one, unless it stands before exactly three digits that do not end in zero: three decimals
    of meaning do not occur, so that it groups. The same mark several times groups.
    """
    t = bare(text)
    plain = (
        F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+\.\d*$"), F.regexp_replace(t, ",", ""))
        .when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+,\d*$"), F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(t.rlike(r"^[+-]?\d{1,3}([.,])\d{3}(\1\d{3})+$"), F.regexp_replace(t, "[.,]", ""))
        .when(t.rlike(r"^[+-]?[1-9]\d{0,2}[.,]\d\d[1-9]$"), F.regexp_replace(t, "[.,]", ""))
        .when(t.rlike(r"^[+-]?(\d+[.,]?\d*|[.,]\d+)([eE][+-]?\d{1,3})?$"), F.translate(t, ",", "."))
    )
    return F.round(plain.try_cast("double").try_cast("decimal(38,6)"), 2).cast("double")


def read_boolean(text: Column) -> Column:
    word = F.lower(bare(text))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def read_date(text: Column) -> Column:
    """A date in one of DATE_FORMS, or of an ISO time stamp; impossible dates are unreadable."""
    day = F.regexp_replace(bare(text), r"^(\d{4}-\d{1,2}-\d{1,2})[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", "$1")
    out = F.lit(None).cast("date")
    for form, pattern in DATE_FORMS:
        text_ = F.initcap(day) if "MMM" in pattern else day
        out = F.when(day.rlike(form), F.try_to_timestamp(text_, F.lit(pattern)).cast("date")).otherwise(out)
    return F.when((F.year(out) >= 1), out)


READERS = {"bigint": read_bigint, "double": read_double, "boolean": read_boolean, "date": read_date, "string": bare}


#: Attributes to an aggregation; more are found by several, whose rows are joined.
BLOCK = 500


def declared(types: DataFrame) -> list[tuple[str, str, list[str]]]:
    """(attribute, type, schemapaths) of the declarations, in order of name and type.

    Names are compared without case and blanks around, rows without a name, schemapath or known type
    declare nothing. The list is metadata: one entry per declared column, whatever the number of rows.
    """
    rows = types.select("schemapath", F.lower(bare(F.col("elementname"))).alias("name"), F.lower(bare(F.col("typename"))).alias("type")).where(F.col("type").isin(*READERS)).groupBy("name", "type").agg(F.sort_array(F.collect_set("schemapath")).alias("paths"))
    found = rows.where("name IS NOT NULL AND size(paths) > 0").collect()
    return sorted((r["name"], r["type"], list(r["paths"])) for r in found)


def column_names(attributes: list[tuple[str, str, list[str]]]) -> list[str]:
    """The wide table's columns: the attribute's name, with its type where the name is declared with several."""
    names = [a[0] for a in attributes]
    return [f"{n}_{t}" if names.count(n) > 1 else n for n, t, _ in attributes]


def widen(elements: DataFrame, types: DataFrame) -> DataFrame:
    """One row per (`schemapath`, `documentid`) with a typed column for each declared attribute (see `column_names`).

    Of several rows of an attribute the one with the latest `modified` decides (then the latest
    `created`, then the greatest value; null times come first), even if its value is null, blank or
    unreadable, which give null. Attributes that are not declared for the schemapath are left out;
    a document without declared attributes has a row of nulls. Rows without documentid or schemapath
    belong to no document. Empty input gives no rows.
    """
    attributes = declared(types)
    name, path = F.lower(bare(F.col("elementname"))), F.col("schemapath")
    rows = elements.where("documentid IS NOT NULL AND schemapath IS NOT NULL").select(path, "documentid", name.alias("__name"), "elementvalue", "modified", "created")
    if not attributes:
        return rows.select("schemapath", "documentid").distinct()
    columns = column_names(attributes)
    blocks = [(attributes[i : i + BLOCK], columns[i : i + BLOCK]) for i in range(0, len(attributes), BLOCK)]
    wide = _block(rows, *blocks[0])
    for i, block in enumerate(blocks[1:]):
        more = _block(rows, *block).withColumnsRenamed({"schemapath": "__path", "documentid": "__document"})
        wide = wide.join(more, (F.col("schemapath") == F.col("__path")) & (F.col("documentid") == F.col("__document"))).drop("__path", "__document")
    return wide


def _block(rows: DataFrame, attributes: list[tuple[str, str, list[str]]], columns: list[str]) -> DataFrame:
    """One row per (`schemapath`, `documentid`) of all rows, with the columns of these attributes.

    A cell's state is its times, the value as written and, as text, the value read; it gets its type at the end.
    """
    path = F.col("schemapath")
    kinds = F.create_map(*(F.lit(x) for n, kind, paths in attributes for at in paths for x in (f"{at}\x1f{n}", kind)))
    rows = rows.withColumn("__kind", F.element_at(kinds, F.concat_ws("\x1f", path, "__name")))
    read = F.lit(None).cast("string")
    for kind, reader in READERS.items():
        read = F.when(F.col("__kind") == kind, reader(F.col("elementvalue")).cast("string")).otherwise(read)
    cell = F.struct("modified", "created", "elementvalue", read.alias("read"))
    ranked = rows.select("schemapath", "documentid", F.when(F.col("__kind").isNotNull(), F.col("__name")).alias("__name"), cell.alias("__cell"))
    picks = [F.max(F.when((F.col("__name") == n) & path.isin(paths), F.col("__cell")))["read"].try_cast(kind).alias(column) for (n, kind, paths), column in zip(attributes, columns)]
    return ranked.groupBy("schemapath", "documentid").agg(*picks)


def filled_cells(wide: DataFrame, types: DataFrame) -> DataFrame:
    """(`schemapath`, `documentid`, `elementname`, `typedvalue`) for each non-null cell of `widen`'s result, values as text."""
    shown = {"bigint": lambda c: c.cast("string"), "double": lambda c: c.cast("decimal(38,2)").cast("string"), "boolean": lambda c: c.cast("string"), "date": lambda c: F.date_format(c, "yyyy-MM-dd"), "string": lambda c: c}
    attributes = declared(types)
    if not attributes:
        return wide.select("schemapath", "documentid", F.lit("").alias("elementname"), F.lit("").alias("typedvalue")).where("false")
    pairs = [F.struct(F.lit(name).alias("elementname"), shown[kind](F.col(column)).alias("typedvalue")) for (name, kind, _), column in zip(attributes, column_names(attributes))]
    return wide.select("schemapath", "documentid", F.inline(F.filter(F.array(*pairs), lambda p: p["typedvalue"].isNotNull())))
