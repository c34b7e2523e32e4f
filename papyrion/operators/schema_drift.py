"""One consistent table from documents whose fields drift from file to file.

Every field of every document becomes a cell of a tagged union: its kind (whole, fraction, truth,
text, object, array, null) and its value; what lies in objects and arrays becomes cells of its own, named by its
path (`address.city`, `lines[].price`). Files' schemas are the fused kinds per path, inferred in
parallel by a partial aggregation that moves one small state per (file, path) and task. Changes are
read from those schemas alone; only for files in which a field leaves and another arrives are the
documents read again and the cells of just these fields compared, by an equality join on (file, document, value). What says which
files and fields these are is metadata; it is broadcast to the scan if it takes few bytes, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrion.stable import if_small, settle

KINDS = ("whole", "fraction", "truth", "text", "object", "array")
#: Levels of objects and arrays that are taken apart; what lies deeper belongs to the value of the last.
DEPTH = 6


# Marks before a field's name and an item's number in a path, told apart from anything a name holds.
_FIELD, _ITEM = "\x01", "\x02"


def _below(value: Column, depth: int) -> Column:
    """(`path`, `value`) of all that lies in an object or array; null for other values."""
    fields = F.transform(F.map_entries(value.try_cast("map<string,variant>")), lambda e: F.struct(F.concat(F.lit(_FIELD), e["key"]).alias("path"), e["value"].alias("value")))
    items = F.transform(value.try_cast("array<variant>"), lambda v, i: F.struct(F.concat(F.lit(_ITEM), i.cast("string")).alias("path"), v.alias("value")))
    own = F.coalesce(fields, items)
    if depth == 1:
        return own

    def with_below(e: Column) -> Column:
        deeper = F.transform(_below(e["value"], depth - 1), lambda f: F.struct(F.concat(e["path"], f["path"]).alias("path"), f["value"].alias("value")))
        return F.coalesce(F.concat(F.array(e), deeper), F.array(e))

    return F.flatten(F.transform(own, with_below))


def _exploded(documents: DataFrame) -> DataFrame:
    """(`schemapath`, `fileseq`, `docpointer`, `name`, `field`, `__value`): the cells before their kind is looked at."""
    text = F.col("elements")
    parsed = documents.select("schemapath", "fileseq", "docpointer", F.when(text.rlike(r"^\s*\{"), F.try_parse_json(text)).alias("__json"), text.rlike(r"^\s*\{[^\[{]*[\[{]").alias("__deep"))
    # documents without brackets inside are flat; others become one flat object of paths
    entries = F.transform(_below(F.col("__json"), DEPTH), lambda e: F.struct(F.substring(e["path"], 2, 2**31 - 1).alias("path"), e["value"].alias("value")))
    flat = parsed.withColumn("__json", F.when(F.col("__deep"), F.to_variant_object(F.map_from_entries(entries))).otherwise(F.col("__json")))
    cell = flat.lateralJoin(documents.sparkSession.tvf.variant_explode_outer(F.col("__json").outer()))
    shown = F.regexp_replace(F.regexp_replace("key", f"{_ITEM}[0-9]+", "[]"), _FIELD, ".")
    name = F.when(F.col("__deep"), shown).otherwise(F.col("key"))
    return cell.select("schemapath", "fileseq", "docpointer", name.alias("name"), F.lower(name).alias("field"), F.col("value").alias("__value"))


def _typed(exploded: DataFrame) -> DataFrame:
    """The cells with `kind` and `value` in place of `__value`."""
    shaped = exploded.withColumn("__shape", F.expr("schema_of_variant(__value)"))
    shape = F.col("__shape")
    kind = (
        F.when(shape == "STRING", "text")
        .when(shape == "BIGINT", "whole")
        .when(shape == "BOOLEAN", "truth")
        .when(shape == "VOID", None)
        .when(shape.startswith("DECIMAL"), F.when(F.regexp_extract(shape, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int") > 19, "whole").otherwise("fraction"))  # whole numbers beyond 64 bits
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.isNotNull(), "fraction")
    )
    return shaped.select(*(c for c in exploded.columns if c != "__value"), kind.alias("kind"), F.expr("try_cast(__value AS string)").alias("value"))


def cells(documents: DataFrame) -> DataFrame:
    """(`schemapath`, `fileseq`, `docpointer`, `name`, `field`, `kind`, `value`), one row per field of a document at any level.

    `field` is `name` in lower case. A document that is null, no valid JSON or no object (JSON objects
    that repeat a name exactly count as invalid) and an empty object give one row with a null field,
    so their file is still known. `kind` is null for a JSON null. Objects and arrays have a row
    themselves, and one for each value in them down to DEPTH levels.
    """
    return _typed(_exploded(documents))


def file_schemas(documents: DataFrame) -> DataFrame:
    """(`schemapath`, `fileseq`, `field`, `kind`, `kinds`, `filled`) per field of a file; a null field stands for the file itself.

    `kind` is the kind of most non-null values (the first in KINDS among equals, null if there are
    none), `kinds` maps every kind that occurs to its count: the alternatives of the tagged union.
    """
    counted = cells(documents).groupBy("schemapath", "fileseq", "field").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS))
    present = F.filter(F.array(*(F.struct(F.col(k).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS))), lambda x: x["n"] > 0)
    return counted.select("schemapath", "fileseq", "field", F.array_max(present)["kind"].alias("kind"), F.map_from_entries(F.transform(present, lambda x: F.struct(x["kind"], x["n"]))).alias("kinds"), sum(F.col(k) for k in KINDS).alias("filled"))


def alternatives(documents: DataFrame) -> DataFrame:
    """(`schemapath`, `fileseq`, `field`, `kind`, `change`, `n`): kinds of value that appear in or leave a field that the file before has too.

    `n` is how many values of the file, or for `leaves` of the file before, are of that kind, repeated
    rows counted. Every alternative counts, however rare, also where the kind of most values stays.
    """
    schemas = settle(file_schemas(documents.where("schemapath IS NOT NULL AND fileseq IS NOT NULL")).where("field IS NOT NULL").select("schemapath", "fileseq", "field", "kinds"))
    before = schemas.select("schemapath", (F.col("fileseq") + 1).alias("fileseq"), "field", F.col("kinds").alias("__before"))
    both = schemas.join(before, ["schemapath", "fileseq", "field"])

    def differing(here: str, there: str, change: str) -> Column:
        only = F.filter(F.map_entries(here), lambda e: ~F.map_contains_key(there, e["key"]))
        return F.transform(only, lambda e: F.struct(e["key"].alias("kind"), F.lit(change).alias("change"), e["value"].alias("n")))

    return both.select("schemapath", "fileseq", "field", F.inline(F.concat(differing("kinds", "__before", "appears"), differing("__before", "kinds", "leaves"))))


def _comparable(value: str) -> F.Column:
    """A value's form for comparison between columns of other types: 17, 17.0 and "17" are equal."""
    number = F.col(value).try_cast("double")
    return F.coalesce(number.cast("string"), F.trim(value))


_PAIRS = T.StructType([T.StructField("schemapath", T.StringType()), T.StructField("fileseq", T.IntegerType()), T.StructField("oldfield", T.StringType()), T.StructField("newfield", T.StringType())])


def _assign(pairs):
    """One-to-one renames of one file: the pair with most equal values first."""
    old, new, rows = set(), set(), []
    for p in pairs.sort_values(["matched", "oldfield", "newfield"], ascending=[False, True, True]).itertuples():
        if p.oldfield not in old and p.newfield not in new:
            old.add(p.oldfield)
            new.add(p.newfield)
            rows.append(p.Index)
    return pairs.loc[rows, ["schemapath", "fileseq", "oldfield", "newfield"]]


def changes(documents: DataFrame, carried: float = 0.5) -> DataFrame:
    """(`schemapath`, `fileseq`, `changetype`, `oldfield`, `newfield`) for each change against file `fileseq` - 1.

    Fields are renamed if more than `carried` of the non-null old values, in documents (`docpointer`)
    that both files have, stand under the new name; each field takes part in one rename at most, the
    one with most equal values. A file without a file before it, and rows without schemapath or
    fileseq, show no changes. Repeated rows change nothing. Empty input gives no rows. What files and fields
    are concerned is found by jobs run while the plan is built.
    """
    schemas = settle(file_schemas(documents.where("schemapath IS NOT NULL AND fileseq IS NOT NULL")))
    fields = schemas.where("field IS NOT NULL").select("schemapath", "fileseq", "field", "kind")
    files = schemas.select("schemapath", "fileseq").distinct()
    after = F.col("fileseq") + 1
    followed = files.join(files.select("schemapath", after.alias("fileseq")), ["schemapath", "fileseq"], "left_semi")
    now = fields.join(followed, ["schemapath", "fileseq"], "left_semi")
    before = fields.select("schemapath", after.alias("fileseq"), "field", F.col("kind").alias("oldkind"), F.lit(True).alias("was")).join(followed, ["schemapath", "fileseq"], "left_semi")
    both = settle(now.withColumn("is", F.lit(True)).join(before, ["schemapath", "fileseq", "field"], "full"))
    arrived = both.where("was IS NULL").select("schemapath", "fileseq", F.col("field").alias("newfield"))
    left = both.where("`is` IS NULL").select("schemapath", "fileseq", F.col("field").alias("oldfield"))
    mixed = if_small(settle(arrived.select("schemapath", "fileseq").distinct().join(left.select("schemapath", "fileseq").distinct(), ["schemapath", "fileseq"])))

    wanted_old = left.join(mixed, ["schemapath", "fileseq"], "left_semi").select("schemapath", (F.col("fileseq") - 1).alias("fileseq"), F.col("oldfield").alias("field"), F.lit("old").alias("side"))
    wanted_new = arrived.join(mixed, ["schemapath", "fileseq"], "left_semi").select("schemapath", "fileseq", F.col("newfield").alias("field"), F.lit("new").alias("side"))
    wanted = if_small(settle(wanted_old.unionByName(wanted_new)))
    concerned = if_small(settle(mixed.unionByName(mixed.select("schemapath", (F.col("fileseq") - 1).alias("fileseq"))).distinct()))
    again = documents.where("docpointer IS NOT NULL").join(concerned, ["schemapath", "fileseq"], "left_semi").select("schemapath", "fileseq", "docpointer", "elements")
    asked = _typed(_exploded(again).join(wanted, ["schemapath", "fileseq", "field"])).where("kind IS NOT NULL")
    moved = settle(asked.select("schemapath", "fileseq", "field", "docpointer", "side", _comparable("value").alias("value")).distinct())
    shared = _documents_in_both(documents, mixed)
    old = moved.where("side = 'old'").select("schemapath", after.alias("fileseq"), "docpointer", F.col("field").alias("oldfield"), "value").join(shared, ["schemapath", "fileseq", "docpointer"], "left_semi")
    new = moved.where("side = 'new'").select("schemapath", "fileseq", "docpointer", F.col("field").alias("newfield"), "value")
    filled = old.groupBy("schemapath", "fileseq", "oldfield").agg(F.countDistinct("docpointer").alias("filled"))
    matched = old.join(new, ["schemapath", "fileseq", "docpointer", "value"]).groupBy("schemapath", "fileseq", "oldfield", "newfield").agg(F.countDistinct("docpointer").alias("matched"))
    likely = matched.join(filled, ["schemapath", "fileseq", "oldfield"]).where(F.col("matched") > carried * F.col("filled"))
    renames = settle(likely.groupBy("schemapath", "fileseq").applyInPandas(_assign, _PAIRS))

    def row(frame: DataFrame, kind: str, oldfield: str, newfield: str) -> DataFrame:
        return frame.select("schemapath", "fileseq", F.lit(kind).alias("changetype"), F.expr(oldfield).alias("oldfield"), F.expr(newfield).alias("newfield"))

    return (
        row(renames, "renamed", "oldfield", "newfield")
        .unionByName(row(arrived.join(renames, ["schemapath", "fileseq", "newfield"], "left_anti"), "added", "''", "newfield"))
        .unionByName(row(left.join(renames, ["schemapath", "fileseq", "oldfield"], "left_anti"), "removed", "oldfield", "''"))
        .unionByName(row(both.where("was AND `is` AND kind <> oldkind"), "retyped", "field", "field"))
    )


def _documents_in_both(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that a file of `mixed` shares with the file before it."""
    known = documents.where("docpointer IS NOT NULL").select("schemapath", "fileseq", "docpointer")
    here = known.join(mixed, ["schemapath", "fileseq"], "left_semi").distinct()
    there = known.select("schemapath", (F.col("fileseq") + 1).alias("fileseq"), "docpointer").join(mixed, ["schemapath", "fileseq"], "left_semi")
    return here.join(there, ["schemapath", "fileseq", "docpointer"], "left_semi")


_NAMES = T.StructType([T.StructField("schemapath", T.StringType()), T.StructField("fromseq", T.IntegerType()), T.StructField("toseq", T.IntegerType()), T.StructField("field", T.StringType()), T.StructField("column", T.StringType())])


def _follow(renames):
    """Per name of one schemapath, the files in which it stands for which column; only renames are looked at, not data."""
    path, rows, current = renames["schemapath"].iloc[0], [], {}
    for seq, group in renames.sort_values("fileseq").groupby("fileseq"):
        moved = {}
        for p in group.sort_values("oldfield").itertuples():
            since, column = current.pop(p.oldfield, (None, p.oldfield))
            if since is not None:
                rows.append((path, since, int(seq) - 1, p.oldfield, column))
            moved[p.newfield] = (int(seq), column)
        for name, at in moved.items():
            if name in current:
                since, column = current[name]
                rows.append((path, since, int(seq) - 1, name, column))
            current[name] = at
    rows += [(path, since, 2**31 - 1, name, column) for name, (since, column) in current.items()]
    import pandas as pd

    return pd.DataFrame(rows, columns=[f.name for f in _NAMES])


def unified(documents: DataFrame, carried: float = 0.5) -> DataFrame:
    """All documents' cells in one consistent table, with a typed branch per kind.

    (`schemapath`, `fileseq`, `docpointer`, `column`, `field`, `kind`, `v_whole`, `v_fraction`, `v_truth`,
    `v_text`, `canonical`), one row per distinct non-null cell. `column` is the name a field had
    before all its renames; of the branches the one of the value's kind is filled, and `canonical` is
    the value in one notation: numbers without a needless fraction, truth values as true/false, text trimmed.
    """
    renames = changes(documents, carried).where("changetype = 'renamed'").select("schemapath", "fileseq", "oldfield", "newfield")
    names = settle(renames.groupBy("schemapath").applyInPandas(_follow, _NAMES))
    found = cells(documents).where("kind IS NOT NULL").select("schemapath", "fileseq", "docpointer", "field", "kind", "value").distinct()
    named = found.alias("c").join(if_small(names).alias("n"), F.expr("c.schemapath = n.schemapath AND c.field = n.field AND c.fileseq BETWEEN n.fromseq AND n.toseq"), "left")
    number = F.expr("try_cast(c.value AS double)")
    canonical = F.when(F.col("c.kind").isin("whole", "fraction") & (number == F.expr("try_cast(c.value AS bigint)")), F.expr("cast(try_cast(c.value AS bigint) AS string)")).otherwise(F.trim("c.value"))
    return named.select(
        "c.schemapath", "c.fileseq", "c.docpointer", F.coalesce("n.column", "c.field").alias("column"), "c.field", "c.kind",
        F.expr("CASE WHEN c.kind = 'whole' THEN try_cast(c.value AS bigint) END").alias("v_whole"),
        F.expr("CASE WHEN c.kind = 'fraction' THEN try_cast(c.value AS double) END").alias("v_fraction"),
        F.expr("CASE WHEN c.kind = 'truth' THEN try_cast(c.value AS boolean) END").alias("v_truth"),
        F.expr("CASE WHEN c.kind IN ('text', 'object', 'array') THEN c.value END").alias("v_text"), canonical.alias("canonical"),
    )
