"""Queries over the general data problems (p1, p4, p5, p6), and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators import attributes, heavy_keys, orphans, schema_drift
from papyrion.sources.tables import table

HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        heavy_keys.heavy_keys(table(spark, d, name), field, HEAVY_SHARE).select(F.lit(name).alias("tablename"), F.lit(field).alias("fieldname"), F.col("keyvalue").cast("bigint").alias("keyvalue"))
        for name, field in (("wl_word", "languageid"), ("wl_synonym", "sourcewordid"))
    ]
    return parts[0].unionByName(parts[1])


def p1_words_by_language(spark: SparkSession, d: str) -> DataFrame:
    measures = {"n_rows": F.count(F.lit(1)), "n_texts": F.count("text"), "min_id": F.min("id"), "max_id": F.max("id"), "longest": F.max(F.length("text")).cast("bigint"), "first_created": F.min("created"), "last_modified": F.max("modified")}
    return heavy_keys.fold_by_key(table(spark, d, "wl_word"), ["languageid"], measures, {"n_ids": "id"})


def p1_synonyms_by_source(spark: SparkSession, d: str) -> DataFrame:
    measures = {"n_rows": F.count(F.lit(1)), "sum_confidence": F.sum("confidence"), "n_confidence": F.count("confidence"), "min_target": F.min("targetwordid"), "max_target": F.max("targetwordid")}
    return heavy_keys.fold_by_key(table(spark, d, "wl_synonym"), ["sourcewordid"], measures, {"n_targets": "targetwordid"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "physicaldocument"))


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.unified(table(spark, d, "physicaldocument"))


def p4_file_schemas(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.file_schemas(table(spark, d, "physicaldocument")).where("field IS NOT NULL").select("schemapath", "fileseq", "field", "kind", F.col("filled").cast("bigint").alias("filled"))


def p4_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.alternatives(table(spark, d, "physicaldocument"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    word, synonym, soundmap, translation = (table(spark, d, f"wl_{n}") for n in ("word", "synonym", "soundmap", "translation"))
    log = table(spark, d, "wl_deletion")
    references = [
        orphans.Reference(synonym, "wl_synonym", "targetwordid", "sourcewordid", "targetwordid", "word"),
        orphans.Reference(soundmap, "wl_soundmap", "wordid", "id", "wordid", "word"),
        orphans.Reference(translation, "wl_translation", "sourcewordid", "targetwordid", "sourcewordid", "word"),
        orphans.Reference(word, "wl_word", "languageid", "id", "languageid", "language"),
    ]
    parents = {"word": (word, "id", "created"), "language": (table(spark, d, "wl_language"), "id", "created")}
    deleted = {"word": (log.where("schemapath = 'WordList:Word'"), "id"), "language": (log.where("schemapath = 'WordList:Language'"), "id")}
    return orphans.orphans(references, parents, deleted)


def p5_per_month(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("tablename", "fieldname", "reason", "refmonth").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("refkey").alias("n_keys"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "elementtype")
    return attributes.filled_cells(attributes.widen(table(spark, d, "documentelement"), types), types).select("documentid", "elementname", "typedvalue").distinct()


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    return attributes.widen(table(spark, d, "documentelement"), table(spark, d, "elementtype"))


QUERIES = {f.__name__: f for f in (p1_found, p1_words_by_language, p1_synonyms_by_source, p4_found, p4_unified, p4_file_schemas, p4_alternatives, p5_found, p5_per_month, p6_found, p6_wide)}

_KINDS = "CASE json_type(value) WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole' WHEN 'DOUBLE' THEN 'fraction' WHEN 'BOOLEAN' THEN 'truth' WHEN 'VARCHAR' THEN 'text' END"
_CELLS = f"""cells AS (
  SELECT schemapath, fileseq, docpointer, lower(key) AS field, {_KINDS} AS kind, json_extract_string(value, '$') AS value
  FROM (SELECT DISTINCT schemapath, fileseq, docpointer, elements FROM physicaldocument), json_each(elements))"""
_FILE_SCHEMAS = f"""{_CELLS}, counted AS (
  SELECT schemapath, fileseq, field, kind, count(*) AS n FROM cells GROUP BY ALL), fields AS (
  SELECT schemapath, fileseq, field, arg_max(kind, n) FILTER (WHERE kind IS NOT NULL) AS kind FROM counted GROUP BY ALL), files AS (
  SELECT DISTINCT schemapath, fileseq FROM physicaldocument)"""
_RENAMED = f"""{_FILE_SCHEMAS}, followed AS (
  SELECT f.schemapath, f.fileseq FROM files f JOIN files g ON g.schemapath = f.schemapath AND g.fileseq = f.fileseq - 1), arrived AS (
  SELECT a.* FROM fields a SEMI JOIN followed USING (schemapath, fileseq) ANTI JOIN fields b ON b.schemapath = a.schemapath AND b.fileseq = a.fileseq - 1 AND b.field = a.field), gone AS (
  SELECT b.schemapath, b.fileseq + 1 AS fileseq, b.field FROM fields b JOIN followed f ON f.schemapath = b.schemapath AND f.fileseq = b.fileseq + 1 ANTI JOIN fields a ON a.schemapath = b.schemapath AND a.fileseq = b.fileseq + 1 AND a.field = b.field), held AS (
  SELECT DISTINCT schemapath, fileseq, docpointer FROM physicaldocument), old AS (
  SELECT g.schemapath, g.fileseq, g.field, c.docpointer, c.value FROM gone g JOIN cells c ON c.schemapath = g.schemapath AND c.fileseq = g.fileseq - 1 AND c.field = g.field AND c.kind IS NOT NULL
  SEMI JOIN held h ON h.schemapath = g.schemapath AND h.fileseq = g.fileseq AND h.docpointer = c.docpointer), filled AS (
  SELECT schemapath, fileseq, field, count(DISTINCT docpointer) AS n FROM old GROUP BY ALL), renamed AS (
  SELECT o.schemapath, o.fileseq, o.field AS oldfield, a.field AS newfield FROM old o JOIN arrived a ON a.schemapath = o.schemapath AND a.fileseq = o.fileseq
  JOIN cells c ON c.schemapath = a.schemapath AND c.fileseq = a.fileseq AND c.field = a.field AND c.docpointer = o.docpointer AND c.value = o.value
  JOIN filled f ON f.schemapath = o.schemapath AND f.fileseq = o.fileseq AND f.field = o.field GROUP BY ALL HAVING count(DISTINCT o.docpointer) > 0.5 * any_value(f.n))"""
_CHANGES = f"""WITH {_RENAMED}
SELECT schemapath, fileseq, 'renamed' AS changetype, oldfield, newfield FROM renamed UNION ALL
SELECT schemapath, fileseq, 'added', '', field FROM arrived a ANTI JOIN renamed r ON r.schemapath = a.schemapath AND r.fileseq = a.fileseq AND r.newfield = a.field UNION ALL
SELECT schemapath, fileseq, 'removed', field, '' FROM gone g ANTI JOIN renamed r ON r.schemapath = g.schemapath AND r.fileseq = g.fileseq AND r.oldfield = g.field UNION ALL
SELECT a.schemapath, a.fileseq, 'retyped', a.field, a.field FROM fields a JOIN fields b ON b.schemapath = a.schemapath AND b.fileseq = a.fileseq - 1 AND b.field = a.field WHERE a.kind <> b.kind"""

# A name is followed back from file to file: to the last rename into it, unless it was renamed away since.
_UNIFIED = f"""WITH RECURSIVE {_RENAMED}, moves AS (
  SELECT schemapath, fileseq, oldfield AS name, false AS into_ FROM renamed UNION ALL SELECT schemapath, fileseq, newfield, true FROM renamed), walk AS (
  SELECT DISTINCT schemapath, fileseq, field, field AS name, fileseq AS upto FROM cells WHERE kind IS NOT NULL UNION
  SELECT w.schemapath, w.fileseq, w.field, r.oldfield, r.fileseq - 1 FROM walk w JOIN renamed r ON r.schemapath = w.schemapath AND r.newfield = w.name AND r.fileseq <= w.upto
  WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE m.schemapath = w.schemapath AND m.name = w.name AND m.fileseq > r.fileseq AND m.fileseq <= w.upto)), named AS (
  SELECT schemapath, fileseq, field, arg_min(name, upto) AS col FROM walk GROUP BY ALL)
SELECT DISTINCT c.schemapath, c.fileseq, c.docpointer, n.col AS "column", c.field, c.kind, CASE c.kind WHEN 'whole' THEN TRY_CAST(c.value AS BIGINT) END AS v_whole, CASE c.kind WHEN 'fraction' THEN TRY_CAST(c.value AS DOUBLE) END AS v_fraction,
  CASE c.kind WHEN 'truth' THEN TRY_CAST(c.value AS BOOLEAN) END AS v_truth, CASE c.kind WHEN 'text' THEN c.value END AS v_text,
  CASE WHEN c.kind IN ('whole', 'fraction') AND TRY_CAST(c.value AS DOUBLE) = trunc(TRY_CAST(c.value AS DOUBLE)) THEN TRY_CAST(c.value AS DOUBLE)::BIGINT::VARCHAR ELSE trim(c.value) END AS canonical
FROM cells c JOIN named n USING (schemapath, fileseq, field) WHERE c.kind IS NOT NULL"""
_EVERY_ROW = _FILE_SCHEMAS.replace("SELECT DISTINCT schemapath, fileseq, docpointer, elements FROM physicaldocument", "SELECT schemapath, fileseq, docpointer, elements FROM physicaldocument")


def _alternatives_of(change: str, here: str, there: str) -> str:
    """Kinds of `here` that `there` lacks in fields of both; "a" is a file, "b" the one before."""
    return f"""SELECT a.schemapath, a.fileseq, a.field, x.kind, '{change}' AS change, x.n FROM fields a JOIN fields b ON b.schemapath = a.schemapath AND b.fileseq = a.fileseq - 1 AND b.field = a.field
  JOIN counted x ON x.schemapath = {here}.schemapath AND x.fileseq = {here}.fileseq AND x.field = {here}.field AND x.kind IS NOT NULL
  WHERE NOT EXISTS (SELECT 1 FROM counted y WHERE y.schemapath = {there}.schemapath AND y.fileseq = {there}.fileseq AND y.field = {there}.field AND y.kind = x.kind)"""


def _orphans_of(tablename: str, fieldname: str, rowkey: str, parent: str, log: str) -> str:
    return f"""SELECT '{tablename}' AS tablename, '{fieldname}' AS fieldname, r.{rowkey}::BIGINT AS rowkey, r.{fieldname}::BIGINT AS refkey,
  CASE WHEN p.id IS NOT NULL THEN 'late' WHEN d.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason, strftime(r.created, '%Y-%m') AS refmonth
  FROM {tablename} r LEFT JOIN (SELECT id, min(created) AS first FROM {parent} GROUP BY id) p ON p.id = r.{fieldname}
  LEFT JOIN (SELECT DISTINCT id FROM wl_deletion WHERE schemapath = '{log}') d ON d.id = r.{fieldname}
  WHERE r.{fieldname} IS NOT NULL AND (p.id IS NULL OR p.first > r.created)"""


_ORPHANS = " UNION ".join(
    (
        _orphans_of("wl_synonym", "targetwordid", "sourcewordid", "wl_word", "WordList:Word"),
        _orphans_of("wl_soundmap", "wordid", "id", "wl_word", "WordList:Word"),
        _orphans_of("wl_translation", "sourcewordid", "targetwordid", "wl_word", "WordList:Word"),
        _orphans_of("wl_word", "languageid", "id", "wl_language", "WordList:Language"),
    )
)
_TYPED = r"""
  CASE t WHEN 'string' THEN v
  WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 't', 'yes', 'y', 'on', '1') THEN 'true' WHEN lower(v) IN ('false', 'f', 'no', 'n', 'off', '0') THEN 'false' END
  WHEN 'bigint' THEN CASE WHEN regexp_full_match(v, '[+-]?\d+(\.0*)?') THEN regexp_replace(v, '\.0*$', '')::BIGINT::VARCHAR WHEN regexp_full_match(v, '[+-]?\d{1,3}(,\d{3})+') THEN replace(v, ',', '')::BIGINT::VARCHAR END
  WHEN 'double' THEN TRY_CAST(TRY_CAST(CASE WHEN regexp_full_match(v, '[+-]?\d{1,3}(,\d{3})+\.\d+') THEN replace(v, ',', '') WHEN regexp_full_match(v, '[+-]?\d{1,3}(\.\d{3})+,\d+') THEN replace(replace(v, '.', ''), ',', '.')
    WHEN regexp_full_match(v, '[+-]?\d+,\d{2}') THEN replace(v, ',', '.') WHEN regexp_full_match(v, '[+-]?\d+(\.\d*)?([eE][+-]?\d+)?') THEN v END AS DOUBLE) AS DECIMAL(38, 2))::VARCHAR
  WHEN 'date' THEN strftime(CASE WHEN regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}(T\d\d:\d\d:\d\d)?') THEN TRY_CAST(left(v, 10) AS DATE) WHEN regexp_full_match(v, '\d{4}/\d{1,2}/\d{1,2}') THEN try_strptime(v, '%Y/%m/%d')::DATE
    WHEN regexp_full_match(v, '\d{1,2}\.\d{1,2}\.\d{4}') THEN try_strptime(v, '%d.%m.%Y')::DATE WHEN regexp_full_match(v, '\d{8}') THEN try_strptime(v, '%Y%m%d')::DATE WHEN regexp_full_match(v, '\d{1,2} [A-Za-z]{3} \d{4}') THEN try_strptime(v, '%d %b %Y')::DATE END, '%Y-%m-%d') END"""
_BEST = """best AS (
  SELECT d.schemapath, d.documentid, lower(trim(d.elementname, E' \t\n')) AS name, e.typename AS t, nullif(trim(arg_max({'v': d.elementvalue}, (d.modified, d.created, coalesce(d.elementvalue, ''))).v, E' \t\n'), '') AS v
  FROM documentelement d JOIN elementtype e ON e.schemapath = d.schemapath AND lower(e.elementname) = lower(trim(d.elementname, E' \t\n')) GROUP BY ALL)"""
# The declared attributes by type.
_DECLARED = {
    "bigint": "addressid itemcount loyaltypoints orderid orderitemid personid quantity",
    "boolean": "isactive isgift ispaid isprimary",
    "date": "birthdate membersince movedin orderdate packedon shippedon",
    "double": "discount freight heightcm price rent totalamount",
    "string": "channel city colour firstname lastname note productname state street zipcode",
}
_WIDE = f"""WITH {_BEST}, typed AS (SELECT schemapath, documentid, name, {_TYPED} AS value FROM best)
SELECT d.schemapath, d.documentid, {", ".join(f"max(value) FILTER (WHERE name = '{n}')::{t.upper().replace('STRING', 'VARCHAR')} AS {n}" for t, names in _DECLARED.items() for n in names.split())}
FROM (SELECT DISTINCT schemapath, documentid FROM documentelement WHERE schemapath IS NOT NULL AND documentid IS NOT NULL) d LEFT JOIN typed t ON t.schemapath = d.schemapath AND t.documentid = d.documentid GROUP BY ALL"""

SQL: dict[str, str] = {
    "p1_found": " UNION ALL ".join(f"SELECT '{t}' AS tablename, '{f}' AS fieldname, {f}::BIGINT AS keyvalue FROM {t} WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM {t})" for t, f in (("wl_word", "languageid"), ("wl_synonym", "sourcewordid"))),
    "p1_words_by_language": "SELECT languageid, count(*) AS n_rows, count(text) AS n_texts, min(id) AS min_id, max(id) AS max_id, max(length(text))::BIGINT AS longest, min(created) AS first_created, max(modified) AS last_modified, count(DISTINCT id) AS n_ids FROM wl_word GROUP BY languageid",
    "p1_synonyms_by_source": "SELECT sourcewordid, count(*) AS n_rows, sum(confidence)::BIGINT AS sum_confidence, count(confidence) AS n_confidence, min(targetwordid) AS min_target, max(targetwordid) AS max_target, count(DISTINCT targetwordid) AS n_targets FROM wl_synonym GROUP BY sourcewordid",
    "p4_found": _CHANGES,
    "p4_file_schemas": f"WITH {_EVERY_ROW} SELECT schemapath, fileseq, field, kind, (SELECT coalesce(sum(n), 0) FROM counted c WHERE c.schemapath = fields.schemapath AND c.fileseq = fields.fileseq AND c.field = fields.field AND c.kind IS NOT NULL)::BIGINT AS filled FROM fields",
    "p4_alternatives": f"WITH {_EVERY_ROW} {_alternatives_of('appears', 'a', 'b')} UNION ALL {_alternatives_of('leaves', 'b', 'a')}",
    "p4_unified": _UNIFIED,
    "p5_found": _ORPHANS,
    "p5_per_month": f"SELECT tablename, fieldname, reason, refmonth, count(*) AS n_references, count(DISTINCT refkey) AS n_keys FROM ({_ORPHANS}) GROUP BY ALL",
    "p6_wide": _WIDE,
    "p6_found": f"WITH {_BEST} SELECT DISTINCT documentid, name AS elementname, typedvalue FROM (SELECT documentid, name, {_TYPED} AS typedvalue FROM best) WHERE typedvalue IS NOT NULL",
}
