"""Queries over text corpora (p2, p3, p7, p8, p9), and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.llm import components, langid, leakage, lookalike, mixture
from papyrion.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "wl_word"), "id", "text", "languageid")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "wl_word"), "text", "languageid")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups(table(spark, d, "wl_synonym"), "sourcewordid", "targetwordid")


LANGUAGES = ["de", "en", "es", "fi", "fr", "it", "nl", "pt", "ru", "sv"]


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return langid.stretches(documents, langid.learn(documents, LANGUAGES))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.wrong_labels(_stretches(spark, d))


def p9_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).select("doc_id", "lang", "first_cue", "last_cue", F.round("confidence", 4).alias("confidence"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "evalitem"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "itemid").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


#: Sources whose weight changes over the training; all others keep theirs.
SCHEDULES = {"lecture_caps": [(0.0, 0.4), (1.0, 1.6)], "festival_set": [(0.0, 0.5), (1.0, 1.5)], "stream_dump": [(0.0, 1.4), (0.5, 1.2), (0.8, 0.3), (1.0, 0.3)]}


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixtarget"), SCHEDULES)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixtarget"), SCHEDULES)[1]


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(_stretches(spark, d)).withColumn("confidence", F.round("confidence", 4))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("groupid").agg(F.count(F.lit(1)).alias("n_words"))


QUERIES = {f.__name__: f for f in (p2_found, p2_canonical, p3_found, p3_group_sizes, p7_found, p7_passages, p8_mix, p8_shares, p9_found, p9_stretches, p9_documents)}

# What the word table holds of look-alikes, stated for SQL apart from the operator's own rules.
_SHAPES = ("аеорсухѕіјһԁѵӏАВЕКМНОРСТУХЅІЈαιορυνΑΒΕΖΗΙΚΜΝΟΡΤΥΧɡ", "aeopcyxsijhdvlABEKMHOPCTYXSIJaiopuvABEZHIKMNOPTYXg")
_ACCENTED = ("ёїѐёЁЇόάίύϊϋ", "ëïèëËÏóáíúïü")
_INVISIBLE = "173, 847, 1564, 6158, 8203, 8204, 8205, 8206, 8207, 8234, 8235, 8236, 8237, 8238, 8288, 8289, 8290, 8291, 8292, 65279"


def _skeleton_sql() -> str:
    """A look-alike form of the column text as SQL over its characters: widths by arithmetic, spaces and invisible ones by number."""
    one = f"""CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c)::INTEGER - 65248) WHEN unicode(c) IN (160, 5760, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' '
      WHEN unicode(c) IN ({_INVISIBLE}) THEN '' WHEN c = 'ﬀ' THEN 'ff' WHEN c = 'ﬁ' THEN 'fi' WHEN c = 'ﬂ' THEN 'fl' WHEN c = 'ﬃ' THEN 'ffi' WHEN c = 'ﬄ' THEN 'ffl' WHEN c IN ('ﬅ', 'ﬆ') THEN 'st'
      WHEN unicode(c) = 8490 THEN 'K' WHEN unicode(c) = 8491 THEN 'Å' ELSE translate(c, '{_SHAPES[0] + _ACCENTED[0]}', '{_SHAPES[1] + _ACCENTED[1]}') END"""
    return f"list_aggregate(list_transform(string_split(text, ''), lambda c: {one}), 'string_agg', '')"


_VALUES = f"""values_ AS (SELECT DISTINCT languageid, text, {_skeleton_sql()} AS s FROM wl_word WHERE languageid IS NOT NULL AND text IS NOT NULL), keyed AS (SELECT *, nfc_normalize(s) AS k FROM values_)"""
_LINKS = "links AS (SELECT DISTINCT sourcewordid AS a, targetwordid AS b FROM wl_synonym WHERE sourcewordid IS NOT NULL AND targetwordid IS NOT NULL), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links)"

SQL: dict[str, str] = {
    "p2_found": f"WITH {_VALUES}, w AS (SELECT DISTINCT id, languageid, text, k FROM wl_word JOIN keyed USING (languageid, text)) SELECT DISTINCT a.id AS wordid_a, b.id AS wordid_b FROM w a JOIN w b ON b.languageid = a.languageid AND b.k = a.k WHERE a.id < b.id AND a.text <> b.text",
    "p2_canonical": f"WITH {_VALUES}, classes AS (SELECT languageid, k, arg_min(text, (s <> text, length(text), text)) AS canonical, count(*) AS n_texts FROM keyed GROUP BY ALL) SELECT languageid, text, canonical, n_texts FROM keyed JOIN classes USING (languageid, k)",
    "p3_found": f"WITH RECURSIVE {_LINKS}, groups_(id, g) USING KEY (id) AS (SELECT a, a FROM both_ways UNION (SELECT e.b, min(x.g) FROM groups_ x JOIN both_ways e ON e.a = x.id JOIN recurring.groups_ y ON y.id = e.b WHERE x.g < y.g GROUP BY e.b)) SELECT id AS wordid, g AS groupid FROM groups_",
}
SQL["p3_group_sizes"] = f"SELECT groupid, count(*) AS n_words FROM ({SQL['p3_found']}) GROUP BY groupid"
