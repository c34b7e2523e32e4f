"""What ANALYZE reports about tables and the keys of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analyze_index(frame: DataFrame, fields: list[str]) -> DataFrame:
    """One row on the keys over `fields`: (`keys`, `rows`, `min_rows`, `max_rows`, `avg_rows`, `selectivity`).

    Keys are compared without case and rows with a null in them have none; selectivity is 100 less the
    mean share of a key in percent. Without keys the counts are 0 and the rest null.
    """
    spelled = {c.lower(): c for c in frame.columns}
    columns = [F.lower(F.col(f"`{spelled[f.lower()]}`").cast("string")).alias(f"k{i}") for i, f in enumerate(fields) if f.lower() in spelled]
    keys = frame.select(*columns).na.drop()
    per_key = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.agg(F.count("n").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"))
    return out.withColumn("selectivity", F.when(F.col("rows") > 0, 100 - F.col("avg_rows") / F.col("rows") * 100))


def analyze_schema(frame: DataFrame, page_size: int) -> DataFrame:
    """One row on a table: (`documents`, `pages`, `page_size`, `min_length`, `max_length`, `avg_length`).

    Pages are those a full layout of `page_size` documents would take, lengths the characters of a
    document as JSON. An empty table has no pages and null lengths.
    """
    fields = [F.col(f"`{c}`") for c in frame.columns]
    length = F.length(F.to_json(F.struct(*fields))) if fields else F.lit(2)
    out = frame.select(length.alias("n")).agg(F.count("n").alias("documents"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("avg_length"))
    return out.select("documents", F.ceil(F.col("documents") / F.lit(page_size)).alias("pages"), F.lit(page_size).alias("page_size"), "min_length", "max_length", "avg_length")


def analyze_pages(frame: DataFrame, page_size: int) -> DataFrame:
    """One row per page of a table: (`partition`, `page`, `documents`, `min_length`, `max_length`, `avg_length`).

    A page is `page_size` documents that follow each other in one partition of the scan; the last may hold
    fewer. Nothing is sorted or moved but one state per page. An empty table gives no rows.
    """
    fields = [F.col(f"`{c}`") for c in frame.columns]
    length = F.length(F.to_json(F.struct(*fields))) if fields else F.lit(2)
    rows = frame.select(length.alias("n"), F.monotonically_increasing_id().alias("at"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    keys = F.shiftright("at", 33).cast("int").alias("partition"), F.floor(within / F.lit(page_size)).cast("bigint").alias("page")
    return rows.groupBy(*keys).agg(F.count("n").alias("documents"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.avg("n").alias("avg_length"))
