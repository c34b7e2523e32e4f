"""Per-key results where a few keys hold most rows.

Every measure offered here is algebraic: each input partition folds its rows into one state per key
(count, sum, minimum, ...) in a hash table that spills when it outgrows its memory, and only those
states are shuffled. A key that holds a third of all rows therefore sends one state per partition,
not its rows, and no task sees more than (partitions x states). Distinct counts are made algebraic by
first folding equal (key, value) pairs, whose states spread over all tasks by the pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_by_key(df: DataFrame, keys: Sequence[str], measures: dict[str, Column], distinct: dict[str, str] | None = None) -> DataFrame:
    """One row per combination of `keys` with the `measures` and the `distinct` counts.

    `measures` maps output names to algebraic aggregates (count, sum, min, max, avg, variance...);
    `distinct` maps output names to columns whose different non-null values are counted exactly.
    Null keys form a key of their own and null values follow SQL's aggregates. An empty table gives
    no rows. Columns that are neither keys nor read by a measure are never carried along.
    """
    folded = df.groupBy(*keys).agg(*(column.alias(name) for name, column in measures.items())) if measures else df.select(*keys).distinct()
    for name, column in (distinct or {}).items():
        pairs = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__value")).agg(F.lit(1).alias("__one"))
        counts = pairs.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.count("__one").alias(name))
        same = [folded[k].eqNullSafe(counts[f"__k{i}"]) for i, k in enumerate(keys)]
        folded = folded.join(counts, same, "left").drop(*(f"__k{i}" for i in range(len(keys)))).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return folded


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(`key`, `n`, `total`) for each non-null key that holds at least `share` of all rows of `df`.

    Rows with a null key count towards the total, repeated rows count each time, and keys exactly at
    the share are in. The total is a scalar subquery that reads no column. An empty table gives no rows.
    """
    counts = df.groupBy(F.col(key).alias("keyvalue")).agg(F.count(F.lit(1)).alias("n"))
    views = {f"__papyrion_counts_{id(counts)}": counts, f"__papyrion_rows_{id(counts)}": df}
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    one, every = views
    try:
        return df.sparkSession.sql(f"SELECT keyvalue, n, (SELECT count(1) FROM {every}) AS total FROM {one} WHERE keyvalue IS NOT NULL AND n >= {share!r}D * (SELECT count(1) FROM {every})")
    finally:
        for name in views:
            df.sparkSession.catalog.dropTempView(name)
