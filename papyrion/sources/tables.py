"""Reading the Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """`name` as it lies in `directory`, one Parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` over as many tasks as there are cores, if its files would keep half of them idle or more.

    For work that costs far more than moving the rows; input in enough files is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df
