"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """A parquet table; one that comes in fewer splits than there are cores is spread over them by a key.

    A large table has many splits and is read as it lies, without that shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is not None and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, spread_by)
    return df
