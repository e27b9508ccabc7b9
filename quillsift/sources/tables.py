"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str, spread: bool = True) -> DataFrame:
    """A Parquet table. One of fewer files than there are cores is dealt out to all of them, since a small file is a
    single task; a large table is read as it lies."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < 4 * cores and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
