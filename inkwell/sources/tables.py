"""Parquet tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``sf_dir/name.parquet`` as Spark's reader finds it (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where fewer than half as many partitions hold rows; others stay as they are.

    A large file is planned as many splits, but all rows of a row group come in one: so the splits with rows are counted, of a table by its footers alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() * 2 <= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() * 2 <= cores
    return df.repartition(cores) if few else df
