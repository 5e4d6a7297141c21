"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where the session has none (tests, one machine)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = os.path.join(tempfile.gettempdir(), f"inkwell-{os.getuid()}-{spark.sparkContext.applicationId}")
    return f"file://{own}"


def application_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/inkwell/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete the application's folder. Results are lazy, so call it after they have been read or written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the application's folder and read it back: cuts the lineage and survives lost executors. It stays until ``clear``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if a bounded count shows that it has ``rows`` rows at most; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
