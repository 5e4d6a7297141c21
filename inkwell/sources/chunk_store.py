"""The chunk table as a sink: batches that replace whole documents, committed at once or not at all.

Folders below the path: ``chunks/batch=<number>/repository_id=<id>`` and ``documents/batch=<number>`` (which documents a batch
replaces), and ``commits``, one row a batch, written last. Readers look at committed batches only, and for each document at
the last one that names it; so a batch that fails, or is cut off, leaves the table as it was. Spark's own writers do the
work, so the path may lie in any store that Spark writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkStore:
    """Chunks (repository_id, document_id, chunk_id, embedding, is_duplicate and more) with vectors of one dimension."""

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension

    def _commits(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        return sorted(r["batch"] for r in self.spark.read.schema("batch long, chunks long").parquet(f"{self.path}/commits").collect())

    def replace(self, chunks: DataFrame) -> int:
        """A batch: its documents lose their old chunks. Duplicates and chunks without a vector stay out; repeated ids count once.

        A vector of another dimension fails the whole batch. A document all of whose chunks stay out is left without any.
        """
        batch = max(self._commits(), default=-1) + 1
        fine = chunks.where(~F.coalesce("is_duplicate", F.lit(False)) & F.col("embedding").isNotNull())
        wrong = F.raise_error(F.concat(F.lit(f"not of dimension {self.dimension}: chunk "), F.coalesce(F.col("chunk_id").cast("string"), F.lit("null"))))
        checked = F.when(F.size("embedding") == self.dimension, F.col("embedding")).otherwise(wrong.cast("array<double>"))
        rows = fine.withColumn("embedding", checked).withColumn("key", F.sha2(F.col("chunk_id").cast("string"), 256)).dropDuplicates(["key"])
        rows.write.mode("overwrite").partitionBy("repository_id").parquet(f"{self.path}/chunks/batch={batch}")
        chunks.select("document_id").where("document_id is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch}")
        n = self.spark.read.parquet(f"{self.path}/chunks/batch={batch}").count()
        self.spark.createDataFrame([(batch, n)], "batch long, chunks long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return batch

    def read(self, repository_id=None) -> DataFrame | None:
        """The current chunks; a repository prunes folders. None before the first commit."""
        done = self._commits()
        if not done:
            return None
        named = self.spark.read.parquet(f"{self.path}/documents").where(F.col("batch").isin(done))
        last = named.groupBy("document_id").agg(F.max("batch").alias("batch"))
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/chunks").where(F.col("batch").isin(done))
        rows = rows if repository_id is None else rows.where(F.col("repository_id") == repository_id)
        return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch")

    def compact(self) -> int:
        """The current chunks as one new batch; older folders may then be deleted from outside."""
        return self.replace(self.read().drop("key"))

