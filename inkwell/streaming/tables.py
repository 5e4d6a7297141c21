"""Tables that streams keep: upserts by batch number that a repeated batch doesn't apply twice, and days recomputed for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators import observability as obs


class UpsertTable:
    """A table below a path, as batches of changed rows: ``changes/batch=<number>``, and ``base/batch=<number>`` after compaction.

    A batch is written over its own folder, so a stream that repeats a batch after a failure changes nothing. Readers take
    the row of the highest batch for each key, from folders that were finished.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _finished(self, kind: str) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a batch replace those with their keys; a key may occur once in a batch."""
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def read(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        base = self._finished("base")[-1:]
        changes = [b for b in self._finished("changes") if not base or b > base[0]]
        parts = [(f"{self.path}/base/batch={b}", b) for b in base] + [(f"{self.path}/changes/batch={b}", b) for b in changes]
        out = None
        for path, b in parts:
            rows = self.spark.read.parquet(path).withColumn("_batch", F.lit(b))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            return None
        last = Window.partitionBy(*self.keys).orderBy(F.desc("_batch"))
        return out.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_batch")

    def compact(self) -> None:
        """Fold all finished batches into a new base; the batches stay until they are deleted from outside."""
        done, rows = self._finished("changes"), self.read()
        if rows is not None and done:
            rows.write.mode("overwrite").parquet(f"{self.path}/base/batch={done[-1]}")


class DailyTable:
    """Roll-ups by day of a stream of events that may come late: a batch recomputes the days that it touches, and only these.

    Events are kept below ``path/events`` by batch and day, so a repeated batch overwrites itself, and a recomputed day reads
    its own folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = UpsertTable(spark, f"{self.path}/daily", ["day", "metric_name"])

    def events(self, upto: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events").where(F.col("batch") <= upto).drop("batch")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch: events (ts, metric_name, status, duration_ms); those without a time belong to no day."""
        rows = batch.where(F.col("ts").isNotNull()).withColumn("day", F.to_date("ts"))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/events/batch={batch_id}")
        mine = self.spark.read.parquet(f"{self.path}/events").where(F.col("batch") == batch_id)
        days = [r[0] for r in mine.select("day").distinct().collect()]  # folders: as many as the batch has days
        if days:
            self.table.apply(obs.daily_rollup(self.events(batch_id).where(F.col("day").isin(days)).drop("day")), batch_id)

    def read(self) -> DataFrame | None:
        return self.table.read()


def run(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, batch by batch, through apply(batch, batch_id); goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
