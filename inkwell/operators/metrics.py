"""Metrics of runs: rows, failures and time of an action, gathered while it runs, and kept as a table of metric events."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "metric_name string, ts timestamp, status string, n long, failed long, duration_ms double, detail string"


class Meter:
    """Metric events below a path. Rows are counted by observations, so no data is scanned for them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.rows = spark, path.rstrip("/"), []

    def record(self, name: str, status: str, n: int = 0, failed: int = 0, duration_ms: float = 0.0, detail: str | None = None) -> None:
        self.rows.append((name, datetime.now(timezone.utc), status, n, failed, float(duration_ms), detail))

    def flush(self) -> None:
        """Append what was recorded: one row for each action or micro-batch."""
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], object], failed: Column | None = None):
        """action(df), measured: its rows, those for which ``failed`` holds, its time, and how it ended. Errors go on."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
        watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failed"))
        began = time.perf_counter()
        try:
            out = action(watched)
        except Exception as e:
            self.record(name, "failure", duration_ms=1000 * (time.perf_counter() - began), detail=f"{type(e).__name__}: {e}"[:512])
            raise
        got = seen.get
        self.record(name, "success", got["n"], got["failed"], 1000 * (time.perf_counter() - began))
        return out

    def captured(self, name: str) -> Callable:
        """A decorator: time and outcome of every call of a function."""

        def around(f: Callable) -> Callable:
            @functools.wraps(f)
            def call(*args, **kwargs):
                began = time.perf_counter()
                try:
                    out = f(*args, **kwargs)
                except Exception as e:
                    self.record(name, "failure", duration_ms=1000 * (time.perf_counter() - began), detail=f"{type(e).__name__}: {e}"[:512])
                    raise
                self.record(name, "success", duration_ms=1000 * (time.perf_counter() - began))
                return out

            return call

        return around


class StreamMeter(StreamingQueryListener):
    """Every micro-batch of the session's streams as a metric event: its rows and how long it took."""

    def __init__(self, meter: Meter):
        self.meter = meter

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.meter.record(f"stream:{p.name or p.id}", "success", p.numInputRows, 0, p.batchDuration, f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.meter.record(f"stream:{event.id}", "failure", detail=str(event.exception)[:512])
