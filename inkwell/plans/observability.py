"""Observability queries; the events table plays the metric and audit events (an error is a failure, value the duration)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import observability as obs
from inkwell.operators.metrics import Meter
from inkwell.plans.registry import query
from inkwell.sources.shared import shared_path, written
from inkwell.sources.tables import table

E = """(SELECT event_id AS id, ts, event_type AS metric_name, CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'view' THEN 'pending' ELSE 'success' END AS status,
 value AS duration_ms, user_id, props AS metadata, json_extract_string(props, '$.k') AS k FROM events)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "pending").otherwise("success")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), status.alias("status"), F.col("value").alias("duration_ms"), "user_id", F.col("props").alias("metadata")
    )


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""SELECT metric_name, count(*) AS n, count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'failure') AS failure_count,
 round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM {E} GROUP BY 1""")
def aggregate_by_metric_name(spark, sf_dir):
    return rounded(obs.aggregate_by_metric_name(events(spark, sf_dir)), "avg_ms")


@query(f"SELECT status, count(*) AS n FROM {E} GROUP BY 1")
def status_counts(spark, sf_dir):
    return obs.status_counts(events(spark, sf_dir))


@query(f"""SELECT metric_name, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, max(duration_ms) AS max_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
 FROM {E} WHERE duration_ms IS NOT NULL GROUP BY 1 ORDER BY avg(duration_ms) DESC, 1 LIMIT 10""")
def top_slow_operations(spark, sf_dir):
    return rounded(obs.top_slow_operations(events(spark, sf_dir)), "avg_ms", "p95_ms")


@query(f"SELECT round(avg(TRY_CAST(nullif(k, '') AS DOUBLE)), 6) AS avg_value, round(sum(TRY_CAST(nullif(k, '') AS DOUBLE)), 4) AS sum_value FROM {E}")
def metadata_numeric(spark, sf_dir):
    return obs.metadata_numeric(events(spark, sf_dir), "missing", "k").select(F.round("avg_value", 6).alias("avg_value"), F.round("sum_value", 4).alias("sum_value"))


@query(f"SELECT k AS value, count(*) AS n FROM {E} WHERE nullif(k, '') IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_metadata_values(spark, sf_dir):
    return obs.top_metadata_values(events(spark, sf_dir), "missing", "k")


@query(f"SELECT coalesce(nullif(k, ''), 'unknown') AS value, count(*) AS n FROM {E} WHERE status = 'failure' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def failures_by_metadata(spark, sf_dir):
    return obs.failures_by_metadata(events(spark, sf_dir), "k")


@query(f"""SELECT k AS application, count(*) FILTER (metric_name = 'signup') AS signup_count, count(*) FILTER (metric_name = 'purchase') AS purchase_count,
 count(*) FILTER (metric_name = 'view') AS view_count, count(*) FILTER (metric_name = 'click') AS click_count, count(*) FILTER (metric_name = 'error') AS error_count,
 count(*) FILTER (status = 'failure') AS failures, count(DISTINCT user_id) FILTER (user_id NOT IN (0, 1)) AS users FROM {E} GROUP BY 1""")
def application_usage(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("metadata", "$.k"))
    return obs.application_usage(e, "k", ["signup", "purchase", "view", "click", "error"], ["0", "1"])


@query(f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, metric_name, CASE WHEN count(duration_ms) > 0 THEN count(duration_ms) ELSE count(status) END AS n, round(avg(duration_ms), 6) AS avg_ms,
 round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99, max(duration_ms) AS max_ms,
 count(*) FILTER (status = 'failure') AS failures FROM {E} GROUP BY 1, 2""")
def daily_rollup(spark, sf_dir):
    return rounded(obs.daily_rollup(events(spark, sf_dir)), "avg_ms", "p50", "p95", "p99").withColumn("day", F.col("day").cast("string"))


@query(f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, metric_name, count(*) AS n FROM {E} GROUP BY 1, 2), m AS (SELECT max(day) AS day FROM d)
SELECT CAST(d.day AS VARCHAR) AS day, metric_name, CASE WHEN d.day >= m.day - 2 THEN n ELSE -1 END AS n FROM d, m""")
def upsert_daily(spark, sf_dir):
    """The last three days recomputed and put over what an earlier run had left (here: -1)."""
    fresh = obs.daily_rollup(events(spark, sf_dir)).select("day", "metric_name", F.col("n").cast("long").alias("n"))
    last = fresh.agg(F.max("day").alias("last"))
    new = fresh.join(F.broadcast(last), F.col("day") >= F.date_sub("last", 2)).drop("last")
    return obs.upsert(fresh.withColumn("n", F.lit(-1).cast("long")), new, ["day", "metric_name"]).withColumn("day", F.col("day").cast("string"))


@query(f"""SELECT success_total, failure_total, success_total + failure_total AS total, round(success_total * 100.0 / (success_total + failure_total), 2) AS success_rate,
 round(failure_total * 100.0 / (success_total + failure_total), 2) AS failure_rate FROM (SELECT count(*) FILTER (status = 'success') AS success_total, count(*) FILTER (status = 'failure') AS failure_total FROM {E})""")
def metrics_summary(spark, sf_dir):
    return obs.summary(events(spark, sf_dir))


_TWO = E.replace("CASE WHEN event_type = 'error'", "CASE WHEN event_id % 3 = 0").replace("WHEN event_type = 'view'", "WHEN event_id % 3 = 1")


@query(f"""WITH g AS (SELECT metric_name, status, count(*) AS n, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'failure') AS f, avg(duration_ms) AS a, min(duration_ms) AS mi, max(duration_ms) AS ma FROM {_TWO} GROUP BY 1, 2)
SELECT metric_name, CAST(sum(n) AS BIGINT) AS n, round(avg(a), 6) AS avg_ms, min(mi) AS min_ms, max(ma) AS max_ms, round(sum(s) * 100.0 / sum(n), 1) AS success_rate, round(sum(f) * 100.0 / sum(n), 1) AS failure_rate FROM g GROUP BY 1""")
def merged_stats(spark, sf_dir):
    """Events whose metrics have three statuses each: groups of metric and status, merged by metric with the plain mean of their means."""
    e = events(spark, sf_dir)
    status = F.when(F.col("id") % 3 == 0, "failure").when(F.col("id") % 3 == 1, "pending").otherwise("success")
    return rounded(obs.merged_stats(obs.aggregate_by(e.withColumn("status", status), "metric_name", "status"), "metric_name"), "avg_ms")


@query(f"""SELECT n, round(n / s, 4) AS per_second, round(n * 60 / s, 4) AS per_minute FROM
 (SELECT count(*) AS n, greatest(1.0, (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6)) AS s FROM {E})""")
def dashboard_throughput(spark, sf_dir):
    return obs.throughput(events(spark, sf_dir))


@query(f"SELECT metric_name, arg_max(nullif(k, ''), (ts, id)) AS value FROM {E} GROUP BY 1")
def latest_gauge(spark, sf_dir):
    return obs.latest_gauge(events(spark, sf_dir), "k")


@query(f"SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failure') AS failed FROM {E} GROUP BY 1")
def hourly_timeline(spark, sf_dir):
    return obs.hourly_timeline(events(spark, sf_dir)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"SELECT id, metric_name, status FROM {E} ORDER BY ts DESC, id DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return obs.recent(events(spark, sf_dir), 50).select("id", "metric_name", "status")


@query(f"""SELECT id, metric_name, user_id FROM {E} WHERE status <> 'pending' AND (metric_name ILIKE '%UR%' OR CAST(user_id AS VARCHAR) ILIKE '%7%') AND nullif(k, '') IS NOT NULL
 AND (starts_with(metric_name, 'pur') OR starts_with(metric_name, 'cl')) ORDER BY ts DESC, id DESC LIMIT 25 OFFSET 25""")
def audit_events_page(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("status") != "pending")
    e = e.where(F.col("metric_name").ilike("%UR%") | F.col("user_id").cast("string").ilike("%7%")).where(obs.json_text("metadata", "k").isNotNull())
    e = e.where(F.col("metric_name").startswith("pur") | F.col("metric_name").startswith("cl"))
    return obs.page(e, [F.desc("ts"), F.desc("id")], 2, 25).select("id", "metric_name", "user_id")


@query(f"SELECT id, metric_name FROM {E} WHERE metric_name NOT IN ('view', 'click') ORDER BY ts DESC, id DESC LIMIT 100")
def metric_events_page(spark, sf_dir):
    return obs.page(obs.in_range(events(spark, sf_dir), exclude=["view", "click"]), [F.desc("ts"), F.desc("id")], 1, 100).select("id", "metric_name")


@query(f"""SELECT metric_name, least(greatest(CAST(floor((duration_ms - 0) / 20) AS INT) + 1, 0), 11) AS bucket, count(*) AS n, round(sum(duration_ms), 4) AS total FROM {E} WHERE duration_ms >= 0 GROUP BY 1, 2""")
def latency_histogram(spark, sf_dir):
    h = obs.histogram(events(spark, sf_dir).where("duration_ms >= 0"), ["metric_name"], 0.0, 200.0, 10)
    return h.select("metric_name", F.col("bucket").cast("int").alias("bucket"), "n", F.round("total", 4).alias("total"))


@query(f"""SELECT count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95,
 round(quantile_cont(duration_ms, 0.99), 6) AS p99, max(duration_ms) AS max_ms FROM {E} WHERE metric_name = 'purchase' AND CAST(ts AS DATE) = (SELECT CAST(min(ts) AS DATE) FROM events)""")
def latency_summary(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.agg(F.to_date(F.min("ts")).alias("d"))
    e = e.where("metric_name = 'purchase'").join(F.broadcast(first), F.to_date("ts") == F.col("d"))
    got = obs.latency_summary(e)
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("avg_ms", "p50", "p95", "p99")], "max_ms")


_SECTIONS = {"usage": ["view", "click"], "growth": ["signup", "purchase"], "faults": ["error"]}
_STATS = "count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failure') AS failed, count(duration_ms) AS timed, avg(duration_ms) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, min(ts) AS a, max(ts) AS b"
_MERGED = "CAST(sum(n) AS BIGINT) AS n, sum(ok) AS ok, sum(failed) AS failed, CAST(sum(timed) AS BIGINT) AS timed, avg(avg_ms) AS avg_ms, min(min_ms) AS min_ms, max(max_ms) AS max_ms, min(a) AS a, max(b) AS b"


@query(f"""WITH e AS (SELECT * FROM {E} WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'),
m AS (SELECT metric_name, CASE WHEN metric_name IN ('view', 'click') THEN 'usage' WHEN metric_name IN ('signup', 'purchase') THEN 'growth' WHEN metric_name = 'error' THEN 'faults' END AS section, {_STATS}, arg_max(k, (ts, id)) AS gauge FROM e GROUP BY 1, 2),
u AS (SELECT 'metric' AS level, metric_name AS name, n, ok, failed, timed, avg_ms, min_ms, max_ms, a, b, gauge FROM m
 UNION ALL SELECT 'section', section, {_MERGED}, NULL FROM m WHERE section IS NOT NULL GROUP BY section UNION ALL SELECT 'overview', 'all', {_MERGED}, NULL FROM m
 UNION ALL SELECT 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), {_STATS}, NULL FROM e GROUP BY date_trunc('hour', ts)),
s AS (SELECT *, greatest(1.0, (epoch_us(b) - epoch_us(a)) / 1e6) AS s FROM u)
SELECT level, name, n, round(ok * 100.0 / n, 1) AS success_rate, round(failed * 100.0 / n, 1) AS failure_rate, round(avg_ms, 6) AS avg_ms, min_ms, max_ms, timed AS sketched,
 round(n / s, 4) AS per_second, round(n * 60 / s, 4) AS per_minute, gauge FROM s""")
def dashboard(spark, sf_dir):
    """Seventeen days of the dashboard from stored hours; the quantiles are sketches', so the SQL leaves them to a test."""
    hours = written(obs.kept_hours(events(spark, sf_dir)), "kept_hours")
    out = obs.dashboard(hours, _SECTIONS, F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return rounded(out.drop("p50", "p95", "p99"), "avg_ms")


@query("""SELECT 'shorten' AS metric_name, 'success' AS status, count(*) AS n, count(*) FILTER (length(text) > 2000) AS failed FROM documents
UNION ALL SELECT 'broken', 'failure', 0, 0 UNION ALL SELECT 'named', 'success', 0, 0""")
def run_metrics(spark, sf_dir):
    """Metric events of an action over all documents, of one that fails, and of a decorated function."""
    meter, docs = Meter(spark, shared_path(spark, "metrics")), table(spark, sf_dir, "documents")
    meter.run("shorten", docs, lambda d: d.select("doc_id", F.left("text", F.lit(2000))).write.parquet(shared_path(spark, "shortened")), F.length("text") > 2000)
    try:
        meter.run("broken", docs, lambda d: d.select(F.raise_error("broken")).write.format("noop").mode("overwrite").save())
    except Exception as e:
        if "broken" not in str(e):
            raise
    meter.captured("named")(lambda: docs.schema)()
    meter.flush()
    return meter.read().select("metric_name", "status", "n", "failed")
