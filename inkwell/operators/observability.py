"""Roll-ups over metric and audit events: columns ts, metric_name, status, duration_ms, user_id, metadata (JSON)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.sources.shared import broadcast_if, written


def json_number(metadata: Column | str, *keys: str) -> Column:
    """The first of the keys that holds something; an empty string holds nothing, and what isn't a number is null."""
    return F.coalesce(*[_number(F.get_json_object(metadata, f"$.{k}")) for k in keys])


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def json_text(metadata: Column | str, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in keys])


def in_range(events: DataFrame, date_from: str | None = None, date_to: str | None = None, metric_names: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Optional predicates, all of which reach the scan."""
    if date_from is not None:
        events = events.where(F.col("ts") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        events = events.where(F.col("ts") <= F.lit(date_to).cast("timestamp"))
    if metric_names:
        events = events.where(F.col("metric_name").isin(metric_names))
    if exclude:
        events = events.where(~F.col("metric_name").isin(exclude))
    return events


def aggregate_by(events: DataFrame, *by: str) -> DataFrame:
    """Counts, successes, failures and the mean, least and greatest duration of each group."""
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failure")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), ok.alias("success_count"), bad.alias("failure_count"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    )


def aggregate_by_metric_name(events: DataFrame) -> DataFrame:
    return aggregate_by(events, "metric_name")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def percentiles(rows: DataFrame, by: list[str], value: str, ps: list[float], small: int = 32_768, accuracy: int = 1_000) -> DataFrame:
    """by..., n and p (the interpolated percentiles, exact) of a column's values that aren't null.

    Where no group has more than ``small`` values (some 2 MB), one pass holds the values of a group. Otherwise a sketch of each group
    gives two borders around each wanted rank; counting says between which of them the ranks lie, and only the values there
    are ranked: about a hundredth of a group for each percentile. Both ways are exact.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    largest = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if largest <= small:
        return v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*[F.lit(float(p)) for p in ps])).alias("p")).where("n > 0")
    around = sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-0.005, 0.005)})
    sketch = v.groupBy(*by).agg(F.percentile_approx("v", [float(c) for c in around], accuracy).alias("cuts"))
    ranged = broadcast_if(written(sketch, "borders"), 100_000)
    same = lambda other: [F.col(f"x.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in by]
    x = v.alias("x").join(ranged.alias("b"), same("b")).select("x.*", F.size(F.filter("b.cuts", lambda c: c < F.col("x.v"))).alias("bucket")) if by else v.join(F.broadcast(sketch)).select("v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bucket"))
    sizes = written(x.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("m")), "buckets")  # a bounded number for each group
    before = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("n", F.sum("m").over(Window.partitionBy(*by)))
    # The two ranks around each percentile, and the bucket that holds them.
    at = [((F.col("n") - 1) * F.lit(p)) for p in ps]
    ranks = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))).alias("rank")
    wanted = before.select(*by, "bucket", "before", "m", "n", ranks).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m")))
    wanted = written(wanted, "ranks")
    some = broadcast_if(wanted.select(*by, "bucket", "before").distinct(), 100_000)
    near = x.alias("x").join(some.alias("w"), [*same("w"), F.col("x.bucket") == F.col("w.bucket")]).select("x.*", "w.before")
    ranked = near.withColumn("rank", (F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("v")) - 1 + F.col("before")).cast("long"))
    got = ranked.alias("x").join(wanted.alias("w"), [*same("w"), F.col("x.rank") == F.col("w.rank")]).groupBy(*[F.col(f"x.{c}").alias(c) for c in by]).agg(F.first("w.n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("x.rank"), F.col("x.v")))).alias("v"))
    value_at = lambda r: F.element_at("v", r.cast("long"))
    out = [value_at(F.floor(a)) + (value_at(F.ceil(a)) - value_at(F.floor(a))) * (a - F.floor(a)) for a in at]
    return got.select(*by, "n", F.array(*out).alias("p"))


def top_slow_operations(events: DataFrame, limit: int = 10) -> DataFrame:
    """Mean, maximum and interpolated 95th percentile for each metric, the slowest first; the limit is clamped to 1..100."""
    timed = events.where("duration_ms is not null")
    agg = timed.groupBy("metric_name").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    slow = written(agg.orderBy(F.desc("avg_ms"), "metric_name").limit(max(1, min(limit, 100))), "slow")
    p = percentiles(timed.join(F.broadcast(slow.select("metric_name")), "metric_name", "left_semi"), ["metric_name"], "duration_ms", [0.95])
    return slow.join(p.select("metric_name", F.get("p", F.lit(0)).alias("p95_ms")), "metric_name").orderBy(F.desc("avg_ms"), "metric_name")


def metadata_numeric(events: DataFrame, *keys: str) -> DataFrame:
    v = json_number("metadata", *keys)
    return events.agg(F.avg(v).alias("avg_value"), F.sum(v).alias("sum_value"))


def top_metadata_values(events: DataFrame, *keys: str, limit: int = 10) -> DataFrame:
    v = json_text("metadata", *keys)
    return events.where(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(max(1, min(limit, 50)))


def failures_by_metadata(events: DataFrame, key: str, limit: int = 20) -> DataFrame:
    v = F.coalesce(json_text("metadata", key), F.lit("unknown"))
    return events.where("status = 'failure'").groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(max(1, min(limit, 50)))


def application_usage(events: DataFrame, app: str, kinds: list[str], system_users: list[str]) -> DataFrame:
    counts = [F.count_if(F.col("metric_name") == k).alias(f"{k}_count") for k in kinds]
    people = F.count_distinct(F.when(~F.col("user_id").cast("string").isin(system_users), F.col("user_id")))
    return events.groupBy(F.col(app).alias("application")).agg(*counts, F.count_if(F.col("status") == "failure").alias("failures"), people.alias("users"))


def daily_rollup(events: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """One row for each day and metric: count (of durations, else of statuses), mean, p50, p95, p99, max, failures."""
    if allowed:
        events = events.where(F.col("metric_name").isin(allowed))
    e = events.withColumn("day", F.to_date("ts"))
    out = e.groupBy("day", "metric_name").agg(F.count("duration_ms").alias("timed"), F.count("status").alias("stated"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("status") == "failure").alias("failures"))
    p = percentiles(e, ["day", "metric_name"], "duration_ms", [0.5, 0.95, 0.99]).select(F.col("day").alias("_d"), F.col("metric_name").alias("_m"), "p")
    out = out.join(p, F.col("day").eqNullSafe(F.col("_d")) & F.col("metric_name").eqNullSafe(F.col("_m")), "left")
    n = F.when(F.col("timed") > 0, F.col("timed")).otherwise(F.col("stated"))
    return out.select("day", "metric_name", n.alias("n"), "avg_ms", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"), F.get("p", F.lit(2)).alias("p99"), "max_ms", "failures")


def latency_summary(events: DataFrame) -> DataFrame:
    """n, avg_ms, p50, p95, p99, max_ms of all durations."""
    p = percentiles(events, [], "duration_ms", [0.5, 0.95, 0.99])
    a = events.agg(F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return p.join(F.broadcast(a)).select("n", "avg_ms", *[F.get("p", F.lit(i)).alias(f"p{q}") for i, q in enumerate((50, 95, 99))], "max_ms")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace current ones with the same key (null keys match null keys)."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return current.alias("o").join(incoming.select(*keys).distinct().alias("n"), cond, "left_anti").select("o.*").unionByName(incoming)


def summary(events: DataFrame) -> DataFrame:
    ok, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failure")
    rate = lambda a, t: F.when(t > 0, F.round(a * 100.0 / t, 2)).otherwise(0.0)
    got = events.agg(ok.alias("success_total"), bad.alias("failure_total"))
    total = F.col("success_total") + F.col("failure_total")
    return got.select("success_total", "failure_total", total.alias("total"), rate(F.col("success_total"), total).alias("success_rate"), rate(F.col("failure_total"), total).alias("failure_rate"))


def merged_stats(groups: DataFrame, by: str) -> DataFrame:
    """Merge group rows (n, success_count, failure_count, avg_ms, min_ms, max_ms): the mean is the plain mean of the means."""
    n = F.sum("n")
    rate = lambda c: F.round(F.when(n > 0, F.sum(c) * 100.0 / n).otherwise(0.0), 1)
    return groups.groupBy(by).agg(
        n.alias("n"), F.avg("avg_ms").alias("avg_ms"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), rate("success_count").alias("success_rate"), rate("failure_count").alias("failure_rate")
    )


def throughput(events: DataFrame) -> DataFrame:
    """Events a second and a minute over the covered range, of one second at least; 4 decimals."""
    span = F.greatest(F.lit(1.0), F.max(F.unix_micros("ts")) / 1e6 - F.min(F.unix_micros("ts")) / 1e6)
    return events.agg(F.count(F.lit(1)).alias("n"), span.alias("s")).select("n", F.round(F.col("n") / F.col("s"), 4).alias("per_second"), F.round(F.col("n") * 60 / F.col("s"), 4).alias("per_minute"))


def latest_gauge(events: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    return events.groupBy("metric_name").agg(F.max_by(json_text("metadata", key), F.struct("ts", id_col)).alias("value"))


def hourly_timeline(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") == "failure").alias("failed"))


def recent(events: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc(id_col)).limit(limit)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows; numbers start at 1 and sizes are clamped to 1..500."""
    size = max(1, min(size, 500))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def histogram(events: DataFrame, by: list[str], low: float, high: float, buckets: int) -> DataFrame:
    b = F.width_bucket("duration_ms", F.lit(low), F.lit(high), F.lit(buckets))
    return events.groupBy(*by, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("total"))


#: Size of the quantile sketches: ranks are right within about 0.4 percent (with 99 percent probability).
SKETCH = 800


def kept_hours(events: DataFrame) -> DataFrame:
    """One row for each hour and metric, to be stored and merged for any range: counts, sums, ends, a quantile sketch of the durations, the latest gauge."""
    e = events.where(F.col("ts").isNotNull()).withColumn("hour", F.date_trunc("hour", "ts"))
    gauge = F.struct("ts", "id", json_text("metadata", "k").alias("value"))
    return e.groupBy("hour", "metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") == "failure").alias("failed"), F.count("duration_ms").alias("timed"),
        F.sum("duration_ms").alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.kll_sketch_agg_double("duration_ms", F.lit(SKETCH)).alias("sketch"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(gauge).alias("gauge"),
    )


def dashboard(hours: DataFrame, sections: dict[str, list[str]], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The dashboard from kept hours in [start, end): level (metric, section, overview, hour), name, n, rates, times, quantiles, events a second, gauge.

    Sections and the overview take the plain mean of their metrics' means, as their groups do; metrics in no section only count
    in the overview. The events are not read again.
    """
    rows = hours if start is None else hours.where(F.col("hour") >= start)
    rows = rows if end is None else rows.where(F.col("hour") < end)
    section = F.coalesce(*[F.when(F.col("metric_name").isin(*names), F.lit(s)) for s, names in sections.items()], F.lit(None).cast("string"))
    sums = [F.sum(c).alias(c) for c in ("n", "ok", "failed", "timed", "total_ms")] + [F.min(c).alias(c) for c in ("min_ms", "first_ts")] + [F.max(c).alias(c) for c in ("max_ms", "last_ts", "gauge")]
    merged = F.kll_merge_agg_double("sketch").alias("sketch")
    mean = (F.col("total_ms") / F.nullif(F.col("timed"), F.lit(0))).alias("avg_ms")
    metric = rows.groupBy("metric_name", section.alias("section")).agg(*sums, merged).select("*", mean)
    again = [F.sum(c).alias(c) for c in ("n", "ok", "failed", "timed", "total_ms")] + [F.min(c).alias(c) for c in ("min_ms", "first_ts")] + [F.max(c).alias(c) for c in ("max_ms", "last_ts")]
    both = metric.groupingSets([["section"], []], "section").agg(*again, F.avg("avg_ms").alias("avg_ms"), merged, F.grouping("section").alias("every"))
    level = F.when(F.col("every") == 1, "overview").otherwise("section")
    none = F.lit(None).cast("string")
    parts = [
        metric.select(F.lit("metric").alias("level"), F.col("metric_name").alias("name"), *_SHOWN, F.col("gauge.value").alias("gauge")),
        both.where("every = 1 or section is not null").select(level.alias("level"), F.when(F.col("every") == 1, "all").otherwise(F.col("section")).alias("name"), *_SHOWN, none.alias("gauge")),
        rows.groupBy("hour").agg(*sums, merged).select(F.lit("hour").alias("level"), F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("name"), *[c if c != "avg_ms" else mean for c in _SHOWN], none.alias("gauge")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    seconds = F.greatest(F.lit(1.0), (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6)
    rate = lambda c: F.round(F.col(c) * 100.0 / F.col("n"), 1)
    q = lambda r: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(r)))
    return out.select(
        "level", "name", "n", rate("ok").alias("success_rate"), rate("failed").alias("failure_rate"), "avg_ms", "min_ms", "max_ms", q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"),
        F.kll_sketch_get_n_double("sketch").alias("sketched"), F.round(F.col("n") / seconds, 4).alias("per_second"), F.round(F.col("n") * 60 / seconds, 4).alias("per_minute"), "gauge",
    )


_SHOWN = ("n", "ok", "failed", "timed", "avg_ms", "min_ms", "max_ms", "first_ts", "last_ts", "sketch")


# How the types of business events begin.
BUSINESS_PREFIXES = ("REPOSITORY_", "DOCUMENT_", "SEARCH_", "CITATION_", "PERMISSION_", "USER_LOGIN", "USER_PASSWORD_")


@dataclass(frozen=True)
class AuditQuery:
    """What an audit list is asked for; None and empty texts ask for nothing. Pages begin at 1 and have 1 to 500 rows."""

    search: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    request_id: str | None = None
    correlation_id: str | None = None
    application_name: str | None = None
    repository_id: str | None = None
    status: str | None = None
    event_type: str | None = None
    entity_type: str | None = None
    entity_id: str | None = None
    has_changes: bool | None = None
    category: str | None = None
    action: str | None = None
    source: str | None = None
    business_only: bool = False
    page: int = 1
    page_size: int = 50

    def condition(self) -> Column:
        """All predicates as one condition, which reaches the scan."""
        held = [F.col(n) == getattr(self, n) for n in ("request_id", "correlation_id", "application_name", "status", "event_type", "entity_type", "entity_id", "category", "action", "source") if getattr(self, n)]
        if self.search:
            held.append(reduce(or_, [F.col(n).ilike(f"%{self.search}%") for n in ("event_type", "entity_type", "entity_id", "exception", "metadata")]))
        if self.date_from:
            held.append(F.col("ts") >= F.lit(self.date_from).cast("timestamp"))
        if self.date_to:
            held.append(F.col("ts") <= F.lit(self.date_to).cast("timestamp"))
        if self.repository_id:
            held.append((F.col("entity_id") == self.repository_id) | (F.get_json_object("metadata", "$.repository_id") == self.repository_id))
        if self.has_changes is not None:
            changed = F.coalesce(F.col("changes") != "[]", F.lit(False))
            held.append(changed if self.has_changes else ~changed)
        if self.business_only:
            held.append(reduce(or_, [F.upper("event_type").startswith(p) for p in BUSINESS_PREFIXES]))
        return reduce(and_, held, F.lit(True))


def audit_events(events: DataFrame, asked: AuditQuery) -> tuple[DataFrame, DataFrame]:
    """The page of events that were asked for, the newest first, and one row with the total of all pages."""
    hits = events.where(asked.condition())
    return page(hits, [F.desc("ts"), F.desc("id")], max(1, asked.page), max(1, min(asked.page_size, 500))), hits.agg(F.count(F.lit(1)).alias("total"))
