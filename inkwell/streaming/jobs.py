"""Streaming: event-time roll-ups with late data, duplicate suppression, and the job state machine with timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.functions.scores import dispatch_priority

TERMINAL = ("COMPLETED", "FAILED", "TIMED_OUT")
# States that end a job, those in which it runs, and the moves that a review allows.
CLOSED = ("COMPLETED", "TIMED_OUT", "QUEUE_FAILED", "STOPPED", "HUMAN_REVIEW")
FAILURES = ("FAILED", "TIMED_OUT", "STOPPED", "QUEUE_FAILED")
RUNNING = ("DISPATCHING", "ASSIGNED", "IN_PROGRESS", "STARTED")
TRANSITIONS = {
    "PENDING": ("IN_REVIEW", "APPROVED", "REJECTED", "CHANGES_REQUESTED"),
    "REOPENED": ("IN_REVIEW", "APPROVED", "REJECTED", "CHANGES_REQUESTED"),
    "IN_REVIEW": ("APPROVED", "REJECTED", "CHANGES_REQUESTED"),
    "CHANGES_REQUESTED": ("IN_REVIEW", "APPROVED", "REJECTED"),
    "APPROVED": ("REOPENED",),
    "REJECTED": ("REOPENED",),
}
#: Seconds after which a job in this state is taken back, and what it becomes.
STALE = {"DISPATCHING": (30, "QUEUED"), "ASSIGNED": (120, "QUEUED"), "IN_PROGRESS": (1800, "TIMED_OUT")}


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Counts in tumbling hours; what comes later than the watermark is left to the daily recomputation."""
    e = events.withWatermark("ts", lateness)
    return e.groupBy(F.window("ts", "1 hour"), "metric_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failure").alias("failed"), F.avg("duration_ms").alias("avg_ms"))


def once(messages: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """At-least-once delivery made effectively once within the watermark."""
    return messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def actionable(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages whose job isn't terminal (stream-static)."""
    return messages.join(jobs.where(F.col("status").isin(*TERMINAL)).select("job_id"), "job_id", "left_anti")


def dispositions(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """drop, hold or dispatch, from the job's state."""
    m = messages.join(jobs.select("job_id", "status"), "job_id", "left")
    what = F.when(F.col("status").isNull(), "drop").when(F.col("status").isin(*TERMINAL), "drop").when(F.col("status") == "QUEUED", "dispatch").otherwise("hold")
    return m.withColumn("disposition", what)


def dispatch_order(messages: DataFrame, sla_s: float = 30.0) -> DataFrame:
    """messages (offset, status, requeued, age_s, processor) with their priority, most urgent first."""
    p = dispatch_priority(F.col("status"), F.col("requeued"), F.col("age_s"), F.col("processor"), sla_s)
    return messages.withColumn("priority", p).orderBy(F.desc("priority"), "offset")


def recovered(jobs: DataFrame, now, live: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Stale jobs and the state they go back to, the oldest first; jobs on a live slot are left alone."""
    to, stale = None, None
    for state, (seconds, after) in STALE.items():
        hit = (F.col("status") == state) & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > seconds)
        to = F.when(hit, after) if to is None else to.when(hit, after)
        stale = hit if stale is None else stale | hit
    rows = jobs.where(stale).withColumn("next_status", to)
    if live is not None:
        rows = rows.join(live, "job_id", "left_anti")
    return rows.orderBy("updated_at", "job_id").limit(limit)


def plan_status(results: Column) -> Column:
    """results: map processor -> status. COMPLETED if all are, FAILED if all are terminal and one failed, else null."""
    v = F.map_values(results)
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x == "COMPLETED"), "COMPLETED").when((F.size(v) > 0) & F.forall(v, lambda x: x.isin("COMPLETED", "FAILED")), "FAILED")


def ready(results: Column, hard: list[str], soft: list[str]) -> Column:
    """All hard dependencies completed; soft ones, if scheduled, completed or failed."""
    out = F.lit(True)
    for d in hard:
        out = out & F.coalesce(results[d] == "COMPLETED", F.lit(False))
    for d in soft:
        out = out & F.coalesce(results[d].isin("COMPLETED", "FAILED"), F.lit(True))
    return out


def job_states(messages: DataFrame, timeout_s: int = 1800) -> DataFrame:
    """messages (job_id, processor, status, ts): the state of each job after every batch; silent jobs time out.

    Keyed state holds the outcome of each processor, so a job's state stays as small as its plan.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "status": ["TIMED_OUT"], "n": [0]})
            return
        names, stats = state.get if state.exists else ([], [])
        seen = dict(zip(names, stats))
        for f in frames:
            for p, s in f.sort_values("ts")[["processor", "status"]].itertuples(index=False):
                if seen.get(p) not in TERMINAL:
                    seen[p] = s
        state.update((list(seen), list(seen.values())))
        state.setTimeoutDuration(timeout_s * 1000)
        done = "COMPLETED" if all(s == "COMPLETED" for s in seen.values()) else "FAILED" if all(s in TERMINAL for s in seen.values()) else "IN_PROGRESS"
        yield pd.DataFrame({"job_id": [key[0]], "status": [done], "n": [len(seen)]})

    return messages.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, n int", "names array<string>, stats array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def pending(results: Column) -> Column:
    """Processors of a plan that have neither completed nor failed."""
    return F.map_keys(F.map_filter(results, lambda k, v: ~F.coalesce(v.isin("COMPLETED", "FAILED"), F.lit(False))))


def effective_status(status: Column, results: Column) -> Column:
    """A finished plan's outcome; while processors are pending a job that was handed out, or failed, is in progress."""
    s, open_ = F.upper(F.trim(status)), F.size(pending(results)) > 0
    return F.coalesce(plan_status(results), F.when(open_ & s.isin("ASSIGNED", "DISPATCHING", "STARTED", "FAILED"), "IN_PROGRESS"), s)


def claimed(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """jobs (job_id, status, processor_id) after claims (job_id, processor_id, ts): a queued job goes to its first claim; others stay."""
    first = claims.groupBy("job_id").agg(F.min(F.struct("ts", "processor_id"))["processor_id"].alias("_by"))
    won = (F.upper("status") == "QUEUED") & F.col("_by").isNotNull()
    out = jobs.join(first, "job_id", "left")
    return out.select("job_id", F.when(won, "DISPATCHING").otherwise(F.col("status")).alias("status"), F.when(won, F.col("_by")).otherwise(F.col("processor_id")).alias("processor_id"), F.coalesce(won, F.lit(False)).alias("claimed"))


def stale_queued(jobs: DataFrame, now: Column, seconds: int = 300, limit: int = 50) -> DataFrame:
    """The oldest queued jobs that have waited too long, touched now."""
    old = jobs.where((F.upper("status") == "QUEUED") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > seconds))
    return old.orderBy("updated_at", "job_id").limit(limit).withColumn("updated_at", now)


def orphaned(jobs: DataFrame, live: DataFrame, released: DataFrame, now: Column, grace: int = 120, limit: int = 100) -> DataFrame:
    """Active jobs (job_id, status, updated_at, results) on no live slot: what is published again, or 'requeue'.

    The limit picks the oldest before live and released ones are left out, so a page may come back short.
    """
    old = jobs.where(F.upper("status").isin(*RUNNING, "PROCESSING") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > grace)).orderBy("updated_at", "job_id").limit(limit)
    old = old.join(live.select("job_id").distinct(), "job_id", "left_anti").join(released.select("job_id").distinct(), "job_id", "left_anti")
    again = F.upper("status").isin("IN_PROGRESS", "PROCESSING", "STARTED") & (F.size(pending(F.col("results"))) > 0)
    return old.select("job_id", F.when(again, F.array_min(pending(F.col("results")))).otherwise("requeue").alias("action"))


def open_jobs(jobs: DataFrame, limit: int = 100) -> DataFrame:
    """Jobs that aren't over, the last touched first; a failed one only while processors are pending. The limit comes before that test."""
    rows = jobs.where(~F.col("status").isin(*CLOSED)).orderBy(F.desc("updated_at"), "job_id").limit(max(1, min(limit, 500)))
    return rows.where((F.upper("status") != "FAILED") | (F.size(pending(F.col("results"))) > 0))


def transitions(reviews: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reviews (review_id, status, version), moves (move_id, review_id, target, expected_version): the reviews after the moves, and each move's outcome.

    A move applies if its target is allowed from the review's state and its version, if it names one, is current. Of several
    moves for a review the first is tried; the others conflict with it.
    """
    allowed = F.create_map(*[x for s, t in TRANSITIONS.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in t]))])
    w = Window.partitionBy("review_id").orderBy("move_id")
    m = moves.withColumn("_n", F.row_number().over(w)).join(reviews, "review_id", "left")
    closed = F.col("status").isin("APPROVED", "REJECTED") & F.col("expected_version").isNull() & (F.col("target") != "REOPENED")
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when(F.col("_n") > 1, "conflict").when(closed, "conflict").when(F.col("expected_version") != F.col("version"), "conflict")
        .when(~F.coalesce(F.array_contains(F.element_at(allowed, F.col("status")), F.col("target")), F.lit(False)), "invalid").otherwise("applied")
    )
    said = m.select("move_id", "review_id", "target", F.col("status").alias("old_status"), outcome.alias("outcome"))
    done = said.where("outcome = 'applied'").select("review_id", "target")
    after = reviews.join(done, "review_id", "left").select("review_id", F.coalesce("target", "status").alias("status"), (F.col("version") + F.when(F.col("target").isNotNull(), 1).otherwise(0)).alias("version"))
    return after, said


def next_dispatch(messages: DataFrame, batch: int = 25, sla_s: float = 30.0) -> DataFrame:
    """Of the first ``batch`` messages of each queue, the most urgent that may go (dispatchable), the first of equals."""
    head = messages.withColumn("_n", F.row_number().over(Window.partitionBy("queue").orderBy("offset"))).where(F.col("_n") <= batch)
    p = dispatch_priority(F.col("status"), F.col("requeued"), F.col("age_s"), F.col("processor"), sla_s)
    rows = head.where("dispatchable").withColumn("priority", p)
    best = Window.partitionBy("queue").orderBy(F.desc("priority"), "offset")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("queue", "offset", "priority")


def reconciled(slots: DataFrame, jobs: DataFrame, now: Column, grace: int = 120) -> DataFrame:
    """One pass of the health loop: slots (slot_id, job_id, healthy) against jobs: what happens to each slot and job."""
    m = slots.join(jobs.select("job_id", "status", "updated_at"), "job_id", "full")
    over = F.col("status").isin(*TERMINAL, "STOPPED", "QUEUE_FAILED")
    what = (
        F.when(F.col("slot_id").isNotNull() & (F.col("status").isNull() | over), "release_slot").when(F.col("slot_id").isNotNull() & ~F.col("healthy"), "requeue_job")
        .when(F.col("slot_id").isNull() & F.col("status").isin(*RUNNING) & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > grace), "requeue_job").otherwise("keep")
    )
    return m.select("slot_id", "job_id", what.alias("action"))
