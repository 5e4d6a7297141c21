"""Outcomes of processors as keyed state: a job's plan in a map, its history in a list, silence in timers.

Messages (job_id, processor, status, ts, no) overwrite their processor's outcome in order of (ts, no). A job is COMPLETED when
all its processors are, FAILED when all have ended and one failed, else IN_PROGRESS; a job in progress that stays silent for
``timeout`` seconds is TIMED_OUT until it speaks again. Every batch that tells of a job gives its row: status, processors, outcomes
(length of the history), failed (processors, sorted) and last (time of the last message). State is RocksDB's, so it isn't held in
memory, and a history keeps at most ``KEPT`` outcomes. In event time jobs share ``SLOTS`` slots by hash (``Slots``), so a batch costs
calls by slot and not by job. With processing time (``Outcomes``, a key a job), states may have a time to live; such a stream has
batches without data all the time, so it ends only when it is stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from operator import itemgetter
from sys import intern

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Outcomes that a job's history keeps.
KEPT = 1000
#: Slots that jobs are dealt to by hash; a checkpoint holds for the number it was begun with.
SLOTS = 4096
SCHEMA = "job_id long, status string, processors int, outcomes int, failed string, last long, version long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = Row("job_id", "status", "processors", "outcomes", "failed", "last", "version")


def judged(plan: dict[str, tuple]) -> tuple[str, str]:
    """What the outcomes of a job's processors (status, time) make of it, and the failed ones."""
    failed = sorted(p for p, (s, _) in plan.items() if s == "FAILED")
    ended = all(s in ("COMPLETED", "FAILED") for s, _ in plan.values())
    return ("FAILED" if failed else "COMPLETED") if ended else "IN_PROGRESS", ",".join(failed)


class Outcomes(StatefulProcessor):
    """Times are microseconds. Every call on a state is a trip to the JVM, so a job's plan and facts are read once a batch, and not at all where it is new."""

    def __init__(self, timeout: float, ttl: float | None):
        self.timeout, self.ttl = timeout, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl is None else int(self.ttl * 1000)
        self.handle = handle
        self.plan = handle.getMapState("plan", "processor string", "status string, at long", ttl)
        self.history = handle.getListState("history", "processor string, status string, at long", ttl)
        self.facts = handle.getValueState("facts", "outcomes int, version long, last long", ttl)

    @staticmethod
    def _row(key: tuple, plan: dict[str, tuple], facts: tuple, status: str | None = None) -> Row:
        outcomes, version, last = facts
        state, failed = judged(plan)
        return _ROW(key[0], status or state, len(plan), outcomes, failed, last, version)

    def _plan(self) -> dict[str, tuple]:
        return {k[0]: tuple(v) for k, v in self.plan.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told = [(r.processor, r.status, r.at) for r in sorted(rows, key=lambda r: (r.at, r.no is None, r.no or 0))]
        facts = self.facts.get()
        plan = {} if facts is None else self._plan()
        changed = {}
        for p, s, t in told:
            if p not in plan or plan[p][1] <= t:
                plan[p] = changed[p] = (s, t)
        for p, outcome in changed.items():
            self.plan.updateValue((p,), outcome)
        outcomes, version, last = (0, 0, told[0][2]) if facts is None else facts
        now = (outcomes + len(told), version + 1, max(last, told[-1][2]))
        self.facts.update(now)
        if now[0] > KEPT:
            self.history.put(([tuple(x) for x in self.history.get()] + told)[-KEPT:])
        else:
            self.history.appendList(told)
        if facts is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        row = self._row(key, plan, now)
        if row.status == "IN_PROGRESS":
            base = timerValues.getCurrentProcessingTimeInMs() if self.ttl is not None else now[2] / 1000
            self.handle.registerTimer(int(base + self.timeout * 1000))
        yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        facts = self.facts.get()
        if facts is None:
            return
        now = (facts[0], facts[1] + 1, facts[2])
        self.facts.update(now)
        yield self._row(key, self._plan(), now, "TIMED_OUT")

    def close(self) -> None:
        pass


class Slots(StatefulProcessor):
    """The same for all jobs of a slot at once, in event time: one value holds their plans and facts, a list what was told batch by batch, and one timer the first time at which a job will have been silent too long."""

    def __init__(self, timeout: float):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "jobs binary, due long")
        self.history = handle.getListState("history", "told binary")

    def _jobs(self) -> tuple[dict[int, tuple], int]:
        """Of each job its plan, outcomes, version, last and status; and when the timer is due (0: there is none)."""
        held = self.jobs.get()
        return ({}, 0) if held is None else (pickle.loads(held[0]), held[1])

    def _ends(self, last: int) -> int:
        return int(last / 1000 + self.timeout * 1000)

    def _keep(self, jobs: dict[int, tuple], due: int) -> None:
        waiting = [last for _, _, _, last, status in jobs.values() if status == "IN_PROGRESS"]
        new = self._ends(min(waiting)) if waiting else 0
        if new != due:
            if due:
                self.handle.deleteTimer(due)
            if new:
                self.handle.registerTimer(new)
        self.jobs.update((pickle.dumps(jobs), new))

    def _remember(self, told: dict[int, list], jobs: dict[int, tuple]) -> None:
        self.history.appendValue((pickle.dumps([(job, p, s, at) for job, rows in told.items() for at, _, p, s in rows]),))
        if any(jobs[job][1] > KEPT for job in told):
            by: dict[int, list] = {}
            for (old,) in self.history.get():
                for row in pickle.loads(old):
                    by.setdefault(row[0], []).append(row)
            self.history.put([(pickle.dumps([row for rows in by.values() for row in rows[-KEPT:]]),)])

    @staticmethod
    def _rows(jobs: dict[int, tuple], of: list[int]) -> pd.DataFrame:
        rows = [(job, status, len(plan), outcomes, judged(plan)[1], last, version) for job in of for plan, outcomes, version, last, status in (jobs[job],)]
        return pd.DataFrame(rows, columns=list(_ROW))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: dict[int, list] = {}
        for f in rows:
            for job, p, s, at, no in zip(*(f[c].tolist() for c in ("job_id", "processor", "status", "at", "no"))):
                told.setdefault(job, []).append((at, no, p and intern(p), s and intern(s)))
        jobs, due = self._jobs()
        for job, new in told.items():
            new.sort(key=itemgetter(0, 1))
            plan, outcomes, version, last, _ = jobs.get(job) or ({}, 0, 0, new[0][0], None)
            for at, _, p, s in new:
                if p not in plan or plan[p][1] <= at:
                    plan[p] = (s, at)
            jobs[job] = (plan, outcomes + len(new), version + 1, max(last, new[-1][0]), judged(plan)[0])
        self._keep(jobs, due)
        self._remember(told, jobs)
        yield self._rows(jobs, list(told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, _ = self._jobs()
        now = timerValues.getCurrentWatermarkInMs()
        silent = [job for job, (_, _, _, last, status) in jobs.items() if status == "IN_PROGRESS" and self._ends(last) <= now]
        for job in silent:
            plan, outcomes, version, last, _ = jobs[job]
            jobs[job] = (plan, outcomes, version + 1, last, "TIMED_OUT")
        self._keep(jobs, 0)  # the timer that expired goes by itself
        if silent:
            yield self._rows(jobs, silent)

    def close(self) -> None:
        pass


def outcomes(messages: DataFrame, timeout: float = 1800.0, lateness: str | None = "1 hour", ttl: float | None = None) -> DataFrame:
    """messages (job_id, processor, status, ts, no), a stream: each job's row after every batch that tells of it; the highest version counts.

    Silence is measured in event time behind the watermark; with ``ttl`` (seconds) in processing time, and states end then.
    """
    told = messages.where("job_id is not null and ts is not null").select("job_id", "processor", "status", "ts", "no", F.unix_micros("ts").alias("at"))
    if ttl is not None:
        rows = told.groupBy("job_id").transformWithState(Outcomes(timeout, ttl), SCHEMA, "update", "processingTime")
    else:
        last = F.lit(2**63 - 1)  # messages without a number count as the last of their time
        dealt = told.withWatermark("ts", lateness).withColumns({"no": F.coalesce("no", last), "slot": F.pmod(F.xxhash64("job_id"), F.lit(SLOTS))})
        rows = dealt.groupBy("slot").transformWithStateInPandas(Slots(timeout), SCHEMA, "update", "eventTime")
    return rows.withColumn("last", F.timestamp_micros("last"))
