"""Stored structures and streams: inverted index, similar content, references by an automaton, outcomes, daily tables, chunk store, dashboard."""

import datetime as dt
import math
import pickle
import random
import re
import time
import zipfile
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkwell.functions import headings, lines
from inkwell.operators import bm25_index as I
from inkwell.operators import chunking
from inkwell.operators import mentions as N
from inkwell.operators import observability as obs
from inkwell.operators import similar_content as S
from inkwell.plans.retrieval import _content
from inkwell.plans.text import outcome_table
from inkwell.sources import documents as D
from inkwell.sources.chunk_store import ChunkStore
from inkwell.sources.shared import application_dir, clear, shared_path
from inkwell.streaming import outcomes as O
from inkwell.streaming.tables import DailyTable, UpsertTable, run

SF = "/root/testdata/sf0.1"


def bm25(docs: dict[int, list[str]], terms: set[str], k: int, allowed=lambda d: True):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for w in docs.values() for t in set(w))
    out = []
    for d, w in docs.items():
        tf = Counter(w)
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms if t in tf)
        if s > 0 and allowed(d):
            out.append((-round(s, 6), d))
    return [(d, -s) for s, d in sorted(out)[:k]]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return {d: rng.choices(vocabulary, weights, k=rng.randint(1, 120)) for d in range(600)}


@pytest.mark.parametrize("direct", [10**9, -1])
def test_index_against_brute_force(spark, words, monkeypatch, direct):
    """Three batches, one removed and partly added again; with and without bounds; ranks as by hand."""
    monkeypatch.setattr(I, "DIRECT", direct)
    monkeypatch.setattr(I, "BLOCK", 16)
    frame = lambda ids: spark.createDataFrame([(d, " ".join(words[d]), "ab"[d % 2]) for d in ids], "doc_id long, text string, scope string")
    index = I.Bm25Index(spark, shared_path(spark, "index"))
    index.add(frame(range(0, 300)), scopes=("scope",))
    before = set(spark.read.parquet(f"{index.path}/postings").inputFiles())
    index.add(frame(range(300, 600)), scopes=("scope",))
    assert before < set(spark.read.parquet(f"{index.path}/postings").inputFiles())  # the first segment's files stay
    index.remove(frame(range(100, 350)))
    index.add(frame(range(340, 350)), scopes=("scope",))
    live = {d: w for d, w in words.items() if not 100 <= d < 340}
    asked = {1: ["w0", "w1", "w37"], 2: ["w250", "w399", "w3"], 3: ["nowhere"], 4: [f"w{i}" for i in range(0, 60, 2)]}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    for k, where, allowed in ((7, None, lambda d: True), (5, F.col("scope") == "b", lambda d: d % 2 == 1)):
        got = {}
        for r in index.search(queries, k, where, digits=6).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["bm25"]))
        for q, terms in asked.items():
            want = bm25(live, set(terms), k, allowed)
            assert [d for d, _ in got.get(q, [])] == [d for d, _ in want]
            assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    best = index.search(queries, 600, min_score=4.0, digits=6)
    assert best.count() == sum(1 for t in asked.values() for _, s in bm25(live, set(t), 600) if s >= 4.0)


def test_index_reads_asked_folders_only(spark, words):
    index = I.Bm25Index(spark, shared_path(spark, "index"))
    index.add(spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string"))
    asked = spark.createDataFrame([("w7",)], "term string")
    plan = index.blocks(asked)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert len(index.blocks(asked).select(F.input_file_name()).distinct().collect()) < len(spark.read.parquet(f"{index.path}/postings").inputFiles()) / 4
    assert index.search(spark.createDataFrame([], "query_id long, terms array<string>")).count() == 0


def test_similar_content_recall(spark):
    vectors, queries = _content(spark, SF)
    index = S.SimilarContent(vectors)
    exact = {(r.query_id, r.vec_id) for r in S.search(vectors, queries, 5, exact=True).collect()}
    found = {(r.query_id, r.vec_id) for r in S.search(vectors, queries, 5, index).collect()}
    assert len(exact) == 100 and len(exact & found) / len(exact) >= 0.9, len(exact & found)
    assert not any(v in (q, q + 1) for q, v in found)
    names = {r.name for r in S.search(vectors, queries, 5, index).collect()}
    assert "Doc-1" not in names


def test_similar_content_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "n") for i in range(300)] + [(900, None, "n"), (901, [float("nan")] * 8, "n"), (902, [1.0], "n"), (903, [], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")
    queries = spark.createDataFrame([(1, rows[1][1], ["1"], None), (2, None, None, None), (3, [1.0], None, ["N"])], "query_id long, vector array<double>, exclude_ids array<string>, exclude_names array<string>")
    index = S.SimilarContent(vectors, lists=8)
    got = S.search(vectors, queries, 3, index, probes=8).collect()
    assert [r.query_id for r in got] == [1, 1, 1] and all(r.vec_id < 300 and r.vec_id != 1 for r in got)
    assert S.search(vectors.limit(0), queries, 3, S.SimilarContent(vectors.limit(0))).count() == 0


def test_similar_content_fills_blocks_and_groups_queries(spark, monkeypatch):
    """Codes of all tasks meet in full blocks, one rest a list; queries told in many groups find what they find in one."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v], "n") for i, v in enumerate(rng.normal(size=(12_000, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string").repartition(6)
    index = S.SimilarContent(vectors, lists=2)
    sizes = spark.read.parquet(index.path).select("list", F.size("ids").alias("n")).collect()
    assert sum(r.n for r in sizes) == 12_000 and all(sum(r.list == at and r.n < S.BLOCK for r in sizes) <= 1 for at in (0, 1))
    queries = vectors.where("vec_id % 400 = 0").selectExpr("vec_id as query_id", "embedding as vector", "array(string(vec_id)) as exclude_ids", "cast(null as array<string>) as exclude_names")
    search = lambda: sorted(map(tuple, S.search(vectors, queries, 4, index, probes=1).collect()))
    one = search()
    monkeypatch.setattr(S, "HELD", 500)
    assert len(one) == 120 and search() == one


def test_mentions_and_dictionary_parts(spark):
    known = spark.createDataFrame([(f"SOP_{i:03d}_QA.docx",) for i in range(200)] + [("SOP-001-QA",), (None,), ("words only",)], "name string")
    told = [
        "See SOP-007-QA.", "Protocol No. is sop-008-qa", "Form No: SOP_009_QA", "as per SOP--010-QA.pdf and SOP-011-QA", "plain SOP-012-QA", "Title: SOP-013-QA", "XSOP-014-QA refer", "refer SOP-015-QAX", "refer to SOP-016-QA-7",
        "the procedure SOP-017-QA/SOP-018-QA", None, "", "It refers to SOP-020-QA\nand see SOP-020-QA", "x. " * 80 + "See SOP-021-QA. Nothing of SOP-022-QA here.",
    ]
    docs = spark.createDataFrame([(i, t, "SOP-016-QA" if i == 8 else None) for i, t in enumerate(told)] + [(99, "see SOP-055-QA", "sop_055_qa.pdf")], "doc_id long, text string, name string")
    want = {
        (0, "SOP-007-QA", "lead", 0.88, 1), (1, "SOP-008-QA", "label", 0.92, 1), (2, "SOP-009-QA", "label", 0.92, 1), (3, "SOP-010-QA", "lead", 0.88, 1), (3, "SOP-011-QA", "trigger", 0.85, 1),
        (5, "SOP-013-QA", "colon", 0.9, 1), (12, "SOP-020-QA", "trigger", 0.85, 2), (13, "SOP-021-QA", "lead", 0.88, 1),
    }
    for size in (1 << 20, 600):
        got = {(r.doc_id, r.target, r.rule, r.confidence, r.evidence) for r in N.mentions(docs, known, "name", size).collect()}
        assert got == want
    counts = {r.name: (r.documents, r.mentions) for r in N.document_references(N.mentions(docs, known, "name"), known).collect()}
    assert counts["SOP_020_QA.docx"] == (1, 2)
    assert N.mentions(docs.limit(0), known).count() == 0 and N.mentions(docs, known.limit(0)).count() == 0


def test_mentions_read_texts_once_for_any_dictionary(spark):
    """A dictionary of many times the size given costs no further reading of texts; ids have odd signs, joining signs at their ends, and stand behind labels."""
    known = spark.createDataFrame([(f"SOP_{i:03d}_QA",) for i in range(400)] + [("SOP (QA) 7",), ("/A-1.",), ("A-1",), ("7-ÉB",), ("NO7",)], "name string")
    told = ["see SOP-007-QA", "see SOP(QA)7, or xSOP(QA)7", "refer to /A-1. now", "see ../A-1", "Ref-SOP-009-QA", "Document NoSOP-010-QA", "see SOP-011-QA.pdf.", "see 7-ÉB", "see SOP-012-QA.PDF.PDF", "see 1.SOP-013-QA"]
    read = spark.sparkContext.accumulator(0)
    count = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string").withColumn("text", count("text"))
    want = {(0, "SOP-007-QA", "lead"), (1, "SOP(QA)7", "lead"), (2, "/A-1.", "lead"), (2, "A-1", "trigger"), (3, "A-1", "trigger"), (4, "SOP-009-QA", "label"), (5, "SOP-010-QA", "label"), (6, "SOP-011-QA", "lead"), (7, "7-ÉB", "lead")}
    for size in (1 << 20, 600):
        before = read.value
        assert {(r.doc_id, r.target, r.rule) for r in N.mentions(docs, known, size=size).collect()} == want
        assert read.value - before == len(told)


def messages(spark, at, rows):
    spark.createDataFrame(rows, "job_id long, processor string, status string, ts timestamp, no long").coalesce(1).write.mode("append").parquet(f"{at}/in")


def test_outcomes_go_on_from_their_checkpoint(spark):
    """The stream is stopped between its batches; a job that was silent and speaks again is no longer timed out."""
    at, t = shared_path(spark, "outcomes"), lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    messages(spark, at, [(1, "a", "FAILED", t(0), 0), (1, "a", "COMPLETED", t(0, 5), 1), (2, "a", "IN_PROGRESS", t(0), 2), (3, "a", "IN_PROGRESS", t(0), 3), (4, "a", "COMPLETED", t(9), 4), (None, "a", "FAILED", t(9), 5)])
    stream = lambda: spark.readStream.schema("job_id long, processor string, status string, ts timestamp, no long").parquet(f"{at}/in")
    show = lambda kept: {r.job_id: (r.status, r.processors, r.outcomes, r.failed) for r in kept.read().collect()}
    got = show(outcome_table(spark, stream(), at, timeout=3600.0))
    assert got == {1: ("COMPLETED", 1, 2, ""), 2: ("TIMED_OUT", 1, 1, ""), 3: ("TIMED_OUT", 1, 1, ""), 4: ("COMPLETED", 1, 1, "")}
    messages(spark, at, [(1, "b", "FAILED", t(10), 6), (2, "a", "COMPLETED", t(10), 7), (5, "b", "IN_PROGRESS", t(10), 8)])
    got = show(outcome_table(spark, stream(), at, timeout=3600.0))
    assert got == {1: ("FAILED", 2, 3, "b"), 2: ("COMPLETED", 1, 2, ""), 3: ("TIMED_OUT", 1, 1, ""), 4: ("COMPLETED", 1, 1, ""), 5: ("IN_PROGRESS", 1, 1, "")}


def test_outcomes_ask_their_states_once():
    """A new job's outcomes are written without reading anything but its facts; a known job's plan is read once."""
    calls = Counter()

    class State:
        def __init__(self, **out):
            self.out = out

        def __getattr__(self, name):
            return lambda *_: calls.update([name]) or self.out.get(name)

    told = lambda *rows: iter([Row(processor=p, status=s, at=t, no=n) for p, s, t, n in rows])
    o = O.Outcomes(60.0, None)
    o.plan, o.history, o.facts, o.handle = State(), State(), State(), State()
    (row,) = o.handleInputRows((1,), told(("b", "FAILED", 5, 1), ("a", "IN_PROGRESS", 7, 2), ("b", "COMPLETED", 5, 2)), State())
    assert (row.status, row.processors, row.outcomes, row.failed, row.last) == ("IN_PROGRESS", 2, 3, "", 7)
    assert calls == {"get": 1, "updateValue": 2, "update": 1, "appendList": 1, "registerTimer": 1}
    calls.clear()
    o.plan, o.facts, o.handle = State(iterator=[(("a",), ("FAILED", 9))]), State(get=(1, 1, 9)), State(listTimers=[3])
    (row,) = o.handleInputRows((1,), told(("a", "COMPLETED", 8, 3)), State())  # late: the later outcome stays
    assert (row.status, row.processors, row.outcomes, row.failed, row.last, row.version) == ("FAILED", 1, 2, "a", 9, 2)
    assert calls == {"get": 1, "iterator": 1, "update": 1, "appendList": 1, "listTimers": 1, "deleteTimer": 1}


def test_slots_of_jobs_do_what_jobs_do(monkeypatch):
    """A slot's jobs in one value of state, over batches with late and untold times, against each job with states of its own; calls don't grow with jobs."""
    monkeypatch.setattr(O, "KEPT", 6)
    calls = Counter()

    class State:
        def __init__(self):
            self.value, self.list, self.map, self.timers = None, [], {}, set()

        def get(self):
            calls.update(["get"])
            return self.value

        def update(self, value):
            calls.update(["update"])
            self.value = value

        def updateValue(self, key, value):
            self.map[key] = value

        def iterator(self):
            return iter(self.map.items())

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            calls.update(["registerTimer"])
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class ListState(State):
        def get(self):
            return iter(list(self.list))

        def put(self, rows):
            self.list = list(rows)

        def appendValue(self, row):
            calls.update(["appendValue"])
            self.list.append(row)

        def appendList(self, rows):
            self.list += rows

    class Values:
        def __init__(self, mark):
            self.mark = mark

        def getCurrentWatermarkInMs(self):
            return self.mark

    def fresh(o):
        o.plan, o.facts, o.jobs, o.history, o.handle = State(), State(), State(), ListState(), State()
        return o

    def expired(o, key, mark):
        for at in sorted(t for t in o.handle.timers if t <= mark):
            yield from o.handleExpiredTimer(key, Values(mark), None)
            o.handle.timers.discard(at)

    rng, slot, alone, now = random.Random(3), fresh(O.Slots(10.0)), {}, 0
    for batch in range(12):
        now += rng.choice([2_000, 6_000, 30_000])
        told = [(rng.randrange(40), rng.choice("abc"), rng.choice(["FAILED", "COMPLETED", "COMPLETED", "IN_PROGRESS"]), max(0, now - rng.randrange(8_000)) * 1000 + rng.randrange(1000), rng.choice([None, *range(50)])) for _ in range(60 if batch % 3 else 8)]
        want, mark = {}, now - 4_000
        for job in {m[0] for m in told}:
            o = alone.setdefault(job, fresh(O.Outcomes(10.0, None)))
            for row in o.handleInputRows((job,), iter([Row(processor=p, status=s, at=at, no=no) for j, p, s, at, no in told if j == job]), Values(mark)):
                want[job] = tuple(row)
        for job, o in alone.items():
            want |= {job: tuple(row) for row in expired(o, (job,), mark)}
        frame = pd.DataFrame([(j, p, s, at, 2**63 - 1 if no is None else no) for j, p, s, at, no in told], columns=["job_id", "processor", "status", "at", "no"])
        calls.clear()
        got = {r[0]: r for f in slot.handleInputRows((0,), iter([frame[:30], frame[30:]]), Values(mark)) for r in f.itertuples(index=False, name=None)}
        assert calls["get"] == calls["update"] == calls["appendValue"] == 1 and calls["registerTimer"] <= 1
        got |= {r[0]: r for f in expired(slot, (0,), mark) for r in f.itertuples(index=False, name=None)}
        assert got == want
        assert len(slot.handle.timers) <= 1
    kept = {}
    for (old,) in slot.history.list:
        for job, *row in pickle.loads(old):
            kept.setdefault(job, []).append(tuple(row))
    assert kept == {job: [tuple(x) for x in o.history.list] for job, o in alone.items()} and max(map(len, kept.values())) == 6


def test_outcomes_with_time_to_live(spark):
    at, key = shared_path(spark, "ttl"), "spark.sql.streaming.stateStore.providerClass"
    messages(spark, at, [(1, "a", "COMPLETED", dt.datetime(2024, 1, 1), 0)])
    raw = spark.readStream.schema("job_id long, processor string, status string, ts timestamp, no long").parquet(f"{at}/in")
    kept, before = UpsertTable(spark, f"{at}/jobs", ["job_id"]), spark.conf.get(key)
    spark.conf.set(key, O.PROVIDER)
    try:
        query = O.outcomes(raw, ttl=3600.0).writeStream.outputMode("update").foreachBatch(lambda rows, no: None if rows.isEmpty() else kept.apply(rows, no)).option("checkpointLocation", f"{at}/checkpoint").start()
        for _ in range(100):  # such a stream has no end of its own
            if kept.read() is not None or query.exception():
                break
            time.sleep(0.3)
        query.stop()
    finally:
        spark.conf.set(key, before)
    assert [(r.job_id, r.status) for r in kept.read().collect()] == [(1, "COMPLETED")]


def test_daily_table_takes_late_and_repeated_batches(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 3, i % 24), "mk"[i % 2], "failure" if i % 5 == 0 else "success", float(i % 17)) for i in range(300)] + [(300, None, "m", "success", 1.0)]
    events = spark.createDataFrame(rows, "id long, ts timestamp, metric_name string, status string, duration_ms double")
    kept = DailyTable(spark, shared_path(spark, "daily"))
    kept.apply(events.where("id % 4 > 0"), 0)
    for _ in range(2):
        kept.apply(events.where("id % 4 = 0"), 1)
    want = obs.daily_rollup(events.where("ts is not null"))
    key = lambda df: sorted(str(tuple(r)) for r in df.select("day", "metric_name", "n", F.round("avg_ms", 9), "p50", "p95", "p99", "max_ms", "failures").collect())
    assert key(kept.read()) == key(want)
    kept.table.compact()
    assert key(kept.read()) == key(want)


def test_chunk_store(spark):
    schema = "repository_id string, document_id string, chunk_id string, embedding array<double>, is_duplicate boolean"
    rows = [("r", "d1", "c1", [1.0, 2.0], False), ("r", "d1", "c2", [1.0, 3.0], True), ("s", "d2", "c3", None, False), ("s", "d2", "c4", [0.0, 1.0], None), ("s", "d2", "c4", [0.0, 1.0], None)]
    store = ChunkStore(spark, shared_path(spark, "chunks"), 2)
    assert store.read() is None
    store.replace(spark.createDataFrame(rows, schema))
    with pytest.raises(Exception, match="not of dimension"):
        store.replace(spark.createDataFrame([("r", "d1", "bad", [1.0], False)], schema))
    assert sorted(r.chunk_id for r in store.read().collect()) == ["c1", "c4"]
    store.replace(spark.createDataFrame([("r", "d1", "c9", [5.0, 5.0], False), ("s", "d2", "c8", None, False)], schema))
    assert [r.chunk_id for r in store.read().collect()] == ["c9"]
    store.compact()
    assert [r.chunk_id for r in store.read("r").collect()] == ["c9"] and store.read("s").count() == 0


def test_dashboard_quantiles(spark):
    """One scan of the events; ranks of the sketches' quantiles are within half a percent."""
    e = spark.range(40_000).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("metric_name"), F.lit("success").alias("status"), (F.rand(3) * 1000).alias("duration_ms"), F.lit('{"k": 1}').alias("metadata"))
    hours = obs.kept_hours(e)
    assert hours._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    values = np.sort([r[0] for r in e.where("metric_name = 'a'").select("duration_ms").collect()])
    row = obs.dashboard(hours, {"s": ["a"]}).where("level = 'metric' and name = 'a'").head()
    for q, got in ((0.5, row.p50), (0.95, row.p95), (0.99, row.p99)):
        assert abs(np.searchsorted(values, got) / len(values) - q) < 0.005
    assert row.sketched == row.n == len(values)


def test_values_are_the_fixed_ones(spark):
    kinds = {"Doc No: GL-1": "metadata", "Document No: GL-1": "metadata", "Doc  no  7": "metadata", "Doctor no": "text"}
    got = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", lines.kind("t").alias("k")).collect()
    assert {r.t: r.k for r in got} == kinds
    assert lines.METADATA_LINE.startswith(r"(?i)^\s*(?:document\s+name|document\s+number|document\s+no|doc(?:ument)?\s+no|sop\s+number|") and len(headings.SKIPPED) == 5
    shown = spark.createDataFrame([("Table of Contents",), ("list of figures",), ("tables",), ("Scope",)], "t string").select(headings.skipped(F.col("t")).alias("s")).collect()
    assert [r.s for r in shown] == [True, True, True, False]


def test_parts_keep_their_numbers_apart(spark):
    rows = [(1, 0, "A", [f"t{i}" for i in range(20_050)]), (1, 1, "B", ["x", "y"])]
    sections = spark.createDataFrame(rows, "doc_id long, section_no int, section_path string, texts array<string>")
    chunks = chunking.semantic_hierarchy(sections)
    assert chunks.count() == chunks.select("chunk_no").distinct().count() == 20_052
    last = chunks.orderBy(F.desc("chunk_no")).head()
    assert last.text == "y" and last.section_path == "B"


def test_broken_files_are_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w>" + "text " * 500 + "</w>")
    data = bytearray((tmp_path / "a.docx").read_bytes())
    data[60:90] = b"\xff" * 30
    (tmp_path / "a.docx").write_bytes(bytes(data))
    (tmp_path / "b.xml").write_bytes(b'<?xml version="1.0" encoding="no-such"?><a/>')
    (tmp_path / "c.txt").write_text("fine")
    got = {r.path.rsplit("/", 1)[-1]: r.style for r in D.load_blocks(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "error", "b.xml": "error", "c.txt": ""}


def test_own_folder(spark):
    assert shared_path(spark, "x").startswith(application_dir(spark))
    assert callable(clear)


def test_similar_labels_are_all_pairs(spark):
    from difflib import SequenceMatcher

    from inkwell.operators import understanding as U

    rng = random.Random(5)
    base = ["document owner", "effective date", "batch no", "a", "ab", "abc", "owner", "pages", "no of pages", "date", "reviewed by", "issue date", "x y", "aab"]
    twist = lambda s: "".join(c for c in s if rng.random() > 0.12) + rng.choice(["", "", "s", " x", "1"])
    left, right = base + [twist(rng.choice(base)) for _ in range(150)], base + [twist(rng.choice(base)) for _ in range(60)]
    key = lambda s: re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()

    def score(a, b):
        return 1.0 if a == b else 0.92 if a in b or b in a else SequenceMatcher(None, a, b).ratio()

    want = {(a, b): score(a, b) for a in map(key, left) if a for b in map(key, right) if b}
    want = {p: pytest.approx(s) for p, s in want.items() if s >= 0.78}
    found = U.similar_labels(spark.createDataFrame([(x,) for x in left], "label string"), spark.createDataFrame([(x,) for x in right], "target string"))
    assert {(r.a, r.b): r.score for r in found.collect()} == want and len(want) > 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stream_meter(spark, tmp_path):
    from inkwell.operators.metrics import Meter, StreamMeter

    meter = Meter(spark, shared_path(spark, "metrics"))
    listener = StreamMeter(meter)
    spark.streams.addListener(listener)
    try:
        spark.range(25).coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        run(stream, lambda rows, no: rows.count(), str(tmp_path / "checkpoint"))
        for _ in range(50):
            if any(r[3] for r in meter.rows):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(r[3] for r in meter.rows) == 25
    meter.flush()
    assert meter.read().where("status = 'success'").agg(F.sum("n")).head()[0] == 25


@pytest.mark.parametrize("cells", [10**7, -1])
def test_whole_documents_against_brute_force(spark, words, monkeypatch, cells):
    """Documents scored by matrix products in tasks, and by joins: the same ranks, over all and by scope; rows without an id stay out."""
    from inkwell.operators import retrieval as R

    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "SCOPES", 1)
    docs = spark.createDataFrame([(d, " ".join(w).upper(), None if d % 3 == 2 else f"s{d % 3}") for d, w in words.items()], "doc_id long, text string, source string").repartition(5)
    asked = {7: {"w1", "w30", "w399"}, 8: {"w0", "nothing"}, 9: {"nothing"}}
    queries = spark.createDataFrame([(q, sorted(t)) for q, t in asked.items()], "query_id long, terms array<string>")
    rows = R.bm25(docs, queries, 5, digits=6)
    if cells > 0:
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {q: [(r.doc_id, round(r.bm25, 6)) for r in sorted(rows.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in asked}
    assert got == {q: bm25(words, t, 5) for q, t in asked.items()}
    scoped = R.bm25(docs, queries, 2, digits=6, scope="source").collect()
    for m in range(3):
        mine = [(r.doc_id, r.bm25) for r in scoped if r.query_id == 7 and r.doc_id % 3 == m]
        assert sorted(mine, key=lambda x: (-x[1], x[0])) == bm25(words, asked[7], 2, lambda d: d % 3 == m)


@pytest.mark.parametrize("cells", [8_000_000, 0])
def test_index_scores_many_postings_by_document(spark, words, monkeypatch, cells):
    """Many postings are scored by document, where no score of a pair is ranked over all; queries beyond the table of cells by bounds. Both as by hand."""
    monkeypatch.setattr(I, "DIRECT", -1)
    monkeypatch.setattr(I.R, "CELLS", cells)
    if cells:
        monkeypatch.delattr(I.Bm25Index, "_ranked")
    index = I.Bm25Index(spark, shared_path(spark, "index"))
    for ids in (range(0, 250), range(250, 600)):
        index.add(spark.createDataFrame([(d, " ".join(words[d]), "ab"[d % 2]) for d in ids], "doc_id long, text string, scope string"), scopes=("scope",))
    index.remove(spark.createDataFrame([(d,) for d in range(200, 300)], "doc_id long"))
    live = {d: w for d, w in words.items() if not 200 <= d < 300}
    queries = spark.createDataFrame([(1, ["w0", "w1", "w37"]), (2, [f"w{i}" for i in range(0, 60, 2)])], "query_id long, terms array<string>")
    got = index.search(queries, 9, F.col("scope") == "b", min_score=1.0, digits=6).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        want = [(d, s) for d, s in bm25(live, set(q.terms), 9, lambda d: d % 2 == 1) if s >= 1.0]
        assert [(r.doc_id, r.bm25) for r in got if r.query_id == q.query_id] == [(d, pytest.approx(s, abs=2e-6)) for d, s in want]
