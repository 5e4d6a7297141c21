"""Tables, topics, chunks by a strategy's name, networks of references and audit lists on small inputs."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.functions import detect, matrix
from inkwell.operators import chunking as K
from inkwell.operators import observability as obs
from inkwell.operators import references as X


def test_kinds_of_tables(spark):
    tables = {
        1: ([["Name:", "x", "y"], ["Role:", "b", "c"]], "KEY_VALUE"), 2: ([["a"], ["b"]], "SINGLE_COLUMN"), 3: ([["", " "], [""]], "INVALID"), 4: ([["a", "b"], ["", "c"]], "KEY_VALUE"),
        5: ([["a", "b", "c"], ["1", "2", "3"]], "GRID"), 6: ([["7", "b", None], ["a", "b", "c"], ["1", "2", "3"]], "GRID"), 7: (None, "INVALID"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in tables.items()], "id int, t array<array<string>>")
    assert {r.id: r.kind for r in df.select("id", matrix.kind(F.col("t")).alias("kind")).collect()} == {i: k for i, (_, k) in tables.items()}


@pytest.mark.parametrize(
    ("text", "rows", "columns", "empty", "spec", "content", "form"),
    [
        ("", 3, 2, 1.0, False, False, True),
        (" | \n | ", 2, 2, 1.0, False, False, True),
        (None, 0, 0, 1.0, False, False, True),
        ("Sl. No | Parameter | Limit\n1 | pH | 7", 2, 3, 0.0, True, True, False),
        ("Sl. No | Parameter\n1 | ", 2, 2, 0.25, True, False, False),
        ("Checked by | Sign | Date\nA | | ", 2, 3, 0.3, False, False, True),
        ("Checked by | | \n | | \n | | \n | | \n | | ", 5, 3, 0.9, False, False, True),
        ("Yes / No | NA\nremarks | x", 2, 2, 0.0, False, False, True),
        ("1.0 PURPOSE | Sign | Date\nchecked by | a | b", 2, 3, 0.0, False, True, False),
        ("12.0 Sign | 3\nchecked by | a", 2, 2, 0.0, False, False, True),
        ("Revision history | a\nb | c", 2, 2, 0.0, False, True, False),
        ("a | b\nc | d", 2, 2, 0.0, False, False, False),
        ("Sign | Date\n" + " ".join(["word"] * 60) + " | checked by", 2, 2, 0.0, False, True, False),
        ("5 to 7 | 8 from 9 | time", 3, 3, 0.0, False, False, False),
    ],
)
def test_forms_and_contents(spark, text, rows, columns, empty, spec, content, form):
    df = spark.createDataFrame([(text, rows, columns, empty)], "t string, r int, c int, e double")
    got = df.select(matrix.specification_table(F.col("t"), F.col("c")), matrix.content_table(F.col("t")), matrix.form_table(F.col("t"), F.col("r"), F.col("c"), F.col("e"))).head()
    assert tuple(got) == (spec, content, form)


def test_topics(spark):
    df = spark.createDataFrame([(1, "NDA, nda and a contract"), (2, "nothing here"), (3, None), (4, "batch " * 9 + "éit itä")], "id int, text string")
    got = {r.id: [tuple(t) for t in r.t] for r in df.select("id", detect.topics("text").alias("t")).collect()}
    assert got[1] == [("Legal", 0.9), ("Regulatory", 0.6)]
    assert got[2] == got[3] == [("General", 1.0)]
    assert got[4] == [("Manufacturing", 1.0)]


def test_chunks_by_name(spark):
    docs = spark.createDataFrame([(1, "Heading\nOne sentence here. Another one follows.\n\nA last one."), (2, None), (3, "  ")], "doc_id long, text string")
    rows = K.preview(docs).collect()
    assert {r.strategy for r in rows} == set(K.STRATEGIES) and {r.doc_id for r in rows} == {1}
    small = K.chunked(docs, "Sliding_Window", size=4, step=2).orderBy("chunk_no").collect()
    assert small[0].text.split()[:2] == ["Heading", "One"] and all(r.n_words <= 4 for r in small)
    with pytest.raises(ValueError, match="unknown chunking strategy"):
        K.chunked(docs, "by-colour")
    assert K.preview(docs.where("false")).count() == 0


def test_semantic_chunks_follow_their_rule(spark):
    docs = spark.createDataFrame([(1, "Red red red. Red red red. Blue blue. Blue blue.")], "doc_id long, text string")
    assert [r.text for r in K.chunked(docs, "semantic").orderBy("chunk_no").collect()] == ["Red red red. Red red red.", "Blue blue. Blue blue."]
    assert K.chunked(docs, "semantic", max_sentences=1).count() == 4


def test_network_of_references(spark):
    said = spark.createDataFrame([(1, "DOC-2"), (1, "DOC-9"), (2, "DOC-2"), (1, "DOC-2")], "source long, target string")
    names = spark.createDataFrame([(1, "doc_1.pdf"), (2, "Doc-2.docx"), (3, "x")], "document_id long, name string")
    e = X.graph(said, names)
    assert {tuple(r) for r in e.where("center = '1'").select("source", "target", "type").collect()} == {
        ("1", "1::DOC-2", "MENTIONS_REFERENCE"), ("1", "1::DOC-9", "MENTIONS_REFERENCE"), ("1::DOC-2", "2", "TARGETS"), ("1", "2", "REFERS_TO"),
    }
    assert [tuple(r) for r in X.referenced_by(e).collect()] == [("2", "1")]
    assert {(r.id, r.label) for r in X.nodes(e).where("center = '1'").collect()} == {("1", "Document"), ("2", "Document"), ("1::DOC-2", "Reference"), ("1::DOC-9", "Reference")}


def test_audit_lists(spark):
    row = "id long, ts timestamp, request_id string, correlation_id string, application_name string, event_type string, entity_type string, entity_id string, status string, category string, action string, source string, changes string, exception string, metadata string"
    trail = spark.createDataFrame([(i, None, "r", None, None, t, "d", str(i), None, None, None, None, c, None, m) for i, (t, c, m) in enumerate([("user_login_x", "[]", None), ("OTHER", '["a"]', '{"repository_id": "0"}'), ("SEARCH_RUN", None, "no json")])], row)
    ids = lambda **asked: sorted(r.id for r in obs.audit_events(trail, obs.AuditQuery(**asked))[0].collect())
    assert ids() == [0, 1, 2] and ids(business_only=True) == [0, 2]
    assert ids(has_changes=True) == [1] and ids(has_changes=False) == [0, 2]
    assert ids(repository_id="0") == [0, 1] and ids(search="NO JS") == [2] and ids(date_from="2024-01-01") == []
    rows, total = obs.audit_events(trail, obs.AuditQuery(page=2, page_size=2))
    assert rows.count() == 1 and total.head()[0] == 3


def test_detected_sections_judge_each_block_once(spark):
    """Regexes aren't repeated by nested rules, and one partition of blocks is dealt out before it is judged."""
    blocks = spark.createDataFrame([(d, n, t, None, None, "", False) for d in (1, 2) for n, t in enumerate(("1.0OBJECTIVE This is the body of it", "2. Scope:", "words", "AB C", "a: b"))], "doc_id long, block_no int, text string, component_type string, heading_level int, style string, bold boolean").coalesce(1)
    rows = K.detected_sections(blocks)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 400 and plan.index("RepartitionByExpression [doc_id") > plan.rindex("RLIKE")
    assert sorted((r.doc_id, r.section_path, list(r.texts)) for r in rows.collect())[:2] == [(1, "1.0 OBJECTIVE", ["This is the body of it"]), (1, "2. Scope", ["words", "AB C", "a: b"])]


def test_means_of_an_answer_do_not_depend_on_the_order(spark):
    """80 scores whose sum is 10.3158: their mean is the same however they are dealt, and lies at a half behind the sixth decimal."""
    from inkwell.operators import reports as R

    scores = [0.1] * 40 + [0.157895] * 40
    rows = spark.createDataFrame([(1, 0.5, s, "Low") for s in scores], "query_id long, confidence double, complexity_score double, complexity_level string")
    for n in (1, 3, 7):
        (r,) = R.answer_summary(rows.repartition(n)).collect()
        assert (r.average_complexity, r.average_confidence, r.complexity_low, r.low) == (10.3158 / 80, 0.5, 80, 0)


def test_rules_of_texts_are_planned_once(spark):
    """Readability takes a text's words once in a column, not once in every use; a literal keyword is looked for before its expression."""
    from inkwell.functions import evidence

    df = spark.createDataFrame([("The able make 12. Rhythm!",), ("",), (None,)], "text string")
    r = evidence.readability("text")
    plan = df.select(r["complexity"].alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("A-Za-z0-9][A-Za-z0-9") == 1
    got = df.select(*[r[k].alias(k) for k in ("n_words", "n_sentences", "n_syllables")]).collect()
    assert [tuple(x) for x in got] == [(5, 2, 4), (0, 0, 0), (0, 0, 0)]
    assert "contains" in df.select(detect.topics("text"))._jdf.queryExecution().analyzed().toString().lower()


def test_packing_holds_few_chunks():
    """A batch of many rows goes on in small batches of chunks, whose rows are those of whole packing."""
    said = [[f"Row {i} has sentence {k} of six words." for k in range(i % 40)] for i in range(500)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(said, pa.list_(pa.string()))], names=["doc_id", "s"])
    out = list(K.packer(["doc_id"], 20, 1, 5, most=5000)([rows]))
    want = [(i, k, c, len(c.split())) for i, s in enumerate(said) for k, c in enumerate(K.pack_sentences(s, 20, 1, 5))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want
    assert len(out) > 10 and max(sum(map(len, b.column("text").to_pylist())) for b in out) < 10_000
