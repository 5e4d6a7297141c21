"""Tables in rows, reports and field operators."""

from pyspark.sql import functions as F

from inkwell.functions import matrix
from inkwell.operators import reports


def test_matrix(spark):
    t = [["Name", "Age"], ["a ", "1"], ["A", "1"], ["name", "AGE"], ["", None], ["--", "2"]]
    df = spark.createDataFrame([(t,)], "t array<array<string>>")
    c = F.col("t")
    got = df.select(matrix.cleaned(c), matrix.without_duplicate_rows(c), matrix.without_repeated_headers(c), matrix.decision(matrix.quality(c)), *[x for x in matrix.stats(c).values()], matrix.key_values(c)).head()
    assert got[0] == [["Name", "Age"], ["a", "1"], ["A", "1"], ["name", "AGE"], ["--", "2"]]
    assert got[1] == [["Name", "Age"], ["a ", "1"], ["", None], ["--", "2"]]
    assert ["name", "AGE"] not in got[2] and got[3] == "ACCEPT" and tuple(got[4:7]) == (6, 2, 2 / 12) and got[7][0].label == "Name"


def test_reports(spark):
    c = spark.createDataFrame([(1, "one two three", 0.5, False), (1, "word " * 20, 0.9, False), (2, "word " * 20, None, True)], "doc_id int, text string, score double, is_duplicate boolean")
    m = reports.quality_metrics(c).head()
    assert (m.chunks_per_doc, m.max_score, m.min_score, round(m.median_score, 3)) == (1.5, 0.9, 0.5, 0.7)
    rows, totals = reports.chunk_report(c)
    assert sorted((r.doc_id, r.status, r.notes) for r in rows.collect()) == [(1, "Good", ""), (1, "Poor", "too short"), (2, "Poor", "duplicate")]
    assert {r.doc_id: (r.n, r.poor, r.duplicates) for r in totals.collect()} == {1: (2, 1, 0), 2: (1, 1, 1)}
    e = reports.embedding_report(c.withColumn("embedding", F.col("score")))
    assert sorted(r.status for r in e.collect()) == ["Excluded", "Filtered", "Used"]


def test_blocks(spark):
    b = spark.createDataFrame([(1, 1, 5, "The limit is 4500 units"), (1, 2, 1, "Nothing here"), (1, 1, 2, "limit")], "chunk_id int, page int, line int, text string").withColumn("needles", reports.needles(F.lit("limit 4500 ab 12")))
    assert [r.line for r in reports.supporting_blocks(b).collect()] == [5]
    p = spark.createDataFrame([(1, 1, "enough usable words on this very page, truly so many"), (1, 2, "x")], "doc_id int, page int, text string")
    n = spark.createDataFrame([(1, 3)], "doc_id int, n int")
    assert [r.page for r in reports.pages_needing_ocr(p, n).orderBy("page").collect()] == [2, 3]
    x = spark.createDataFrame([(1, p, 5) for p in range(1, 6)] + [(2, None, 5)], "doc_id int, page int, n_pages int")
    assert sorted((r.doc_id, r.page or 0) for r in reports.blocks_for_extraction(x).collect()) == [(1, 1), (1, 2), (1, 5), (2, 0)]
    assert reports.blocks_for_extraction(x, strict=True).count() == 3


def test_fields(spark):
    a = spark.createDataFrame([(1, "Owner", "x"), (1, "Date", " ")], "doc_id int, name string, value string")
    b = spark.createDataFrame([(1, "owner", "y"), (1, "date", "2024"), (1, "Code", "7")], "doc_id int, name string, value string")
    assert {r.name: r.value for r in reports.merge_fields(a, b).collect()} == {"Owner": "x", "Date": "2024", "Code": "7"}
    f = spark.createDataFrame([(1, "A", "1", 0), (1, "a", "2", 3), (1, "B", "9", 1)], "doc_id int, label string, value string, pos int")
    assert sorted((r.label, r.value, r.pos) for r in reports.unique_fields(f).collect()) == [("A", "2", 0), ("B", "9", 1)]
    v = spark.createDataFrame([("r", d, n, x) for d in (1, 2, 3) for n, x in (("Dept", "QA"), ("Id", str(d)), ("Site", "S1" if d < 3 else "S2"))], "repository_id string, doc_id int, name string, value string")
    assert [(r.name, r.value, r.level) for r in reports.folder_levels(v, ["id"], ["site"]).orderBy("level").collect()] == [("site", "S1", 1), ("dept", "QA", 2)]


def test_citations(spark):
    c = spark.createDataFrame([(1, 0, "alpha", "beta gamma"), (1, 1, "beta gamma", "beta gamma"), (1, 2, "gamma", "beta gamma")], "query_id int, pos int, text string, answer string")
    assert [(r.pos, r.number) for r in reports.preferred_citations(c, 2).orderBy("number").collect()] == [(1, 1), (2, 2)]
    a = spark.createDataFrame([(1, "see [1] and [2]"), (2, "none"), (3, "[9]")], "id int, text string")
    allowed = spark.createDataFrame([(1, "1"), (1, "2"), (3, "1")], "id int, marker string")
    assert {r.id: r.valid for r in reports.unknown_markers(a, allowed).collect()} == {1: True, 2: False, 3: False}
    t = spark.range(1).select(reports.title_accuracy(F.lit("pump test"), F.lit("The pump test plan")), reports.title_accuracy(F.lit("test pump"), F.lit("pump test")), reports.title_accuracy(F.lit("pump x"), F.lit("pump"))).head()
    assert tuple(t) == (100.0, 85.0, 40.0)
