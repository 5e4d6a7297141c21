"""Files as blocks, the chunk table and the template graph."""

import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.sources import documents as D


def test_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("Plan", "Title") + para("Scope", "Heading2") + para("Some text.") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + para(" ")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="x"'
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        for i, t in ((10, "ten"), (2, "two")):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<p:sld {a}><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sld>")
    (tmp_path / "c.xml").write_text("<article><front><article-title>On x</article-title><p>One</p></front><body><p>One</p><p>Two <i>x</i></p></body></article>")
    (tmp_path / "d.txt").write_text("line one\n\n line two ")
    (tmp_path / "e.docx").write_text("no archive")
    (tmp_path / "f.pdf").write_text("unknown")
    got = {}
    for r in D.load_blocks(spark, str(tmp_path)).orderBy("path", "block_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.text, r.page, r.component_type, r.heading_level))
    assert got["a.docx"] == [("Plan", 1, "title", 1), ("Scope", 1, "subtitle", 2), ("Some text.", 1, "paragraph", None), ("a | b\n1 | 2", 1, "table", None)]
    assert got["b.pptx"] == [("two", 2, "paragraph", None), ("ten", 10, "paragraph", None)]
    assert [x[0] for x in got["c.xml"]] == ["On x", "One", "Two x"] and [x[0] for x in got["d.txt"]] == ["line one", "line two"]
    assert got["e.docx"][0][0].startswith("BadZipFile") and "f.pdf" not in got
    text = {r.path.rsplit("/", 1)[-1]: r.text for r in D.article_text(D.load_blocks(spark, str(tmp_path / "c.xml"))).collect()}
    assert text == {"c.xml": "On x\n\nOne\n\nTwo x"}
    chunks = D.collected_chunks(spark, str(tmp_path), min_words=1).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.section_path) for r in chunks][0] == ("a.docx", "Plan > Scope")


def test_chunk_table(spark):
    rows = [("r", "d1", "c1", [1.0, 2.0], False), ("r", "d1", "c2", [1.0, 3.0], True), ("r", "d2", "c3", None, False), ("r", "d2", "c4", [0.0, 1.0], None), ("r", "d2", "c4", [0.0, 1.0], None)]
    schema = "repository_id string, document_id string, chunk_id string, embedding array<double>, is_duplicate boolean"
    first = D.store_chunks(None, spark.createDataFrame(rows, schema), 2)
    assert sorted(r.chunk_id for r in first.collect()) == ["c1", "c4"]
    second = D.store_chunks(first, spark.createDataFrame([("r", "d1", "c9", [5.0, 5.0], False)], schema), 2)
    assert sorted(r.chunk_id for r in second.collect()) == ["c4", "c9"]
    assert [r.chunk_id for r in D.document_chunks(second, "d1", "r").collect()] == ["c9"]
    with pytest.raises(Exception, match="dimension"):
        D.store_chunks(None, spark.createDataFrame([("r", "d", "c", [1.0], False)], schema), 2).collect()
    names = second.select(F.col("document_id").alias("doc_name"), F.lit(None).cast("string").alias("document_name"))
    assert [tuple(r) for r in D.unique_documents(names, 1).collect()] == [("d1", True)]


def test_graph(spark):
    nodes = spark.createDataFrame([(k, k.upper()) for k in "abcd"], "key string, props string")
    edges = spark.createDataFrame([("a", "b", "CHILD", 2), ("a", "c", "HEADING", 1), ("b", "d", "STEP", 1), ("d", "a", "CHILD", 1)], "parent string, child string, type string, order int")
    n, e = D.merge_graph(nodes, edges, spark.createDataFrame([("b", "new"), ("e", "E")], "key string, props string"), spark.createDataFrame([("c", "e", "STEP", 1), ("a", "b", "CHILD", 5)], "parent string, child string, type string, order int"))
    got = [(r.child, r.depth, r.props) for r in D.tree_of(n, e, "a").orderBy("path").collect()]
    assert got == [("c", 1, "C"), ("e", 2, "E"), ("b", 1, "new"), ("d", 2, "D")]


def test_spread_counts_splits_with_rows(spark, tmp_path):
    """One row group that is planned as many splits is read by one task, so it is spread; many row groups stay."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from inkwell.sources.tables import spread

    rows = pa.table({"k": list(range(20_000)), "text": [f"{i * 7919 % 10007} word {i}" for i in range(20_000)]})
    for groups in (1, 20):
        pq.write_table(rows, str(tmp_path / f"{groups}.parquet"), row_group_size=20_000 // groups, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        held = lambda df: df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
        for groups in (1, 20):
            df = spark.read.parquet(str(tmp_path / f"{groups}.parquet"))
            assert df.rdd.getNumPartitions() > 8 and sum(n > 0 for n in held(df)) == (1 if groups == 1 else sum(n > 0 for n in held(spread(df))))
            n = held(spread(df))
            assert sum(n) == 20_000 and sum(x > 0 for x in n) >= 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
