"""The pipeline's stages on a small folder of tables, each held against what its input says."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("klmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    item = prose(20)
    texts = [prose(60) for _ in range(150)] + [prose(50).upper().replace(" ", "!! ") for _ in range(60)]
    texts[40] = texts[41] = texts[42]
    words = texts[43].split()
    words[30] = "changed"
    texts[44] = " ".join(words)
    texts[50] = f"{prose(30)} {item} {prose(10)}"
    for i in range(0, 60):
        texts[i] += "\nshared footer line"
    docs = [(i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 150), 0) for i in range(0, 210) if i % 3]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(30))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out_{name}"
        out.write.parquet(path)
        docs = got[name] = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = lambda n: {r.doc_id for r in got[n].select("doc_id").collect()}
    assert ids("quality") == set(range(150))
    assert ids("line_dedup") == set(range(150)) and got["line_dedup"].where(F.col("text").contains("shared footer")).count() == 0
    assert got["line_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    assert ids("near_dup") == set(range(150)) - {41, 42, 44}
    assert ids("decontaminate") == set(range(150)) - {41, 42, 44, 50}
    assert ids("packing") == ids("decontaminate")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dup", "decontaminate", "packing"]


def test_run_and_extra_columns(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("keep", F.lit(1)).withColumn("pos", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_nulls_and_empty(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "src1", 0), (None, "some text", "en", "src2", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, sf_dir).count()
        assert n >= 3 or name in ("quality", "packing")
        assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_repeated_rows_leave_one_document(spark, sf_dir):
    a, b = "one two three four five six seven", "entirely other words stand here now indeed"
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (1, a, "en", "s", 1), (2, a, "en", "t", 1), (3, b, "en", "s", 1), (3, b, "de", "s", 1), (None, b, "en", "s", 1), (4, None, "en", "s", 0), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3, 4]
