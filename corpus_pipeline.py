"""Corpus preparation from raw documents to packed windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written to the shared folder and read again, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import quality as quality_model
from inkwell.llm.common import held_out, small_side, written
from inkwell.llm.decontaminate import clean
from inkwell.llm.line_dedup import line_dedup
from inkwell.llm.near_dup import near_dup
from inkwell.llm.packing import pack_documents
from inkwell.llm.queries import tokenizer_file
from inkwell.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return quality_model.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; every document stays. n_chars follows the text."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id; of rows that repeat an id, the one with the smallest text hash."""
    gone = written(near_dup(docs).where(~F.col("keep")).select("doc_id"), "copies", narrow=True)
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated", narrow=True)
    kept = docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    side, first = small_side(twice), Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = kept.join(side, "doc_id", "left_semi").withColumn("_copy_no", F.row_number().over(first)).where("_copy_no = 1").select(*docs.columns)
    return kept.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return pack_documents(docs, tokenizer_file())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontaminate", decontamination), ("packing", packing)]

#: The classifier, the sketches and the tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
