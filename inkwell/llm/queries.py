"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import secrets
from inkwell.llm.decontaminate import decontaminate
from inkwell.llm.line_dedup import line_dedup
from inkwell.llm.near_dup import near_dup
from inkwell.llm.packing import pack_documents
from inkwell.llm.phrases import phrases
from inkwell.llm.pieces import fingerprints
from inkwell.llm.quality import quality
from inkwell.llm.substring_dedup import substring_dedup
from inkwell.llm.topk import quantized, topk
from inkwell.llm.toxicity import toxicity
from inkwell.llm.warc import fixity_report
from inkwell.llm.whitening import whiten
from inkwell.sources.tables import table


def tokenizer_file() -> str:
    """The public byte-level vocabulary that op8 packs with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    """The public merge-type piece model that op11 encodes with."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, by a ledger that has met each document without its last line: texts of one line aren't scanned again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.new_ledger(docs)
    secrets.scan_versions(docs.withColumn("text", secrets.without_last_line(F.col("text"))), "doc_id", "text", ledger)
    return secrets.document_report(docs, ledger)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill: the replica has lost the last character of every body whose page_id is divisible by 97."""
    hurt = F.when(F.col("page_id") % 97 == 0, F.expr("left(html, greatest(length(html) - 1, 0))")).otherwise(F.col("html"))
    return fixity_report(table(spark, sf_dir, "pages"), hurt)


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), piece_file())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_line_dedup, op3_quality, op4_near_dup, op5_topk, op6_substring_dedup, op7_secrets, op8_packing, op9_toxicity, op10_warc, op11_pieces, op12_whitening, op13_phrases,
    )
}
