"""Reports and selections over chunks, blocks, fields and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T


def quality_metrics(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, text, score): extremes, mean and median score, mean length and tokens, chunks a document."""
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(T.token_count("text")).alias("tokens"))
    docs = per_doc.agg(F.avg("n").alias("chunks_per_doc"), (F.sum("chars") / F.sum("n")).alias("avg_length"), (F.sum("tokens") / F.sum("n")).alias("avg_tokens"))
    s = chunks.agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.median("score").alias("median_score"))
    return docs.join(F.broadcast(s))


def chunk_report(chunks: DataFrame, min_words: int = 10, target: int = 150) -> tuple[DataFrame, DataFrame]:
    """chunks (doc_id, text, is_duplicate): each with a status and notes, and totals for each document."""
    w = T.token_count("text")
    notes = F.concat_ws("; ", F.when(w < min_words, "too short"), F.when(w > 2 * target, "too long"), F.when(F.col("is_duplicate"), "duplicate"))
    rows = chunks.withColumn("n_words", w).withColumn("notes", notes)
    rows = rows.withColumn("status", F.when((F.col("n_words") < min_words) | F.col("is_duplicate"), "Poor").when(F.col("n_words") > 2 * target, "Review").otherwise("Good"))
    count = lambda s: F.count_if(F.col("status") == s)
    totals = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("avg_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"), count("Review").alias("review"), count("Poor").alias("poor"), F.count_if("is_duplicate").alias("duplicates")
    )
    return rows, totals


def embedding_report(chunks: DataFrame, min_words: int = 10) -> DataFrame:
    """Used if embedded, not a duplicate and long enough; Filtered if a rule took it; Excluded without an embedding."""
    short = T.token_count("text") < min_words
    status = F.when(F.col("embedding").isNull(), "Excluded").when(short | F.col("is_duplicate"), "Filtered").otherwise("Used")
    return chunks.withColumn("status", status)


def needles(*texts: Column) -> Column:
    """Distinct lower-case tokens; digits from 4 characters, others from 3."""
    every = F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(every, lambda x: F.when(x.rlike("^[0-9]+$"), F.length(x) >= 4).otherwise(F.length(x) >= 3)))


def supporting_blocks(blocks: DataFrame, wanted: str = "needles") -> DataFrame:
    """blocks (chunk_id, page, line, text, needles): the blocks with the highest needle weight, all ties, in reading order."""
    t = F.lower("text")
    weight = F.aggregate(wanted, F.lit(0), lambda a, n: a + F.when(F.contains(t, n), F.when(n.rlike("[0-9]") | (F.length(n) >= 8), 3).otherwise(1)).otherwise(0))
    bonus = F.when(t.rlike(r"\d"), 5).otherwise(0) * F.when(F.exists(wanted, lambda n: n.rlike("^[0-9]+$")), 1).otherwise(0) + F.when(t.contains("revision history"), 2).otherwise(0)
    rows = blocks.withColumn("weight", weight + bonus).where("weight > 0")
    best = rows.withColumn("_r", F.rank().over(Window.partitionBy("chunk_id").orderBy(F.desc("weight")))).where("_r = 1").drop("_r")
    return best.orderBy("chunk_id", "page", "line")


def pages_needing_ocr(blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """blocks (doc_id, page, text), page_counts (doc_id, n): the pages from 1 to n whose joined text isn't usable."""
    order = "line" if "line" in blocks.columns else "text"
    parts = F.array_sort(F.collect_list(F.struct(order, F.col("text").alias("t"))))
    joined = blocks.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))
    good = joined.where(T.usable_native_text("text")).select("doc_id", "page")
    return page_counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page")).join(good, ["doc_id", "page"], "left_anti")


def extraction_pages(n: Column) -> Column:
    """Pages 1, 2 and the last; all of up to three."""
    return F.when(n <= 3, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(1), F.lit(2), n))


def blocks_for_extraction(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """blocks (doc_id, page, n_pages, ...): those on the selected pages; all of a document without page tags unless strict."""
    keep = F.coalesce(F.array_contains(extraction_pages(F.col("n_pages")), F.col("page")), F.lit(False))
    if strict:
        return blocks.where(keep)
    tagged = F.bool_or(keep).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("_k", keep).withColumn("_t", tagged).where(F.col("_k") | ~F.col("_t")).drop("_k", "_t")


def merge_fields(extracted: DataFrame, discovered: DataFrame) -> DataFrame:
    """(doc_id, name, value) twice, by lower-case name: extracted values win, discovered ones fill what is missing or empty."""
    a = extracted.select("doc_id", F.lower("name").alias("key"), F.col("name").alias("a_name"), F.nullif(F.trim("value"), F.lit("")).alias("a_value"))
    b = discovered.select("doc_id", F.lower("name").alias("key"), F.col("name").alias("b_name"), F.nullif(F.trim("value"), F.lit("")).alias("b_value"))
    m = a.join(b, ["doc_id", "key"], "full")
    return m.select("doc_id", F.coalesce("a_name", "b_name").alias("name"), F.coalesce("a_value", "b_value").alias("value"))


def unique_fields(fields: DataFrame) -> DataFrame:
    """(doc_id, label, value, pos): one row for each label whatever its case; the last value, at the first position."""
    g = fields.groupBy("doc_id", F.lower("label").alias("key")).agg(F.min_by("label", "pos").alias("label"), F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    return g.drop("key")


def folder_levels(fields: DataFrame, instance: list[str], grouping: list[str], depth: int = 3, min_docs: int = 2) -> DataFrame:
    """(repository_id, doc_id, name, value): values that several documents share, grouping fields first, up to a depth."""
    f = fields.where(~F.lower("name").isin(*instance)).groupBy("repository_id", F.lower("name").alias("name"), "value").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= min_docs)
    first = F.when(F.col("name").isin(*grouping), 0).otherwise(1) if grouping else F.lit(1)
    w = Window.partitionBy("repository_id").orderBy(first, F.desc("n"), "name", "value")
    return f.withColumn("level", F.row_number().over(w)).where(F.col("level") <= depth)


def preferred_citations(citations: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, text, answer): most answer tokens first, ties in their order, renumbered, k of them."""
    have = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    score = F.size(F.array_intersect(have, needles(F.col("answer"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return citations.withColumn("score", score).withColumn("number", F.row_number().over(w)).where(F.col("number") <= k)


def unknown_markers(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """answers (id, text), allowed (id, marker): whether each answer has markers and all of them are allowed."""
    m = answers.select("id", F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)))).alias("marker"))
    bad = m.where("marker is not null").join(allowed, ["id", "marker"], "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("bad"))
    n = m.groupBy("id").agg(F.count("marker").alias("n"))
    return n.join(bad, "id", "left").select("id", ((F.col("n") > 0) & F.col("bad").isNull()).alias("valid"))


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Every table without the rows of the documents that are gone."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def title_accuracy(query: Column, title: Column) -> Column:
    """100 for the phrase, 85 for all tokens, else the share of tokens found, up to 80."""
    q = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0)))
    have = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))
    share = F.size(F.array_intersect(q, have)) / F.greatest(F.size(q), F.lit(1))
    return F.when(F.size(q) == 0, 0.0).when(F.contains(F.lower(title), F.lower(query)), 100.0).when(share == 1, 85.0).otherwise(F.bround(share * 80, 0))


def confidence_distribution(rows: DataFrame) -> DataFrame:
    """rows (query_id, confidence): how many are of each level, none left out, with the mean and the highest confidence."""
    band = lambda low, high: F.count_if((F.col("confidence") >= low) & (F.col("confidence") < high))
    return rows.groupBy("query_id").agg(
        F.count_if(F.col("confidence") >= 0.85).alias("very_high"), band(0.70, 0.85).alias("high"), band(0.50, 0.70).alias("medium"), F.count_if(F.col("confidence") < 0.50).alias("low"),
        F.avg("confidence").alias("avg_confidence"), F.max("confidence").alias("max_confidence"), F.min("confidence").alias("min_confidence"),
    )


def page_range(blocks: DataFrame, by: str = "chunk_id") -> DataFrame:
    """First and last page and line of the blocks of a chunk; what isn't known stays out."""
    return blocks.groupBy(by).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min(F.coalesce("line_start", "line_number")).alias("line_start"), F.max(F.coalesce("line_end", "line_start", "line_number")).alias("line_end"))


def exact_mean(x: Column, digits: int = 6) -> Column:
    """The mean of values of so many decimals, whatever their order: they are summed as whole numbers."""
    return F.sum(F.round(x * 10**digits).cast("long")) / F.lit(float(10**digits)) / F.count(x)


def answer_summary(rows: DataFrame, digits: int = 6) -> DataFrame:
    """rows (query_id, confidence, complexity_score, complexity_level) of an answer's chunks, scores of ``digits`` decimals: averages, extremes, and how many are of each level."""
    level = lambda name: F.count_if(F.col("complexity_level") == name)
    hard = rows.groupBy("query_id").agg(exact_mean(F.col("complexity_score"), digits).alias("average_complexity"), exact_mean(F.col("confidence"), digits).alias("average_confidence"), *[level(n).alias(f"complexity_{n.lower()}") for n in ("Low", "Medium", "High")])
    return confidence_distribution(rows).drop("avg_confidence").join(hard, "query_id")
