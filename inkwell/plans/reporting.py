"""Reports, scores, tables in rows, references and validation over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import matrix, scores, text, validate
from inkwell.operators import observability as obs
from inkwell.operators import reports as R
from inkwell.plans.observability import E, events
from inkwell.plans.registry import query
from inkwell.sources.tables import table

#: Chunks: the turns of conversations, with a score and a mark of duplicates.
_CH = "c AS (SELECT conv_id AS doc_id, turn, text, CASE WHEN turn % 3 > 0 THEN (conv_id % 50 + turn) / 60.0 END AS score, turn % 4 = 3 AS is_duplicate, CASE WHEN turn % 5 > 0 THEN turn END AS embedding FROM conversations)"
_NW = "CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END"


def chunks(spark, sf_dir):
    t = F.col("turn")
    score = F.when(t % 3 > 0, (F.col("conv_id") % 50 + t) / 60.0)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text", score.alias("score"), (t % 4 == 3).alias("is_duplicate"), F.when(t % 5 > 0, t).alias("embedding"))


@query(f"""WITH {_CH}, d AS (SELECT doc_id, count(*) AS n, sum(length(text)) AS chars, sum({_NW}) AS tokens FROM c GROUP BY 1)
SELECT round(avg(n), 6) AS chunks_per_doc, round(sum(chars) / sum(n), 6) AS avg_length, round(sum(tokens) / sum(n), 6) AS avg_tokens, (SELECT round(avg(score), 6) FROM c) AS avg_score, (SELECT round(max(score), 6) FROM c) AS max_score, (SELECT round(min(score), 6) FROM c) AS min_score, (SELECT round(median(score), 6) FROM c) AS median_score FROM d""")
def quality_metrics(spark, sf_dir):
    m = R.quality_metrics(chunks(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(f"""WITH {_CH}, w AS (SELECT *, {_NW} AS n FROM c), s AS (SELECT *, CASE WHEN n < 10 OR is_duplicate THEN 'Poor' WHEN n > 40 THEN 'Review' ELSE 'Good' END AS status FROM w)
SELECT doc_id, count(*) AS n, round(avg(n), 6) AS avg_words, CAST(min(n) AS INT) AS min_words, CAST(max(n) AS INT) AS max_words, count(*) FILTER (status = 'Review') AS review, count(*) FILTER (status = 'Poor') AS poor, count(*) FILTER (is_duplicate) AS duplicates FROM s GROUP BY 1""")
def chunk_report(spark, sf_dir):
    return R.chunk_report(chunks(spark, sf_dir), 10, 20)[1].withColumn("avg_words", F.round("avg_words", 6))


@query(f"WITH {_CH} SELECT doc_id, turn, CASE WHEN embedding IS NULL THEN 'Excluded' WHEN {_NW} < 10 OR is_duplicate THEN 'Filtered' ELSE 'Used' END AS status FROM c")
def embedding_report(spark, sf_dir):
    return R.embedding_report(chunks(spark, sf_dir), 10).select("doc_id", "turn", "status")


@query(f"WITH {_CH}, x AS (SELECT doc_id, turn, coalesce(score, turn / 40.0) AS d FROM c) SELECT doc_id, turn, round(greatest(0, least(1, 1 - d)), 6) AS similarity, round(coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE d END, CASE WHEN turn % 2 = 0 THEN greatest(0, least(1, 1 - d)) END, greatest(0.01, 1 - 0.025 * turn)), 6) AS result, CASE WHEN d >= 0.85 THEN 'very_high' WHEN d >= 0.7 THEN 'high' WHEN d >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM x")
def score_columns(spark, sf_dir):
    x = chunks(spark, sf_dir).select("doc_id", "turn", F.coalesce("score", F.col("turn") / 40.0).alias("d"))
    t = F.col("turn")
    result = scores.result_score(F.when(t % 3 != 0, F.col("d")), F.when(t % 2 == 0, F.col("d")), t)
    return x.select("doc_id", "turn", F.round(scores.distance_to_similarity(F.col("d")), 6).alias("similarity"), F.round(result, 6).alias("result"), scores.level(F.col("d")).alias("level"))


@query(f"WITH {_CH} SELECT doc_id % 7 AS query_id, count(*) FILTER (score >= 0.85) AS very_high, count(*) FILTER (score >= 0.7 AND score < 0.85) AS high, count(*) FILTER (score >= 0.5 AND score < 0.7) AS medium, count(*) FILTER (score < 0.5) AS low, round(avg(score), 6) AS avg_confidence, round(max(score), 6) AS max_confidence FROM c WHERE score IS NOT NULL GROUP BY 1")
def confidence_distribution(spark, sf_dir):
    rows = chunks(spark, sf_dir).where("score is not null").select((F.col("doc_id") % 7).alias("query_id"), F.col("score").alias("confidence"))
    d = R.confidence_distribution(rows)
    return d.select("query_id", "very_high", "high", "medium", "low", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("max_confidence", 6).alias("max_confidence"))


@query(f"WITH {_CH}, n AS (SELECT doc_id, turn, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN length(x) >= 4 ELSE length(x) >= 3 END)) AS n FROM c) SELECT doc_id, turn, CAST(len(n) AS INT) AS n, list_min(n) AS least FROM n")
def evidence_needles(spark, sf_dir):
    n = R.needles(F.coalesce("text", F.lit("")))
    return chunks(spark, sf_dir).select("doc_id", "turn", F.size(n).alias("n"), F.array_min(n).alias("least"))


@query("""SELECT page_id, length(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[^\\pL\\pN]', '', 'g')) AS score FROM pages""")
def ocr_text_score(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.alnum_score(F.regexp_replace("html", "<[^>]*>", " ")).cast("long").alias("score"))


_GOOD = "length(t) >= 40 AND length(regexp_replace(t, '[^\\pL]', '', 'g')) >= 12 AND len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) >= 5 AND length(regexp_replace(t, '[^\\pL]', '', 'g')) / length(t) >= 0.28"


@query(f"""WITH b AS (SELECT conv_id AS doc_id, turn // 2 + 1 AS page, turn, text FROM conversations WHERE turn < 6), j AS (SELECT doc_id, page, trim(string_agg(CASE WHEN doc_id % 3 = 0 THEN left(text, 10) ELSE text END, ' ' ORDER BY turn)) AS t FROM b GROUP BY 1, 2)
SELECT d.doc_id, p AS page FROM (SELECT DISTINCT doc_id FROM b) d, (SELECT unnest([1, 2, 3, 4]) AS p) LEFT JOIN j ON j.doc_id = d.doc_id AND j.page = p WHERE NOT coalesce({_GOOD}, false)""")
def pages_needing_ocr(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").where("turn < 6")
    cut = F.when(F.col("conv_id") % 3 == 0, F.left("text", F.lit(10))).otherwise(F.col("text"))
    rows = b.select(F.col("conv_id").alias("doc_id"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page"), F.col("turn").alias("line"), cut.alias("text"))
    return R.pages_needing_ocr(rows, rows.select("doc_id", F.lit(4).alias("n")).distinct())


@query("""WITH b AS (SELECT conv_id AS doc_id, turn + 1 AS page, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT doc_id, page FROM b WHERE CASE WHEN n <= 3 THEN page <= n ELSE page IN (1, 2, n) END OR doc_id % 4 = 0""")
def extraction_blocks(spark, sf_dir):
    """Documents divisible by 4 have no page tags and keep all blocks."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("at"), F.when(F.col("conv_id") % 4 != 0, (F.col("turn") + 1).cast("int")).alias("page"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).cast("int").alias("n_pages"))
    return R.blocks_for_extraction(rows).select("doc_id", F.col("at").alias("page"))


@query("""WITH t AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT id, CAST(n AS INT) AS n_rows, 3 AS n_columns, round((n // 2) / (n * 3.0), 6) AS empty_ratio, CAST(least(n, 3) AS INT) AS distinct_rows FROM t""")
def table_matrices(spark, sf_dir):
    """Each customer's orders as a table: a column of every other row is empty, and rows repeat by status."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"))
    row = F.array(F.concat(F.lit("r"), (F.col("n") % 3).cast("string")), F.when(F.col("n") % 2 == 0, " ").otherwise("x"), F.lit("y"))
    t = o.groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]).alias("t"))
    s = matrix.stats(F.col("t"))
    keyed = F.transform("t", lambda r: F.array(F.get(r, F.lit(0))))
    return t.select("id", s["n_rows"].alias("n_rows"), s["n_columns"].alias("n_columns"), F.round(s["empty_ratio"], 6).alias("empty_ratio"), F.size(matrix.without_duplicate_rows(keyed)).alias("distinct_rows"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN '12.5' WHEN 2 THEN '2024-01-31' WHEN 5 THEN 'plain text' END AS value, CASE c_custkey % 6 WHEN 3 THEN 'invalid_number' WHEN 4 THEN 'invalid_date' END AS reason FROM customer""")
def coerced_values(spark, sf_dir):
    """Booleans, numbers, dates and texts, good and bad ones, with what each becomes (stated)."""
    v = F.expr("CASE c_custkey % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN '12.5 mg' WHEN 2 THEN '2024-01-31' WHEN 3 THEN 'none' WHEN 4 THEN '2024-13-01' ELSE ' plain text ' END")
    kind = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'number' WHEN 3 THEN 'number' WHEN 2 THEN 'date' WHEN 4 THEN 'date' ELSE 'string' END")
    reason = F.when(F.col("c_custkey") % 6 != 1, validate.reason(kind, v))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), validate.coerced(v, kind).alias("value"), reason.alias("reason"))


@query("""WITH a AS (SELECT o_custkey AS doc_id, lower(o_orderpriority) AS k, max(o_orderpriority) AS name, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END) AS value FROM orders GROUP BY 1, 2),
b AS (SELECT o_custkey AS doc_id, lower(o_orderpriority) AS k, upper(max(o_orderpriority)) AS name, 'found' AS value FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT doc_id, coalesce(a.name, b.name) AS name, coalesce(nullif(a.value, ''), b.value) AS value FROM a FULL JOIN b USING (doc_id, k)""")
def merged_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("")).alias("value"))
    b = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc_id"), F.upper("o_orderpriority").alias("name"), F.lit("found").alias("value")).distinct()
    return R.merge_fields(a, b)


@query("""WITH f AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS label, o_orderstatus || o_orderkey AS value, o_orderkey AS pos FROM orders)
SELECT doc_id, arg_min(label, pos) AS label, arg_max(value, pos) AS value, min(pos) AS pos FROM f GROUP BY doc_id, lower(label)""")
def unique_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(k % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("label"), F.concat("o_orderstatus", k.cast("string")).alias("value"), k.alias("pos"))
    return R.unique_fields(f)


@query("""WITH v AS (SELECT c_nationkey AS repository_id, 'segment' AS name, c_mktsegment AS value, c_custkey AS d FROM customer UNION ALL SELECT c_nationkey, 'group', 'G' || c_custkey % 3, c_custkey FROM customer),
g AS (SELECT repository_id, name, value, count(DISTINCT d) AS n FROM v GROUP BY 1, 2, 3 HAVING count(DISTINCT d) >= 2)
SELECT repository_id, name, value, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY CASE WHEN name = 'group' THEN 0 ELSE 1 END, n DESC, name, value) AS INT) AS level FROM g QUALIFY level <= 3""")
def folder_levels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    field = lambda name, value: c.select(F.col("c_nationkey").alias("repository_id"), F.col("c_custkey").alias("doc_id"), F.lit(name).alias("name"), value.alias("value"))
    v = field("Segment", F.col("c_mktsegment")).unionByName(field("Group", F.concat(F.lit("G"), (F.col("c_custkey") % 3).cast("string")))).unionByName(field("Id", F.lit("same")))
    return R.folder_levels(v, ["id"], ["group"]).select("repository_id", "name", "value", "level")


@query("""WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ['1', '2'] WHEN 1 THEN ['9'] WHEN 2 THEN [] ELSE ['1'] END AS m FROM customer) SELECT id, len(m) > 0 AND len(list_filter(m, lambda x: x NOT IN ('1', '2'))) = 0 AS valid FROM a""")
def citation_markers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    said = F.when(F.col("id") % 4 == 0, "see [1] and [2], [1]").when(F.col("id") % 4 == 1, "see [9]").when(F.col("id") % 4 == 2, "none").otherwise("[1]")
    return R.unknown_markers(c.select("id", said.alias("text")), c.select("id", F.explode(F.array(F.lit("1"), F.lit("2"))).alias("marker")))


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT o_orderkey, o_custkey FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""")
def purged_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.purge({"orders": o}, gone, "o_custkey")["orders"]


@query("""SELECT p_partkey AS k, list_transform(string_split(CASE WHEN p_partkey % 3 = 0 THEN p_size || '.x.' || p_partkey % 12 ELSE p_size || '.' || p_partkey % 12 END, '.'), lambda x: coalesce(TRY_CAST(x AS INT), 9999))[2] AS second, 'Repo' || replace(p_brand, '#', '') AS collection,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'a b' END AS folder, len(list_distinct(['x', 'y ' || p_partkey % 2])) AS terms FROM part""")
def name_columns(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    number = F.when(k % 3 == 0, F.concat(n, F.lit(".x."), (k % 12).cast("string"))).otherwise(F.concat(n, F.lit("."), (k % 12).cast("string")))
    folder = F.when(k % 4 == 0, " / ").otherwise(" a/\\  b ")
    terms = F.concat(F.lit("x; x ,y "), (k % 2).cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.get(text.number_key(number), F.lit(1)).alias("second"), text.collection_name("p_brand").alias("collection"), text.folder_name(folder).alias("folder"), F.size(text.split_terms(terms)).cast("long").alias("terms"))


@query(f"SELECT CASE WHEN id % 3 = 0 THEN 'collecting' WHEN id % 3 = 1 THEN 'derived' ELSE 'planned' END AS status, count(*) AS n FROM {E} GROUP BY 1")
def benchmark_summary(spark, sf_dir):
    k = F.col("id") % 3
    return obs.status_counts(events(spark, sf_dir).withColumn("status", F.when(k == 0, "collecting").when(k == 1, "derived").otherwise("planned")))
