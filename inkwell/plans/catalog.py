"""Catalog, dedup and hierarchy queries over documents, labels, embeddings and the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import catalog as C
from inkwell.operators import similarity as S
from inkwell.plans.registry import query
from inkwell.sources.tables import spread, table

_FP = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


@query("""SELECT doc_id, source, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND source = 'src1' AND contains(lower(text), 'the') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5""")
def list_documents(spark, sf_dir):
    d = C.filters(table(spark, sf_dir, "documents"), {"language": ["en", "de"], "repository": "src1", "unknown": 1, "n": ""}, {"language": "lang", "repository": "source"})
    return C.page(d.where(F.lower("text").contains("the")), F.desc("n_chars"), F.col("doc_id"), offset=5, limit=20).select("doc_id", "source", "lang", "n_chars")


@query("""SELECT d.source, count(*) AS n_chunks, count(l.quality) AS n_embedded, arg_min(CAST(l.quality AS VARCHAR), d.doc_id) FILTER (l.quality IS NOT NULL) AS category, coalesce(bool_or(l.toxic = 1), false) AS has_duplicate
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1 HAVING count(*) >= 10""")
def document_catalog(spark, sf_dir):
    """Index statistics by source, filtered after the aggregation."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("source", "doc_id", F.col("quality").alias("embedding"), F.col("quality").cast("string").alias("category"), (F.col("toxic") == 1).alias("is_duplicate"))
    return C.index_statistics(rows, "source", "doc_id").where("n_chunks >= 10")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def folder_assignment(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(f"""WITH h AS (SELECT doc_id, source, sha256(text) AS c, CASE WHEN length({_FP}) >= 80 THEN sha256({_FP}) END AS t, lang FROM documents)
SELECT a.doc_id AS document_id, min(b.doc_id) AS duplicate_of FROM h a JOIN h b ON a.source = b.source AND a.doc_id <> b.doc_id AND (a.c = b.c OR a.t = b.t) WHERE b.lang <> 'fr' GROUP BY 1""")
def find_duplicates(spark, sf_dir):
    """Duplicates within the source; French rows stand for a status that blocks nobody."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select(F.col("doc_id").alias("document_id"), "source", F.col("lang").alias("status"), F.sha2("text", 256).alias("content_hash"), text.text_hash("text").alias("content_text_hash"))
    return C.find_duplicates(d, d, ["source"], ["fr"])


@query(f"""WITH h AS (SELECT doc_id, md5({_FP}) AS h, CASE WHEN {_FP} = '' THEN 0 ELSE len(string_split({_FP}, ' ')) END AS n_words FROM documents),
f AS (SELECT h, min(doc_id) AS first FROM h WHERE n_words >= 10 GROUP BY 1)
SELECT doc_id, n_words, n_words < 10 OR doc_id <> first AS is_duplicate FROM h LEFT JOIN f USING (h)""")
def mark_duplicates(spark, sf_dir):
    return C.mark_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("n_words", F.col("n_words").cast("long"))


@query("SELECT item_id FROM benchmark WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark WHERE item_id % 2 = 0)")
def insert_if_not_duplicate(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("h", F.sha2("text", 256))
    return C.insert_new(b, b.where("item_id % 2 = 0"), ["h"]).select("item_id")


_PAIR = "SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s, x.label AS la, y.label AS lb FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"


@query(f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIR}) WHERE s >= 0.4")
def similarity_pairs(spark, sf_dir):
    return S.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH p AS (SELECT * FROM ({_PAIR}) WHERE s >= 0.4 AND la <> lb), b AS (SELECT id, max(s) AS s FROM (SELECT a AS id, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY 1)
SELECT vec_id, coalesce(round(least(s, 1.0) * 100, 2), 0.0) AS match_pct FROM embeddings LEFT JOIN b ON vec_id = id""")
def match_percentages(spark, sf_dir):
    return S.match_percentages(table(spark, sf_dir, "embeddings"), 0.4, group="label")


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM ({_PAIR}) WHERE s >= 0.4), n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS r FROM (SELECT a AS id FROM p UNION SELECT b FROM p)),
e AS MATERIALIZED (SELECT n.id, r, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS before FROM n LEFT JOIN p ON p.b = n.id GROUP BY 1, 2),
k AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL SELECT e.r, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, id) END FROM k JOIN e ON e.r = k.r + 1)
SELECT id FROM n WHERE NOT list_contains((SELECT kept FROM k ORDER BY r DESC LIMIT 1), id)""")
def greedy_near_duplicates(spark, sf_dir):
    return S.greedy_near_duplicates(S.similar_pairs(table(spark, sf_dir, "embeddings"), 0.4))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM ({_PAIR}) WHERE s >= 0.45 AND la <> lb), y AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT a AS id, a AS o FROM y UNION SELECT r.id, y.b FROM reach r JOIN y ON r.o = y.a),
c AS (SELECT id, min(o) AS root FROM reach GROUP BY 1), u AS (SELECT root, id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM c JOIN embeddings ON vec_id = id), m AS (SELECT root, i, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY 1, 2),
l AS (SELECT root, sqrt(sum(m * m)) AS n FROM m GROUP BY 1), d AS (SELECT u.root, id, label, sum(x * m) / CASE WHEN any_value(n) > 0 THEN any_value(n) ELSE 1 END AS s FROM u JOIN m USING (root, i) JOIN l USING (root) GROUP BY 1, 2, 3),
g AS (SELECT root, id, label FROM d WHERE s >= 0.45), k AS (SELECT root, row_number() OVER (ORDER BY root) AS cluster_id FROM g GROUP BY root HAVING count(DISTINCT label) >= 2)
SELECT id, CAST(cluster_id AS INT) AS cluster_id FROM g JOIN k USING (root)""")
def cross_document_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return S.clusters(S.similar_pairs(e, 0.45, group="label"), e, 0.45)


@query("""WITH o AS (SELECT o_custkey AS k, o_orderstatus AS f, CAST(count(*) AS VARCHAR) AS v FROM orders WHERE o_orderdate < '1996-01-01' GROUP BY 1, 2),
n AS (SELECT o_custkey AS k, o_orderstatus AS f, CAST(count(*) AS VARCHAR) AS v FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1, 2)
SELECT k, f AS field, o.v AS "old", n.v AS "new" FROM o FULL JOIN n USING (k, f) WHERE o.v IS DISTINCT FROM n.v""")
def map_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("field"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).alias("before"))
    side = lambda c: o.where(c).groupBy("k", "field").agg(F.count(F.lit(1)).cast("string").alias("value"))
    return C.changes(side(F.col("before")), side(~F.col("before")), ["k"])


_TREE = "(SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region)"


def tree(spark, sf_dir):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent"))
    n = table(spark, sf_dir, "nation").select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(s("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    return c.unionByName(n).unionByName(r)


_ANC = f"""a AS (SELECT id, parent AS ancestor, 1 AS depth FROM {_TREE} WHERE parent IS NOT NULL UNION ALL SELECT a.id, t.parent, a.depth + 1 FROM a JOIN {_TREE} t ON a.ancestor = t.id WHERE t.parent IS NOT NULL)"""


@query(f"WITH RECURSIVE {_ANC} SELECT id, ancestor, depth FROM a")
def ancestor_chain(spark, sf_dir):
    return C.ancestors(tree(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ANC}, c AS (SELECT id, ancestor, depth FROM a UNION ALL SELECT id, id, 0 FROM {_TREE}),
d AS (SELECT id AS ancestor, 'color' AS field, id AS value FROM {_TREE} WHERE id LIKE 'r%' UNION ALL SELECT id, 'size', id FROM {_TREE} WHERE id LIKE 'n1%' UNION ALL SELECT id, 'color', id FROM {_TREE} WHERE id LIKE 'c%7')
SELECT id, field, arg_min(value, depth) AS value, min(depth) AS depth FROM c JOIN d USING (ancestor) GROUP BY 1, 2""")
def effective_fields(spark, sf_dir):
    t = tree(spark, sf_dir)
    chain = C.ancestors(t).unionByName(t.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth")))
    define = lambda like, field: t.where(F.col("id").like(like)).select(F.col("id").alias("type_id"), F.lit(field).alias("field"), F.col("id").alias("value"))
    return C.nearest_definition(chain, define("r%", "color").unionByName(define("n1%", "size")).unionByName(define("c%7", "color")))


@query("""WITH l AS (SELECT doc_id, pos, trim(line) AS line FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line) <> ''),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) >= 3 AND len(regexp_split_to_array(line, '\\s+')) <= 8 AS gone FROM l)
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, CAST(coalesce(count(*) FILTER (gone), 0) AS INT) AS n_removed FROM documents d LEFT JOIN c USING (doc_id) GROUP BY 1""")
def repeated_watermarks(spark, sf_dir):
    return C.repeated_lines(table(spark, sf_dir, "documents"))


@query("SELECT conv_id AS repository_id, turn % 3 AS user_id, arg_min(role, CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END) AS role FROM conversations WHERE turn % 5 <> 4 GROUP BY 1, 2")
def highest_role(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("repository_id"), (F.col("turn") % 3).alias("user_id"), "role", F.when(F.col("turn") % 5 == 4, 1).alias("revoked_at"))
    return C.highest_role(b, ["system", "assistant", "user"])


@query("""SELECT count(DISTINCT o_custkey) AS documents, count(DISTINCT (o_custkey, o_orderpriority)) AS pages FROM orders""")
def count_documents_and_pages(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("documents"), F.count_distinct("o_custkey", "o_orderpriority").alias("pages"))


@query("""SELECT n_nationkey AS repository_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
HAVING bool_and(o_orderstatus <> 'P' OR o_totalprice > 1000) AND max(o_orderdate) <= TIMESTAMP '2030-01-01'""")
def expired_repositories(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("repository_id")), "o_custkey")
    o = o.select("repository_id", F.when((F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 1000), "completed").otherwise("open").alias("status"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    return C.expired_repositories(o, 0.0, F.lit("2030-01-01").cast("timestamp"))
