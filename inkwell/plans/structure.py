"""Kinds of tables, topics, chunks of all strategies side by side, networks of references, audit lists and scores of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import detect, matrix
from inkwell.operators import chunking as K
from inkwell.operators import observability as obs
from inkwell.operators import references as X
from inkwell.operators import reports as R
from inkwell.plans import documents as D
from inkwell.plans import retrieval as V
from inkwell.plans import text as P
from inkwell.plans.registry import ORACLES, query
from inkwell.sources.shared import written
from inkwell.sources.tables import spread, table

#: First rows of tables, by the customer's number; the rows below them are the customer's orders.
_HEADERS = (
    ("Sl. No", "Parameter", "Requirement"), ("Prepared by", "Sign", "Date"), ("Revision history", "Summary of changes", "Version number"), ("Remarks:", "", ""), ("Checked by", "Signature", "Yes / No"), ("", "", ""),
    ("Activity", "Description", "Purpose"), ("1.0 PURPOSE OF", "note", "note"), ("Employee", "Code", "Time"), ("Name:", "Value", "Unit"),
)
_HEAD = f"CASE o_custkey % {len(_HEADERS)} " + " ".join(f"WHEN {i} THEN {{0}}({', '.join(repr(c) for c in h)})" for i, h in enumerate(_HEADERS)) + " END"
_CELLS = (
    "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END", "CASE WHEN o_custkey % 10 IN (4, 5) AND n % 2 = 0 THEN ' ' ELSE concat('entry ', n) END",
    "CASE WHEN o_custkey % 3 = 0 THEN '' WHEN n % 5 = 0 THEN 'the order was sent on the next day and a clerk has seen it before' ELSE o_orderstatus END",
)
_WIDTH = "CASE o_custkey % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"


def _contains(markers, of="norm") -> str:
    return "len(list_filter([" + ", ".join(f"'{m}'" for m in markers) + f"], lambda m: contains({of}, m)))"


def _long(least: int) -> str:
    return f"coalesce(list_sum(list_filter(list_transform(cells, lambda c: len(string_split_regex(c, '\\s+'))), lambda n: n >= {least})), 0)"


_FORM = " + ".join(
    f"CAST(regexp_matches(norm, '(^|[^a-z0-9]){m.replace('.', chr(92) + '.')}([^a-z0-9]|$)')" + (f" AND NOT regexp_matches(norm, '\\d+\\s+{m}\\s+\\d+')" if m in ("to", "from") else "") + " AS INT)" for m in matrix.FORM_MARKERS
)


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
t AS (SELECT o_custkey AS id, list_prepend(list_slice(any_value({_HEAD.format('list_value')}), 1, any_value({_WIDTH})), list(list_slice([{', '.join(_CELLS)}], 1, {_WIDTH}) ORDER BY n)) AS t FROM o GROUP BY 1),
x AS (SELECT id, t, len(t) AS n_rows, len(t[1]) AS n_columns, array_to_string(list_transform(t, lambda r: array_to_string(r, ' | ')), chr(10)) AS text, list_transform(t, lambda r: list_filter(list_transform(r, lambda c: trim(c)), lambda c: c <> '')) AS filled FROM t),
y AS (SELECT *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, flatten(filled) AS cells, (len(flatten(t)) - len(flatten(filled))) / len(flatten(t)) AS empty, list_max(list_transform(filled, lambda r: len(r))) AS widest, list_filter(filled[1:6], lambda r: len(r) > 0) AS firsts FROM x),
z AS (SELECT *, n_columns >= 2 AND contains(norm, 'parameter') AND regexp_matches(norm, 'sl\\.? no|s\\. no|sr\\. no|requirement|specification') AS spec, {_contains(matrix.CONTENT_MARKERS)} AS marks, {_long(8)} AS told8, {_long(12)} AS told12,
 len(list_filter(cells, lambda c: len(string_split_regex(c, '\\s+')) >= 12)) AS tales, len(list_filter(cells, lambda c: len(string_split_regex(c, '\\s+')) <= 4)) / greatest(len(cells), 1) AS short, {_FORM} AS hits, len(regexp_extract_all(norm, 'yes\\s*/\\s*no|\\bna\\b|\\bn/a\\b')) AS boxes FROM y),
w AS (SELECT *, regexp_matches(text, '[1-9]\\.0\\s+[A-Z][A-Z &/]+') OR (regexp_matches(norm, 'summary of changes|revision history') AND len(cells) >= 4) OR (regexp_matches(norm, '\\b(sl|s|sr)\\.?\\s*no\\b') AND len(cells) >= 5) OR (marks >= 2 AND len(cells) >= 3) OR (marks >= 1 AND told8 >= 20) OR told8 >= 60 AS content FROM z)
SELECT id, CASE WHEN widest <= 0 THEN 'INVALID' WHEN widest = 1 THEN 'SINGLE_COLUMN' WHEN widest = 2 THEN 'KEY_VALUE' WHEN len(list_filter(firsts, lambda r: contains(r[1], ':') OR (len(r) = 2 AND NOT regexp_full_match(r[1], '\\d+')))) / greatest(len(firsts), 1) >= 0.6 THEN 'KEY_VALUE' ELSE 'GRID' END AS kind,
 spec, content, CASE WHEN norm = '' THEN true WHEN spec THEN false WHEN len(cells) = 0 THEN true WHEN content THEN false ELSE NOT (tales >= 3 OR told12 >= 80 OR (n_rows >= 10 AND n_columns = 2 AND empty < 0.15))
  AND ((n_rows >= 5 AND n_columns >= 2 AND empty >= 0.45) OR (n_rows >= 3 AND n_columns >= 2 AND hits >= 3 AND short >= 0.6 AND told12 < 40) OR (hits >= 2 AND (boxes >= 2 OR regexp_matches(norm, 'sign|checked by|verified by|approved by|prepared by')))) END AS form FROM w""")
def table_kinds(spark, sf_dir):
    """Each customer's orders under one of ten headers, as a table of one to three columns."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", F.row_number().over(w).alias("n"))
    rows = o.select("o_custkey", "n", F.expr(f"slice(array({', '.join(_CELLS)}), 1, {_WIDTH})").alias("r"))
    g = rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]).alias("body"))
    t = g.select(F.col("o_custkey").alias("id"), F.concat(F.array(F.expr(f"slice({_HEAD.format('array')}, 1, {_WIDTH})")), F.col("body")).alias("t"))
    s, said = matrix.stats(F.col("t")), matrix.as_text(F.col("t"))
    x = t.select("id", "t", said.alias("text"), *[c.alias(k) for k, c in s.items()])
    return x.select("id", matrix.kind(F.col("t")).alias("kind"), matrix.specification_table(F.col("text"), F.col("n_columns")).alias("spec"), matrix.content_table(F.col("text")).alias("content"), matrix.form_table(F.col("text"), F.col("n_rows"), F.col("n_columns"), F.col("empty_ratio")).alias("form"))


#: Words added to documents, so that topics of several weights and ties come up.
_ADDED = ("' batch batch yield'", "' QA audit; change control'", "' the NDA and a contract'", "''", "' invoice, budget, cost, payment, revenue'", "' patient health test analysis'")
_TOPIC_TEXT = f"concat(coalesce(text, ''), CASE doc_id % {len(_ADDED)} " + " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(_ADDED)) + " END)"
_TOPIC_RULES = ", ".join(f"({i}, '{n}', '{k}')" for i, (n, keys) in enumerate(detect.TOPICS.items()) for k in keys)


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(lower({_TOPIC_TEXT}), '([^\\pL\\pN_])', '\\1\\1', 'g') AS t FROM documents),
k AS (SELECT i, topic, regexp_replace(word, '([^\\pL\\pN_])', '\\1\\1', 'g') AS word FROM (VALUES {_TOPIC_RULES}) k(i, topic, word)),
m AS (SELECT doc_id, i, topic, least(1.0, sum(least(1.0, 0.3 * len(regexp_extract_all(t, '(^|[^\\pL\\pN_])' || word || '([^\\pL\\pN_]|$)'))))) AS s FROM d, k WHERE contains(t, word) GROUP BY 1, 2, 3),
r AS (SELECT doc_id, topic, round(s, 2) AS confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS INT) AS rank FROM m WHERE s > 0)
SELECT doc_id, coalesce(topic, 'General') AS topic, CAST(coalesce(confidence, 1.0) AS DOUBLE) AS confidence, coalesce(rank, 1) AS rank FROM d LEFT JOIN r USING (doc_id)""")
def document_topics(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(detect.topics(F.expr(_TOPIC_TEXT))).alias("at", "t"))
    return d.select("doc_id", "t.topic", "t.confidence", (F.col("at") + 1).alias("rank"))


_NW = "len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))"
_STRATEGIES = {
    "fixed-overlap": "chunk_fixed_overlap", "sentence-based": "chunk_sentence_based", "paragraph-based": "chunk_paragraph_based", "sliding-window": "chunk_sliding_window", "section-based": "chunk_section_based",
    "hierarchical": "chunk_hierarchical", "semantic-hierarchy": "chunk_semantic_hierarchy",
}


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS strategy, count(*) AS n_chunks, CAST(sum({_NW if s == 'semantic-hierarchy' else 'n_words'}) AS BIGINT) AS words FROM ({ORACLES[name]}) WHERE {'true' if s == 'semantic-hierarchy' else 'n_words > 0'}" + (" AND text <> ''" if s != "sliding-window" else " AND h <> md5('')") + " GROUP BY 1"
    for s, name in _STRATEGIES.items()))
def chunk_preview(spark, sf_dir):
    """Seven strategies side by side (the eighth, by meaning, is held against its rule in a test)."""
    rows = K.preview(P.docs(spark, sf_dir), {s: {} for s in _STRATEGIES})
    return rows.groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_words").alias("words"))


_GRAPH = P._FOUND + r""", nn AS (SELECT doc_id, target, CAST(regexp_extract(target, '^DOC-(\d+)-A$', 1) AS BIGINT) AS k FROM c),
rr AS (SELECT nn.doc_id, target, d.doc_id AS resolved FROM nn LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = k AND k <> nn.doc_id)"""


def _network(spark, sf_dir) -> DataFrame:
    found, _ = P._mentioned(spark, sf_dir)
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.expr("concat('doc_', doc_id, '_A.docx')").alias("name"))
    return X.graph(found.select(F.col("doc_id").alias("source"), "target"), documents)


@query(_GRAPH + """ SELECT CAST(doc_id AS VARCHAR) AS center, CAST(doc_id AS VARCHAR) AS source, doc_id || '::' || target AS target, 'MENTIONS_REFERENCE' AS type FROM rr
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id || '::' || target, CAST(resolved AS VARCHAR), 'TARGETS' FROM rr WHERE resolved IS NOT NULL
UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(resolved AS VARCHAR), 'REFERS_TO' FROM rr WHERE resolved IS NOT NULL""")
def reference_graph(spark, sf_dir):
    """The networks around all documents."""
    return _network(spark, sf_dir)


@query(_GRAPH + """, e AS (SELECT doc_id AS center, doc_id || '' AS id FROM rr UNION SELECT doc_id, doc_id || '::' || target FROM rr UNION SELECT doc_id, CAST(resolved AS VARCHAR) FROM rr WHERE resolved IS NOT NULL)
SELECT CAST(center AS VARCHAR) AS center, count(*) AS n_nodes, count(*) FILTER (contains(id, '::')) AS n_references FROM e GROUP BY 1""")
def reference_nodes(spark, sf_dir):
    n = X.nodes(_network(spark, sf_dir))
    return n.groupBy("center").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("label") == "Reference").alias("n_references"))


@query(_GRAPH + " SELECT DISTINCT CAST(resolved AS VARCHAR) AS document_id, CAST(doc_id AS VARCHAR) AS source FROM rr WHERE resolved IS NOT NULL")
def referenced_by(spark, sf_dir):
    return X.referenced_by(_network(spark, sf_dir))


@query("""WITH p AS (SELECT p_partkey AS id, 'PN-' || p_partkey || '-X' AS name FROM part), r AS (SELECT id AS source, name AS target, CASE WHEN id % 5 = 0 THEN id + 1 WHEN id % 7 = 0 THEN NULL ELSE id END AS resolved FROM p)
SELECT source, target, resolved, p.name AS have FROM r JOIN p ON p.id = resolved WHERE p.name <> target""")
def reference_violations(spark, sf_dir):
    """A fifth of the references is resolved to the neighbour of the part that they name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.expr("concat('pn_', p_partkey, '_x.pdf')").alias("name"))
    k = F.col("document_id")
    told = p.select(k.alias("source"), F.expr("concat('PN-', document_id, '-X')").alias("target"), F.when(k % 5 == 0, k + 1).when(k % 7 == 0, None).otherwise(k).alias("resolved"))
    return X.violations(told, p).select("source", "target", "resolved", "have")


#: Events as audit events; both engines take these expressions.
_TRAIL = (
    "event_id AS id", "CAST(ts AS TIMESTAMP) AS ts", "concat('r', event_id % 40) AS request_id", "concat('c', user_id % 9) AS correlation_id", "CASE WHEN user_id % 2 = 0 THEN 'web' ELSE 'batch' END AS application_name",
    "concat(CASE event_id % 4 WHEN 0 THEN 'document_' WHEN 1 THEN 'SEARCH_' WHEN 2 THEN 'USER_LOGIN_' ELSE 'JOB_' END, event_type) AS event_type",
    "CASE WHEN event_id % 3 = 0 THEN 'document' ELSE 'repository' END AS entity_type", "concat('', user_id % 30) AS entity_id", "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status",
    "CASE WHEN event_id % 5 = 0 THEN 'security' ELSE 'usage' END AS category", "event_type AS action", "CASE WHEN event_id % 6 < 3 THEN 'api' ELSE 'ui' END AS source",
    "CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[\"title\"]' END AS changes", "CASE WHEN event_type = 'error' THEN 'Timeout of a lock' END AS exception", "concat('{\"repository_id\": \"', event_id % 25, '\"}') AS metadata",
)
#: What is asked, and the same in SQL.
_ASKED = {
    "all": (obs.AuditQuery(), "true"),
    "text": (obs.AuditQuery(search="TIMEOUT", page=2, page_size=20), "(exception ILIKE '%TIMEOUT%')"),
    "metadata": (obs.AuditQuery(search='": "7"', date_from="2024-01-03", date_to="2024-01-20"), """metadata LIKE '%": "7"%' AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20'"""),
    "request": (obs.AuditQuery(request_id="r7", application_name="web", has_changes=False), "request_id = 'r7' AND application_name = 'web' AND (changes IS NULL OR changes = '[]')"),
    "repository": (obs.AuditQuery(repository_id="12", has_changes=True), "(entity_id = '12' OR json_extract_string(metadata, '$.repository_id') = '12') AND changes IS NOT NULL AND changes <> '[]'"),
    "business": (obs.AuditQuery(business_only=True, correlation_id="c4", status="failure", category="usage", source="ui", page_size=5), "event_id % 4 < 3 AND correlation_id = 'c4' AND status = 'failure' AND category = 'usage' AND source = 'ui'"),
    "entity": (obs.AuditQuery(entity_type="document", entity_id="3", action="click", event_type="JOB_click"), "entity_type = 'document' AND entity_id = '3' AND action = 'click' AND event_type = 'JOB_click'"),
}


@query(f"WITH t AS (SELECT {', '.join(_TRAIL)}, event_id FROM events) " + " UNION ALL ".join(
    f"(SELECT '{name}' AS asked, id, count(*) OVER () AS total FROM t WHERE {sql} ORDER BY ts DESC, id DESC LIMIT {a.page_size} OFFSET {(a.page - 1) * a.page_size})" for name, (a, sql) in _ASKED.items()))
def audit_list(spark, sf_dir):
    """Seven lists over all events as audit events: between them all sixteen predicates, with the totals."""
    trail = table(spark, sf_dir, "events").selectExpr(*_TRAIL)
    pages = []
    for name, (asked, _) in _ASKED.items():
        rows, total = obs.audit_events(trail, asked)
        pages.append(rows.select(F.lit(name).alias("asked"), "id").join(F.broadcast(total)))
    return reduce(DataFrame.unionByName, pages)


@query(f"""WITH sc AS ({ORACLES['retrieval_confidence']}), cx AS ({ORACLES['passage_complexity']}), j AS (SELECT * FROM sc JOIN cx ON key = doc_id)
SELECT query_id, round(avg(complexity_score), 6) AS average_complexity, round(avg(confidence), 6) AS average_confidence, max(confidence) AS highest, min(confidence) AS lowest, count(*) FILTER (complexity_level = 'Low') AS complexity_low,
 count(*) FILTER (complexity_level = 'Medium') AS complexity_medium, count(*) FILTER (complexity_level = 'High') AS complexity_high, count(*) FILTER (confidence >= 0.85) AS very_high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.85) AS high,
 count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM j GROUP BY 1""")
def answer_scores(spark, sf_dir):
    """Each question's passages: their confidence and complexity, summed up; only passages that an answer has are analysed."""
    sure = written(V.retrieval_confidence(spark, sf_dir), "confidence")
    docs = table(spark, sf_dir, "documents").join(sure.select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_semi")
    hard = D.complexities(docs).select(F.col("doc_id").alias("key"), "complexity_score", "complexity_level")
    s = R.answer_summary(sure.join(hard, "key"))
    # Means of 80 values end in a 5 behind the sixth decimal; like the SQL, the binary number is rounded, not its decimal form.
    shown = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6
    return s.select("query_id", shown("average_complexity").alias("average_complexity"), shown("average_confidence").alias("average_confidence"), F.col("max_confidence").alias("highest"), F.col("min_confidence").alias("lowest"), "complexity_low", "complexity_medium", "complexity_high", "very_high", "high", "medium", "low")


_BLOCK = "concat(coalesce(text, ''), CASE WHEN conv_id % 2 = 0 AND turn % 2 = 0 THEN concat(' ', 2000 + conv_id) WHEN turn % 3 = 1 THEN ' Revision history 1' ELSE '' END)"


@query(f"""WITH b AS (SELECT conv_id, turn, {_BLOCK} AS text FROM conversations), n AS (SELECT conv_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN length(x) >= 4 ELSE length(x) >= 3 END)) AS n FROM b WHERE turn = 0),
w AS (SELECT conv_id, turn, coalesce(list_sum(list_transform(n, lambda x: CASE WHEN NOT contains(lower(text), x) THEN 0 WHEN regexp_matches(x, '[0-9]') OR length(x) >= 8 THEN 3 ELSE 1 END)), 0)
 + CASE WHEN regexp_matches(text, '[0-9]') AND len(list_filter(n, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), 'revision history') THEN 2 ELSE 0 END AS weight FROM b JOIN n USING (conv_id) WHERE turn > 0)
SELECT conv_id AS chunk_id, turn AS line, CAST(weight AS INT) AS weight FROM w WHERE weight > 0 QUALIFY rank() OVER (PARTITION BY conv_id ORDER BY weight DESC) = 1""")
def supporting_blocks(spark, sf_dir):
    """The turns of a conversation that support its first one best."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_BLOCK).alias("text"))
    n = c.where("turn = 0").select("conv_id", R.needles(F.col("text")).alias("needles"))
    b = c.where("turn > 0").join(n, "conv_id").select(F.col("conv_id").alias("chunk_id"), F.floor(F.col("turn") / 4).alias("page"), F.col("turn").alias("line"), "text", "needles")
    return R.supporting_blocks(b).select("chunk_id", "line", F.col("weight").cast("int").alias("weight"))
