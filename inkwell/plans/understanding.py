"""Queries over questions, document types, entities, fields, vectors and the structure of blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import headings as H
from inkwell.operators import chunking as K
from inkwell.operators import understanding as U
from inkwell.plans.registry import query
from inkwell.plans.security import _q
from inkwell.sources.tables import table

# Questions with what the rules make of them: rewritten, sub-queries, intent, doc_name, section_name, category. Stated, not computed.
_ASKED = (
    ("Could you please tell me what is the scope and what are the limits?", "what is the scope and what are the limits?", "what is the scope?|what are the limits?", "factual", "", "", ""),
    ("What is A valve and B pump?", "What is A valve and B pump?", "What is A valve?|What is B pump?", "factual", "", "", ""),
    ("alpha test, beta test, gamma", "alpha test, beta test, gamma", "alpha test?|beta test?|gamma?", "factual", "", "", ""),
    ("How to start the pump", "How to start the pump", "", "procedural", "", "", ""),
    ("compare x vs y in document called plan-1 section Scope of work", "compare x vs y in document called plan-1 section Scope of work", "", "comparative", "plan-1", "Scope of work", ""),
    ("please", "please", "", "factual", "", "", ""),
    ("Where is report.pdf", "Where is report.pdf", "", "navigational", "report.pdf", "", ""),
    ("why does it fail; list all parts", "why does it fail; list all parts", "why does it fail?|list all parts?", "explanatory", "", "", ""),
    ("everything in category Quality Control", "everything in category Quality Control", "", "factual", "", "", "Quality Control"),
)


def _pick(k: str, values) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


@query("SELECT c_custkey AS k, " + ", ".join(f"{_pick('c_custkey', [r[i] for r in _ASKED])} AS {n}" for i, n in enumerate(("rewritten", "parts", "intent", "doc_name", "section_name", "category"), 1)) + " FROM customer")
def query_stages(spark, sf_dir):
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr(_pick("c_custkey", [r[0] for r in _ASKED])).alias("q"))
    f = q.withColumn("f", U.query_filters("q", F.create_map().cast("map<string,string>")))
    named = [F.coalesce(F.col("f")[n], F.lit("")).alias(n) for n in ("doc_name", "section_name", "category")]
    return f.select("k", U.rewritten("q").alias("rewritten"), F.array_join(U.sub_queries("q"), "|").alias("parts"), U.intent("q")["intent"].alias("intent"), *named)


@query("""WITH t AS (SELECT doc_id, trim(array_to_string(list_slice(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), 1, 8), ' ')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 400 THEN t WHEN contains(left(t, 400), ' ') THEN regexp_replace(left(t, 400), ' [^ ]*$', '') ELSE left(t, 400) END AS context FROM t WHERE t IS NOT NULL""")
def compressed_contexts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", U.compressed("text", 8, 100).alias("context"))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS rank, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'text ' || o_orderkey END AS text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 9 END AS page FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r QUALIFY n <= 3),
s AS (SELECT query_id, string_agg('[' || n || '] (doc' || CASE WHEN page IS NULL THEN '' ELSE ', p.' || page END || ') ' || trim(text), ' ' ORDER BY n) FILTER (trim(text) <> '') AS said, count(*) FILTER (trim(text) <> '') AS n FROM b GROUP BY 1)
SELECT query_id, CASE WHEN n = 0 THEN 'Insufficient evidence in the retrieved documents.' ELSE 'Based on the retrieved documents:' || chr(10) || said || chr(10) || chr(10) || 'Sources: ' || array_to_string(list_transform(range(1, n + 1), lambda i: '[' || i || ']'), ' ') END AS answer, n > 0 AS sufficient FROM s""")
def extractive_answers(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("rank"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("text "), k.cast("string"))).alias("text"), F.lit("doc").alias("document"), F.when(k % 3 != 0, k % 9).alias("page"))
    return U.extractive_answers(rows, 3)


_WORDS = ("non-disclosure of nda terms", "patient with a diagnosis", "hereinafter the terms and conditions", "fda guidance document", "standard operating procedure purpose: scope:", "abstract references et al hypothesis", "doi: journal", "invoice bill to", "plain words", "", "executive summary")
_SCORES = "list_filter([" + ", ".join(f"CASE WHEN h{i} > 0 THEN {{'t': {_q(n)}, 's': least(0.99, {b} + 0.05 * (h{i} - 1)), 'i': {i}}} END" for i, (n, _, b) in enumerate(U.TYPES)) + "], lambda x: x IS NOT NULL)"
_HITS = ", ".join("(" + " + ".join(f"CAST(contains(t, {_q(w)}) AS INT)" for w in ws) + f") AS h{i}" for i, (_, ws, _) in enumerate(U.TYPES))


@query(f"""WITH d AS (SELECT o_orderkey AS k, lower(trim({_pick('o_orderkey', _WORDS)} || CASE WHEN o_orderkey % 3 = 0 THEN ' findings' ELSE '' END)) AS t FROM orders), h AS (SELECT k, t, {_HITS} FROM d), s AS (SELECT k, t, {_SCORES} AS s FROM h),
b AS (SELECT k, t, s, list_sort(s, 'DESC') AS o, list_max(list_transform(s, lambda x: x.s)) AS top FROM s)
SELECT k, CASE WHEN t = '' THEN 'Unknown' WHEN len(s) = 0 THEN 'Other' ELSE list_filter(s, lambda x: x.s >= top - 1e-12)[1].t END AS type, CASE WHEN t = '' THEN 0.0 WHEN len(s) = 0 THEN 0.55 ELSE round(top, 4) END AS confidence FROM b""")
def document_types(spark, sf_dir):
    t = F.expr(f"concat({_pick('o_orderkey', _WORDS)}, CASE WHEN o_orderkey % 3 = 0 THEN ' findings' ELSE '' END)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), U.document_type(t).alias("d")).select("k", "d.type", "d.confidence")


_PATTERNS = {"SOP": {"filename_tokens": ["SOP"], "id_patterns": [r"SOP-\d+"], "sections": ["Purpose", "Scope"]}, "Report": {"filename_tokens": ["REPORT", "SUMMARY"], "id_patterns": [], "sections": ["findings"]}}


@query("""WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'SOP-12.pdf' WHEN 1 THEN 'my report.docx' WHEN 2 THEN 'x.txt' ELSE 'sop' END AS n, CASE p_partkey % 3 WHEN 0 THEN 'Purpose and Scope' WHEN 1 THEN 'our findings' ELSE 'nothing' END AS t FROM part),
c AS (SELECT k, CASE k % 4 WHEN 0 THEN 1.0 WHEN 3 THEN 1.0 ELSE 0 END AS sn, CASE k % 3 WHEN 0 THEN 0.99 ELSE 0 END AS ss, CASE k % 4 WHEN 1 THEN 0.85 ELSE 0 END AS rn, CASE k % 3 WHEN 1 THEN 0.99 ELSE 0 END AS rs, CASE k % 3 WHEN 1 THEN 1.0 ELSE 0 END AS rm FROM d),
t AS (SELECT *, round(0.4 * sn + 0.4 * ss, 4) AS s, round(0.4 * rn + 0.4 * rs + 0.2 * rm, 4) AS r FROM c)
SELECT k, CASE WHEN greatest(s, r) = 0 THEN 'Unknown' WHEN r >= s THEN CASE WHEN greatest(r, rn, rs, rm) >= 0.7 THEN 'Report' ELSE 'Unknown' END ELSE CASE WHEN greatest(s, sn, ss) >= 0.7 THEN 'SOP' ELSE 'Unknown' END END AS type,
 CASE WHEN greatest(s, r) = 0 THEN 0.0 WHEN r >= s THEN greatest(r, rn, rs, rm) ELSE greatest(s, sn, ss) END AS confidence FROM t""")
def hybrid_document_types(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "SOP-12.pdf").when(k % 4 == 1, "my report.docx").when(k % 4 == 2, "x.txt").otherwise("sop")
    text = F.when(k % 3 == 0, "Purpose and Scope").when(k % 3 == 1, "our findings").otherwise("nothing")
    return table(spark, sf_dir, "part").select(k.alias("k"), U.hybrid_type(text, name, _PATTERNS).alias("d")).select("k", "d.type", "d.confidence")


_SAID = ("Dr. Jane Doe met Acme Corp. in Paris", "on 2024-01-02 or 01/02/2024 or March 3rd, 2024", "Standard Operating of drug AB-1 in lab B2", "12 Main Street near Tokyo", "nothing to see", "PharmaLine-X1 by TechCorp")


@query("WITH t AS (SELECT c_custkey AS k, " + _pick("c_custkey", _SAID) + " AS t FROM customer), e AS (" + " UNION ALL ".join(f"SELECT k, {_q(d.kind)} AS kind, unnest(regexp_extract_all(t, {_q(d.pattern)})) AS value FROM t" for d in U.ENTITIES) + f") SELECT k, kind, value FROM e WHERE kind <> 'PERSON' OR lower(value) NOT IN ({', '.join(map(_q, U.NO_PERSON))})")
def rule_entities(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.expr(_pick("c_custkey", _SAID)).alias("t"))
    return t.select("k", F.explode(U.entities("t")).alias("e")).select("k", "e.kind", "e.value")


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'body text' || chr(10) || 'keep CONF here' WHEN 1 THEN 'a' || chr(10) || chr(10) || 'b' ELSE '' END AS text, CASE c_custkey % 3 WHEN 0 THEN 'conf' ELSE '' END AS markers FROM customer""")
def entity_preparation(spark, sf_dir):
    """Texts with markers, repeated lines, page numbers and blank lines, and what must be left of them (stated)."""
    k = F.col("c_custkey")
    t = F.when(k % 3 == 0, "CONF\nbody text\npage 3\nx\nx\nx\nkeep CONF here").when(k % 3 == 1, "a\n\n\n\nb\nPage 12\n").otherwise("  ")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), U.prepared_for_entities(t, ["conf"], [r"(?i)page \d+$"]).alias("p"))
    return rows.select("k", "p.text", F.array_join("p.markers", ",").alias("markers"))


@query("""SELECT c_custkey AS doc_id, 'owner' AS field_name, 'Jane' AS value, 0.93 AS confidence, 'rule_pattern' AS method FROM customer UNION ALL SELECT c_custkey, 'issue_date', '2024-01-02', 0.918, 'table_cell' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'pages', '12', 0.93, 'adjacent_line' FROM customer WHERE c_custkey % 3 = 0""")
def extracted_fields(spark, sf_dir):
    """Pairs by rule, table and next line; stated results: an exact label, one that holds the field's name, and one on the next line."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    pair = lambda df, pos, label, value, source: df.select("doc_id", F.lit(pos).alias("pos"), F.lit(label).alias("label"), F.lit(value).alias("value"), F.lit(source).alias("source"))
    pairs = pair(k, 1, "Owner", "Jane", "inline_pattern").unionByName(pair(k, 2, "unrelated thing", "x", "inline_pattern")).unionByName(pair(k, 3, "Owner", "Joe", "table_row"))
    pairs = pairs.unionByName(pair(k.where("doc_id % 2 = 0"), 4, "the issue date", "2024-01-02", "table_row")).unionByName(pair(k.where("doc_id % 2 = 1"), 4, "the issue date", "soon", "table_row"))
    pairs = pairs.unionByName(pair(k.where("doc_id % 3 = 0"), 5, "Pages", "12 sheets", "next_line"))
    fields = spark.createDataFrame([("owner", "string"), ("issue_date", "date"), ("pages", "number")], "field_name string, type string")
    return U.extracted_fields(pairs, fields)


_LABELS = ("Document  Owner", "This is a sentence.", "a b c d e f g", "1", "É x", "Batch; no", "No of pages")


@query(f"SELECT c_custkey AS k, CASE c_custkey % {len(_LABELS)} WHEN 0 THEN 'Document Owner' WHEN 4 THEN 'É x' WHEN 6 THEN 'No of pages' END AS name FROM customer")
def field_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), U.field_name(F.expr(_pick("c_custkey", _LABELS))).alias("name"))


@query("SELECT p_partkey AS k, lower(p_name) LIKE '%widget%' AND lower(p_name) LIKE '%cold%' OR lower(p_name) LIKE '%rod%' AS hit FROM part")
def title_matches(spark, sf_dir):
    """Both words of a term in any order, or a term of one word."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), U.title_matches(F.col("p_name"), ["Widget cold", " rod "]).alias("hit"))


@query("SELECT vec_id, vec_id % 5 > 1 AS valid FROM embeddings")
def valid_vectors(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    v = F.when(F.col("vec_id") % 5 == 0, F.array_append(e, F.lit(1.0))).when(F.col("vec_id") % 5 == 1, F.transform(e, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", U.valid_vector(v, 64).alias("valid"))


# Blocks with what the rules say of them: heading, component, level. Stated, not computed.
_BLOCKS = (
    ("1.0OBJECTIVE This is the body of it", True, "paragraph", 0), ("2. Scope:", True, "title", 1), ("3.1 Working Standard", True, "subtitle", 2), ("This is a sentence that ends.", False, "paragraph", 0), ("PURPOSE", True, "paragraph", 0),
    ("Table of contents", False, "paragraph", 0), ("GL-CQA-GOP-0007", False, "paragraph", 0), ("6 Instructions for the use of the pump", True, "paragraph", 0), ("a. item one", False, "paragraph", 0), ("Revision History", True, "paragraph", 0), ("3.2 Press the Button", False, "paragraph", 0),
)


@query("SELECT c_custkey AS k, " + f"CASE c_custkey % {len(_BLOCKS)} " + " ".join(f"WHEN {i} THEN {str(b[1]).lower()}" for i, b in enumerate(_BLOCKS)) + " END AS heading, " + _pick("c_custkey", [b[2] for b in _BLOCKS]) + f" AS component, CASE c_custkey % {len(_BLOCKS)} " + " ".join(f"WHEN {i} THEN {b[3]}" for i, b in enumerate(_BLOCKS)) + " END AS level FROM customer")
def block_components(spark, sf_dir):
    t = F.expr(_pick("c_custkey", [b[0] for b in _BLOCKS]))
    none, text = F.lit(None), F.lit("text")
    c = H.classified(text, none.cast("string"), none.cast("string"), none.cast("int"), F.lit(""), t, F.lit(10.0), F.lit(False), F.lit(10.0))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), H.is_heading(t, F.lit("paragraph"), none.cast("int"), F.lit(""), F.lit(False)).alias("heading"), c.alias("c"))
    return rows.select("k", "heading", "c.component", F.coalesce("c.level", F.lit(0)).alias("level"))


@query("""SELECT c_custkey AS doc_id, n AS section_no, ['1.0 OBJECTIVE', '2. Scope > 3.1 Working Standard', 'PURPOSE'][n + 1] AS section_path, ['This is the body of it', 'Plain text here.', 'more and more'][n + 1] AS text FROM customer, (SELECT unnest([0, 1, 2]) AS n)""")
def detected_sections(spark, sf_dir):
    """Every customer is a document of the same eight blocks; the sections are stated."""
    texts = ("1.0OBJECTIVE This is the body of it", "2. Scope:", "3.1 Working Standard", "Plain text here.", "PURPOSE", "", "more and more", "running head")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("block_no", "text"))
    rows = rows.withColumns({"component_type": F.when(F.col("block_no") == 7, "header").otherwise("paragraph"), "heading_level": F.lit(None).cast("int"), "style": F.lit(""), "bold": F.lit(False)})
    return K.detected_sections(rows).select("doc_id", "section_no", "section_path", F.array_join("texts", "|").alias("text"))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Body text here' ELSE '3. A thing ..... 5' END AS text FROM customer WHERE c_custkey % 2 = 0")
def blocks_without_contents(spark, sf_dir):
    texts = ((1, "Table of contents"), (1, "1. PURPOSE........3"), (1, "2. SCOPE.......4"), (2, "3. A thing ..... 5"), (2, "4. B thing ..... 6"), (2, "5. C thing ..... 7"), (3, "Body text here"), (3, "Prepared by: X"))
    blocks = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(t).alias("text")) for p, t in texts])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(blocks).alias("block_no", "b")).select("doc_id", "block_no", "b.page", "b.text", F.lit("text").alias("block_type"))
    return K.without_contents(rows.where("doc_id % 2 = 0 or page < 3")).select("doc_id", "text")


@query("""SELECT c_custkey AS doc_id, n AS part, array_to_string(list_transform(range(n * 3, n * 3 + 3), lambda i: i || ' | word word word word word | tail'), chr(10)) AS text, 27 AS n_words FROM customer, (SELECT unnest([0, 1]) AS n) WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 0, 'only row', 2 FROM customer WHERE c_custkey % 2 = 1""")
def table_block_chunks(spark, sf_dir):
    """Tables of eight rows in batches of 30 words, whose short last batch goes, and tables of one row."""
    long = "Table 1: x\nSl. No | Description\n" + "\n".join(f"{i} | word word word word word | tail" for i in range(8))
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("block_no"), F.when(F.col("c_custkey") % 2 == 0, long).otherwise("Table 2: only row").alias("text"), F.lit(1).alias("line_number"))
    return K.table_chunks(t, 30, 60).select("doc_id", "part", "text", "n_words")


@query("""WITH c AS (SELECT l.doc_id, l.no, l.path, l.text FROM (SELECT c_custkey AS doc_id, unnest([{'no': 0, 'path': 'A', 'text': 'one two three' || chr(10) || 'four'}, {'no': 2, 'path': 'B', 'text': 'five'}, {'no': 3, 'path': 'B', 'text': 'six seven eight nine'}], recursive := true) FROM customer) l)
SELECT doc_id, CAST(no AS INT) AS chunk_no, path AS section_path, text FROM c""")
def merged_chunks(spark, sf_dir):
    c = F.array(*[F.struct(F.lit(n).alias("chunk_no"), F.lit(p).alias("section_path"), F.lit(t).alias("text")) for n, p, t in ((0, "A", "one two three"), (1, "A", "four"), (2, "B", "five"), (3, "B", "six seven eight nine"))])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(c).alias("c")).select("doc_id", "c.*")
    return K.merged_neighbours(rows, 10, 3).select("doc_id", "chunk_no", "section_path", "text")


@query("""SELECT c_custkey AS doc_id, n AS chunk_no, [1, 1, 1][n + 1] AS page_start, [1, 2, 2][n + 1] AS page_end, [1, 2, NULL][n + 1] AS line_start, [2, 9, NULL][n + 1] AS line_end FROM customer, (SELECT unnest([0, 1, 2]) AS n)""")
def cited_blocks(spark, sf_dir):
    """Chunks that are found as they are, by white space, and nowhere; the pages and lines are stated."""
    blocks = F.array(*[F.struct(F.lit(n).alias("block_no"), F.lit(p).alias("page"), F.lit(no).alias("line_number"), F.lit(t).alias("text")) for n, p, no, t in ((0, 1, 1, "The first line."), (1, 1, 2, "A second  line here"), (2, 2, 9, "third"))])
    chunks = F.array(*[F.struct(F.lit(n).alias("chunk_no"), F.lit(t).alias("text")) for n, t in ((0, "first line.\nA second"), (1, "A second line here third"), (2, "nowhere"))])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return K.cited_blocks(c.select("doc_id", F.explode(chunks).alias("c")).select("doc_id", "c.*"), c.select("doc_id", F.explode(blocks).alias("b")).select("doc_id", "b.*"))
