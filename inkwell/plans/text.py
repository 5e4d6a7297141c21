"""Text, detection, validation, chunking and streaming queries over documents, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.functions import scores, text, validate
from inkwell.operators import chunking as K
from inkwell.operators import mentions as N
from inkwell.operators import references as X
from inkwell.plans.observability import E, events, rounded
from inkwell.plans.registry import query
from inkwell.sources.shared import shared_path
from inkwell.sources.tables import spread, table
from inkwell.streaming import jobs as J
from inkwell.streaming import outcomes as O
from inkwell.streaming.tables import DailyTable, UpsertTable, run

STOP = ["that", "this", "with", "from"]


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm, CASE WHEN length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) >= 80 THEN sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) END AS hash FROM documents")
def text_fingerprints(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.fingerprint_text("text").alias("norm"), text.text_hash("text").alias("hash"))


@query("""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ('that', 'this', 'with', 'from'))) AS terms FROM benchmark)
SELECT item_id, len(terms) AS n_terms, list_sort(terms)[1] AS least FROM q""")
def query_terms(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", text.query_terms("text", STOP).alias("terms"))
    return t.select("item_id", F.size("terms").cast("long").alias("n_terms"), F.get(F.array_sort("terms"), F.lit(0)).alias("least"))


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), h AS (SELECT doc_id, list_filter(['thanea', 'edinths', 'erinhe', 'zzzz'], lambda x: list_contains(t, x) OR list_contains(t, regexp_replace(x, 's+$', ''))) AS hits FROM d)
SELECT doc_id, len(hits) AS n_hits, len(hits) >= 2 AS kept FROM h""")
def evidence_filter(spark, sf_dir):
    terms = F.array(*[F.lit(x) for x in ("thanea", "edinths", "erinhe", "zzzz")])
    hits = docs(spark, sf_dir).select("doc_id", text.evidence("text", terms).alias("h"))
    return hits.select("doc_id", F.size("h").cast("long").alias("n_hits"), text.has_evidence(F.col("h"), terms).alias("kept"))


@query("""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 150) / 100.0)) AS BIGINT) * 100 + 1, 100)) AS i FROM w)
SELECT doc_id, CAST(i / 100 AS INT) AS chunk_no, md5(array_to_string(list_slice(w, i + 1, i + 150), ' ')) AS h, CAST(least(150, len(w) - i) AS INT) AS n_words FROM s""")
def chunk_sliding_window(spark, sf_dir):
    return K.sliding_window_of_all(docs(spark, sf_dir)).select("doc_id", "chunk_no", F.md5("text").alias("h"), "n_words")


# The SQL engine's word ends are those of ASCII, so letters around an abbreviation are named.
_ABBR = text.ABBREVIATION.removeprefix(r"\b").removesuffix(r"\.")
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SENT = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){_ABBR}\\.', '\\1\\2.' || chr(1), 'g'), '([.!?])\\s+([A-Z0-9"])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), ''), {_BLANK})), lambda x: x <> '')"""


@query(f"""WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents), i AS (SELECT doc_id, s, unnest(range(0, CAST(greatest(0, ceil((len(s) - 5) / 4.0)) AS BIGINT) * 4 + 1, 4)) AS i FROM s WHERE len(s) > 0),
c AS (SELECT doc_id, CAST(i / 4 AS INT) AS chunk_no, array_to_string(list_slice(s, i + 1, i + 5), ' ') AS text FROM i)
SELECT doc_id, chunk_no, text, CAST(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS INT) AS n_words FROM c""")
def chunk_sentence_based(spark, sf_dir):
    return K.sentence_based(docs(spark, sf_dir)).select("doc_id", "chunk_no", "text", "n_words")


def _packed(source: str, size: int = 150, overlap: int = 2, least: int = 60) -> str:
    """SQL that packs sentences: source defines z (doc_id, sec, path, i, t), i from 1 without gaps in each (doc_id, sec)."""
    return f"""WITH RECURSIVE {source},
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, sec ORDER BY i) AS c, count(*) OVER (PARTITION BY doc_id, sec) AS n FROM (SELECT *, len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) AS w FROM z)),
e AS (SELECT a.doc_id, a.sec, a.i, a.w > {size} AS long, coalesce(max(b.i), a.i) AS e, any_value(a.n) AS n FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND a.sec = b.sec AND b.i >= a.i AND b.c - a.c + a.w <= {size} GROUP BY a.doc_id, a.sec, a.i, a.w),
x AS (SELECT *, CASE WHEN long THEN i + 1 WHEN e < n THEN i + greatest(e - i + 1 - least({overlap}, e - i), 1) END AS following FROM e),
v AS (SELECT doc_id, sec, i FROM x WHERE i = 1 UNION ALL SELECT x.doc_id, x.sec, x.following FROM v JOIN x USING (doc_id, sec, i) WHERE x.following <= x.n),
k AS (SELECT v.doc_id, v.sec, v.i, 0 AS j, string_agg(p.t, ' ' ORDER BY p.i) AS text FROM v JOIN x USING (doc_id, sec, i) JOIN p ON p.doc_id = v.doc_id AND p.sec = v.sec AND p.i BETWEEN x.i AND x.e WHERE NOT x.long GROUP BY v.doc_id, v.sec, v.i
 UNION ALL SELECT doc_id, sec, i, j, array_to_string(list_slice(ws, j + 1, j + {size}), ' ') FROM (SELECT doc_id, sec, i, ws, unnest(range(0, len(ws), {size})) AS j FROM (SELECT doc_id, sec, i, string_split(trim(regexp_replace(p.t, '\\s+', ' ', 'g')), ' ') AS ws FROM v JOIN x USING (doc_id, sec, i) JOIN p USING (doc_id, sec, i) WHERE long))),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i, j) AS m, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n FROM k),
g AS (SELECT doc_id, sec, m, 1 AS grp, n AS acc FROM m WHERE m = 1 UNION ALL SELECT m.doc_id, m.sec, m.m, CASE WHEN acc < {least} THEN grp ELSE grp + 1 END, CASE WHEN acc < {least} THEN acc + n ELSE n END FROM g JOIN m ON m.doc_id = g.doc_id AND m.sec = g.sec AND m.m = g.m + 1),
o AS (SELECT doc_id, sec, m, CASE WHEN grp > 1 AND max(acc) OVER (PARTITION BY doc_id, sec, grp) < {least} THEN grp - 1 ELSE grp END AS grp FROM g),
c AS (SELECT doc_id, sec, grp - 1 AS part, string_agg(text, ' ' ORDER BY m) AS text, CAST(sum(n) AS INT) AS n_words FROM o JOIN m USING (doc_id, sec, m) GROUP BY doc_id, sec, grp)"""


_WHOLE = f"z AS (SELECT doc_id, 0 AS sec, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS t FROM (SELECT doc_id, {_SENT} AS s FROM documents))"


@query(_packed(_WHOLE) + " SELECT doc_id, CAST(part AS INT) AS chunk_no, '' AS section_path, text, n_words FROM c")
def chunk_fixed_overlap(spark, sf_dir):
    return K.fixed_overlap(docs(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i, t, len(string_split(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ')) AS w FROM (SELECT doc_id, unnest(range(0, len(ps))) AS no, trim(unnest(ps)) AS t FROM (SELECT doc_id, regexp_split_to_array(text, '\\n\\s*\\n|[\\r\\n]+') AS ps FROM documents)) WHERE t <> ''),
b AS (SELECT doc_id, i, 0 AS batch, 1 AS n, w AS words FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN n >= 3 OR words + p.w > 150 THEN batch + 1 ELSE batch END, CASE WHEN n >= 3 OR words + p.w > 150 THEN 1 ELSE n + 1 END, CASE WHEN n >= 3 OR words + p.w > 150 THEN p.w ELSE words + p.w END FROM b JOIN p ON p.doc_id = b.doc_id AND p.i = b.i + 1),
c AS (SELECT doc_id, CAST(batch AS INT) AS chunk_no, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text, CAST(sum(w) AS INT) AS n_words FROM b JOIN p USING (doc_id, i) GROUP BY 1, 2) SELECT * FROM c""")
def chunk_paragraph_based(spark, sf_dir):
    return K.paragraph_based(docs(spark, sf_dir)).select("doc_id", "chunk_no", "text", "n_words")


#: Lines, headings with as many words as their level says, and the sections under them, told by the stack of open headings.
_SECTIONS = f"""l AS (SELECT *, len(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')) AS level FROM (SELECT doc_id, unnest(range(0, len(ls))) AS no, trim(unnest(ls)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE t <> ''),
h AS (SELECT *, level <= 6 AND NOT regexp_matches(t, '[.!?,;:]$') AS h FROM l), gr AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS grp FROM h),
hd AS (SELECT doc_id, grp, t, CAST(level AS INT) AS level FROM gr WHERE h),
st AS (SELECT a.doc_id, a.grp, string_agg(b.t, ' > ' ORDER BY b.grp) AS deep, count(b.t) AS depth FROM hd a JOIN hd b ON b.doc_id = a.doc_id AND (b.grp = a.grp OR b.grp < a.grp AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM hd x WHERE x.doc_id = a.doc_id AND x.grp > b.grp AND x.grp < a.grp AND x.level <= b.level)) GROUP BY 1, 2),
se AS (SELECT gr.doc_id, gr.grp, gr.no, gr.t, dense_rank() OVER (PARTITION BY gr.doc_id ORDER BY gr.grp) - 1 AS sec FROM gr WHERE NOT h),
u AS (SELECT doc_id, sec, grp, no, unnest(range(len(s))) AS k, unnest(s) AS t FROM (SELECT doc_id, sec, grp, no, {_SENT.replace("(text,", "(t,")} AS s FROM se))"""


@query(_packed(_SECTIONS + ", z AS (SELECT doc_id, sec, '' AS path, row_number() OVER (PARTITION BY doc_id, sec ORDER BY no, k) AS i, t FROM u)")
       + " SELECT doc_id, CAST(sec AS BIGINT) * 4294967296 + part AS chunk_no, coalesce(hd.t, '') AS section_path, text, n_words FROM c JOIN (SELECT DISTINCT doc_id, sec, grp FROM se) USING (doc_id, sec) LEFT JOIN hd USING (doc_id, grp)")
def chunk_section_based(spark, sf_dir):
    return K.section_based(K.sections_of_text(docs(spark, sf_dir)))


@query(_packed(_SECTIONS + ", z AS (SELECT doc_id, sec, '' AS path, row_number() OVER (PARTITION BY doc_id, sec ORDER BY no, k) AS i, t FROM u)")
       + " SELECT doc_id, CAST(sec AS BIGINT) * 4294967296 + part AS chunk_no, coalesce(array_to_string(list_slice(string_split(deep, ' > '), 1, 2), ' > '), '') AS section_path, text, n_words FROM c JOIN (SELECT DISTINCT doc_id, sec, grp FROM se) USING (doc_id, sec) LEFT JOIN st USING (doc_id, grp)")
def chunk_hierarchical(spark, sf_dir):
    """Headings are as deep as they have words; paths are cut to two of them."""
    return K.hierarchical(K.sections_of_text(docs(spark, sf_dir), text.token_count))


@query("""WITH l AS (SELECT doc_id, no, t, len(string_split(regexp_replace(t, '\\s+', ' ', 'g'), ' ')) <= 6 AND NOT regexp_matches(t, '[.!?,;:]$') AS h FROM (SELECT doc_id, unnest(range(0, len(ls))) AS no, trim(unnest(ls)) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE t <> ''),
g AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY no) AS grp FROM l), b AS (SELECT *, max(CASE WHEN h THEN t END) OVER (PARTITION BY doc_id, grp) AS path FROM g),
r AS (SELECT doc_id, coalesce(path, '') AS section_path, t AS text, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS sec, row_number() OVER (PARTITION BY doc_id, grp ORDER BY no) - 1 AS part FROM b WHERE NOT h)
SELECT doc_id, CAST(sec AS BIGINT) * 4294967296 + part AS chunk_no, section_path, text FROM r""")
def chunk_semantic_hierarchy(spark, sf_dir):
    return K.semantic_hierarchy(K.sections_of_text(docs(spark, sf_dir))).select("doc_id", "chunk_no", "section_path", "text")


@query("""SELECT doc_id, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[\\r\\n]+'))) AS p FROM documents) WHERE p <> '' GROUP BY 1""")
def paragraphs(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", F.explode(text.paragraphs("text")).alias("p"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("chars"))


@query("SELECT vec_id, CASE WHEN s >= 0.95 THEN 'block' WHEN s >= 0.85 THEN 'human_review' WHEN s >= 0.75 THEN 'warning' ELSE 'allow' END AS action FROM (SELECT vec_id, 0.7 + CAST(embedding[1] AS DOUBLE) AS s FROM embeddings)")
def similarity_risk(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", scores.similarity_risk(0.7 + F.get("embedding", F.lit(0)).cast("double")).alias("action"))


@query("""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(upper(trim(c_name || '_v 2.pdf.docx')), '(\\.(PDF|DOCX?|PPTX?|TXT|XLSX?))+$', ''), '_', '-'), '\\s+', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS id FROM customer""")
def document_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.document_id(F.concat("c_name", F.lit("_v 2.pdf.docx"))).alias("id"))


@query("""WITH d AS (SELECT o_custkey AS doc_id, o_orderpriority AS field, max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN 'x' ELSE '' END) AS value, max(o_orderkey % 100) / 100.0 AS confidence FROM orders GROUP BY 1, 2),
r AS (SELECT doc_id, string_agg(CASE WHEN value = '' THEN field END, ',' ORDER BY field) AS missing, string_agg(CASE WHEN value = 'x' THEN field END, ',' ORDER BY field) AS invalid, string_agg(CASE WHEN value <> '' AND confidence < 0.7 THEN field END, ',' ORDER BY field) AS low FROM d GROUP BY 1)
SELECT doc_id, coalesce(missing, '') AS missing, coalesce(invalid, '') AS invalid, coalesce(low, '') AS low_confidence, CASE WHEN missing IS NOT NULL OR invalid IS NOT NULL THEN 'FAIL' WHEN low IS NOT NULL THEN 'WARNING' ELSE 'PASS' END AS status FROM r""")
def document_validation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 3 == 1, "x").otherwise("")
    got = o.groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("field_name")).agg(F.max(value).alias("value"), (F.max(F.col("o_orderkey") % 100) / 100.0).alias("confidence"))
    return validate.validate(got.select("doc_id", "field_name", F.lit("number").alias("type"), F.lit(True).alias("required")), got)


#: Lines with labels that documents get: one twice, one whose value is its label, one too long, one without a value.
_LABELLED = """concat(coalesce(text, ''), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('Owner : team ', doc_id % 7, chr(10)) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN concat('Valid from = 2024-01-', 10 + doc_id % 20, chr(10)) ELSE '' END,
 CASE WHEN doc_id % 4 = 0 THEN concat('OWNER: nobody', chr(10), 'Same: same', chr(10)) ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN concat('  a label of far too many words here: x', chr(10), 'Empty:', chr(10), 'Ratio: 1:', doc_id, '  ') ELSE '' END)"""
_PAIR = r"'^\s*([A-Za-z][^:\n]*?)\s*[:=]\s*(\S.*?)\s*$'"


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split({_LABELLED}, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, CAST(pos AS INT) AS pos, trim(regexp_extract(line, {_PAIR}, 1)) AS label, regexp_extract(line, {_PAIR}, 2) AS value FROM l)
SELECT doc_id, label, value, pos FROM p WHERE length(label) BETWEEN 1 AND 64 AND len(string_split(label, ' ')) <= 6 AND lower(label) <> lower(value) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(label) ORDER BY pos) = 1""")
def label_value_pairs(spark, sf_dir):
    """Documents with planted labels, beside the labels that they have."""
    return validate.label_pairs(docs(spark, sf_dir).select("doc_id", F.expr(_LABELLED).alias("text")))


@query("""WITH m AS (SELECT p_partkey AS source, 'PN-' || p_brand || '-' || p_size AS name FROM part), r AS (SELECT source, upper(replace(replace(name, '#', '-'), ' ', '')) AS target FROM m),
o AS (SELECT target, min(source) AS resolved, count(*) AS n FROM r GROUP BY 1 HAVING n = 1)
SELECT r.source + 1 AS source, r.target, coalesce(CASE WHEN o.resolved <> r.source + 1 THEN o.resolved END, -1) AS resolved FROM r LEFT JOIN o USING (target)""")
def reference_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), F.translate(F.concat(F.lit("PN-"), "p_brand", F.lit("-"), F.col("p_size").cast("string")), "#", "-").alias("name"))
    return X.resolve(p.select((F.col("document_id") + 1).alias("source"), text.document_id("name").alias("target")), p).select("source", "target", F.coalesce("resolved", F.lit(-1).cast("long")).alias("resolved"))


#: Lines that every third document but one gets, with ids of orders: led, labelled, in a sentence of references, untold, behind a colon, unknown, again.
_MENTIONS = (
    "concat('Refer to DOC-', doc_id, '-A for details.')", "concat('SOP No: doc_', doc_id + 1, '_a')", "concat('In accordance with DOC--', doc_id + 2, '-A and DOC-', doc_id + 3, '-A.pdf')",
    "concat('Nothing but DOC-', doc_id + 4, '-A')", "concat('Details: DOC-', doc_id + 5, '-A.')", "concat('See XDOC-', doc_id + 6, '-A or DOC-', doc_id + 7, '-AB')", "concat('doc-', doc_id, '-a is described in DOC-', doc_id + 1, '-A')",
)
_PLANTED = "concat_ws(chr(10), coalesce(text, ''), " + ", ".join(f"CASE WHEN (doc_id + {i}) % 3 > 0 THEN {m} END" for i, m in enumerate(_MENTIONS)) + ")"
_FOUND = rf"""WITH d AS (SELECT doc_id, 'DOC-' || (doc_id + 2) || '-A' AS own, string_split({_PLANTED}, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, own, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS raw FROM d),
n AS (SELECT *, regexp_replace(translate(raw, 'abcdefghijklmnopqrstuvwxyz_', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ-'), '-+', '-', 'g') AS u FROM l WHERE contains(upper(raw), 'DOC')),
t AS (SELECT *, unnest(regexp_extract_all(u, '[A-Z0-9][A-Z0-9/.-]*[A-Z0-9]')) AS token FROM n),
k AS (SELECT DISTINCT 'DOC-' || o_orderkey || '-A' AS target FROM orders),
r AS (SELECT doc_id, target, i, raw, CASE
    WHEN regexp_matches(u, '\b(SOP|FORM|WI|REPORT|PROTOCOL|DOCUMENT)\s+NO\.?\s*[:#-]?\s*' || token || '$') THEN 'label'
    WHEN regexp_matches(u, '\b(REFER(\s+TO)?|SEE(\s+ALSO)?|AS\s+PER|ACCORDING\s+TO|BASED\s+ON)\s+' || token || '(\s|$)') THEN 'lead'
    WHEN regexp_matches(lower(raw), 'refer|in accordance with|described in|(^|[^\w-])see([^\w-]|$)') THEN 'trigger'
    WHEN regexp_matches(u, ':\s*' || token || '\.?\s*$') THEN 'colon' END AS rule
  FROM t JOIN k ON k.target = regexp_replace(token, '\.(PDF|DOCX?|TXT)$', '') WHERE target <> own),
f AS (SELECT doc_id, target, arg_min(rule, i) AS rule, arg_min(raw, i) AS sentence, CAST(count(DISTINCT raw) AS INT) AS evidence FROM r WHERE rule IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, CASE rule WHEN 'label' THEN 0.92 WHEN 'lead' THEN 0.88 WHEN 'trigger' THEN 0.85 ELSE 0.9 END AS confidence FROM f)"""


def _mentioned(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PLANTED).alias("text"), F.expr("concat('doc_', doc_id + 2, '_A.docx')").alias("name"))
    known = table(spark, sf_dir, "orders").select(F.expr("concat('doc-', o_orderkey, '-A')").alias("name"))
    return N.mentions(spread(d), known, "name"), known


@query(_FOUND + " SELECT doc_id, target, CASE rule WHEN 'label' THEN 'sop' ELSE 'document' END AS type, rule, CAST(confidence AS DOUBLE) AS confidence, sentence, evidence FROM c")
def reference_extraction(spark, sf_dir):
    """References of all documents, each with planted lines, to the orders' ids; none to itself."""
    return _mentioned(spark, sf_dir)[0]


@query(_FOUND + " SELECT lower(left(target, 3)) || substr(target, 4) AS name, count(*) AS documents, CAST(sum(evidence) AS BIGINT) AS mentions, CAST(max(confidence) AS DOUBLE) AS confidence FROM c GROUP BY target")
def reference_counts(spark, sf_dir):
    return N.document_references(*_mentioned(spark, sf_dir))


@query("""WITH j AS (SELECT event_id AS job_id, CASE event_id % 4 WHEN 0 THEN 'DISPATCHING' WHEN 1 THEN 'ASSIGNED' WHEN 2 THEN 'IN_PROGRESS' ELSE 'QUEUED' END AS status, ts FROM events)
SELECT job_id, CASE WHEN status = 'IN_PROGRESS' THEN 'TIMED_OUT' ELSE 'QUEUED' END AS next_status FROM j WHERE epoch(TIMESTAMP '2024-01-15') - floor(epoch(ts)) > CASE status WHEN 'DISPATCHING' THEN 30 WHEN 'ASSIGNED' THEN 120 WHEN 'IN_PROGRESS' THEN 1800 ELSE 1e18 END ORDER BY ts, job_id LIMIT 50""")
def stale_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*[F.lit(s) for s in ("DISPATCHING", "ASSIGNED", "IN_PROGRESS", "QUEUED")]), (F.col("event_id") % 4 + 1).cast("int"))
    jobs = e.select(F.col("event_id").alias("job_id"), state.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return J.recovered(jobs, F.lit("2024-01-15").cast("timestamp")).select("job_id", "next_status")


@query("""SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type AS metric_name, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS avg_ms FROM events GROUP BY 1, 2""")
def streaming_hourly(spark, sf_dir):
    """The stream of events in tumbling hours, run to its end in one trigger."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events*")
    at = shared_path(spark, "hourly")
    out = J.hourly(events_of(raw)).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "metric_name", "n", "failed", F.round("avg_ms", 6).alias("avg_ms"))
    kept = UpsertTable(spark, f"{at}/table", ["hour", "metric_name"])
    run(out, kept.apply, f"{at}/checkpoint", "update")
    return kept.read()


def _arrivals(spark, sf_dir, late):
    """The events as a stream of two batches: the rows that come late are a second file behind the first."""
    at, e = shared_path(spark, "arrivals"), table(spark, sf_dir, "events")
    for when in (~late, late):
        e.where(when).coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in"), at


@query(f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, metric_name, CASE WHEN count(duration_ms) > 0 THEN count(duration_ms) ELSE count(status) END AS n, round(avg(duration_ms), 6) AS avg_ms,
 round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99, max(duration_ms) AS max_ms,
 count(*) FILTER (status = 'failure') AS failures FROM {E} GROUP BY 1, 2""")
def streaming_daily(spark, sf_dir):
    """Every fifth event comes late, of all days: its batch recomputes the days that it touches."""
    raw, at = _arrivals(spark, sf_dir, F.col("event_id") % 5 == 0)
    kept = DailyTable(spark, f"{at}/daily")
    run(events_of(raw), kept.apply, f"{at}/checkpoint")
    return rounded(kept.read(), "avg_ms", "p50", "p95", "p99").withColumn("day", F.col("day").cast("string"))


@query("""WITH m AS (SELECT user_id * 1000 + dayofyear(ts) AS job_id, event_type AS processor, CASE WHEN value < 20 THEN 'FAILED' WHEN value < 90 THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status, ts, event_id AS no FROM events),
z AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM m),
p AS (SELECT job_id, processor, arg_max(status, (ts, no)) AS status FROM m GROUP BY 1, 2),
j AS (SELECT job_id, CAST(count(*) AS INT) AS processors, bool_and(status IN ('COMPLETED', 'FAILED')) AS ended, coalesce(string_agg(CASE WHEN status = 'FAILED' THEN processor END, ',' ORDER BY processor), '') AS failed FROM p GROUP BY 1),
h AS (SELECT job_id, CAST(count(*) AS INT) AS outcomes, max(ts) AS last FROM m GROUP BY 1)
SELECT job_id, CASE WHEN ended AND failed <> '' THEN 'FAILED' WHEN ended THEN 'COMPLETED' WHEN epoch_ms(last) + 43200000 <= epoch_ms(mark) THEN 'TIMED_OUT' ELSE 'IN_PROGRESS' END AS status, processors, outcomes, failed FROM j JOIN h USING (job_id), z""")
def streaming_outcomes(spark, sf_dir):
    """Jobs (a user's day) and the outcomes of their processors (kinds of events) as keyed state; twelve silent hours time a job out."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events*")
    at = shared_path(spark, "outcomes")
    state = F.when(F.col("value") < 20, "FAILED").when(F.col("value") < 90, "COMPLETED").otherwise("IN_PROGRESS")
    job = F.col("user_id") * 1000 + F.dayofyear("ts")
    told = raw.select(job.alias("job_id"), F.col("event_type").alias("processor"), state.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("no"))
    return outcome_table(spark, told, at).read().select("job_id", "status", "processors", "outcomes", "failed")


def outcome_table(spark, told, at, timeout=43200.0):
    """The stream of outcomes, kept as a table by job; the state store of RocksDB is set for the time in which it starts."""
    kept, key = UpsertTable(spark, f"{at}/jobs", ["job_id"]), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, O.PROVIDER)
    try:
        last = Window.partitionBy("job_id").orderBy(F.desc("version"))
        run(O.outcomes(told, timeout), lambda rows, no: kept.apply(rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r"), no), f"{at}/checkpoint", "update")
    finally:
        spark.conf.set(key, before)
    return kept


def events_of(raw):
    status = F.when(F.col("event_type") == "error", "failure").otherwise("success")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric_name"), status.alias("status"), F.col("value").alias("duration_ms"))


__all__ = ["events"]
