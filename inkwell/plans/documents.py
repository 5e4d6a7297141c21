"""Queries over passages, section paths, lines and blocks, whose texts are made from the rows of orders and part so that every rule is hit."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import citations, evidence, lines
from inkwell.plans.registry import query
from inkwell.plans.security import _T as _TEXTS
from inkwell.plans.security import _q, texts
from inkwell.sources.tables import spread, table

_TERMS = ("id", "password", "the", "card", "Project", "x", "vendor")
_TERM_LIST = "[" + ", ".join(map(_q, _TERMS)) + "]"
_SPAN = f"""list_sort(list_distinct(flatten(list_transform(list_filter({_TERM_LIST}, lambda w: length(w) >= 2), lambda w: list_transform(range(1, len(string_split_regex(t, '(?i)\\b' || w || '\\b'))),
 lambda i: {{'start': CAST(list_sum(list_transform(list_slice(string_split_regex(t, '(?i)\\b' || w || '\\b'), 1, i), lambda p: length(p))) + (i - 1) * length(w) AS INT), 'end': CAST(list_sum(list_transform(list_slice(string_split_regex(t, '(?i)\\b' || w || '\\b'), 1, i), lambda p: length(p))) + i * length(w) AS INT)}})))))"""


def terms():
    return F.array(*[F.lit(t) for t in _TERMS])


@query(f"WITH {_TEXTS}, x AS (SELECT k, coalesce(text, '') AS t FROM t) SELECT k, CAST(len(s) AS INT) AS n, coalesce(array_to_string(list_transform(s, lambda z: z.start || '-' || z.end), ','), '') AS spans FROM (SELECT k, {_SPAN} AS s FROM x)")
def highlight_spans(spark, sf_dir):
    spans = evidence.highlights("text", terms())
    said = F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return texts(spark, sf_dir).select("k", F.size(spans).alias("n"), said.alias("spans"))


_EV = "list_filter(['id', 'password', 'card'], lambda w: contains(t, w))"
_SCORED = f"""WITH {_TEXTS}, x AS (SELECT k, coalesce(text, '') AS t, CASE WHEN k % 5 > 0 THEN k % 7 END AS page, CASE WHEN k % 3 = 0 THEN k % 50 END AS line, CASE WHEN k % 4 = 0 THEN '' ELSE 'S1' END AS section, (k % 100) / 100.0 AS score, k % 6 = 0 AS dup, (k % 10) / 10.0 AS ocr, {_SPAN} AS s FROM (SELECT k, text, coalesce(text, '') AS t FROM t)),
g AS (SELECT *, {_EV} AS ev, len({_EV}) / 6.0 AS cov FROM x),
r AS (SELECT *, round(greatest(0, least(1, 0.70 * cov + 0.20 * least(1.0, len(s) / 7.0) + 0.10 * CASE WHEN page IS NOT NULL THEN 1 ELSE 0 END)), 4) AS grounding,
 round(greatest(0, least(1, 0.40 * CASE WHEN length(t) = 0 THEN 0 WHEN length(t) < 40 THEN 0.45 WHEN length(t) < 120 THEN 0.75 ELSE 1 END + 0.30 * (CAST(page IS NOT NULL AS INT) + CAST(line IS NOT NULL AS INT) + CAST(section <> '' AS INT)) / 3.0 + 0.30 * cov + 0.10 * score
 - CASE WHEN dup THEN 0.40 ELSE 0 END - CASE WHEN ocr < 0.5 THEN 0.15 ELSE 0 END)), 4) AS quality FROM g)"""


@query(f"""{_SCORED} SELECT k, grounding, quality, array_to_string(list_filter([CASE WHEN length(t) = 0 THEN 'missing_text' END, CASE WHEN length(t) > 0 AND length(t) < 40 THEN 'incomplete_chunk' END,
 CASE WHEN coalesce(page, 0) = 0 AND coalesce(line, 0) = 0 AND section = '' THEN 'missing_metadata' END, CASE WHEN len(ev) = 0 THEN 'weak_match' END, CASE WHEN score < 0.25 THEN 'low_score' END, CASE WHEN grounding < 0.5 THEN 'low_grounding' END, CASE WHEN dup THEN 'duplicate_result' END], lambda f: f IS NOT NULL), ',') AS flags FROM r""")
def passage_quality(spark, sf_dir):
    k, t = F.col("k"), F.coalesce(F.col("text"), F.lit(""))
    ev = F.filter(F.array(F.lit("id"), F.lit("password"), F.lit("card")), lambda w: F.contains(t, w))
    page, line, section = F.when(k % 5 > 0, k % 7), F.when(k % 3 == 0, k % 50), F.when(k % 4 == 0, "").otherwise("S1")
    rows = texts(spark, sf_dir).select("k", t.alias("text"), ev.alias("ev"), page.alias("page"), line.alias("line"), section.alias("section"), ((k % 100) / 100.0).alias("score"), (k % 6 == 0).alias("dup"), ((k % 10) / 10.0).alias("ocr"))
    c = F.col
    rows = rows.withColumn("grounding", evidence.grounding(c("text"), c("ev"), terms(), c("page").isNotNull()))
    rows = rows.withColumn("quality", evidence.quality(c("text"), c("page"), c("line"), c("section"), c("ev"), terms(), c("score"), c("dup"), c("ocr")))
    said = F.array_join(evidence.flags(c("text"), c("page"), c("line"), c("section"), c("ev"), terms(), c("score"), c("grounding"), c("dup")), ",")
    return rows.select("k", "grounding", "quality", said.alias("flags"))


_SYL = "CASE WHEN regexp_replace(w, '[^a-zA-Z]', '', 'g') = '' THEN 0 WHEN length(regexp_replace(w, '[^a-zA-Z]', '', 'g')) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')), '[aeiouy]+')) - CASE WHEN lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) LIKE '%e' AND len(regexp_extract_all(lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"


def _readability_sql(source: str) -> str:
    return f"""w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9''\\-]*') AS w, len(list_filter(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x) <> '')) AS parts FROM {source}),
y AS (SELECT doc_id, t, len(w) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(parts, 1) END AS s, coalesce(list_sum(list_transform(w, lambda w: {_SYL})), 0) AS y, coalesce(list_sum(list_transform(w, lambda w: length(w))), 0) AS chars FROM w),
e AS (SELECT *, CASE WHEN n = 0 THEN 100 ELSE greatest(0, least(100, 206.835 - 1.015 * (n / s) - 84.6 * (y / n))) END AS ease, CASE WHEN n = 0 THEN 0 ELSE greatest(0, 0.39 * (n / s) + 11.8 * (y / n) - 15.59) END AS grade FROM y),
rd AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, 0.65 * (1 - ease / 100) + 0.35 * least(1, grade / 18))) END AS hard FROM e)"""


@query(f"""WITH src AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents), {_readability_sql('src')}
SELECT doc_id, CAST(n AS INT) AS n_words, CAST(s AS INT) AS n_sentences, CAST(y AS INT) AS n_syllables, round(CASE WHEN n = 0 THEN 0 ELSE n / s END, 6) AS avg_sentence, round(CASE WHEN n = 0 THEN 0 ELSE chars / n END, 6) AS avg_word, round(ease, 6) AS ease, round(grade, 6) AS grade, round(hard, 6) AS complexity FROM rd""")
def readability(spark, sf_dir):
    r = evidence.readability("text")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *[(c if n.startswith("n_") else F.round(c, 6)).alias(n) for n, c in r.items()])


def _count(p: str) -> str:
    return f"len(regexp_extract_all(t, {_q(p)}))"


def _some(ps) -> str:
    return "len(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(t, {_q(p)})" for p in ps) + ")))"


_CLAMP = "greatest(0, least(1, {0}))"
_ASCII = r"'[^\x00-\x7F]+'"


@query(f"""WITH src AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), {_ASCII}, ' ', 'g') || CASE doc_id % 5 WHEN 0 THEN chr(10) || '- item SOP-12 HPLC' || chr(10) || '| a | b |' WHEN 1 THEN ' ISO 9001 = x + y*2 camelCase 12 mg' WHEN 2 THEN chr(10) || '    code' || chr(10) || '1) step' ELSE '' END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents), {_readability_sql('src')},
d AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE {_CLAMP.format(_some(evidence.TECHNICAL) + ' / greatest(n, 1)')} END AS technical, CASE WHEN n = 0 THEN 0 ELSE {_CLAMP.format(_some(evidence.ENTITIES) + ' / greatest(n, 1)')} END AS entity,
 {_CLAMP.format(_count(evidence.BULLETS) + ' / greatest(s, 1)')} AS lists, {_CLAMP.format('(' + ' + '.join(map(_count, evidence.TABLES)) + ') / greatest(s, 1)')} AS tabs, {_CLAMP.format(_count(evidence.EQUATIONS) + ' / greatest(n, 1)')} AS eqs, {_CLAMP.format('(' + ' + '.join(map(_count, evidence.CODE)) + ') / greatest(s, 1)')} AS code FROM rd),
c AS (SELECT *, {_CLAMP.format('0.30 * hard + 0.30 * technical + 0.20 * entity + 0.20 * (0.35 * lists + 0.30 * tabs + 0.20 * eqs + 0.15 * code)')} AS score FROM d)
SELECT doc_id, round(score, 6) AS complexity_score, CASE WHEN score <= 0.30 THEN 'Low' WHEN score >= 0.71 THEN 'High' ELSE 'Medium' END AS complexity_level, round(technical, 6) AS technical_density, round(entity, 6) AS entity_density, round(lists, 6) AS list_density, round(tabs, 6) AS table_density FROM c""")
def passage_complexity(spark, sf_dir):
    """Documents without their non-ASCII letters, a third of them with lists, tables, formulas or code added."""
    return complexities(table(spark, sf_dir, "documents"))


def complexities(docs):
    nl = "\n"
    more = F.when(F.col("doc_id") % 5 == 0, f"{nl}- item SOP-12 HPLC{nl}| a | b |").when(F.col("doc_id") % 5 == 1, " ISO 9001 = x + y*2 camelCase 12 mg").when(F.col("doc_id") % 5 == 2, f"{nl}    code{nl}1) step").otherwise("")
    t = F.trim(F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]+", " "), more), F.lit(" \t\n\x0b\x0c\r"))
    rows = spread(docs.select("doc_id", "text")).select("doc_id", t.alias("t"))
    c = evidence.complexity("t")
    return rows.select("doc_id", *[(c[n] if n.endswith("level") else F.round(c[n], 6)).alias(n) for n in ("complexity_score", "complexity_level", "technical_density", "entity_density", "list_density", "table_density")])


# Section paths, one for each shape.
_PATHS = ("'Scope'", "concat('1.2 Part ', p_size)", "concat('5 Title > 5.', p_size, ' Working Standard')", "'6 Instructions for the use of pumps'", "'A > > B '", "''", "NULL", "'Document'", "'B/Y REVISION  HISTORY: gis y'", "'7 Check > note'")
_PATH = f"CASE p_partkey % {len(_PATHS)} " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PATHS)) + " END"
_NUM = "regexp_matches({0}, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$')"
_NT = "CASE WHEN " + _NUM + " THEN rtrim(regexp_extract({0}, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$', 1), '.') ELSE {0} END", "CASE WHEN " + _NUM + " THEN trim(regexp_extract({0}, '^(\\d+(?:\\.\\d+)*\\.?)\\s+(.+)$', 2)) ELSE '' END"


@query(f"""WITH p AS (SELECT p_partkey AS k, {_PATH} AS path FROM part), l AS (SELECT k, path, list_filter(list_transform(string_split_regex(coalesce(path, ''), '\\s*>\\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p),
h AS (SELECT *, len(parts) AS n, coalesce(parts[len(parts)], '') AS leaf, CASE WHEN len(parts) > 1 THEN parts[len(parts) - 1] ELSE '' END AS parent FROM l),
m AS (SELECT *, {_NT[0].format('leaf')} AS number, {_NT[1].format('leaf')} AS title FROM h), z AS (SELECT *, number <> '' AND title <> '' AND NOT contains(number, '.') AND len(string_split_regex(title, '\\s+')) >= 4 AS long FROM m)
SELECT k, CASE WHEN n = 0 THEN '' WHEN long THEN title WHEN number <> '' THEN number ELSE leaf END AS section_name, CASE WHEN n = 0 THEN '' WHEN long THEN array_to_string(list_append(parts[1:n - 1], title), ' > ') ELSE array_to_string(parts, ' > ') END AS section_path,
 CASE WHEN n = 0 THEN '' WHEN title <> '' THEN title WHEN n > 1 THEN {_NT[1].format('parent')} ELSE '' END AS title, parent,
 CASE WHEN lower(trim(coalesce(path, ''))) IN ('document', 'unknown', '', 'introduction', 'none') THEN '' WHEN path = 'Scope' THEN 'Scope' WHEN path LIKE '%REVISION%' THEN 'Revision History' WHEN path LIKE '6 Instr%' THEN 'Instructions For The Use Of Pumps' ELSE trim(path) END AS label FROM z""")
def section_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.expr(_PATH).alias("path"))
    return p.select("k", citations.section_parts("path").alias("s"), citations.section_label("path").alias("label")).select("k", "s.*", "label")


@query("""WITH p AS (SELECT p_partkey AS k, CASE WHEN k % 3 = 0 THEN NULL ELSE p_size END AS page, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'Document' ELSE '1.' || p_size END AS section, CASE WHEN k % 5 = 0 THEN 'Up' ELSE '' END AS parent, CASE WHEN k % 6 = 0 THEN '' ELSE p_name END AS title, CASE WHEN k % 7 > 2 THEN k % 90 END AS line, k % 8 = 0 AS is_table, CASE WHEN k % 2 = 0 THEN 'T1' END AS tname, CASE WHEN k % 9 > 3 THEN 40 ELSE 5 END AS words FROM part)
SELECT k, round(least(1, (CASE WHEN coalesce(page, 0) <> 0 THEN 0.25 ELSE 0 END + CASE WHEN section <> '' THEN 0.2 ELSE 0 END + CASE WHEN parent <> '' THEN 0.15 ELSE 0 END + CASE WHEN title <> '' AND lower(title) NOT IN ('document', 'unknown', '', 'introduction', 'none') THEN 0.15 ELSE 0 END + CASE WHEN line IS NOT NULL THEN 0.1 ELSE 0 END
 + CASE WHEN tname IS NULL THEN 0 WHEN is_table THEN 0.15 ELSE 0.05 END) * CASE WHEN words < 30 THEN 0.5 ELSE 1 END * CASE WHEN lower(section) IN ('document', '') THEN 0.25 ELSE 1 END), 6) AS quality,
 array_to_string(list_filter(['D' || k, CASE WHEN section <> '' THEN 'Section ' || section || CASE WHEN title <> '' THEN ' ' || title ELSE '' END END, 'Page ' || page || CASE WHEN k % 2 = 1 THEN '-' || (page + 1) ELSE '' END, 'Lines ' || line], lambda x: x IS NOT NULL), ', ') AS said FROM p""")
def citation_quality(spark, sf_dir):
    k = F.col("p_partkey")
    c = {
        "page": F.when(k % 3 != 0, F.col("p_size")), "section": F.when(k % 4 == 0, "").when(k % 4 == 1, "Document").otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"))), "parent": F.when(k % 5 == 0, "Up").otherwise(""),
        "title": F.when(k % 6 == 0, "").otherwise(F.col("p_name")), "line": F.when(k % 7 > 2, k % 90), "is_table": k % 8 == 0, "tname": F.when(k % 2 == 0, "T1"), "text": F.repeat(F.lit("word "), F.when(k % 9 > 3, 40).otherwise(5)),
    }
    rows = table(spark, sf_dir, "part").select(k.alias("k"), *[v.alias(n) for n, v in c.items()])
    g = F.col
    quality = citations.citation_quality(g("text"), g("page"), g("section"), g("parent"), g("title"), g("line"), g("is_table"), g("tname"))
    line = citations.citation_line(F.concat(F.lit("D"), g("k").cast("string")), g("section"), g("title"), g("page"), F.when(g("k") % 2 == 1, g("page") + 1), g("line"), F.lit(None).cast("int"))
    return rows.select("k", F.round(quality, 6).alias("quality"), line.alias("said"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'a-1.pdf,notes.v2.docx' WHEN 1 THEN '' WHEN 2 THEN 'Plan.PDF' ELSE 'x.csv' END AS files FROM customer""")
def mentioned_files(spark, sf_dir):
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "see a-1.pdf and notes.v2.docx or A-1.PDF").when(k == 1, "no file here").when(k == 2, "Plan.PDF, plan.pdf").otherwise("(x.csv)")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.array_join(citations.mentioned_files(said), ",").alias("files"))


# Lines, one for each kind and some that only look like one.
_LINES = (
    "'Page 3 of 12'", "concat('Introduction ..... ', o_orderkey % 90)", "concat('1.2 Purpose and scope ', o_orderkey % 90)", "'Table 4: Limits of use'", "'Figure 2 Flow of material'", "'Sl. No.  Description  Remarks'", "'1 AB-12 CD-34 5.5'",
    "'Document No: GL-1 Version 2'", "'Prepared by: someone'", "'Electronically generated document'", "'Sign and date'", "'The pump is started and the valve is opened.'", "''", "'   '", "'Role Senior QA approver'", "'Print ID 4 Printed by x'",
    "'yes | no | 12 | pass'", "'A normal sentence with the number 12'", "'3 of 4'", "concat('KG-', o_orderkey % 9, ' 12 mg OK ', o_orderkey % 7)",
)
_LINE = f"CASE o_orderkey % {len(_LINES)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LINES)) + " END"
_WORDS = "CASE WHEN v = '' THEN 0 ELSE len(string_split_regex(v, '\\s+')) END"
_CODE = f"len(list_filter(tk, lambda x: regexp_matches(x, {_q(lines.CODE)}) AND (NOT regexp_matches(x, '^[A-Za-z]+$') OR x = upper(x))))"
_CELL = f"len(list_filter(tk, lambda x: regexp_matches(x, {_q(lines.CELL)})))"
_LONG = "len(list_filter(tk, lambda x: regexp_matches(x, '^[A-Za-z]{4,}$')))"


def _m(p: str, v: str = "v") -> str:
    return f"regexp_matches({v}, {_q(p)})"


@query(f"""WITH l AS (SELECT o_orderkey AS k, {_LINE} AS raw FROM orders), s AS (SELECT k, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v FROM l),
t AS (SELECT *, {_WORDS} AS n, list_filter(list_transform(string_split(v, ' '), lambda x: trim(x, '()[]{{}}:;,.')), lambda x: x <> '') AS tk, {_m('[.!?]$')} AS marks FROM s),
c AS (SELECT *, {_CODE} AS code, {_CELL} AS cell, {_LONG} AS long, greatest(3, CAST(floor(len(tk) / 2) AS INT)) AS half FROM t),
f AS (SELECT *, v <> '' AND ({_m(lines.SIGNATURE_ROLE)} OR {_m(lines.ELECTRONIC)} OR len(regexp_extract_all(v, {_q(lines.PRINT)})) >= 2 OR {_m(lines.APPROVAL)} OR {_m(lines.METADATA_LINE)} OR len(regexp_extract_all(v, {_q(lines.METADATA)})) >= 2) AS meta,
 {_m(lines.TOC_DOTS)} OR ({_m(lines.TOC_ENTRY)} AND NOT {_m('[.!?]' + chr(92) + 's+' + chr(92) + 'S+')} AND n BETWEEN 2 AND 14) AS toc,
 v <> '' AND ({_m(lines.TABLE_CAPTION)} OR {_m(lines.FIGURE_CAPTION)} OR (len(regexp_extract_all(v, {_q(lines.TABLE_HEADER)})) >= 2 AND n <= 16 AND (NOT marks OR {_m(lines.DELIMITER, 'raw')}))
  OR (NOT marks AND len(tk) >= 3 AND (({_m(lines.DELIMITER, 'raw')} AND cell >= 2 AND long <= 4) OR (regexp_matches(tk[1], '^[0-9]+$') AND code >= 2) OR (cell >= half AND long <= 3) OR (code >= half AND long <= 2)))) AS tab,
 {_m(lines.FORM_LABEL)} AND n <= 6 AS form, {_m(lines.PAGE_MARK)} AS page FROM c)
SELECT k, CASE WHEN v = '' THEN 'blank' WHEN meta THEN 'metadata' WHEN page THEN 'page' WHEN toc THEN 'toc' WHEN tab THEN 'table' WHEN form THEN 'form' ELSE 'text' END AS kind, v = '' OR meta OR page OR toc OR tab OR form AS skipped FROM f""")
def line_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_LINE).alias("line"))
    return rows.select("k", lines.kind("line").alias("kind"), lines.is_skipped("line").alias("skipped"))


@query("SELECT p_partkey AS k, trim(lower(regexp_replace(p_name || '  X', '[aeiou]', '_', 'g'))) AS text FROM part")
def post_processed(spark, sf_dir):
    steps = [{"type": "regex_replace", "pattern": "[aeiou]", "replacement": "_"}, {"type": "lowercase"}, {"type": "unknown"}, {"type": "strip"}]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), lines.post_processed(F.concat("p_name", F.lit("  X")), steps).alias("text"))
