"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(list_slice(w, s + 1, s + least(len(w), 13)), ' ') AS win
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, s, array_to_string(list_slice(w, s + 1, s + size), ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)
),
h AS (SELECT dw.doc_id, dw.s, dw.size, iw.item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"

_OP2 = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
),
t AS (SELECT *, trim(line, {_BLANK}) AS t FROM l),
b AS (SELECT t FROM t WHERE t <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
m AS (SELECT t.doc_id, t.pos, t.line, t.t <> '' AS full_line, b.t IS NOT NULL AS dropped FROM t LEFT JOIN b ON t.t = b.t)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (dropped) AS n_removed,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS text
  FROM m GROUP BY doc_id
) g USING (doc_id)
"""

# Plain Jaccard; on these texts the probability Jaccard links the same pairs.
_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s + 1, s + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS s FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM p JOIN c AS cx ON cx.doc_id = x JOIN c AS cy ON cy.doc_id = y WHERE k >= 0.8 * (cx.n + cy.n - k)
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id
),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.y FROM reach r JOIN sym s ON r.other = s.x)
SELECT doc_id, min(other) AS class_id, doc_id = min(other) AS keep FROM reach GROUP BY 1
"""

_OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""


def _record(html: str) -> str:
    return f"""'WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf
 || 'Content-Type: text/html' || crlf || 'Content-Length: ' || strlen(coalesce({html}, '')) || crlf || crlf || coalesce({html}, '')"""


def _level(below: str) -> str:
    """A file's next tree level; a file that has one node keeps it."""
    return f"""(SELECT file, node // 16 AS node, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY node)) END AS h
 FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM {below}) GROUP BY file, node // 16)"""


# The replica's bodies, as the drill has it; what is damaged or shifted follows from its records' hashes and lengths.
_HURT = "(CASE WHEN page_id % 97 = 0 THEN left(html, greatest(length(html) - 1, 0)) ELSE html END)"

_OP10 = f"""
WITH r AS (SELECT page_id, {_record("html")} AS rec, {_record(_HURT)} AS rec2 FROM (SELECT *, chr(13) || chr(10) AS crlf FROM pages)),
d AS (SELECT page_id, strlen(rec) + 4 AS length, sha256(rec) AS digest, strlen(rec2) + 4 AS length2, sha256(rec2) AS digest2 FROM r),
t AS (SELECT greatest(1, CAST(ceil(sum(length) / 8388608.0) AS BIGINT)) AS files FROM d),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, digest) - 1 AS copy FROM d),
f AS (SELECT *, (CAST('0x' || substr(digest, 1, 8) AS BIGINT) + copy) % files AS file FROM c, t),
o AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(coalesce(sum(length) OVER v, 0) AS BIGINT) AS start, CAST(coalesce(sum(length2) OVER v, 0) AS BIGINT) AS start2
  FROM f WINDOW w AS (PARTITION BY file ORDER BY digest, page_id, copy), v AS (PARTITION BY file ORDER BY digest, page_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l0 AS (SELECT file, seq AS node, sha256(digest || ':' || start || ':' || (start + length)) AS h FROM o),
root AS (SELECT file, h FROM {_level(_level(_level(_level("l0"))))})
SELECT page_id, file, seq, start, CAST(length AS BIGINT) AS length, digest, h AS root, digest <> digest2 AS damaged, digest = digest2 AND start <> start2 AS shifted FROM o JOIN root USING (file)
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS w FROM d),
g AS MATERIALIZED (
  SELECT lang, size, array_to_string(list_slice(w, s + 1, s + size), ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(0, len(w) - size + 1)) AS s FROM p, (VALUES (1), (2), (3), (4)) AS t(size) WHERE len(w) >= size)
),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 30),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS head, array_to_string(list_slice(w, k + 1, size), ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
),
heads AS MATERIALIZED (SELECT parts.*, f.f AS l FROM parts JOIN f ON f.lang = parts.lang AND f.phrase = head),
cut AS MATERIALIZED (
  SELECT heads.lang, heads.phrase, a, k, l, f.f AS r, CAST(a AS HUGEINT) * 2000000 // (CAST(l AS HUGEINT) + CAST(f.f AS HUGEINT)) AS score
  FROM heads JOIN f ON f.lang = heads.lang AND f.phrase = tail
),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, a AS longer, array_to_string(list_slice(w, s + 1, s + m), ' ') AS phrase FROM (SELECT *, unnest(range(0, size - m + 1)) AS s FROM c, (VALUES (2), (3)) AS t(m) WHERE m < size)),
gone AS (SELECT DISTINCT worst.lang, worst.phrase FROM worst JOIN inner_of AS i ON i.lang = worst.lang AND i.phrase = worst.phrase WHERE 100 * i.longer >= 80 * worst.a),
kept AS (SELECT worst.* FROM worst LEFT JOIN gone USING (lang, phrase) WHERE gone.phrase IS NULL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

ORACLES = {"op1_decontaminate": _OP1, "op2_line_dedup": _OP2, "op4_near_dup": _OP4, "op5_topk": _OP5, "op10_warc": _OP10, "op13_phrases": _OP13}
