"""Jobs, reviews, catalogs and access, over tables that orders, events and customer stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import catalog as C
from inkwell.plans.registry import query
from inkwell.sources.tables import table
from inkwell.streaming import jobs as J

_NOW = "TIMESTAMP '2024-02-15 00:00:00'"
#: events as jobs: every state, and a plan of two processors.
_JOBS = """j AS (SELECT event_id AS job_id, ['QUEUED', 'DISPATCHING', 'ASSIGNED', 'IN_PROGRESS', 'COMPLETED', 'FAILED', 'STOPPED'][event_id % 7 + 1] AS status, ts AS updated_at, CAST(user_id AS VARCHAR) AS processor_id,
 CASE WHEN event_id % 3 = 0 THEN 'COMPLETED' WHEN event_id % 3 = 1 THEN 'FAILED' END AS a, CASE WHEN event_id % 4 < 2 THEN 'COMPLETED' WHEN event_id % 4 = 2 THEN 'RUNNING' END AS b FROM events)"""
_PEND = "list_sort(list_filter([CASE WHEN a IS NULL THEN 'a' END, CASE WHEN b IS NULL OR b = 'RUNNING' THEN 'b' END], lambda x: x IS NOT NULL))"


def jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in ("QUEUED", "DISPATCHING", "ASSIGNED", "IN_PROGRESS", "COMPLETED", "FAILED", "STOPPED")]), (k % 7 + 1).cast("int"))
    plan = F.create_map(F.lit("a"), F.when(k % 3 == 0, "COMPLETED").when(k % 3 == 1, "FAILED"), F.lit("b"), F.when(k % 4 < 2, "COMPLETED").when(k % 4 == 2, "RUNNING"))
    return e.select(k.alias("job_id"), state.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("user_id").cast("string").alias("processor_id"), plan.alias("results"))


def now():
    return F.lit("2024-02-15").cast("timestamp")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN a = 'COMPLETED' AND b = 'COMPLETED' THEN 'COMPLETED' WHEN a IN ('COMPLETED', 'FAILED') AND b IN ('COMPLETED', 'FAILED') THEN 'FAILED'
 WHEN len({_PEND}) > 0 AND status IN ('ASSIGNED', 'DISPATCHING', 'STARTED', 'FAILED') THEN 'IN_PROGRESS' ELSE status END AS status, array_to_string({_PEND}, ',') AS pending FROM j""")
def effective_job_status(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", J.effective_status(F.col("status"), F.col("results")).alias("status"), F.array_join(F.array_sort(J.pending(F.col("results"))), ",").alias("pending"))


@query(f"""WITH {_JOBS}, c AS (SELECT event_id // 2 * 2 AS job_id, 'p' || user_id AS processor_id, ts, event_id FROM events), f AS (SELECT job_id, arg_min(processor_id, (ts, processor_id)) AS p FROM c GROUP BY 1)
SELECT job_id, CASE WHEN status = 'QUEUED' AND p IS NOT NULL THEN 'DISPATCHING' ELSE status END AS status, CASE WHEN status = 'QUEUED' AND p IS NOT NULL THEN p ELSE processor_id END AS processor_id, status = 'QUEUED' AND p IS NOT NULL AS claimed FROM j LEFT JOIN f USING (job_id)""")
def job_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "events").select((F.col("event_id") - F.col("event_id") % 2).alias("job_id"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("processor_id"), "ts")
    return J.claimed(jobs(spark, sf_dir), claims)


@query(f"WITH {_JOBS} SELECT job_id FROM j WHERE status = 'QUEUED' AND epoch({_NOW}) - floor(epoch(updated_at)) > 300 ORDER BY updated_at, job_id LIMIT 50")
def stale_queued_jobs(spark, sf_dir):
    return J.stale_queued(jobs(spark, sf_dir), now()).select("job_id")


@query(f"""WITH {_JOBS}, o AS (SELECT * FROM j WHERE status IN ('DISPATCHING', 'ASSIGNED', 'IN_PROGRESS') AND epoch({_NOW}) - floor(epoch(updated_at)) > 120 ORDER BY updated_at, job_id LIMIT 100)
SELECT job_id, CASE WHEN status = 'IN_PROGRESS' AND len({_PEND}) > 0 THEN ({_PEND})[1] ELSE 'requeue' END AS action FROM o WHERE job_id % 5 <> 0 AND job_id % 11 <> 0""")
def orphaned_jobs(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"))
    return J.orphaned(jobs(spark, sf_dir), ids.where("job_id % 5 = 0"), ids.where("job_id % 11 = 0"), now())


@query(f"""WITH {_JOBS}, o AS (SELECT * FROM j WHERE status NOT IN ('COMPLETED', 'TIMED_OUT', 'QUEUE_FAILED', 'STOPPED', 'HUMAN_REVIEW') ORDER BY updated_at DESC, job_id LIMIT 500)
SELECT job_id, status FROM o WHERE status <> 'FAILED' OR len({_PEND}) > 0""")
def non_terminal_jobs(spark, sf_dir):
    return J.open_jobs(jobs(spark, sf_dir), 500).select("job_id", "status")


@query(f"WITH {_JOBS} SELECT count(*) FILTER (status = 'QUEUED') AS queued FROM j")
def queued_jobs(spark, sf_dir):
    return jobs(spark, sf_dir).where("status = 'QUEUED'").agg(F.count(F.lit(1)).alias("queued"))


@query("""SELECT event_id AS "offset", CASE WHEN event_type = 'signup' THEN 1000 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 500 ELSE 0 END + CASE WHEN event_id % 9 > 0 AND value >= 20 THEN 300 ELSE 0 END
 + CASE WHEN event_id % 9 = 0 THEN 0 ELSE least(CAST(trunc(greatest(value, 0)) AS INT), 120) END + CASE WHEN event_type IN ('click', 'view') THEN 50 ELSE 0 END AS priority FROM events""")
def dispatch_priorities(spark, sf_dir):
    """Ages are unknown where the id is divisible by 9; views have no processor, so they are for the first one."""
    e = table(spark, sf_dir, "events")
    processor = F.when(F.col("event_type") == "click", " Chunking_Vectorizing").when(F.col("event_type") != "view", "other")
    m = e.select(F.col("event_id").alias("offset"), F.when(F.col("event_type") == "signup", "QUEUED").otherwise("HELD").alias("status"), (F.col("user_id") % 2 == 1).alias("requeued"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("age_s"), processor.alias("processor"))
    return J.dispatch_order(m).select("offset", "priority")


@query("""WITH m AS (SELECT user_id % 20 AS queue, event_id AS o, CASE WHEN event_type = 'signup' THEN 1000 ELSE 0 END + 500 + CASE WHEN value >= 20 THEN 300 ELSE 0 END + least(CAST(trunc(greatest(value, 0)) AS INT), 120) + 50 AS p, event_id % 3 > 0 AS ok FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY o) AS n FROM m QUALIFY n <= 25)
SELECT queue, o AS "offset", p AS priority FROM h WHERE ok QUALIFY row_number() OVER (PARTITION BY queue ORDER BY p DESC, o) = 1""")
def next_dispatch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select((F.col("user_id") % 20).alias("queue"), F.col("event_id").alias("offset"), F.when(F.col("event_type") == "signup", "QUEUED").otherwise("HELD").alias("status"), F.lit(False).alias("requeued"), F.col("value").alias("age_s"), F.lit(None).cast("string").alias("processor"), (F.col("event_id") % 3 > 0).alias("dispatchable"))
    return J.next_dispatch(m)


_STATES = ("PENDING", "REOPENED", "IN_REVIEW", "CHANGES_REQUESTED", "APPROVED", "REJECTED")
_OK = " OR ".join(f"(status = '{s}' AND target IN ({', '.join(repr(t) for t in ts)}))" for s, ts in J.TRANSITIONS.items())


@query(f"""WITH r AS (SELECT c_custkey AS review_id, {list(_STATES)}[c_custkey % 6 + 1] AS status, c_custkey % 3 AS version FROM customer),
m AS (SELECT event_id AS move_id, event_id % 400 AS review_id, {list(_STATES)}[event_id % 5 + 1] AS target, CASE WHEN event_id % 4 = 0 THEN event_id % 3 END AS ev FROM events),
x AS (SELECT m.*, status, version, row_number() OVER (PARTITION BY m.review_id ORDER BY move_id) AS n FROM m LEFT JOIN r USING (review_id))
SELECT move_id, CASE WHEN status IS NULL THEN 'not_found' WHEN n > 1 THEN 'conflict' WHEN status IN ('APPROVED', 'REJECTED') AND ev IS NULL AND target <> 'REOPENED' THEN 'conflict' WHEN ev <> version THEN 'conflict' WHEN {_OK} THEN 'applied' ELSE 'invalid' END AS outcome FROM x""")
def review_transitions(spark, sf_dir):
    state = lambda c, n: F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col(c) % n + 1).cast("int"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("review_id"), state("c_custkey", 6).alias("status"), (F.col("c_custkey") % 3).alias("version"))
    k = F.col("event_id")
    m = table(spark, sf_dir, "events").select(k.alias("move_id"), (k % 400).alias("review_id"), state("event_id", 5).alias("target"), F.when(k % 4 == 0, k % 3).alias("expected_version"))
    return J.transitions(r, m)[1].select("move_id", "outcome")


@query(f"""WITH {_JOBS}, s AS (SELECT event_id AS slot_id, event_id + CASE WHEN event_id % 50 = 0 THEN 1000000000 ELSE 0 END AS job_id, event_id % 4 > 0 AS healthy FROM events WHERE event_id % 2 = 0)
SELECT slot_id, job_id, CASE WHEN slot_id IS NOT NULL AND (status IS NULL OR status IN ('COMPLETED', 'FAILED', 'STOPPED')) THEN 'release_slot' WHEN slot_id IS NOT NULL AND NOT healthy THEN 'requeue_job'
 WHEN slot_id IS NULL AND status IN ('DISPATCHING', 'ASSIGNED', 'IN_PROGRESS') AND epoch({_NOW}) - floor(epoch(updated_at)) > 120 THEN 'requeue_job' ELSE 'keep' END AS action FROM s FULL JOIN j USING (job_id)""")
def health_reconciliation(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0")
    slots = e.select(F.col("event_id").alias("slot_id"), (F.col("event_id") + F.when(F.col("event_id") % 50 == 0, 1000000000).otherwise(0)).alias("job_id"), (F.col("event_id") % 4 > 0).alias("healthy"))
    return J.reconciled(slots, jobs(spark, sf_dir), now())


# Records: every customer is a document, known by id, name or file; chunk statistics come under any of them.
_REC = "r AS (SELECT c_custkey AS document_id, 'doc' || c_custkey AS document_name, CASE WHEN c_custkey % 3 = 0 THEN 'file' || c_custkey // 2 ELSE '' END AS original_file_name, c_nationkey AS repository_id FROM customer)"
_KEYS = "k AS (SELECT document_id, 0 AS p, CAST(document_id AS VARCHAR) AS key FROM r UNION ALL SELECT document_id, 1, document_name FROM r UNION ALL SELECT document_id, 2, original_file_name FROM r WHERE original_file_name <> '')"
_STAT = "st AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'file' || o_custkey // 2 WHEN 1 THEN 'doc' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS key, count(*) AS n_chunks, count(CASE WHEN o_orderkey % 2 = 0 THEN 1 END) AS n_embedded, max(o_orderpriority) AS category FROM orders GROUP BY 1)"


def records(spark, sf_dir):
    k = F.col("c_custkey")
    file = F.when(k % 3 == 0, F.concat(F.lit("file"), F.floor(k / 2).cast("string"))).otherwise("")
    return table(spark, sf_dir, "customer").select(k.alias("document_id"), F.concat(F.lit("doc"), k.cast("string")).alias("document_name"), file.alias("original_file_name"), F.col("c_nationkey").alias("repository_id"))


def stats(spark, sf_dir):
    k = F.col("o_custkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("file"), F.floor(k / 2).cast("string"))).when(k % 3 == 1, F.concat(F.lit("doc"), k.cast("string"))).otherwise(k.cast("string"))
    return table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count(F.when(F.col("o_orderkey") % 2 == 0, 1)).alias("n_embedded"), F.max("o_orderpriority").alias("category"))


@query(f"""WITH {_REC}, {_KEYS}, {_STAT}, f AS (SELECT document_id, arg_min((n_chunks, n_embedded, category), p) AS s FROM k JOIN st USING (key) GROUP BY 1)
SELECT document_id, coalesce(s[1], 0) AS n_chunks, coalesce(s[2], 0) AS n_embedded, s[3] AS category, coalesce(s[1], 0) > 0 AS indexed FROM r LEFT JOIN f USING (document_id)""")
def indexed_stats(spark, sf_dir):
    return C.indexed_stats(records(spark, sf_dir), stats(spark, sf_dir)).select("document_id", "n_chunks", "n_embedded", "category", "indexed")


@query(f"""WITH {_REC}, {_KEYS}, {_STAT}, f AS (SELECT document_id, arg_min((n_chunks, category), p) AS s FROM k JOIN st USING (key) GROUP BY 1), pg AS (SELECT * FROM r ORDER BY document_id DESC LIMIT 60 OFFSET 10)
SELECT document_id, coalesce(s[1], 0) AS n_chunks, s[2] AS category, CASE WHEN document_id % 4 > 0 THEN 'S' || document_id % 4 END AS job_status FROM pg LEFT JOIN f USING (document_id) WHERE s[2] IN ('1-URGENT', '5-LOW')""")
def catalog_page(spark, sf_dir):
    jobs_ = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("S"), (F.col("c_custkey") % 4).cast("string")).alias("status"))
    got = C.catalog_page(records(spark, sf_dir), stats(spark, sf_dir), jobs_, [F.desc("document_id")], 10, 60, {"category": ["1-URGENT", "5-LOW"]})
    return got.select("document_id", "n_chunks", "category", "job_status")


@query(f"WITH {_REC}, pg AS (SELECT * FROM r ORDER BY document_id LIMIT 40 OFFSET 5) SELECT document_id, repository_id FROM pg WHERE repository_id % 2 = 0")
def accessible_page(spark, sf_dir):
    allowed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repository_id")).where("repository_id % 2 = 0")
    return C.accessible_page(records(spark, sf_dir), allowed, [F.col("document_id")], 5, 40).select("document_id", "repository_id")


@query(f"""WITH {_REC}, {_KEYS}, ow AS (SELECT key, max(document_id) AS document_id FROM k GROUP BY 1),
sc AS (SELECT l_suppkey AS query_id, CASE l_orderkey % 3 WHEN 0 THEN 'file' || o_custkey // 2 WHEN 1 THEN 'doc' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS key, l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT query_id, document_id, max(score) AS score FROM sc JOIN ow USING (key) WHERE score >= 20 GROUP BY 1, 2)
SELECT query_id, document_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INT) AS rank FROM b QUALIFY rank <= 5""")
def ranked_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    k, m = F.col("o_custkey"), F.col("l_orderkey") % 3
    key = F.when(m == 0, F.concat(F.lit("file"), F.floor(k / 2).cast("string"))).when(m == 1, F.concat(F.lit("doc"), k.cast("string"))).otherwise(k.cast("string"))
    scores = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select(F.col("l_suppkey").alias("query_id"), key.alias("key"), F.col("l_quantity").alias("score"))
    return C.rank_documents(scores, records(spark, sf_dir), 5, 20.0)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jobs_of_documents(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return C.rows_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query("SELECT p_partkey, (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part WHERE p_partkey % 7 = 0) AS already_imported FROM part")
def already_imported(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return C.marked_imported(p.select("p_partkey", "p_brand", "p_size"), p.where("p_partkey % 7 = 0"), ["p_brand", "p_size"]).select("p_partkey", "already_imported")


@query("""WITH f AS (SELECT c_custkey AS doc_id, 'F' || c_nationkey % 5 AS field_id, c_mktsegment AS field_name FROM customer), e AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey % 5 END AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'building' ELSE 'Machinery' END AS name, o_orderstatus || o_orderkey AS value FROM orders),
a AS (SELECT f.doc_id, field_id, arg_min(value, pos) AS v FROM f JOIN e ON f.doc_id = e.doc_id AND lower(field_id) = lower(item_id) GROUP BY 1, 2), b AS (SELECT f.doc_id, field_id, arg_min(value, pos) AS v FROM f JOIN e ON f.doc_id = e.doc_id AND lower(field_name) = lower(name) GROUP BY 1, 2)
SELECT f.doc_id, f.field_id, coalesce(a.v, b.v) AS value FROM f LEFT JOIN a USING (doc_id, field_id) LEFT JOIN b USING (doc_id, field_id)""")
def resolved_values(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("F"), (F.col("c_nationkey") % 5).cast("string")).alias("field_id"), F.col("c_mktsegment").alias("field_name"))
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.when(k % 2 == 0, F.concat(F.lit("f"), (k % 5).cast("string"))).alias("item_id"), F.when(k % 3 == 0, "building").otherwise("Machinery").alias("name"),
        F.concat("o_orderstatus", k.cast("string")).alias("value"),
    )
    return C.resolved_values(f, e)


@query("SELECT o_custkey AS document_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS review_id FROM orders GROUP BY 1")
def latest_reviews(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("review_id"), "o_orderdate")
    return C.latest(r, "document_id", "o_orderdate", "review_id").select("document_id", "review_id")


@query("SELECT o_orderkey AS review_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 10")
def review_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("document_type_id"), F.col("o_orderdate").alias("updated_at"))
    return C.list_reviews(o, {"status": ["O", "P"], "document_type_id": "2-HIGH", "assigned_to": "", "unknown": 1}, 30, 10).select("review_id", "status")


_BIND = "b AS (SELECT conv_id AS repository_id, turn AS user_id, role, CASE WHEN turn % 5 = 4 THEN 1 END AS revoked_at FROM conversations)"


def bindings(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("repository_id"), F.col("turn").alias("user_id"), "role", F.when(F.col("turn") % 5 == 4, 1).alias("revoked_at"))


@query(f"WITH {_BIND} SELECT repository_id, user_id, role FROM b WHERE repository_id = 1 AND revoked_at IS NULL")
def repository_members(spark, sf_dir):
    return C.members(bindings(spark, sf_dir), 1).select("repository_id", "user_id", "role")


@query(f"WITH {_BIND} SELECT DISTINCT user_id, repository_id FROM b WHERE revoked_at IS NULL AND repository_id IS NOT NULL")
def user_repositories(spark, sf_dir):
    return C.user_repositories(bindings(spark, sf_dir))


@query("""WITH c AS (SELECT o_custkey AS document_id, 'c' || o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 END AS page, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS section_path, o_orderstatus AS section_name, CASE WHEN o_orderkey % 7 > 2 THEN o_orderkey % 4 END AS line_start FROM orders)
SELECT document_id, chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page, 0), coalesce(section_path, section_name, ''), coalesce(line_start, 0), chunk_id) AS INT) AS position FROM c""")
def sorted_chunks(spark, sf_dir):
    k = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.when(k % 3 > 0, k % 5).alias("page"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("section_path"),
        F.col("o_orderstatus").alias("section_name"), F.when(k % 7 > 2, k % 4).alias("line_start"),
    )
    return C.sorted_chunks(c).select("document_id", "chunk_id", "position")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 5 WHEN c_custkey % 20 = 8 THEN c_custkey - 3 WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey + 1 END AS parent FROM customer),
w AS (SELECT id, id AS at, [id] AS seen, false AS back FROM n UNION ALL SELECT w.id, n.parent, list_append(seen, n.parent), list_contains(seen, n.parent) FROM w JOIN n ON w.at = n.id WHERE n.parent IS NOT NULL AND NOT back)
SELECT id, bool_or(back) AS circular FROM w GROUP BY 1""")
def circular_hierarchies(spark, sf_dir):
    k = F.col("c_custkey")
    n = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 50 == 0, k + 5).when(k % 20 == 8, k - 3).when(k % 10 == 9, None).otherwise(k + 1).alias("parent"))
    return C.circular(n)


@query("""WITH o AS (SELECT c_custkey AS k, CAST(c_custkey % 3 AS VARCHAR) AS a, c_name AS x, CAST(c_nationkey AS VARCHAR) AS z FROM customer)
SELECT k, 'a' AS field, a AS "old", CAST(k % 2 AS VARCHAR) AS "new" FROM o WHERE a <> CAST(k % 2 AS VARCHAR) UNION ALL SELECT k, 'b.y.z', z, CASE WHEN k % 4 > 0 THEN z END FROM o WHERE k % 4 = 0 UNION ALL SELECT k, 'b.w', NULL, 'new' FROM o WHERE k % 5 = 0""")
def deep_changes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey")
    y = F.struct(F.col("c_nationkey").alias("z"))
    old = c.select("k", F.to_json(F.struct((F.col("k") % 3).alias("a"), F.struct(F.col("c_name").alias("x"), y.alias("y")).alias("b"))).alias("j"))
    later = F.struct(F.when(F.col("k") % 4 > 0, F.col("c_nationkey")).alias("z"))
    new = c.select("k", F.to_json(F.struct((F.col("k") % 2).alias("a"), F.struct(F.col("c_name").alias("x"), F.when(F.col("k") % 4 > 0, later).alias("y"), F.when(F.col("k") % 5 == 0, "new").alias("w")).alias("b"))).alias("j"))
    return C.deep_changes(old, new, "k", "j")


@query("""WITH e AS (SELECT p_partkey AS source, 'T' || p_size AS target, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 END AS rid FROM part) SELECT source, target, CAST(rid AS VARCHAR) AS resolved_id FROM e WHERE rid IS NOT NULL UNION SELECT source, target, NULL FROM e WHERE rid IS NULL""")
def references_union(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.concat(F.lit("T"), F.col("p_size").cast("string")).alias("target"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 9).alias("resolved_id"))
    e = e.unionByName(e)
    return C.references_for(e.where("resolved_id is not null"), e.where("resolved_id is null"))


@query("SELECT o_orderkey % 1000 AS pmid, CASE WHEN o_orderkey % 1000 < 200 THEN 'PMC' || o_orderkey % 1000 END AS pmcid FROM orders")
def resolved_pmcids(spark, sf_dir):
    ids = table(spark, sf_dir, "part").where("p_partkey < 200").select(F.col("p_partkey").alias("pmid"), F.concat(F.lit("PMC"), F.col("p_partkey").cast("string")).alias("pmcid"))
    ids = ids.unionByName(spark.createDataFrame([(0, "PMC0")], "pmid long, pmcid string"))
    return C.resolve_ids(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("pmid")), ids)
