"""Document catalog: filters, paging, scoped duplicates, index statistics, set operations, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.sources.shared import broadcast_if, written


def filters(rows: DataFrame, wanted: dict, allowed: dict[str, str]) -> DataFrame:
    """Equality for a value, membership for a list; unknown keys, nulls and '' are skipped; all must hold."""
    conds = []
    for key, value in wanted.items():
        values = [v for v in (value if isinstance(value, list | tuple) else [value]) if v not in (None, "")]
        if key in allowed and values:
            conds.append(F.col(allowed[key]) == values[0] if len(values) == 1 else F.col(allowed[key]).isin(values))
    return rows.where(reduce(lambda a, b: a & b, conds)) if conds else rows


def split_filters(wanted: dict, stored: set[str], indexed: set[str]) -> tuple[dict, dict, dict]:
    """Filters for the store, for metadata.* keys, and for aggregated columns."""
    meta = {k.removeprefix("metadata."): v for k, v in wanted.items() if k.startswith("metadata.")}
    return {k: v for k, v in wanted.items() if k in stored}, meta, {k: v for k, v in wanted.items() if k in indexed}


def metadata_matches(metadata: str, wanted: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.get_json_object(metadata, f"$.{k}") == str(v) for k, v in wanted.items()], F.lit(True))


def page(rows: DataFrame, *order: Column, offset: int = 0, limit: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def find_duplicates(incoming: DataFrame, existing: DataFrame, scope: list[str], ignored_status: list[str]) -> DataFrame:
    """document_id of incoming rows and the earliest other document in their scope with the same content or text hash."""
    old = existing.where(~F.col("status").isin(ignored_status)) if ignored_status else existing
    old = old.select(*scope, F.explode(F.array(F.struct(F.lit("content").alias("by"), F.col("content_hash").alias("hash")), F.struct(F.lit("text").alias("by"), F.col("content_text_hash").alias("hash")))).alias("h"), F.col("document_id").alias("other")).select(*scope, "h.by", "h.hash", "other").where("hash is not null")
    new = incoming.select(*scope, F.explode(F.array(F.struct(F.lit("content").alias("by"), F.col("content_hash").alias("hash")), F.struct(F.lit("text").alias("by"), F.col("content_text_hash").alias("hash")))).alias("h"), "document_id").select(*scope, "h.by", "h.hash", "document_id").where("hash is not null")
    # The two smallest ids of each key are enough: one of them isn't the document itself.
    w = Window.partitionBy(*scope, "by", "hash").orderBy("other")
    least = old.withColumn("_r", F.row_number().over(w)).where("_r <= 2").drop("_r")
    return new.join(least, [*scope, "by", "hash"]).where("other <> document_id").groupBy("document_id").agg(F.min("other").alias("duplicate_of"))


def insert_new(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key nobody has yet."""
    return incoming.join(existing.select(*keys).distinct(), keys, "left_anti")


def mark_duplicates(rows: DataFrame, key: str = "doc_id", body: str = "text", min_words: int = 10) -> DataFrame:
    """Short texts are duplicates; of equal normalised texts all but the first are. Keeps the first by key."""
    said = text.held(text.fingerprint_text(body), lambda n: F.struct(F.md5(n).alias("h"), F.when(n == "", 0).otherwise(F.size(F.split(n, " "))).alias("n")))
    t = rows.select(key, said.alias("s")).select(key, F.col("s.h").alias("_h"), F.col("s.n").alias("n_words"))
    first = t.where(F.col("n_words") >= min_words).groupBy("_h").agg(F.min(key).alias("_first"))
    return t.join(first, "_h", "left").select(key, "n_words", ((F.col("n_words") < min_words) | (F.col(key) != F.col("_first"))).alias("is_duplicate"))


def index_statistics(chunks: DataFrame, doc: str, position: str) -> DataFrame:
    """For each document: chunks, embedded ones, the first category that isn't null, and whether any chunk is a duplicate."""
    first = F.min_by("category", F.when(F.col("category").isNotNull(), F.col(position)))
    return chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("embedding").alias("n_embedded"), first.alias("category"), F.coalesce(F.bool_or("is_duplicate"), F.lit(False)).alias("has_duplicate"))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, value) tables: fields whose values differ, null where one side has none."""
    on = [*key, "field"]
    m = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), on, "full")
    return m.where(~F.col("old").eqNullSafe(F.col("new")))


def flattened(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, field, value) of a JSON object column, nested objects by dotted paths; everything else keeps its JSON text."""
    level = rows.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("field", "value"))
    done = None
    while True:
        nested = F.coalesce(F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$") & F.from_json("value", "map<string,string>").isNotNull(), F.lit(False))
        level = written(level.withColumn("_nested", nested), "level")
        leaves = level.where("not _nested").select(key, "field", "value")
        done = leaves if done is None else done.unionByName(leaves)
        deeper = level.where("_nested")
        if deeper.isEmpty():
            return done
        level = deeper.select(key, F.col("field").alias("_f"), F.explode(F.from_json("value", "map<string,string>")).alias("_k", "value")).select(key, F.concat_ws(".", "_f", "_k").alias("field"), "value")


def deep_changes(old: DataFrame, new: DataFrame, key: str, json: str) -> DataFrame:
    """(key, field, old, new) of the dotted paths whose values differ between two JSON columns."""
    return changes(flattened(old, key, json), flattened(new, key, json), [key])


def ancestors(nodes: DataFrame) -> DataFrame:
    """nodes (id, parent): id, ancestor and depth, the least distance. A walk that meets a node again ends there.

    Distances double each round, so rounds are logarithmic in the longest chain; each is a written table.
    """
    reach = written(nodes.where("parent is not null and id <> parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "reach")
    span = 1
    while True:
        x, y = reach.alias("x"), reach.where(F.col("depth") == span).alias("y")
        far = y.join(x, F.col("x.id") == F.col("y.ancestor")).select(F.col("y.id").alias("id"), F.col("x.ancestor").alias("ancestor"), (F.col("x.depth") + span).alias("depth"))
        far = far.where("id <> ancestor").groupBy("id", "ancestor").agg(F.min("depth").alias("depth")).join(reach.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        far = written(far, "far")
        if far.isEmpty():
            return reach
        reach, span = written(reach.unionByName(far), "reach"), span * 2


def circular(nodes: DataFrame) -> DataFrame:
    """id and circular: whether the walk from a node comes back to one it has met."""
    reach = ancestors(nodes)
    back = reach.alias("r").join(nodes.alias("n"), (F.col("r.ancestor") == F.col("n.id")) & (F.col("n.parent") == F.col("r.id"))).select(F.col("r.id").alias("id"))
    on_cycle = back.unionByName(nodes.where("id = parent").select("id")).distinct()
    into = reach.join(on_cycle.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select("id").unionByName(on_cycle).distinct()
    return nodes.select("id").distinct().join(into.withColumn("circular", F.lit(True)), "id", "left").select("id", F.coalesce("circular", F.lit(False)).alias("circular"))


def nearest_definition(chain: DataFrame, definitions: DataFrame) -> DataFrame:
    """chain (id, ancestor, depth; depth 0 is the type itself), definitions (type_id, field, value): the nearest value of each field."""
    m = chain.join(definitions.withColumnRenamed("type_id", "ancestor"), "ancestor")
    return m.groupBy("id", "field").agg(F.min_by("value", "depth").alias("value"), F.min("depth").alias("depth"))


def highest_role(bindings: DataFrame, order: list[str]) -> DataFrame:
    """user_id, repository_id, role: the highest role that isn't revoked."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("role"))
    return bindings.where("revoked_at is null").groupBy("repository_id", "user_id").agg(F.min_by("role", rank).alias("role"))


def expired_repositories(docs: DataFrame, retention_s: float, now: Column) -> DataFrame:
    """Repositories whose documents are all completed, the last one retention_s or more before now."""
    g = docs.groupBy("repository_id").agg(F.every(F.col("status") == "completed").alias("done"), F.max("completed_at").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("done") & (F.unix_timestamp("last") + retention_s <= F.unix_timestamp(now))).select("repository_id", "n")


def repeated_lines(docs: DataFrame, min_count: int = 3, max_words: int = 8) -> DataFrame:
    """doc_id, text without the short lines that a document repeats min_count times or more, and how many went.

    Counts are made inside the row, so no text is shuffled.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    t = docs.select("doc_id", lines.alias("l"))
    runs = F.aggregate(F.array_sort("l"), F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("many")), lambda a, x: F.struct(
        x.alias("last"), F.when(x == a["last"], a["n"] + 1).otherwise(1).alias("n"),
        F.when((x == a["last"]) & (a["n"] + 1 == min_count), F.concat(a["many"], F.array(x))).otherwise(a["many"]).alias("many"))) ["many"]
    many = F.filter(runs, lambda x: F.size(F.split(x, r"\s+")) <= max_words) if min_count > 1 else F.array_distinct("l")
    kept = t.withColumn("m", many).withColumn("k", F.filter("l", lambda x: ~F.array_contains("m", x)))
    return kept.select("doc_id", F.array_join("k", "\n").alias("text"), (F.size("l") - F.size("k")).alias("n_removed"))


def record_keys(records: DataFrame) -> DataFrame:
    """key, document_id and priority of everything that may name a record: its id, its name, its original file name."""
    names = F.array(*[F.struct(F.lit(i).alias("priority"), F.trim(F.col(c).cast("string")).alias("key")) for i, c in enumerate(("document_id", "document_name", "original_file_name"))])
    return records.select("document_id", F.explode(names).alias("k")).select("k.key", "k.priority", "document_id").where("key <> ''")


def owner_of_key(records: DataFrame) -> DataFrame:
    """key and the document that it names; a key that several records claim names the last of them."""
    return record_keys(records).groupBy("key").agg(F.max("document_id").alias("document_id"))


def rank_documents(chunk_scores: DataFrame, records: DataFrame, top_k: int = 10, min_score: float = 0.0) -> DataFrame:
    """chunk_scores (query_id, key, score): the best score of each document that a key names, the top_k of each query from min_score on."""
    best = chunk_scores.where(F.col("score") >= min_score).join(owner_of_key(records), "key").groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def indexed_stats(records: DataFrame, stats: DataFrame) -> DataFrame:
    """records with the index statistics (key, n_chunks, n_embedded, category) of their id, else name, else original name; else none."""
    found = record_keys(records).join(stats, "key").groupBy("document_id").agg(F.min_by(F.struct("n_chunks", "n_embedded", "category"), "priority").alias("s"))
    out = records.join(found, "document_id", "left")
    return out.select(records["*"], F.coalesce("s.n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("s.n_embedded", F.lit(0)).alias("n_embedded"), F.col("s.category").alias("category"), (F.coalesce("s.n_chunks", F.lit(0)) > 0).alias("indexed"))


def catalog_page(records: DataFrame, stats: DataFrame, jobs: DataFrame, order: list[Column], offset: int, limit: int, indexed: dict) -> DataFrame:
    """A page of records with index statistics and job states; filters on statistics apply behind the page, which may come back short."""
    rows = indexed_stats(records.orderBy(*order).offset(offset).limit(limit), stats).join(jobs.select("document_id", F.col("status").alias("job_status")), "document_id", "left")
    return filters(rows, {k: v for k, v in indexed.items()}, {"category": "category", "indexed": "indexed"})


def accessible_page(records: DataFrame, allowed: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of records, and of it those whose repository the user may see."""
    return records.orderBy(*order).offset(offset).limit(limit).join(broadcast_if(allowed.select("repository_id").distinct(), 100_000), "repository_id", "left_semi")


def rows_of(rows: DataFrame, wanted: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the wanted keys."""
    return rows.join(broadcast_if(wanted.select(key).distinct(), 100_000), key, "left_semi")


def marked_imported(records: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """records with already_imported: whether their key is there."""
    have = imported.select(*keys).distinct().withColumn("_have", F.lit(True))
    return records.join(have, keys, "left").withColumn("already_imported", F.coalesce("_have", F.lit(False))).drop("_have")


def resolved_values(fields: DataFrame, extracted: DataFrame) -> DataFrame:
    """fields (doc_id, field_id, field_name), extracted (doc_id, pos, item_id, name, value): the value by id, else by name whatever its case."""
    by_id = fields.join(extracted.where("item_id is not null"), (fields["doc_id"] == extracted["doc_id"]) & (F.lower(fields["field_id"]) == F.lower(F.trim("item_id")))).groupBy(fields["doc_id"], "field_id").agg(F.min_by("value", "pos").alias("v1"))
    by_name = fields.join(extracted.where("name is not null"), (fields["doc_id"] == extracted["doc_id"]) & (F.lower(F.trim("field_name")) == F.lower(F.trim("name"))) & (F.trim("name") != "")).groupBy(fields["doc_id"], "field_id").agg(F.min_by("value", "pos").alias("v2"))
    out = fields.join(by_id, ["doc_id", "field_id"], "left").join(by_name, ["doc_id", "field_id"], "left")
    return out.select("doc_id", "field_id", F.coalesce("v1", "v2").alias("value"))


def resolve_ids(wanted: DataFrame, id_map: DataFrame, key: str = "pmid") -> DataFrame:
    """wanted ids with what the map knows of them; unknown ones keep nulls."""
    return wanted.join(broadcast_if(id_map.dropDuplicates([key]), 1_000_000), key, "left")


def latest(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """The last row of each key by an order of columns."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def list_reviews(reviews: DataFrame, wanted: dict, limit: int = 50, offset: int = 0) -> DataFrame:
    """Reviews that fit every filter given, the last touched first."""
    columns = {c: c for c in ("repository_id", "status", "document_type_id", "assigned_to", "document_id")}
    return page(filters(reviews, wanted, columns), F.desc("updated_at"), F.col("review_id"), offset=offset, limit=limit)


def members(bindings: DataFrame, repository_id) -> DataFrame:
    """Bindings of a repository that aren't revoked, by role and user."""
    return bindings.where((F.col("repository_id") == repository_id) & F.col("revoked_at").isNull()).orderBy("role", "user_id")


def user_repositories(bindings: DataFrame) -> DataFrame:
    return bindings.where("revoked_at is null and repository_id is not null").select("user_id", "repository_id").distinct()


def sorted_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_id, page, section_path, section_name, line_start) numbered in reading order; what is unknown comes first."""
    w = Window.partitionBy("document_id").orderBy(F.coalesce("page", F.lit(0)), F.coalesce("section_path", "section_name", F.lit("")), F.coalesce("line_start", F.lit(0)), F.coalesce("chunk_id", F.lit("")))
    return chunks.withColumn("position", F.row_number().over(w))


def retrieval_filters(wanted: dict | None, document_id: str | None = None) -> dict:
    """Filters without empty values; an explicit document wins over one among them."""
    out = {k: v for k, v in (wanted or {}).items() if v not in (None, "", [], ())}
    return out | {"document_id": document_id} if document_id else out


def references_for(resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    """resolved (source, target, resolved_id), unresolved (source, target): the distinct union of both, by source."""
    return resolved.select("source", "target", F.col("resolved_id").cast("string").alias("resolved_id")).unionByName(unresolved.select("source", "target", F.lit(None).cast("string").alias("resolved_id"))).distinct()
