"""Score columns: normalisation, fusion, confidence, quality, bands."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x between the bounds; a null becomes the upper one, so tell nulls apart before."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def distance_to_similarity(distance: Column) -> Column:
    """1 - distance between 0 and 1; null stays null."""
    return F.when(distance.isNotNull(), clamp(1 - distance))


def min_max(x: Column, *by: str) -> Column:
    """(x - low) / (high - low) within the groups; null stays null, a constant group is 1."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull(), None).when(high == low, 1.0).otherwise((x - low) / (high - low))


def alpha_hybrid(vector: Column, bm25: Column, alpha: float) -> Column:
    """alpha * vector + (1 - alpha) * bm25; a missing side leaves the other alone."""
    a = max(0.0, min(1.0, alpha))
    return F.when(vector.isNull() & bm25.isNull(), 0.0).when(vector.isNull(), bm25).when(bm25.isNull(), vector).otherwise(a * vector + (1 - a) * bm25)


def result_score(score: Column, distance: Column, position: Column) -> Column:
    """The score, else what the distance gives, else a value that falls with the position."""
    return F.coalesce(score, distance_to_similarity(distance), F.greatest(F.lit(0.01), 1 - 0.025 * position))


#: Weights of the confidence parts, levels from below.
CONFIDENCE = {"rerank": 0.40, "vector": 0.25, "bm25": 0.20, "rrf": 0.10, "agreement": 0.05, "overlap": 0.02}
LEVELS = ((0.85, "very_high"), (0.70, "high"), (0.50, "medium"))


def level(x: Column, bands=LEVELS, otherwise: str = "low") -> Column:
    out = None
    for low, name in bands:
        out = F.when(x >= low, name) if out is None else out.when(x >= low, name)
    return out.otherwise(otherwise)


def confidence_parts(query: str = "query_id", overlap: float = 0.0) -> Column:
    """Base, sibling score and bonus of rows with normalized_vector_score, normalized_bm25_score, vector_score, bm25_score, rrf_score, rerank_score_normalized and rerank_score."""
    c = F.col
    present = lambda x: F.nullif(x, F.lit(0.0))  # noqa: E731  a zero counts as missing here
    rerank = min_max(F.coalesce(present(c("rerank_score_normalized")), c("rerank_score"), c("rerank_score_normalized")), query)
    vector, bm25, rrf = (min_max(c(n), query) for n in ("normalized_vector_score", "normalized_bm25_score", "rrf_score"))
    v = clamp(F.coalesce(vector, clamp(c("vector_score"))))
    b = clamp(F.coalesce(bm25, clamp(c("bm25_score") / F.greatest(c("bm25_score"), F.lit(1.0)))))
    # greatest and least skip nulls, so missing signals are told apart before
    v = F.when(F.coalesce(c("normalized_vector_score"), c("vector_score")).isNotNull(), v)
    b = F.when(F.coalesce(c("normalized_bm25_score"), c("bm25_score")).isNotNull(), b)
    r = F.when(c("rrf_score").isNotNull(), clamp(rrf))
    parts = [(CONFIDENCE["rerank"], rerank), (CONFIDENCE["vector"], v), (CONFIDENCE["bm25"], b), (CONFIDENCE["rrf"], r)]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    base = F.when(weight > 0, sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0)) / weight).otherwise(0.0)
    sibling = F.when(rerank.isNotNull() | vector.isNotNull() | rrf.isNotNull(), F.coalesce(present(rerank), present(vector), present(rrf), F.lit(0.0)))
    bonus = F.when(v.isNotNull() & b.isNotNull(), clamp(F.lit(overlap / 100)) * CONFIDENCE["overlap"]).otherwise(0.0)
    return F.struct(base.alias("base"), sibling.alias("sibling"), bonus.alias("bonus"))


def with_confidence(rows, query: str = "query_id", document: str = "doc_key", overlap: float = 0.0):
    """Rows with confidence (0..1) and level."""
    first = confidence_parts(query, overlap)
    doc, all_ = Window.partitionBy(query, document), Window.partitionBy(query)
    s = rows.withColumn("_s", first).withColumn("_sibling", F.col("_s.sibling"))
    share = F.count(F.lit(1)).over(doc) / F.count(F.lit(1)).over(all_)
    agree = F.coalesce(F.when(F.avg("_sibling").over(doc).isNotNull(), clamp(share * F.avg("_sibling").over(doc))), F.lit(0.0))
    total = clamp(F.col("_s.base") + CONFIDENCE["agreement"] * agree + F.col("_s.bonus"))
    out = s.withColumn("confidence", total).withColumn("level", level(F.col("confidence")))
    return out.drop("_s", "_sibling")


#: Bands of similarity to blocked content.
SIMILARITY_BANDS = ((0.95, "block"), (0.85, "human_review"), (0.75, "warning"))


def similarity_risk(similarity: Column) -> Column:
    return level(similarity, SIMILARITY_BANDS, "allow")


# How urgent a queue message is.
DISPATCH = {"queued": 1000, "first_time": 500, "late": 300, "age_cap": 120, "chunking": 50}
DEFAULT_PROCESSOR = "chunking_vectorizing"


def dispatch_priority(status: Column, requeued: Column, age_s: Column, processor: Column, sla_s: float = 30.0) -> Column:
    """Points for queued, first-time and late messages (ten seconds before the limit), age and the first processor; an unknown age adds none."""
    p = DISPATCH
    age = F.greatest(age_s, F.lit(0.0))
    return (
        F.when(status == "QUEUED", p["queued"]).otherwise(0) + F.when(F.coalesce(requeued, F.lit(False)), 0).otherwise(p["first_time"]) + F.when(age_s.isNotNull() & (age >= max(0.0, sla_s - 10)), p["late"]).otherwise(0)
        + F.when(age_s.isNull(), 0).otherwise(F.least(age.cast("int"), F.lit(p["age_cap"]))) + F.when(F.lower(F.trim(F.coalesce(F.nullif(processor, F.lit("")), F.lit(DEFAULT_PROCESSOR)))) == DEFAULT_PROCESSOR, p["chunking"]).otherwise(0)
    )
