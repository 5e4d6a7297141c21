"""Policy over detections: keyword dictionaries, decisions, risk scores, and redaction of what leaves.

Everything is decided inside a document's row, so neither texts nor matches are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import detect as D

RANKS = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "warning", "human_review", "block")

# Kinds of detections by how the decision treats them, in lower case.
CRITICAL_KINDS = ("authentication credentials/api keys", "api key", "private key", "password", "-----begin private key-----")
GOVERNMENT_KINDS = (
    "aadhaar", "aadhaar number", "pan", "pan number", "passport", "passport number", "ssn", "social security number (ssn)",
    "bank account", "bank account number", "credit/debit card", "credit/debit card number", "cvv",
)
INFORMATIONAL_KINDS = ("confidentiality label", "sop number", "batch number", "product name", "equipment name")
INFORMATIONAL_ENTITIES = ("person", "org", "gpe", "location/gpe", "date", "product", "facility", "loc", "fac")
ACTIONABLE_KINDS = (
    "email address", "phone number", "employee id", "supplier contact", "internal url", "internal project name",
    "patient_context", "employee_context", "document_prompt_injection",
)
# Document types that raise the decision by themselves.
ESCALATED = {"NDA": "high", "Contract": "medium", "Medical Record": "high", "Regulatory Document": "medium"}
# Scores of severities and actions, and the weights of an upload's risk.
SEVERITY_SCORES = {"low": 15.0, "medium": 45.0, "high": 75.0, "critical": 95.0}
ACTION_SCORES = {"block": 95.0, "human_review": 70.0, "quarantine": 70.0, "flag": 70.0, "warning": 40.0, "warn": 40.0, "mask": 40.0}
WEIGHTS = {"dlp": 0.30, "similarity": 0.25, "prompt_guard": 0.20, "moderation": 0.15, "keyword": 0.10}
# What replaces a text that may not leave, and the words that make an export be masked.
WITHHELD = {"retrieval": "[Content withheld by retrieval DLP.]", "export": "[Content withheld by export DLP policy.]"}
NEEDLES = ("ssn", "aadhaar", "passport", "api key", "password", "bank account", "pan ")


@dataclass(frozen=True)
class Keywords:
    """terms by category, the action of each category ('block' if none is given), and phrases in which a term means no harm."""

    terms: dict[str, tuple[str, ...]]
    actions: dict[str, str] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()

    def matches(self, text: Column | str) -> Column:
        """category and term of each distinct term in the text; of terms that overlap the longest counts."""
        t = F.lower(D._text(text))
        known = {term.lower(): category for category, terms in self.terms.items() for term in terms}
        if not known:
            return F.array().cast("array<struct<category:string,term:string>>")
        quote = "|".join(rf"\Q{w}\E" for w in sorted(known, key=lambda w: (-len(w), w)))
        hit = F.array_distinct(F.regexp_extract_all(t, F.lit(rf"(?U)\b(?:{quote})\b"), F.lit(0)))
        if self.allowed:
            present = F.filter(F.array(*[F.lit(p.lower()) for p in self.allowed]), lambda p: F.contains(t, p))
            hit = F.filter(hit, lambda w: ~F.exists(present, lambda p: F.contains(p, w)))
        by = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.transform(hit, lambda w: F.struct(F.element_at(by, w).alias("category"), w.alias("term")))

    def action(self, matches: Column) -> Column:
        """The strictest action of the categories found."""
        of = F.create_map(*[F.lit(x) for c in self.terms for x in (c, self.actions.get(c, "block"))])
        ranks = F.transform(matches, lambda m: F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.element_at(of, m["category"])))
        return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.coalesce(F.array_max(ranks), F.lit(1).cast("long")).cast("int"))


def _kind(m: Column) -> Column:
    return F.lower(F.trim(m["kind"]))


def _critical(m: Column) -> Column:
    return _kind(m).isin(*CRITICAL_KINDS) | F.contains(_kind(m), F.lit("private key")) | F.contains(F.lower(m["value"]), F.lit("private key"))


def decided(
    docs: DataFrame, found: str = "found", document_type: Column | None = None, topic_action: Column | None = None, similarity: Column | None = None,
    keyword_action: Column | None = None, moderation: Column | None = None, auto_block: bool = False,
) -> DataFrame:
    """docs with status (allow, human_review, block), severity, risk_level, decision and reviewer_actions.

    found: detections (array of kind, severity, value). moderation: struct of risk, action and confidence. Inputs that are
    left out, or null in a row, raise nothing.
    """
    no = F.lit("allow")
    doc_type, topic, keyword = (F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in (document_type, topic_action, keyword_action))
    alike = F.coalesce(similarity, F.lit(0.0)) if similarity is not None else F.lit(0.0)
    m_risk, m_action, m_sure = (F.coalesce(moderation[n], d) if moderation is not None else d for n, d in (("risk", F.lit("low")), ("action", no), ("confidence", F.lit(0.0))))
    x = F.coalesce(F.col(found), F.array().cast("array<struct<kind:string,severity:string,value:string>>"))
    label = F.filter(x, lambda m: _kind(m) == "confidentiality label")
    told = F.filter(x, lambda m: ~_kind(m).isin(*INFORMATIONAL_KINDS) & ~((F.lower(m["severity"]) == "entity") & _kind(m).isin(*INFORMATIONAL_ENTITIES)))
    rest = F.filter(told, lambda m: ~_critical(m))
    is_high = lambda m: _kind(m).isin(*GOVERNMENT_KINDS) | (F.lower(m["severity"]) == "high")
    phi = F.exists(x, lambda m: m["kind"] == "PHI/medical record")
    patient = F.exists(x, lambda m: F.contains(F.lower(m["value"]), F.lit("patient")) | (m["kind"] == "PATIENT_CONTEXT"))
    escalate = F.coalesce(*[F.when(doc_type == t, F.lit(level)) for t, level in ESCALATED.items()], F.lit(""))
    moderated = m_action.isin("block", "warn", "mask") | (m_risk.isin("medium", "high", "critical") & (m_sure >= 0.7))
    moderated_high = moderated & (m_risk.isin("high", "critical") | (m_action == "block"))

    flags = {
        "_critical": F.exists(told, _critical) | (phi & patient),
        "_found_high": F.exists(rest, is_high),
        "_found_medium": F.exists(rest, lambda m: ~is_high(m) & _kind(m).isin(*ACTIONABLE_KINDS)),
        "_other": F.coalesce(F.array_max(F.transform(F.filter(rest, lambda m: ~is_high(m) & ~_kind(m).isin(*ACTIONABLE_KINDS)), lambda m: F.array_position(F.array(*[F.lit(r) for r in RANKS]), F.lower(m["severity"])))), F.lit(0).cast("long")),
        "_privileged": F.exists(x, lambda m: (m["kind"] == "Confidential legal/privileged content") | F.lower(m["value"]).rlike("attorney-client|trade secret")),
        "_marks": (F.size(label) >= 5) & (F.size(label) >= 5 * F.greatest(F.lit(1), F.size(F.array_distinct(F.transform(label, lambda m: F.lower(F.trim(m["value"]))))))),
        "_phi": phi, "_escalate": escalate, "_alike": alike, "_topic": topic, "_keyword": keyword, "_moderated": moderated, "_moderated_high": moderated_high,
    }
    rows = docs.withColumns(flags)
    c = F.col
    real = c("_found_high") | c("_found_medium")
    high = c("_found_high") | c("_phi") | c("_privileged") | (c("_escalate") == "high") | c("_moderated_high")
    medium = c("_found_medium") | (c("_escalate") == "medium") | (c("_moderated") & ~c("_moderated_high")) | (c("_keyword") == "warning")
    keyed = c("_keyword").isin("block", "human_review")
    marks = c("_marks") & ~real & ~c("_critical") & ~high
    quiet = marks & ~keyed & (c("_alike") < 0.75) & ~c("_topic").isin("block", "human_review", "warning")
    review = c("_critical") | high | (medium & (~marks | real)) | keyed | c("_topic").isin("block", "human_review") | (c("_alike") >= 0.75) | c("_moderated")
    status = F.when(c("_critical") & F.lit(auto_block), "block").when(quiet, "allow").when(review, "human_review").otherwise("allow")
    rank = F.greatest(
        F.lit(1), F.when(c("_critical"), 4), F.when(high, 3), F.when(medium, 2), c("_other").cast("int"),
        F.when((status == "human_review") & ((c("_keyword") == "block") | (c("_alike") > 0.95)), 3),
    )
    rank = F.when((status == "human_review") & (rank < 2), 2).otherwise(rank)
    out = rows.withColumn("status", status).withColumn("severity", F.element_at(F.array(*[F.lit(r) for r in RANKS]), rank)).drop(*flags)
    return enriched(out)


def enriched(policy: DataFrame) -> DataFrame:
    """policy (status, severity): with risk_level, decision, and what a reviewer may do; a document under review is never of low risk."""
    sure = F.when((F.col("status") == "human_review") & (F.col("severity") == "low"), "medium").otherwise(F.col("severity"))
    known = F.col("status").isin("allow", "mask_and_allow", "human_review", "block")
    actions = F.when(F.col("status") == "human_review", F.array(F.lit("ALLOW"), F.lit("MASK_AND_ALLOW"), F.lit("BLOCK"))).otherwise(F.array().cast("array<string>"))
    out = policy.withColumn("severity", sure).withColumn("risk_level", F.upper("severity"))
    return out.withColumn("decision", F.when(known, F.upper("status")).otherwise("HUMAN_REVIEW")).withColumn("reviewer_actions", actions)


def _score(action: Column, scores: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(*[F.when(F.lower(action) == k, F.lit(v)) for k, v in scores.items()], F.lit(otherwise))


def ingress_scores(severity: Column, detections: Column, similarity: Column, prompt_action: Column, prompt_hits: Column, moderation_action: Column, moderation_confidence: Column, keyword_action: Column) -> dict[str, Column]:
    """The parts of an upload's risk and their weighted sum, each between 0 and 100 with two decimals."""
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 2)
    of = lambda a: _score(F.coalesce(a, F.lit("allow")), ACTION_SCORES, 10.0)
    parts = {
        "dlp": clamp(_score(severity, SEVERITY_SCORES, 20.0) + F.least(F.lit(20.0), detections * 0.5)),
        "similarity": clamp(F.coalesce(similarity, F.lit(0.0)) * 100.0),
        "prompt_guard": clamp(F.when(F.coalesce(prompt_hits, F.lit(0)) > 0, of(prompt_action)).otherwise(10.0)),
        "moderation": clamp(of(moderation_action) + F.coalesce(moderation_confidence, F.lit(0.0)) * 20.0),
        "keyword": clamp(of(keyword_action)),
    }
    total = clamp(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)))
    return {"upload_security_score": total} | {f"{k}_score": v for k, v in parts.items()}


def retrieval_redacted(text: Column | str, keywords: Keywords) -> Column:
    """text and decision of a search result: withheld if a keyword blocks it, else masked."""
    t = D._text(text)
    hit = keywords.matches(t)
    block, masked = keywords.action(hit) == "block", D.mask_text(t)
    out = F.when(block, WITHHELD["retrieval"]).otherwise(masked)
    return F.struct(out.alias("text"), F.when(t == "", "allow").when(block, "block").when((masked != t) | (F.size(hit) > 0), "mask").otherwise("allow").alias("decision"))


def export_redacted(text: Column | str, keywords: Keywords) -> Column:
    """text and decision of what is exported: withheld, masked if a keyword or a sensitive word is in it, or as it is."""
    t = D._text(text)
    hit = keywords.matches(t)
    block, masked = keywords.action(hit) == "block", D.mask_text(t)
    sensitive = F.lower(t).rlike("|".join(NEEDLES))
    decision = F.when(block, "block").when(F.size(hit) > 0, "mask").when(sensitive & (masked != t), "mask").otherwise("allow")
    out = F.when(block, WITHHELD["export"]).when((F.size(hit) > 0) | sensitive, masked).otherwise(t)
    return F.struct(out.alias("text"), decision.alias("decision"))


def redacted_chunks(chunks: DataFrame, keywords: Keywords, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """chunks with text and decision for export, and the worst decision of each document."""
    rows = chunks.withColumn("_r", export_redacted("text", keywords)).withColumn("text", F.col("_r.text")).withColumn("decision", F.col("_r.decision")).drop("_r")
    order = F.array(F.lit("allow"), F.lit("mask"), F.lit("block"))
    return rows, rows.groupBy(key).agg(F.max_by("decision", F.array_position(order, F.col("decision"))).alias("decision"))


def output_moderation(text: Column | str, keywords: Keywords) -> Column:
    """action (allow, mask, block), severity and flags of a generated text: pattern, guard and keyword layers, the strictest wins."""
    t = D._text(text)
    rule, guard, hit = D.scan(t), D.moderation(t), keywords.matches(t)
    has = lambda s: F.exists(rule, lambda m: m["severity"] == s)
    blocks = (guard["action"] == "block") | (keywords.action(hit) == "block")
    action = F.when(blocks, "block").when(has("high") | has("medium") | (guard["action"] == "warn") | (F.size(hit) > 0), "mask").otherwise("allow")
    severity = F.when(blocks | has("high"), "high").when(has("medium") | (guard["action"] == "warn") | (F.size(hit) > 0), "medium").otherwise("low")
    flags = F.array_distinct(F.concat(F.transform(rule, lambda m: m["kind"]), F.transform(hit, lambda m: m["category"]), F.when(guard["action"] != "allow", F.array(F.concat(F.lit("local_"), guard["action"], F.lit("_pattern")))).otherwise(F.array().cast("array<string>"))))
    return F.struct(action.alias("action"), severity.alias("severity"), flags.alias("flags"))


def review_queue(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on document_id: incoming rows (document_id, severity, reason, detections) replace the queue's, with masked values only."""
    shown = F.transform("detections", lambda m: F.struct(m["kind"].alias("kind"), m["severity"].alias("severity"), D.masked_value(m["kind"], m["value"]).alias("masked")))
    new = incoming.select(F.concat(F.lit("rev_"), F.col("document_id").cast("string")).alias("review_id"), "document_id", "severity", "reason", shown.alias("detections"), F.lit("PENDING").alias("status"))
    last = Window.partitionBy("document_id").orderBy("severity", "reason")
    new = new.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    return current.join(new.select("document_id"), "document_id", "left_anti").select(new.columns).unionByName(new)


def reviewer_overrides(documents: DataFrame, queue: DataFrame) -> DataFrame:
    """document_id and the override of the first queue row that a reviewer has decided; null where none was."""
    # Queue states and what they allow.
    said = F.when(F.col("status") == "APPROVED", "ALLOW").when(F.col("status") == "APPROVED_MASKED", "MASK_AND_ALLOW").when(F.col("status") == "REJECTED", "BLOCK")
    first = queue.groupBy("document_id").agg(F.min_by(said, "review_id").alias("override"))
    return documents.select("document_id").join(first, "document_id", "left")


def census(docs: DataFrame, key: str = "doc_id", found: str = "found") -> DataFrame:
    """docs with status and detections: documents and matches by status, kind and severity; documents without any have null kinds."""
    m = docs.select(key, "status", F.explode_outer(found).alias("m")).select(key, "status", "m.kind", "m.severity", F.col("m.value").isNotNull().cast("int").alias("one"))
    each = m.groupBy("status", "kind", "severity", key).agg(F.sum("one").alias("one"))
    return each.groupBy("status", "kind", "severity").agg(F.count(F.lit(1)).alias("documents"), F.sum("one").alias("matches"))
