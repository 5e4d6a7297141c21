"""Document references: extraction, exact resolution, invariants and the neighbourhood graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T

#: References without a dictionary of ids: kinds, own and coarser patterns whose group 1 is the target, confidences. Known ids: ``mentions``.
PATTERNS = (
    ("labeled", r"(?i)\b(?:refer to|reference|see|as per|according to)[: ]+(?:document |sop |policy )?([A-Z]{2,}(?:[-_][A-Z0-9]{2,})+)", 0.92),
    ("implicit", r"\b([A-Z]{2,}(?:[-_][A-Z0-9]{2,}){2,})\b", 0.88),
    ("annexure", r"(?i)\b((?:annexure|appendix) [A-Z0-9]{1,4})\b", 0.86),
    ("section", r"(?i)\b(section \d+(?:\.\d+)*)\b", 0.84),
    ("citation", r"(\[\d{1,3}\])", 0.78),
)


def extract(docs: DataFrame, patterns=PATTERNS) -> DataFrame:
    """doc_id, target (normalised), kind, confidence: the most confident mention of each target of a document; none to itself."""
    said = lambda k, c: lambda x: F.struct(F.lit(c).alias("confidence"), F.lit(k).alias("kind"), x.alias("target"))
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), said(k, c)) for k, p, c in patterns]))
    rows = docs.where("text is not null").select("doc_id", F.col("name") if "name" in docs.columns else F.lit(None).cast("string").alias("name"), F.explode(found).alias("m"))
    rows = rows.select("doc_id", "name", T.document_id("m.target").alias("target"), "m.kind", "m.confidence")
    rows = rows.where(F.col("name").isNull() | (F.col("target") != T.document_id("name")))
    return rows.groupBy("doc_id", "target").agg(F.max_by(F.struct("kind", "confidence"), "confidence").alias("m")).select("doc_id", "target", "m.kind", "m.confidence")


def resolve(references: DataFrame, documents: DataFrame) -> DataFrame:
    """references (source, target), documents (document_id, name): the one document whose normalised name is the target."""
    names = documents.select(F.col("document_id").alias("resolved"), T.document_id("name").alias("target"))
    once = names.groupBy("target").agg(F.min("resolved").alias("resolved"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return references.join(once, "target", "left").withColumn("resolved", F.when(F.col("resolved") != F.col("source"), F.col("resolved")))


def violations(resolved: DataFrame, documents: DataFrame) -> DataFrame:
    """Resolved references whose document has another normalised name; must be empty."""
    names = documents.select(F.col("document_id").alias("resolved"), T.document_id("name").alias("have"))
    return resolved.where("resolved is not null").join(names, "resolved").where("have <> target")


def neighbourhood(edges: DataFrame, node: str | int) -> DataFrame:
    """edges (source, target): the edges at a node in either direction."""
    return edges.where((F.col("source") == node) | (F.col("target") == node)).distinct()


def graph(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """mentions (source, target), documents (document_id, name): the edges around every source, as center, source, target and type.

    A document refers to the one a target is resolved to and mentions the reference, which targets that document. Ids are
    texts; a reference's is source::target. One center's network is a filter on ``center``.
    """
    r = resolve(mentions.select("source", "target").distinct(), documents)
    me, ref, other = F.col("source").cast("string"), F.concat_ws("::", F.col("source").cast("string"), "target"), F.col("resolved").cast("string")
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    found = F.array(edge(me, ref, "MENTIONS_REFERENCE"), edge(ref, other, "TARGETS"), edge(me, other, "REFERS_TO"))
    return r.select(me.alias("center"), F.explode(found).alias("e")).select("center", "e.*").where("target is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """center, id and label of the nodes that a center's edges touch."""
    both = edges.select("center", F.explode(F.array("source", "target")).alias("id"))
    return both.distinct().withColumn("label", F.when(F.col("id").contains("::"), "Reference").otherwise("Document"))


def referenced_by(edges: DataFrame) -> DataFrame:
    """document_id and source: which documents refer to each."""
    return edges.where("type = 'REFERS_TO'").select(F.col("target").alias("document_id"), "source").distinct()
