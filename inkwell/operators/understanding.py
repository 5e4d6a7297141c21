"""What a query asks and what a document is: rewriting, decomposition, intent, filters, compression; document types, entities, fields."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.citations import FILE_NAME
from inkwell.functions.detect import Detector, found
from inkwell.functions.validate import coerced

# Filler words of a question, words of intents in their order, and what names a document, section or category in it.
FILLER = r"(?i)\b(?:please|kindly|could you|can you|tell me|explain|about|regarding)\b"
CLAUSES = r"(?i)\?\s*(?=(?:what|who|where|when|why|how|which|list|describe)\b)|(?<=\?)\s*|\band\b(?=\s*(?:what|who|where|when|why|how|which)\b)|[;]"
STEM = r"(?i)^(what is|what are|who is|who are|list|describe)\s+(.+)$"
INTENTS = (
    ("procedural", ("how to", "procedure", "steps", "process"), 0.7), ("navigational", ("where", "which document", "find", "locate"), 0.65),
    ("comparative", ("compare", "difference", "vs", "versus"), 0.65), ("explanatory", ("why", "reason", "cause"), 0.6),
)
DOCUMENT = r"(?i)\b(?:document|doc|sop|file)\s+(?:named|called|titled)?\s*[\"']?([A-Za-z0-9._\\-]+)[\"']?"
SECTION = r"(?i)\b(?:section|heading)\s+[\"']?([A-Za-z0-9 .\\-_/]+)[\"']?"
CATEGORY = r"(?i)\b(?:category|document\s+type)\s+[\"']?([A-Za-z][A-Za-z0-9 .\\-_/]+)[\"']?"


def rewritten(query: Column | str) -> Column:
    """A question without its filler words; one that has no others stays as it is."""
    q = F.coalesce(T.col(query), F.lit(""))
    out = T.squeeze(F.regexp_replace(q, FILLER, " "))
    return F.when(out == "", q).otherwise(out)


def sub_queries(query: Column | str) -> Column:
    """The questions in a question: its clauses, else 'what is A and B' taken apart, else a list of short items; none if it is one."""
    q = rewritten(query)
    ask = lambda x: F.when(x.endswith("?"), x).otherwise(F.concat(x, F.lit("?")))
    strip = lambda x: F.trim(x, F.lit(" ?."))
    parts = F.filter(F.transform(F.split(q, CLAUSES), strip), lambda x: F.length(x) > 3)
    bare = F.rtrim(q, F.lit(" ?."))
    items = lambda x: F.filter(F.transform(F.split(x, r"(?i),|\band\b"), lambda y: F.trim(y, F.lit(" ."))), lambda y: F.length(y) > 3)
    listed = items(F.regexp_extract(bare, STEM, 2))
    short = F.filter(items(bare), lambda y: (F.length(y) <= 80) & (F.size(F.split(y, r"\s+")) <= 6))
    none = F.array().cast("array<string>")
    return (
        F.when(F.size(parts) > 1, F.transform(parts, ask)).when(bare.rlike(STEM) & (F.size(listed) >= 2), F.transform(listed, lambda y: F.concat(F.regexp_extract(bare, STEM, 1), F.lit(" "), y, F.lit("?"))))
        .when(q.contains(",") & (F.size(short) >= 2), F.transform(short, ask)).otherwise(none)
    )


def intent(query: Column | str, confidence: Column | float = 0.55, threshold: float = 0.0) -> Column:
    """intent and confidence: the first kind one of whose words is in the question, else factual. confidence: that of its topic."""
    q = F.lower(F.coalesce(T.col(query), F.lit("")))
    base = confidence if isinstance(confidence, Column) else F.lit(confidence)
    hit = lambda words: sum((F.when(q.contains(w), 1).otherwise(0) for w in words), F.lit(0)) > 0
    kind = F.coalesce(*[F.when(hit(w), F.lit(n)) for n, w, _ in INTENTS], F.lit("factual"))
    sure = F.coalesce(*[F.when(hit(w), F.greatest(base, F.lit(c))) for _, w, c in INTENTS], base)
    return F.struct(F.when(sure < threshold, "factual").otherwise(kind).alias("intent"), sure.alias("confidence"))


def query_filters(query: Column | str, given: Column | None = None) -> Column:
    """doc_name, section_name and category that a question names, as a map; filters that are given win."""
    q = F.coalesce(T.col(query), F.lit(""))
    first = lambda p: F.nullif(F.trim(F.regexp_extract(q, p, 1)), F.lit(""))
    named = {"doc_name": F.coalesce(first(DOCUMENT), first(FILE_NAME)), "section_name": first(SECTION), "category": first(CATEGORY)}
    made = F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    if given is None:
        return made
    have = F.coalesce(given, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(made, lambda k, v: ~F.map_contains_key(have, k)), have)


def compressed(context: Column | str, sentences: int = 8, tokens: int = 512) -> Column:
    """The first sentences of a context, cut at a word so that about ``tokens`` of four characters are left, 200 characters at least."""
    most = max(200, tokens * 4)
    t = F.trim(F.array_join(F.slice(F.split(F.coalesce(T.col(context), F.lit("")), r"(?<=[.!?])\s+"), 1, max(1, sentences)), " "))
    head = F.left(t, F.lit(most))
    return F.when(F.length(t) <= most, t).when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)


def contexts(rows: DataFrame, sentences: int = 8, tokens: int = 512) -> DataFrame:
    """rows (query_id, rank, text), a top-k of bounded size: the compressed context of each query."""
    joined = rows.where(F.trim("text") != "").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("text").alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
    return joined.select("query_id", compressed("t", sentences, tokens).alias("context"))


def extractive_answers(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows (query_id, rank, text, document, page): an answer made of the best texts with their sources; queries without any say so."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", p."), F.col("page").cast("string"))).otherwise("")
    w = Window.partitionBy("query_id").orderBy("rank")
    best = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    said = F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] ("), F.coalesce("document", F.lit("document")), page, F.lit(") "), F.trim("text"))
    per = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("_n", said.alias("s"))))).alias("s"))
    sources = F.array_join(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " ")
    answer = F.concat(F.lit("Based on the retrieved documents:\n"), F.array_join(F.transform("s", lambda x: x["s"]), " "), F.lit("\n\nSources: "), sources)
    return per.select("query_id", F.when(F.size("s") == 0, "Insufficient evidence in the retrieved documents.").otherwise(answer).alias("answer"), (F.size("s") > 0).alias("sufficient"))


# Document types by words in a text, with the confidence of the first word.
TYPES = (
    ("NDA", ("non-disclosure", "non disclosure", "confidentiality agreement", "nda "), 0.85),
    ("Medical Record", ("patient", "medical record", "phi", "diagnosis", "clinical notes"), 0.82),
    ("Contract", ("hereinafter", "party of the first part", "terms and conditions", "agreement between"), 0.8),
    ("Regulatory Document", ("fda", "ema", "regulatory submission", "21 cfr", "guidance document"), 0.8),
    ("SOP", ("standard operating procedure", "sop ", "purpose:", "scope:", "responsibility:"), 0.78),
    ("Research Paper", ("abstract", "methodology", "references", "et al", "hypothesis"), 0.75),
    ("Publication", ("published in", "journal", "doi:", "copyright"), 0.72),
    ("Invoice", ("invoice", "amount due", "bill to", "payment terms"), 0.8),
    ("Policy", ("policy statement", "shall comply", "company policy"), 0.7),
    ("Manual", ("user manual", "instructions for use", "installation guide"), 0.7),
    ("Report", ("executive summary", "findings", "recommendations"), 0.65),
)


def type_scores(text: Column | str) -> Column:
    """type and score of every type whose words a text has: the base and 0.05 for each further word, up to 0.99."""
    t = F.lower(F.trim(F.coalesce(T.col(text), F.lit(""))))
    hits = lambda words: sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    each = [F.when(hits(w) > 0, F.struct(F.lit(n).alias("type"), F.least(F.lit(0.99), b + 0.05 * (hits(w) - 1)).alias("score"))) for n, w, b in TYPES]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def document_type(text: Column | str) -> Column:
    """type and confidence: the highest score, the first of equals; Other without any, Unknown for a blank text."""
    scores = type_scores(text)
    best = F.aggregate(scores, F.struct(F.lit("Other").alias("type"), F.lit(-1.0).alias("score")), lambda a, x: F.when(x["score"] > a["score"] + 1e-12, x).otherwise(a))
    blank = F.trim(F.coalesce(T.col(text), F.lit(""))) == ""
    return F.struct(F.when(blank, "Unknown").otherwise(best["type"]).alias("type"), F.when(blank, 0.0).when(F.size(scores) == 0, 0.55).otherwise(F.round(best["score"], 4)).alias("confidence"))


def hybrid_type(text: Column, name: Column, patterns: dict[str, dict], weights: tuple[float, float, float] = (0.4, 0.4, 0.2), least: float = 0.70) -> Column:
    """type and confidence from a document's name, its sections and its words.

    patterns: for each type filename_tokens, id_patterns and sections. A type is accepted if its weighted score, or its best
    part, reaches ``least``.
    """
    n, t = F.coalesce(name, F.lit("")), F.coalesce(text, F.lit(""))
    rows = []
    for kind in sorted(set(patterns) | {x[0] for x in TYPES}):
        spec = patterns.get(kind, {})
        tokens, ids, sections = spec.get("filename_tokens", []), spec.get("id_patterns", []), spec.get("sections", [])
        hit = sum((F.when(F.upper(n).contains(k.upper()), 1).otherwise(0) for k in tokens), F.lit(0))
        by_id = F.lit(False)
        for p in ids:
            by_id = by_id | n.rlike(f"(?i){p}")
        by_name = F.greatest(F.when(by_id, 0.85).otherwise(0.0), F.when(hit > 0, F.least(F.lit(1.0), hit / max(1, len(tokens)) + 0.35)).otherwise(0.0), F.when(by_id & (hit > 0), 0.95).otherwise(0.0))
        seen = sum((F.when(t.rlike(rf"(?i)\b\Q{s}\E\b"), 1).otherwise(0) for s in sections), F.lit(0))
        by_section = F.when(seen > 0, F.least(F.lit(0.99), 0.55 + seen / max(1, len(sections)) * 0.44)).otherwise(0.0)
        rows.append(F.struct(F.lit(kind).alias("type"), by_name.cast("double").alias("name"), by_section.cast("double").alias("section")))

    def judged(ml: Column) -> Column:
        top = F.array_max(F.transform(ml, lambda x: x["score"]))
        words = lambda kind: F.coalesce(F.get(F.filter(ml, lambda x: x["type"] == kind), F.lit(0))["score"] / top, F.lit(0.0))
        parts = F.transform(F.array(*rows), lambda r: F.struct(r["type"].alias("type"), r["name"].alias("name"), r["section"].alias("section"), words(r["type"]).alias("words")))
        total = lambda r: F.round(weights[0] * r["name"] + weights[1] * r["section"] + weights[2] * r["words"], 4)
        scored = F.transform(parts, lambda r: F.struct(total(r).alias("total"), r["type"].alias("type"), F.greatest(r["name"], r["section"], r["words"]).alias("part")))
        return F.aggregate(scored, F.struct(F.lit(0.0).alias("total"), F.lit("Unknown").alias("type"), F.lit(0.0).alias("part")), lambda a, x: F.when(x["total"] > a["total"], x).otherwise(a))

    def accepted(b: Column) -> Column:
        peak = F.greatest(b["total"], b["part"])
        return F.struct(F.when(peak >= least, b["type"]).otherwise("Unknown").alias("type"), F.round(peak, 4).alias("confidence"))

    return T.held(T.held(type_scores(text), judged), accepted)


# Rules for entities, and what looks like a person but is none.
ENTITIES = (
    Detector("PERSON", "entity", r"\b(?:Dr\.|Mr\.|Mrs\.|Ms\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"),
    Detector("PERSON", "entity", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
    Detector("ORG", "entity", r"\b[A-Z][A-Za-z0-9_]*\s+(?:Inc\.|Corp\.|Corporation|LLC|Ltd\.|Co\.|Company)\b"),
    Detector("ORG", "entity", r"\b(?:BioPharma\s+Solutions|PharmaCorp|TechCorp|HealthCare\s+Inc)\b"),
    Detector("LOCATION/GPE", "entity", r"\b(?:New\s+York|London|Paris|Tokyo|Berlin|India|USA|United\s+States|Germany|Boston|California)\b"),
    Detector("LOCATION/GPE", "entity", r"\b\d+\s+[A-Z][a-z]+\s+(?:St\.|Street|Rd\.|Road|Ave\.|Avenue|Blvd\.|Boulevard)\b"),
    Detector("DATE", "entity", r"\b\d{4}-\d{2}-\d{2}\b"),
    Detector("DATE", "entity", r"\b\d{2}/\d{2}/\d{4}\b"),
    Detector("DATE", "entity", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,\s+\d{4}\b"),
    Detector("PRODUCT", "entity", r"(?i)\b(?:product|model|brand|drug)\s+[A-Z0-9-]{3,15}\b"),
    Detector("PRODUCT", "entity", r"\b(?:PharmaLine-[A-Z0-9]+)\b"),
    Detector("FACILITY", "entity", r"(?i)\b(?:facility|cleanroom|suite|lab|building|plant|warehouse)\s+[A-Z0-9-]{1,10}\b"),
)
NO_PERSON = ("standard operating", "operating procedure", "confidential draft", "internal use", "reference copy")


def entities(text: Column | str) -> Column:
    """kind and value of the entities in a text, by rules."""
    said = []
    for d in ENTITIES:
        values = found(text, d.pattern, d.group)
        values = F.filter(values, lambda v: ~F.lower(v).isin(*NO_PERSON)) if d.kind == "PERSON" else values
        said.append(_told(d.kind, values))
    return F.flatten(F.array(*said))


def _told(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def prepared_for_entities(text: Column | str, markers: list[str], page_patterns: list[str], min_count: int = 3) -> Column:
    """text without repeated short lines, lines of markers alone and page numbers, and the markers that it has."""
    t = F.trim(F.coalesce(T.col(text), F.lit("")), F.lit(" \t\r\n"))
    lines = F.split(t, "\n")
    bare = F.transform(lines, lambda x: F.trim(x))
    many = lambda x: (F.size(F.filter(bare, lambda y: y == x)) >= min_count) & (F.size(F.split(x, r"\s+")) <= 8)
    any_marker = r"(?i)\b(?:" + "|".join(rf"\Q{m}\E" for m in markers) + r")\b"
    only = lambda x: (F.regexp_replace(F.regexp_replace(x, any_marker, ""), r"[\s\-|/.,]+", "") == "") & (x != "")
    page = lambda x: x.rlike("|".join(f"^(?:{p})" for p in page_patterns)) & (x != "")
    has = [F.when(t.rlike(rf"(?i)\b\Q{m}\E\b"), F.lit(m)) for m in markers]
    found_markers = F.filter(F.array(*has), lambda m: m.isNotNull())
    # Counting by distinct short lines keeps long texts linear.
    repeated = F.filter(F.array_distinct(F.filter(bare, lambda x: (x != "") & (F.length(x) <= 200))), many)
    kept = F.filter(lines, lambda x: ~F.array_contains(repeated, F.trim(x)) & ~((F.size(found_markers) > 0) & only(F.trim(x))) & ~page(F.trim(x)))
    return F.struct(F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\r\n")).alias("text"), found_markers.alias("markers"))


def label_key(label: Column) -> Column:
    """What of a label is compared: small letters and digits, words apart by one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9]+", " "))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def label_match(label: Column, target: Column) -> Column:
    """1 for the same label, .92 if one holds the other, else the share of characters in matching blocks. Vectorised."""
    a, b = label_key(label), label_key(target)
    model = F.pandas_udf(_ratio, "double")
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(b, a) | F.contains(a, b), 0.92).otherwise(model(a, b))


def similar_labels(labels: DataFrame, targets: DataFrame, least: float = 0.78) -> DataFrame:
    """labels (label), targets (target): a, b (their keys) and score of the pairs of distinct keys that match by ``least`` (.78 or more) or more.

    Two keys of together n characters that match by t share m >= t n / 2 characters in blocks; u = n - 2 m others part them, so
    there are u + 1 blocks at most, and m - u - 1 or more shared pairs of letters. For t over .7 and n >= 8 there is one at
    least, and so pairs of letters are the keys of the join; shorter keys meet by letters. Only pairs that pass this count,
    and the bound by letters that both have, get the exact ratio.
    """
    if least < 0.78:
        raise ValueError("the bounds hold from 0.78 on")
    side = lambda df, c, name: df.select(label_key(F.col(c)).alias(name)).where(F.col(name) != "").distinct()
    a, b = side(labels, "label", "a"), side(targets, "target", "b")
    letters = lambda s: F.split(s, "")

    def counted(s: Column, size: int) -> Column:
        """Distinct grams, the second and later of one kind told apart by their number: common ones are counted as often as both have them."""
        grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.substring(s, i, F.lit(size))))
        return F.when(F.length(s) >= size, F.transform(grams, lambda g, i: F.concat(g, F.lit("/"), (i - F.array_position(grams, g) + 1).cast("string"))))

    two = a.select("a", F.explode(counted(F.col("a"), 2)).alias("g")).join(b.select("b", F.explode(counted(F.col("b"), 2)).alias("g")), "g").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    one = lambda df, c: df.select(c, F.explode(F.array_distinct(letters(F.col(c)))).alias("g"))
    short = one(a.where(F.length("a") < 8), "a").join(one(b, "b"), "g").where((F.length("a") + F.length("b") < 8) | (F.length("a") == 1))
    short = short.unionByName(one(a, "a").join(one(b.where(F.length("b") == 1), "b"), "g")).select("a", "b").distinct()
    n = F.length("a") + F.length("b")
    enough = F.col("shared") >= least * n / 2 - (1 - least) * n - 1 - 1e-9
    inside = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    pairs = two.where(enough | inside).select("a", "b").unionByName(short).distinct()
    common = F.size(F.array_intersect(counted(F.col("a"), 1), counted(F.col("b"), 1)))
    pairs = pairs.where(inside | ((2.0 * common / n >= least - 1e-9) & (2.0 * F.least(F.length("a"), F.length("b")) / n >= least - 1e-9)))
    model = F.pandas_udf(_ratio, "double")
    score = F.when(F.col("a") == F.col("b"), 1.0).when(inside, 0.92).otherwise(model("a", "b"))
    return pairs.withColumn("score", score).where(F.col("score") >= least)


def field_name(label: Column | str) -> Column:
    """A label that may name a field, squeezed; null for sentences and labels of more than 64 characters or six words, or under two letters."""
    t = T.squeeze(F.coalesce(T.col(label), F.lit("")))
    good = (t != "") & (F.length(t) <= 64) & ~t.rlike("[.?!;]") & (F.size(F.split(t, " ")) <= 6) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 2) & t.rlike("[A-Za-z0-9]")
    return F.when(good, t)


def extracted_fields(pairs: DataFrame, definitions: DataFrame) -> DataFrame:
    """pairs (doc_id, pos, label, value, source), definitions (field_name, type): doc_id, field_name, value, confidence, method.

    An exact label is a rule (.93); else the best label of .82 or more counts (.78 + .15 of its score, up to .95), and one of
    .78 or more as a fuzzy match (.65 + .2 of it, up to .88). The method before another wins, then confidence, then position.
    Distinct labels meet definitions by ``similar_labels``, so there is no product of both.
    """
    named = definitions.withColumn("b", label_key(F.replace("field_name", F.lit("_"), F.lit(" "))))
    scored = similar_labels(pairs.select("label"), named.select(F.col("b").alias("target")))
    m = pairs.withColumn("a", label_key(F.col("label"))).join(scored, "a").join(named, "b").drop("a", "b")
    m = m.withColumn("value", coerced(F.col("value"), F.col("type"))).where("value is not null and score >= 0.78")
    same = F.lower(F.replace("label", F.lit("_"), F.lit(" "))) == F.lower(F.replace("field_name", F.lit("_"), F.lit(" ")))
    place = F.when(F.col("source") == "inline_pattern", "pattern_pair").when(F.col("source") == "next_line", "adjacent_line").when(F.col("source") == "table_row", "table_cell").otherwise("label_pair")
    # The order of the methods, the confidence, and the method's name.
    rank = F.when(same & (F.col("source") == "inline_pattern"), 1).when(F.col("score") >= 0.82, 2).otherwise(3)
    sure = F.when(rank == 1, 0.93).when(rank == 2, F.least(F.lit(0.95), 0.78 + F.col("score") * 0.15)).otherwise(F.least(F.lit(0.88), 0.65 + F.col("score") * 0.2))
    method = F.when(rank == 1, "rule_pattern").when(rank == 2, place).otherwise("fuzzy_label")
    best = m.groupBy("doc_id", "field_name").agg(F.min(F.struct(rank.alias("rank"), (-sure).alias("minus"), "pos", "value", method.alias("method"))).alias("b"))
    return best.select("doc_id", "field_name", F.left("b.value", F.lit(512)).alias("value"), F.round(-F.col("b.minus"), 3).alias("confidence"), F.col("b.method").alias("method"))


def title_matches(title: Column, terms: list[str]) -> Column:
    """Whether a title has a term as a phrase, or all words of a term of several."""
    t, hit = F.lower(F.coalesce(title, F.lit(""))), F.lit(False)
    for term in (x.strip().lower() for x in terms):
        words = [w for w in term.split() if len(w) > 1]
        every = F.lit(True)
        for w in words:
            every = every & t.contains(w)
        hit = hit | (t.contains(term) | (every if len(words) >= 2 else F.lit(False)) if term else F.lit(False))
    return (t != "") & hit


def title_query(terms: list[str], field: str = "Title") -> str:
    """A fielded search string: words of a term joined by AND, terms in brackets joined by AND; tagged terms stay as they are. For one query, on the driver."""
    parts: list[str] = []
    for term in (x.strip() for x in terms):
        words = [w.strip('"') for w in term.split() if w.strip('"')]
        made = term if "[" in term else " AND ".join(f"{w}[{field}]" for w in words)
        if made and made not in parts:
            parts.append(made)
    return parts[0] if len(parts) == 1 else " AND ".join(f"({p})" for p in parts)


def valid_vector(vector: Column, dimension: int) -> Column:
    """Whether a vector has the dimension and only finite components."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def embedded(chunks: DataFrame, encode: Callable[[pd.Series], pd.Series] | None = None, dimension: int = 64, text: str = "text") -> DataFrame:
    """chunks with embedding, of length one. encode: a vectorised model (texts to lists of floats); without one, hashed word counts."""
    if encode is not None:
        return chunks.withColumn("embedding", F.pandas_udf(encode, "array<double>")(F.col(text)))
    at = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(at, lambda x: x == i)).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return chunks.withColumn("embedding", T.held(F.struct(raw.alias("v"), norm.alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])))
