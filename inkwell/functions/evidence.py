"""What a passage offers as evidence: highlights, grounding, quality with its flags, readability and complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.detect import found
from inkwell.functions.scores import clamp
from inkwell.functions.text import col, held


def highlights(text: Column | str, terms: Column | str) -> Column:
    """Distinct (start, end) of the whole-word matches of each term, whatever their case, by start; terms of one character don't count.

    A literal term has one length, so the pieces between its matches say where they are.
    """
    t = F.coalesce(col(text), F.lit(""))
    words = F.filter(F.transform(col(terms), lambda x: F.trim(x)), lambda x: F.length(x) >= 2)

    def spans(term: Column) -> Column:
        pieces = F.split(t, F.concat(F.lit(r"(?iU)\b\Q"), term, F.lit(r"\E\b")), -1)
        ends = F.aggregate(
            pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda a, p: F.struct((a["at"] + F.length(p) + F.length(term)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p)).alias("start"), (a["at"] + F.length(p) + F.length(term)).alias("end")))).alias("out")),
        )["out"]
        return F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, spans))))


def coverage(evidence: Column, terms: Column) -> Column:
    """The share of the query's terms, of two characters at least, that are among the evidence."""
    need = F.array_distinct(F.transform(F.filter(terms, lambda x: F.length(x) >= 2), F.lower))
    return F.when(F.size(need) == 0, 0.0).otherwise(F.size(F.array_intersect(need, F.transform(evidence, F.lower))) / F.size(need))


# Weights and steps of the scores.
GROUNDING = {"coverage": 0.70, "density": 0.20, "citation": 0.10}
COMPLETENESS = ((40, 0.45), (120, 0.75))
QUALITY = {"text": 0.40, "metadata": 0.30, "evidence": 0.30, "prior": 0.10, "duplicate": 0.40, "ocr": 0.15}


def grounding(text: Column, evidence: Column, terms: Column, cited: Column) -> Column:
    """How far a passage bears on the query's terms, 0 to 1 with four decimals; without terms 0."""
    density = F.least(F.lit(1.0), F.size(highlights(text, terms)) / F.greatest(F.size(terms), F.lit(1)))
    g = GROUNDING["coverage"] * coverage(evidence, terms) + GROUNDING["density"] * density + GROUNDING["citation"] * F.when(cited, 1.0).otherwise(0.0)
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.round(clamp(g), 4))


def quality(text: Column, page: Column, line: Column, section: Column, evidence: Column, terms: Column, score: Column, duplicate: Column, ocr: Column) -> Column:
    """Completeness of text and metadata and support by evidence, less for duplicates and poor recognition."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    whole = F.when(n == 0, 0.0).when(n < COMPLETENESS[0][0], COMPLETENESS[0][1]).when(n < COMPLETENESS[1][0], COMPLETENESS[1][1]).otherwise(1.0)
    bits = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in (page, line, F.nullif(section, F.lit("")))), F.lit(0)) / 3.0
    support = F.when(F.size(terms) == 0, 0.5).otherwise(coverage(evidence, terms))
    q = QUALITY
    total = q["text"] * whole + q["metadata"] * bits + q["evidence"] * support + q["prior"] * clamp(F.coalesce(score, F.lit(0.0)))
    less = F.when(duplicate, q["duplicate"]).otherwise(0.0) + F.when(ocr < 0.5, q["ocr"]).otherwise(0.0)
    return F.round(clamp(total - less), 4)


def flags(text: Column, page: Column, line: Column, section: Column, evidence: Column, terms: Column, score: Column, grounded: Column, duplicate: Column) -> Column:
    """What is wrong with a passage, in a fixed order."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    bare = (F.coalesce(page, F.lit(0)) == 0) & (F.coalesce(line, F.lit(0)) == 0) & (F.coalesce(section, F.lit("")) == "")
    asked = F.size(terms) > 0
    # The flags, in their order.
    said = [
        F.when(n == 0, "missing_text"), F.when((n > 0) & (n < 40), "incomplete_chunk"), F.when(bare, "missing_metadata"), F.when(asked & (F.size(evidence) == 0), "weak_match"),
        F.when(score < 0.25, "low_score"), F.when(asked & (grounded < 0.5), "low_grounding"), F.when(duplicate, "duplicate_result"),
    ]
    return F.filter(F.array(*said), lambda x: x.isNotNull())


def _syllables(word: Column) -> Column:
    """Groups of vowels, one less for a silent e; short words have one, words without letters none."""
    rest = lambda w: held(F.regexp_count(w, F.lit("[aeiouy]+")), lambda n: F.greatest(F.lit(1), n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0)))
    return held(F.lower(F.regexp_replace(word, "[^a-zA-Z]", "")), lambda w: F.when(w == "", 0).when(F.length(w) <= 3, 1).otherwise(rest(w)))


def _readability(text: Column) -> Column:
    """A struct of the columns of ``readability``; each step is held once, the words, the counts, and what is made of them."""
    begun = held(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n\x0b\x0c")), lambda t: F.struct(
        F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*"), F.lit(0)).alias("words"), F.size(F.filter(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x) != "")).alias("parts"),
    ))

    def counts(c: Column) -> Column:
        n, words = F.size(c["words"]), c["words"]
        s, y = F.when(n == 0, 0).otherwise(F.greatest(c["parts"], F.lit(1))), F.aggregate(words, F.lit(0), lambda a, w: a + _syllables(w))
        return F.struct(n.alias("n"), s.alias("s"), y.alias("y"), F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).alias("length"))

    def graded(c: Column) -> Column:
        n, per_s, per_w = c["n"], c["n"] / c["s"], c["y"] / c["n"]
        ease = F.when(n == 0, 100.0).otherwise(clamp(206.835 - 1.015 * per_s - 84.6 * per_w, 0.0, 100.0))
        grade = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 0.39 * per_s + 11.8 * per_w - 15.59))
        average = {"avg_sentence": F.when(n == 0, 0.0).otherwise(per_s), "avg_word": F.when(n == 0, 0.0).otherwise(c["length"] / n)}
        return F.struct(n.alias("n_words"), c["s"].alias("n_sentences"), c["y"].alias("n_syllables"), *[v.alias(k) for k, v in average.items()], ease.alias("ease"), grade.alias("grade"))

    def whole(g: Column) -> Column:
        hard = F.when(g["n_words"] == 0, 0.0).otherwise(clamp(0.65 * (1 - g["ease"] / 100) + 0.35 * clamp(g["grade"] / 18)))
        return F.struct(*[g[k].alias(k) for k in READABILITY[:-1]], hard.alias("complexity"))

    return held(held(held(begun, counts), graded), whole)


READABILITY = ("n_words", "n_sentences", "n_syllables", "avg_sentence", "avg_word", "ease", "grade", "complexity")


def readability(text: Column | str) -> dict[str, Column]:
    """n_words, n_sentences, n_syllables, average lengths, Flesch ease (0..100), Flesch-Kincaid grade (>= 0), and a complexity between 0 and 1."""
    r = _readability(col(text))
    return {k: r[k] for k in READABILITY}


# Technical terms, entities and structure that make a text complex, and their weights.
TECHNICAL = (
    r"\b[A-Z]{2,}(?:[-/][A-Z0-9]{1,})*\b",
    r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b",
    r"(?i)\b[A-Z0-9]{1,3}[-_][A-Z0-9][A-Z0-9\-_]*\b",
    r"\b(?:[A-Z][a-z]?\d*){2,}\b",
    r"(?i)\b(?:SOP|WI|CAPA|OOS|OOT|GMP|GDP|GLP|QA|QC|IQ|OQ|PQ)[-_]?\d{2,}\b",
    r"(?i)\b(?:21\s*CFR|ICH|FDA|EMA|ISO\s*\d+|USP|EP|BP|Annex\s+\d+|Part\s+\d+)\b",
    r"(?i)\b(?:ASTM|IEEE|ANSI|NIST|ASME|API|SAE)\s+[A-Z0-9\-.]+\b",
    r"(?i)\b(?:HPLC|GC(?:-MS)?|LC(?:-MS)?|FTIR|NMR|SEM|TEM|PCR|ELISA|Bioreactor|Autoclave|Centrifuge)\b",
)
ENTITIES = (
    r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})\b",
    r"(?i)\b\d+(?:\.\d+)?(?:%|mg|ml|kg|mm|cm|°C|ppm|ppb)?\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b",
    r"\b[A-Z][A-Za-z0-9\-]{2,}\b",
    r"(?i)\b(?:SOP|WI|CAPA|OOS|OOT|GMP|GDP|GLP|QA|QC|IQ|OQ|PQ)[-_]?\d{2,}\b",
)
BULLETS = r"(?m)^\s*(?:[-*•●▪◦]|\d+[.)])\s+\S"
TABLES = (r"\|.+\|", r"(?m)^[^\n|\t]+\t[^\n|\t]+(?:\t[^\n|\t]+)+$")
EQUATIONS = r"(?:\$[^$]+\$|=\s*[\w\d+\-*/^().\s]{4,})"
CODE = (r"```[\s\S]*?```", r"(?m)^ {4,}\S")
STRUCTURE = {"lists": 0.35, "tables": 0.30, "equations": 0.20, "code": 0.15}
COMPLEXITY = {"readability": 0.30, "technical": 0.30, "entity": 0.20, "structural": 0.20}
COMPLEXITY_LEVELS = (0.30, 0.71)


def complexity(text: Column | str, entities: Column | None = None) -> dict[str, Column]:
    """complexity_score and level, and the densities it is made of. entities: how many are known already (0: they are estimated)."""
    t = F.coalesce(col(text), F.lit(""))
    some = lambda ps: F.size(F.array_distinct(F.flatten(F.array(*[found(t, p) for p in ps]))))
    many = lambda *ps: sum((F.size(found(t, p)) for p in ps), F.lit(0))
    parts = {
        "read": _readability(t), "technical": some(TECHNICAL), "guessed": some(ENTITIES), "known": F.coalesce(entities, F.lit(0)) if entities is not None else F.lit(0),
        "lists": many(BULLETS), "tables": many(*TABLES), "equations": many(EQUATIONS), "code": many(*CODE),
    }

    def densities(c: Column) -> Column:
        r = c["read"]
        words, sentences = F.greatest(r["n_words"], F.lit(1)), F.greatest(r["n_sentences"], F.lit(1))
        of_words = lambda n: F.when(r["n_words"] <= 0, 0.0).otherwise(clamp(n / words))
        entity = of_words(F.when(c["known"] > 0, c["known"]).otherwise(c["guessed"]))
        d = {"hard": r["complexity"], "technical": of_words(c["technical"]), "entity": entity, "lists": clamp(c["lists"] / sentences), "tables": clamp(c["tables"] / sentences), "equations": clamp(c["equations"] / words), "code": clamp(c["code"] / sentences)}
        return F.struct(*[v.cast("double").alias(k) for k, v in d.items()])

    def scored(d: Column) -> Column:
        structural = clamp(sum((d[k] * w for k, w in STRUCTURE.items()), F.lit(0.0)))
        w = COMPLEXITY
        score = clamp(d["hard"] * w["readability"] + d["technical"] * w["technical"] + d["entity"] * w["entity"] + structural * w["structural"])
        return F.struct(score.alias("score"), structural.alias("structural"), d.alias("d"))

    # Each step is held once: the counts, the densities made of them, and the score.
    s = held(held(held(F.struct(*[v.alias(k) for k, v in parts.items()]), densities), scored), lambda x: x)
    level = F.when(s["score"] <= COMPLEXITY_LEVELS[0], "Low").when(s["score"] >= COMPLEXITY_LEVELS[1], "High").otherwise("Medium")
    d = s["d"]
    return {"complexity_score": s["score"], "complexity_level": level, "technical_density": d["technical"], "entity_density": d["entity"], "list_density": d["lists"], "table_density": d["tables"], "structural_density": s["structural"]}
