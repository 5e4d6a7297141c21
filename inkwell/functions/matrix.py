"""Tables inside a row: arrays of arrays of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import held, squeeze

# Words that forms have, and words that tables with content have.
FORM_MARKERS = (
    "date", "time", "from", "to", "sl. no", "s. no", "employee", "code", "sign", "signature", "checked by", "verified by", "approved by", "initiated by", "trainer", "comments", "remarks", "yes", "no", "na", "n/a",
)
CONTENT_MARKERS = (
    "purpose", "scope", "responsibility", "responsibilities", "responsible", "procedure", "definitions", "definition", "abbreviations", "abbreviation", "reference", "references", "activity", "description", "details",
    "investigation", "deviation", "out of specification", "out of trend", "oos", "oot", "sample", "material", "product", "batch", "rejection", "root cause", "corrective", "preventive", "acceptance criteria", "assessment",
    "impact assessment", "reportability", "reportable event", "justification", "event", "training", "attachment", "personnel", "issue date", "issuance", "issued to", "issued by", "qms", "outage", "archived", "remarks",
    "lab investigation", "department", "date range", "revision history", "summary of changes", "change control", "change control number", "version number", "effective date", "new annexure", "annexure introduction",
    "deviation observer", "deviation owner", "section qa", "investigation owner", "quality approver", "qualified person", "recurring deviations", "non-conformance", "nonconformance",
)
SIGNATURES = ("sign", "signature", "checked by", "verified by", "approved by", "prepared by")


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def cleaned(table: Column) -> Column:
    """Cells trimmed; rows without any content dropped."""
    rows = F.transform(table, lambda r: F.transform(r, _clean))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def stats(table: Column) -> dict[str, Column]:
    """Rows, widest row, share of empty cells."""
    cells = F.flatten(table)
    empty = F.size(F.filter(cells, lambda c: _clean(c) == ""))
    width = F.coalesce(F.array_max(F.transform(table, lambda r: F.size(r))), F.lit(0))
    return {"n_rows": F.size(table), "n_columns": width, "empty_ratio": F.when(F.size(cells) > 0, empty / F.size(cells)).otherwise(1.0)}


def _row_key(r: Column) -> Column:
    return F.lower(F.array_join(F.transform(r, _clean), "\u001f"))


def without_duplicate_rows(table: Column) -> Column:
    """The header and the first of each set of equal rows, whatever their case."""
    keys = F.transform(table, _row_key)
    return F.filter(table, lambda r, i: (i == 0) | (F.array_position(keys, _row_key(r)) == (i + 1).cast("long")))


def without_repeated_headers(table: Column) -> Column:
    """In tables of more than three rows, later rows that equal the first go."""
    return F.when(F.size(table) > 3, F.filter(table, lambda r, i: ~((i > 0) & (_row_key(r) == _row_key(F.get(table, F.lit(0))))))).otherwise(table)


def quality(table: Column) -> Column:
    """.7 of the filled share and .3 of the share without noise (cells of marks alone), .1 more for a full header; at most 1."""
    cells = F.flatten(table)
    n = F.greatest(F.size(cells), F.lit(1))
    fill = F.size(F.filter(cells, lambda c: _clean(c) != "")) / n
    noise = F.size(F.filter(cells, lambda c: (_clean(c) != "") & ~_clean(c).rlike(r"[\p{L}\p{N}]"))) / n
    header = F.coalesce(F.forall(F.get(table, F.lit(0)), lambda c: _clean(c) != ""), F.lit(False))
    return F.least(F.lit(1.0), 0.7 * fill + 0.3 * (1 - noise) + F.when(header, 0.1).otherwise(0.0))


def decision(score: Column) -> Column:
    return F.when(score >= 0.6, "ACCEPT").when(score >= 0.4, "REVIEW").otherwise("REJECT")


def key_values(table: Column) -> Column:
    """Label and value of two-cell rows."""
    return F.transform(F.filter(table, lambda r: (F.size(r) == 2) & (_clean(F.get(r, F.lit(0))) != "")), lambda r: F.struct(_clean(r[0]).alias("label"), _clean(r[1]).alias("value")))


def kind(table: Column) -> Column:
    """INVALID without content, SINGLE_COLUMN, KEY_VALUE (two filled columns, or labels in .6 of the first six rows), else GRID."""
    filled = F.transform(F.coalesce(table, F.array().cast("array<array<string>>")), lambda r: F.filter(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""))

    def decided(rows: Column) -> Column:
        widest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        first = F.filter(F.slice(rows, 1, 6), lambda r: F.size(r) > 0)
        labels = F.filter(first, lambda r: r[0].contains(":") | ((F.size(r) == 2) & ~r[0].rlike(r"^\d+$")))
        return F.when(widest <= 0, "INVALID").when(widest == 1, "SINGLE_COLUMN").when((widest == 2) | (F.size(labels) / F.greatest(F.size(first), F.lit(1)) >= 0.6), "KEY_VALUE").otherwise("GRID")

    return held(filled, decided)


def as_text(table: Column) -> Column:
    """A table's rows as lines, cells between bars."""
    return F.array_join(F.transform(table, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def _parts(text: Column) -> Column:
    """What the rules look at: the text, its normal form and its filled cells."""
    t = F.coalesce(text, F.lit(""))
    cells = F.filter(F.transform(F.split(t, r"[\r\n|]"), lambda c: F.trim(c)), lambda c: c != "")
    return F.struct(t.alias("text"), F.trim(squeeze(F.lower(t))).alias("norm"), cells.alias("cells"))


def _any(text: Column, *words: str) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def _words(cells: Column, least: int) -> Column:
    """The words of all cells that have ``least`` or more."""
    n = F.filter(F.transform(cells, lambda c: F.size(F.split(c, r"\s+"))), lambda n: n >= least)
    return F.aggregate(n, F.lit(0), lambda a, x: a + x)


def _specification(p: Column, n_columns: Column) -> Column:
    parameters = p["norm"].contains("parameter")
    told = _any(p["norm"], "sl. no", "sl no", "s. no", "sr. no") | _any(p["norm"], "requirement", "specification") | F.exists(p["cells"], lambda c: c.rlike(r"^\d+(\.\d+)+\s+\S"))
    return (p["norm"] != "") & (n_columns >= 2) & parameters & told


def _content(p: Column) -> Column:
    norm, n = p["norm"], F.size(p["cells"])
    count = lambda t, rx: F.regexp_count(t, F.lit(rx))
    hits = sum((F.when(norm.contains(m), 1).otherwise(0) for m in CONTENT_MARKERS), F.lit(0))

    def decided(x: Column) -> Column:
        numbered = (count(p["text"], r"(?<!\d)[1-9]\.0\s+[A-Z][A-Z &/]+") > 0) | (count(p["text"], r"(?<!\d)\d+\.\d+(?:\.\d+)*\.?\s+\S") >= 2)
        changes = (_any(norm, "summary of changes", "revision history") & (n >= 4)) | (norm.contains("change control") & norm.contains("summary"))
        serial = (count(norm, r"\b(?:sl\.?\s*no|s\.?\s*no|sr\.?\s*no)\b") > 0) & (n >= 5)
        marked = ((x["hits"] >= 2) & (n >= 3)) | ((x["hits"] >= 1) & (x["told"] >= 20)) | (x["told"] >= 60)
        return (norm != "") & (numbered | changes | serial | marked)

    return held(F.struct(hits.alias("hits"), _words(p["cells"], 8).alias("told")), decided)


def _form_hits(norm: Column) -> Column:
    hits = F.lit(0)
    for m in FORM_MARKERS:
        hit = norm.rlike(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])")
        if m in ("to", "from"):
            hit = hit & ~norm.rlike(rf"\d+\s+{m}\s+\d+")
        hits = hits + F.when(hit, 1).otherwise(0)
    return hits


def content_table(text: Column) -> Column:
    """Whether a table in text form carries content: numbered sections, lists of changes, serial numbers, markers or long cells."""
    return held(_parts(text), _content)


def specification_table(text: Column, n_columns: Column) -> Column:
    """Whether a table lists parameters by serial numbers, requirements or numbered sections."""
    return held(_parts(text), lambda p: _specification(p, n_columns))


def form_table(text: Column, n_rows: Column, n_columns: Column, empty_ratio: Column) -> Column:
    """Whether a table is a form to be filled in: blank, a grid of short labels, boxes to tick or signatures; without text it is."""

    def decided(p: Column) -> Column:
        n = F.size(p["cells"])
        short = F.size(F.filter(p["cells"], lambda c: F.size(F.split(c, r"\s+")) <= 4)) / F.greatest(n, F.lit(1))
        tales = F.size(F.filter(p["cells"], lambda c: F.size(F.split(c, r"\s+")) >= 12))
        boxes = F.regexp_count(p["norm"], F.lit(r"(?:☐|□|✓|yes\s*/\s*no|\bna\b|\bn/a\b)"))

        def by_counts(x: Column) -> Column:
            blank = (n_rows >= 5) & (n_columns >= 2) & (empty_ratio >= 0.45)
            labelled = (n_rows >= 3) & (n_columns >= 2) & (x["hits"] >= 3) & (short >= 0.6) & (x["told"] < 40)
            marked = (x["hits"] >= 2) & ((boxes >= 2) | _any(p["norm"], *SIGNATURES))
            prose = (tales >= 3) | (x["told"] >= 80) | ((n_rows >= 10) & (n_columns == 2) & (empty_ratio < 0.15))
            return ~prose & (blank | labelled | marked)

        ruled = held(F.struct(_form_hits(p["norm"]).alias("hits"), _words(p["cells"], 12).alias("told")), by_counts)
        return F.when(p["norm"] == "", True).when(_specification(p, n_columns), False).when(n == 0, True).when(_content(p), False).otherwise(ruled)

    return held(_parts(text), decided)
