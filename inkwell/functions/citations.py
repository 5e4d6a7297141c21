"""Section labels, citation quality and citation lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import col

# Labels that name no section, headings that are recovered from noise, file names in a query.
GENERIC = ("document", "unknown", "", "introduction", "none")
STRUCTURAL = r"(?i)\b(revision\s+history|change\s+history|document\s+history|table\s+of\s+contents|purpose|scope|references|instructions?\s+for\s+[a-z][a-z\s]{2,40})\b"
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+(.+)$"
FILE_NAME = r"(?i)\b([A-Za-z0-9][\w.\-]{0,240}\.(?:pdf|docx?|pptx?|txt|html?|xlsx?|csv))\b"


def number_and_title(text: Column | str) -> Column:
    """number and title of '1.2 Title'; a label without a number is all number."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    numbered = t.rlike(NUMBERED)
    number = F.when(numbered, F.rtrim(F.regexp_extract(t, NUMBERED, 1), F.lit("."))).otherwise(t)
    return F.struct(number.alias("number"), F.when(numbered, F.trim(F.regexp_extract(t, NUMBERED, 2))).otherwise("").alias("title"))


def section_label(text: Column | str) -> Column:
    """'' for labels that name no section; the heading inside a noisy label, in title case; else the label."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    heading = F.regexp_replace(F.trim(F.regexp_extract(t, STRUCTURAL, 1)), r"\s+", " ")
    return F.when(F.lower(t).isin(*GENERIC), "").when(heading != "", F.initcap(heading)).otherwise(t)


def section_parts(path: Column | str) -> Column:
    """section_name, section_path, title and parent of an 'A > B' path.

    A leaf with a dotted number is named by it, one with a bare number and a title of four words or more by the title.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(col(path), F.lit("")), r"\s*>\s*"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    leaf = F.coalesce(F.get(parts, n - 1), F.lit(""))
    parent = F.coalesce(F.get(parts, n - 2), F.lit(""))
    here = number_and_title(leaf)
    dotted, long = here["number"].contains("."), F.size(F.split(here["title"], r"\s+")) >= 4
    titled = (here["number"] != "") & (here["title"] != "")
    name = F.when(titled & ~dotted & long, here["title"]).when(here["number"] != "", here["number"]).otherwise(leaf)
    full = F.when(titled & ~dotted & long, F.array_append(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), here["title"])).otherwise(parts)
    title = F.when(here["title"] != "", here["title"]).when(n > 1, number_and_title(parent)["title"]).otherwise("")
    return F.struct(F.when(n == 0, "").otherwise(name).alias("section_name"), F.array_join(full, " > ").alias("section_path"), F.when(n == 0, "").otherwise(title).alias("title"), parent.alias("parent"))


def citation_quality(text: Column, page: Column, section: Column, parent: Column, title: Column, line: Column, is_table: Column, table_name: Column) -> Column:
    """How complete a citation is, 0 to 1: halved for short texts, a quarter for sections that aren't named."""
    has = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    s = add(F.coalesce(page, F.lit(0)) != 0, 0.25) + add(has(section), 0.2) + add(has(parent), 0.15) + add(has(title) & ~F.lower(title).isin(*GENERIC), 0.15)
    s = s + add(line.isNotNull(), 0.1) + F.when(~has(table_name), 0.0).when(is_table, 0.15).otherwise(0.05)
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    s = s * F.when(words < 30, 0.5).otherwise(1.0) * F.when(F.lower(F.coalesce(F.trim(section), F.lit(""))).isin(*GENERIC), 0.25).otherwise(1.0)
    return F.least(s, F.lit(1.0))


def citation_line(document: Column, section: Column, title: Column, page_start: Column, page_end: Column, line_start: Column, line_end: Column) -> Column:
    """'Document, Section 1.2 Title, Page 3-4, Lines 5-9', of what is known."""
    span = lambda name, a, b: F.when(a.isNotNull(), F.concat(F.lit(name), F.when(F.coalesce(b, a) > a, F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).otherwise(a.cast("string"))))
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" ", F.lit("Section"), section, F.nullif(title, F.lit(""))))
    return F.concat_ws(", ", F.nullif(document, F.lit("")), named, span("Page ", page_start, page_end), span("Lines ", line_start, line_end))


def mentioned_files(text: Column | str) -> Column:
    """File names in a query, whatever their case once, in order."""
    every = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(FILE_NAME), F.lit(1))
    low = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == (i + 1).cast("long"))
