"""References to known documents in texts: what may be an id is cut out of the texts and joined with the known ids.

Ids are compared in their normal form (capitals, no spaces, _ as -, no runs of -, no file suffix). A hit counts if it is a
whole id: no letter, digit or joining sign lets the id go on. In order of units (lines; long lines by sentences), the first
rule that fits decides: a label before the id (0.92), a phrase that leads to it (0.88), a trigger phrase anywhere in the unit
(0.85), a colon before it at the unit's end (0.9). A document doesn't refer to itself.

As an id is whole, its place is told by the text alone: a run of letters, digits and joining signs, from its start or from
behind a label, to its end or to a file suffix. So texts are read once, whatever the dictionary's size; the candidates, a few
a text, meet the ids in one join, and the rules are then applied to the units with candidates. Ids with other signs are cut
by the lengths that such ids have. Null and empty texts have no references; ids that repeat count once; null ids and ids
without a letter or digit name nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.sources.shared import written

#: Bytes of ids up to which the dictionary is broadcast to the candidates; a larger one is joined by shuffling.
DICTIONARY_BYTES = 32 << 20
#: References that a task holds before it hands them on.
HELD = 2000

# Labels with the types that they give, phrases that lead to an id, phrases that make a unit one of references.
LABELS = {
    "Document No": "document", "Document Number": "document", "Document ID": "document", "Document Reference": "document", "Related Document": "document", "SOP No": "sop", "WI No": "work_instruction",
    "Form No": "form", "Ref": "document", "Protocol No": "protocol", "Protocol": "protocol", "Report No": "report", "Report": "report",
}
LEADS = r"\b(?:refer(?:\s+to)?|see(?:\s+also)?|as\s+per|according\s+to|based\s+on)\s+"
TRIGGERS = (
    "reference", "references", "refer", "refer to", "referred to", "ref.", "see", "see also", "according to", "as per", "in accordance with", "follows", "follow", "following", "comply with",
    "complies with", "defined in", "described in", "specified in", "documented in", "mentioned in", "listed in", "outlined in", "governed by", "based on", "derived from", "related document",
    "related documents", "associated document", "supporting document", "parent document", "child document", "linked document", "annexure", "appendix", "attachment", "work instruction",
    "instructions", "gop for", "sop for", "list of annexures", "procedure", "policy", "guideline", "manual", "standard", "sop", "gop", "wi", "form", "doc", "ann",
)
OUTLINE = r"^\d+(?:\.\d+)+\.?\s+"

_FOUND = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("target", "type", "rule")), ("confidence", pa.float64()), ("sentence", pa.string()), ("evidence", pa.int32())])
_SCHEMA = "doc_id long, target string, type string, rule string, confidence double, sentence string, evidence int"
_UNITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("own", pa.string()), ("key", pa.string()), ("units", pa.list_(pa.string())), ("ids", pa.list_(pa.string()))])
_CAPITALS = str.maketrans("abcdefghijklmnopqrstuvwxyz_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ-")
_JOINING, _SIGNS = "/.-", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789/.-")
#: Signs of a run that a label, with what may follow it, can end with.
_ENDS = frozenset(x[-1].upper() for x in LABELS) | set("S.-")


class Finder:
    """Candidates for ids in texts, and references of units to those that are known.

    ``lead`` and ``trail``: the most joining signs that an id begins and ends with; ``lengths``: those of ids with signs
    other than letters, digits and joining signs.
    """

    def __init__(self, lead: int = 0, trail: int = 0, lengths: Iterable[int] = (), triggers: tuple[str, ...] = TRIGGERS):
        self.most_lead, self.most_trail, self.lengths = lead, trail, sorted(lengths)
        label = "|".join(re.sub(r"(?:\\ | )", r"\\s+", re.escape(x)) for x in LABELS)
        self.label = re.compile(rf"(?i)\b({label})\.?\s*(?:[:#-]|\bis\b)?\s*$")
        self.labelled = re.compile(rf"(?i)(?=\b(?:{label}))")
        self.types = {k.upper(): v for k, v in LABELS.items()}
        self.leads = re.compile(f"(?i){LEADS}$")
        self.short = re.compile(r"(?i)(?:^|[^\w-])(?:" + "|".join(re.escape(t) for t in triggers if len(t) <= 4) + r")(?:[^\w-]|$)")
        self.long = tuple(t.lower() for t in triggers if len(t) > 4)
        self.behind = re.compile(r"(?:\.(?:PDF|DOCX?|TXT))?(?![A-Z0-9])(?![/.\-]+[A-Z0-9])")
        self.end_of_id, self.colon = re.compile(r":\s*[A-Za-z0-9][A-Za-z0-9/_\-.]{1,63}[A-Za-z0-9]\.?\s*$"), re.compile(r":\s*$")
        self.run, self.suffix = re.compile(r"(?<![A-Z0-9/.\-])[A-Z/.\-]*+[0-9][A-Z0-9/.\-]*+"), re.compile(r"\.(?:PDF|DOCX?|TXT)$")
        self.stretch, self.digit, self.letter = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile("[0-9]"), re.compile("[A-Z]")
        self.outline, self.sentence = re.compile(OUTLINE), re.compile(r"(?<=[.!?])\s+(?!\d)")

    @staticmethod
    def normal(unit: str) -> str:
        """ASCII capitals, _ as -, runs of - as one."""
        return re.sub("-+", "-", unit.translate(_CAPITALS))

    def units(self, text: str) -> Iterator[str]:
        """The units that have a digit, as every id does."""
        if not self.digit.search(text):
            return
        for line in text.splitlines():
            if not self.digit.search(line):
                continue
            line = line.strip()
            if len(line) >= 200 and not self.end_of_id.search(line) and not self.outline.match(line):
                yield from (p.strip() for p in self.sentence.split(line) if p.strip() and self.digit.search(p))
            elif line:
                yield line

    def said(self, unit: str, start: int) -> re.Match | None:
        """The label right before a place."""
        return self.label.search(unit, max(0, start - 64), start)

    def begins(self, unit: str, start: int) -> bool:
        """Whether nothing but joining signs stands before a place in its run."""
        while start and unit[start - 1] in _JOINING:
            start -= 1
        return not start or unit[start - 1] not in _SIGNS

    def candidates(self, unit: str) -> Iterator[tuple[int, int]]:
        """(start, end) of all that may be a whole id in a normalized unit."""
        labels = [m.start() for m in self.labelled.finditer(unit)]
        told = lambda low, high: {s for at in labels for s in range(max(low, at + 2), min(high, at + 65)) if unit[s - 1] in _ENDS and self.said(unit, s)}
        for m in self.run.finditer(unit):
            run = m[0]
            first, last = m.start() + len(run) - len(run.lstrip(_JOINING)), m.start() + len(run.rstrip(_JOINING))
            starts = {*range(max(m.start(), first - self.most_lead), first + 1), *told(first + 1, last)}
            ends = {*range(last, min(m.end(), last + self.most_trail) + 1)}
            if suffix := self.suffix.search(unit, max(m.start(), last - 5), last):
                ends.add(suffix.start())
            yield from ((s, e) for s in starts for e in ends if s < e)
        if self.lengths:
            for m in self.stretch.finditer(unit):
                if self.digit.search(m[0]):
                    behind_labels = told(m.start() + 1, m.end())
                    for e in (e for e in range(m.start() + 1, m.end() + 1) if self.behind.match(unit, e)):
                        starts = (e - n for n in self.lengths if e - n >= m.start())
                        yield from ((s, e) for s in starts if not _SIGNS.issuperset(unit[s:e]) and (s in behind_labels or self.begins(unit, s)))

    def ids_of(self, unit: str) -> set[str]:
        """The texts of the candidates of a normalized unit that have a letter and a digit."""
        return {t for t in {unit[s:e] for s, e in self.candidates(unit)} if self.letter.search(t) and self.digit.search(t)}

    def hits(self, unit: str, known: set[str]) -> list[tuple[int, int, str]]:
        """(start, end, label type or none) of whole known ids in a normalized unit, the longest at each end."""
        out: dict[int, int] = {}
        for start, end in self.candidates(unit):
            if unit[start:end] in known and (end not in out or out[end] > start):
                out[end] = start
        hits = ((start, end, self.said(unit, start)) for end, start in out.items())
        return sorted((start, end, said[1] if said else "") for start, end, said in hits)

    def triggered(self, unit: str) -> bool:
        low = unit.lower()
        return any(t in low for t in self.long) or bool(self.short.search(unit))

    def references(self, units: Iterable[str], own: set[str], known: set[str]) -> list[tuple]:
        """target, type, rule, confidence, first sentence, number of sentences; of a text's units, in order."""
        found: dict[str, list] = {}
        for raw in units:
            unit, here = self.normal(raw), {}
            hits = self.hits(unit, known)
            if not hits:
                continue
            rules = [[], [], []]
            trigger = self.triggered(raw)
            for start, end, label in hits:
                target = unit[start:end]
                if label:
                    rules[0].append((target, self.types[" ".join(label.upper().split())], "label", 0.92))
                elif self.leads.search(unit, max(0, start - 64), start):
                    rules[0].append((target, "document", "lead", 0.88))
                elif trigger:
                    rules[1].append((target, "document", "trigger", 0.85))
                elif re.fullmatch(r"\.?\s*", unit[end:]) and self.colon.search(unit, 0, start):
                    rules[2].append((target, "document", "colon", 0.9))
            for target, *how in rules[0] + rules[1] + rules[2]:
                if target not in own:
                    here.setdefault(target, how)
            for target, how in here.items():
                if target in found:
                    found[target][1].add(raw)
                else:
                    found[target] = [how + [raw], {raw}]
        return [(t, *how, len(said)) for t, (how, said) in found.items()]


def normal_id(name: Column | str) -> Column:
    """The normal form of an id, as mentions are compared; names that have no letter or no digit are null."""
    t = T.document_id(name)
    return F.when(t.rlike("[A-Z]") & t.rlike("[0-9]"), t)


def mentions(docs: DataFrame, known: DataFrame, name: str | None = None, size: int = DICTIONARY_BYTES) -> DataFrame:
    """docs (doc_id, text and maybe a name), known (name): doc_id, target, type, rule, confidence, sentence, evidence (units with it).

    ``size``: bytes of ids up to which they are broadcast; both ways give the same rows.
    """
    ids = written(known.select(normal_id("name").alias("id")).where("id is not null"), "known_ids")
    signs = lambda pattern: F.coalesce(F.max(F.length(F.regexp_extract("id", pattern, 0))), F.lit(0))
    shape = ids.agg(
        signs("^[/.-]*").alias("lead"), signs("[/.-]*$").alias("trail"), F.collect_set(F.when(F.col("id").rlike("[^A-Z0-9/.-]"), F.length("id"))).alias("lengths"), F.coalesce(F.sum(F.octet_length("id") + 16), F.lit(0)).alias("bytes")
    ).head()
    told = (shape["lead"], shape["trail"], tuple(shape["lengths"]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*told)
        for b in batches:
            rows, held = [], 0
            for i, text in enumerate(b.column("text")):
                units, found = [], set()
                for raw in finder.units(text.as_py()):
                    if here := finder.ids_of(finder.normal(raw)):
                        units.append(raw)
                        found |= here
                if found:
                    rows.append({c: b.column(c)[i].as_py() for c in ("row", "doc_id", "own", "key")} | {"units": units, "ids": list(found)})
                    held += len(found)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, _UNITS)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _UNITS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*told)
        for b in batches:
            got = []
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("doc_id", "own", "key", "units", "known")}
                got += [dict(zip(_FOUND.names, (r["doc_id"], *x))) for x in finder.references(r["units"], {r["own"], r["key"]}, set(r["known"]))]
                if len(got) > HELD:
                    yield pa.RecordBatch.from_pylist(got, _FOUND)
                    got = []
            yield pa.RecordBatch.from_pylist(got, _FOUND)

    rows = docs.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", (F.col(name) if name else F.lit(None)).cast("string").alias("name"))
    rows = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text", normal_id("name").alias("own"), T.document_id(F.col("doc_id").cast("string")).alias("key"))
    units = written(rows.mapInArrow(cut, "row long, doc_id long, own string, key string, units array<string>, ids array<string>"), "units")
    side = F.broadcast(ids) if shape["bytes"] <= size else ids.hint("shuffle_merge")
    met = units.select("row", F.explode("ids").alias("id")).join(side, "id", "left_semi")
    met = met.groupBy("row").agg(F.collect_list("id").alias("known"))  # a text's own candidates
    return units.drop("ids").join(met, "row").select("doc_id", "own", "key", "units", "known").mapInArrow(judge, _SCHEMA)


def document_references(found: DataFrame, known: DataFrame) -> DataFrame:
    """How often each known document is referred to: name, documents, mentions, and the best confidence."""
    names = known.select("name", normal_id("name").alias("target")).where("target is not null").distinct()
    counts = found.groupBy("target").agg(F.count(F.lit(1)).alias("documents"), F.sum("evidence").alias("mentions"), F.max("confidence").alias("confidence"))
    return names.join(counts, "target").select("name", "documents", "mentions", "confidence")
