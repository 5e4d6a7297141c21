"""Secret scans over an incremental ledger of blobs.

Every version of every path is a row (path, content). Contents are addressed by their SHA-256; the ledger remembers which
pairs of blob and rule version have been scanned and what was found. A scan reads only contents whose pair is unseen,
once for each blob however many paths hold it, appends to the ledger, and joins the findings back to all paths.

Null contents are scanned as empty ones. Repeated rows share a blob. Rows keep their path even if it is null or repeated.
Very long contents are scanned whole. Only the path and content columns are read, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import session_dir, ship, small_side, written

ship(__name__)

#: Kinds in order of rank, each with its pattern, the group whose length counts and the least length.
BASE_RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("vcs_token", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 1),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
LEDGER_SCHEMA = "blob binary, rule_version string, findings array<struct<kind:string,start:int,end:int>>"

#: A cheap test that every text with a match of the kind passes.
_NEEDS = {"access": ("AKIA",), "private_key": ("-----BEGIN ",), "jwt": ("eyJ",), "vcs_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "chat_token": ("xox",), "url_login": ("://",)}
_KEYWORDS = re.compile(r"(?ai)passw|secret|token|api_?key")


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def compiled(rules=RULES) -> list[tuple]:
    out = []
    for kind, pattern, group, least in rules:
        # Greedy runs of one class are maximal, so a run that is long enough can be asked for at once.
        out.append((kind, re.compile(r"[0-9a-f]{24,}" if (kind, pattern, least) == BASE_RULES[2][:2] + (24,) else pattern), group, least))
    return out


def scan_text(text: str, rules: list[tuple]) -> list[tuple[int, int, str]]:
    """(start, rank, end) with code-point offsets; leftmost non-overlapping matches of each kind, those too short dropped."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        if kind in _NEEDS and not any(x in text for x in _NEEDS[kind]):
            continue
        if kind == "assign" and not _KEYWORDS.search(text):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end()))
    return sorted(found)


def _scan(rules):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = compiled(rules)
        for f in frames:
            got = [[{"kind": ready[r][0], "start": s, "end": e} for s, r, e in scan_text(t or "", ready)] for t in f["content"]]
            yield pd.DataFrame({"blob": f["blob"], "findings": got}, columns=["blob", "findings"])

    return run


def scan_versions(versions: DataFrame, path: str, content: str, ledger: str, rules=RULES) -> DataFrame:
    """path, blob (hex), scanned and findings (kind, start, end) for every row of versions, after bringing the ledger up to date.

    scanned: whether this call had to scan the row's blob; the others were in the ledger already.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    rows = versions.select(F.col(path).alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    # A row's place among the carriers of its blob: its path as text, a null path before all others.
    rows = rows.withColumns({"blob": F.unhex(F.sha2("content", 256)), "place": F.coalesce(F.concat(F.lit("="), F.col("path").cast("string")), F.lit(""))})
    known = written(rows.select("path", "place", "blob"), "versions")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(ledger)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        seen = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.col("rule_version") == version).select("blob").distinct()
        unseen = known.join(seen, "blob", "left_anti")
    else:
        unseen = known
    # One carrier for each unseen blob: its other paths, and blobs seen before, aren't read.
    carrier = written(unseen.groupBy("blob").agg(F.min("place").alias("place")), "carriers")
    skip = written(known.join(carrier, ["blob", "place"], "left_anti").select("place", "blob").distinct(), "skip")
    todo = rows.join(small_side(skip), ["place", "blob"], "left_anti")
    new = todo.select("blob", "content").mapInPandas(_scan(rules), "blob binary, findings array<struct<kind:string,start:int,end:int>>")
    new.select("blob", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(ledger)
    entries = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    entries = entries.groupBy("blob").agg(F.max("findings").alias("findings"))  # a retried append may have left an entry twice
    out = known.join(entries, "blob", "left").join(carrier.select("blob", F.lit(True).alias("scanned")), "blob", "left")
    return out.select("path", F.lower(F.hex("blob")).alias("blob"), F.coalesce("scanned", F.lit(False)).alias("scanned"), F.coalesce("findings", empty).alias("findings"))


def document_report(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob, scanned for every document; each document is a path.

    Without a ledger of the caller's, one is begun for this call alone.
    """
    ledger = ledger or new_ledger(docs)
    found = scan_versions(docs, "doc_id", "text", ledger, rules)
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"), "blob", "scanned")


def new_ledger(df: DataFrame) -> str:
    return f"{session_dir(df.sparkSession)}/ledger-{uuid.uuid4().hex}"


def without_last_line(text: Column) -> Column:
    """What a text was before its last line was added; a text of one line is as it was."""
    return F.regexp_replace(text, r"\n[^\n]*\z", "")
