"""Line dedup by distinct-site spread.

A line (trimmed of white space, not empty) that occurs on ``min_sites`` distinct sites or more is cross-site boilerplate
and is taken out of every document. Spread is estimated with one HyperLogLog sketch per line hash, merged by aggregation;
only lines whose estimate lies within the sketch's error of the threshold get an exact distinct count. The margin is four
standard errors of a sketch of 2**12 registers and one site more on either side, so an estimate decides wrongly for fewer
than 1 in 10,000 lines outside it; sketches of up to some hundred sites hold the hashes of the sites themselves and are
exact but for collisions, so thresholds of that size don't see this error.

Null texts stay null and have no lines; a null site counts as one site of its own (''). What goes from a row depends on
its text alone, so null ids, repeated ids with other texts and repeated rows are treated like any other. Very long texts
are one row for each line. Columns of the input that are called n_lines or n_removed are replaced; all others are carried
along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import row_key, small_side, written

MIN_SITES = 10
LG_K = 12
#: Four standard errors of a sketch with 2**12 registers (1.04 / 64 each).
MARGIN = 0.065
BLANK = " \t\r\x0b\x0c"


def _trimmed(line: Column | str) -> Column:
    return F.trim(line, F.lit(BLANK))


def _lines(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns asked for, pos and a 128-bit hash of each line that is not blank."""
    cut = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    names = [c for c in cut.columns if c != "line"]
    cut = cut.select(*names, _trimmed("line").alias("line")).where("length(line) > 0")
    return cut.select(*names, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """Hashes (h1, h2) of the lines that occur on min_sites distinct sites or more."""
    lines = _lines(docs, F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = written(spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin) - 1), "spread", narrow=True)
    sure = F.col("sites") > min_sites * (1 + margin) + 1
    near = spread.where(~sure)
    exact = (
        lines.join(small_side(near.select("h1", "h2")), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(sure).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The documents without their boilerplate lines: their columns, text rewritten, and n_lines (not blank), n_removed.

    The positions of the lines that go are kept for each distinct text that has one. Where that table is small it is
    broadcast and no text moves; otherwise the texts are shuffled once, by their hash.
    """
    common = small_side(written(boilerplate(docs, site, min_sites), "boilerplate", narrow=True))
    drop = _lines(docs, *row_key(F.col("text"))).join(common, ["h1", "h2"], "left_semi")
    drop = written(drop.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("pos")).alias("drop")), "dropped", narrow=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(F.col("text")))
    joined = rows.join(small_side(drop), ["r1", "r2"], "left").select("_row", "drop", F.split("_row.text", "\n").alias("_lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n"))
    kept = [text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    n = F.size(F.filter("_lines", lambda x: F.length(_trimmed(x)) > 0)).cast("long")
    return joined.select(*kept, F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed"))
