"""WARC records and their Merkle fixity audit.

Pages become WARC response records. A record's SHA-256 says which archive file it goes to (copies of a record go to the
files after it) and orders the records of a file, so every record has an offset range. The tree of a file hashes its
records in offset order: a leaf is the SHA-256 of a record's digest and its range, an inner node that of up to ``fanout``
child hashes. Replicas are compared root by root; only children of mismatching nodes are compared on the next level,
down to the records that differ or are missing.

A replica is a copy of the files: it keeps their records and order, but has offset ranges of its own, from the lengths that
its records really have. So a record is damaged if its digest differs, shifted if it is whole but lies elsewhere.

Null urls and bodies are written as empty, a null id too. Repeated rows are records of their own, very long pages are
records like any other. Extra columns are ignored. An empty table has no files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import ship, written

ship(__name__)

FANOUT = 16
FILE_BYTES = 8 << 20
END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 response record as text, without the two line ends that close it; lengths are in bytes of UTF-8."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html,
    )


def placed(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """records (page_id, digest, length, and narrow columns that depend on them): with file, seq, copy and start.

    Equal rows are counted first, so a record with very many copies is one row until its copies are dealt to the files.
    """
    total = records.agg(F.sum("length")).head()[0] or 0
    files = max(1, -(-total // file_bytes))
    copies = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("_n"))
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") + F.col("copy")
    dealt = each.withColumn("file", F.pmod(at, F.lit(files))).drop("_n")
    order = Window.partitionBy("file").orderBy("digest", "page_id", "copy")
    return offsets(dealt.withColumn("seq", (F.row_number().over(order) - 1).cast("long")))


def offsets(records: DataFrame) -> DataFrame:
    """records (file, seq, length): with start, the bytes before them in their file (whose size bounds the window)."""
    before = F.sum("length").over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return records.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def _digested(text: Column) -> tuple[Column, Column]:
    return F.sha2(text, 256), (F.octet_length(text) + len(END)).cast("long")


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES, **more: Column) -> DataFrame:
    """page_id, digest, length, file, seq, start of every page's record, and what ``more`` makes of each page."""
    digest, length = _digested(record(F.col("page_id"), F.col("url"), F.col("html")))
    rows = pages.select("page_id", digest.alias("digest"), length.alias("length"), *[c.alias(k) for k, c in more.items()])
    return written(placed(written(rows, "records"), file_bytes).drop("copy"), "archive")


def tree(leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves (file, seq, start, length, digest): file, depth (of the file's root above its leaves), level, node, hash."""
    said = F.concat_ws(":", "digest", F.col("start").cast("string"), (F.col("start") + F.col("length")).cast("string"))
    n = leaves.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n")).head()[0] or 0
    depth = F.lit(0)
    levels, width = 0, 1
    while width < most:
        depth = F.when(F.col("n") > width, F.lit(levels + 1)).otherwise(depth)
        levels, width = levels + 1, width * fanout
    level = leaves.join(n, "file").select("file", depth.cast("int").alias("depth"), F.lit(0).alias("level"), F.col("seq").alias("node"), F.sha2(said, 256).alias("hash"))
    level = written(level, "leaves")
    nodes = level
    for i in range(1, levels + 1):
        up = level.where(F.col("depth") >= i).groupBy("file", "depth", F.floor(F.col("node") / fanout).alias("up"))
        level = up.agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("kids")).select("file", "depth", F.lit(i).alias("level"), F.col("up").alias("node"), F.sha2(F.array_join("kids.hash", ""), 256).alias("hash"))
        level = written(level, "level", narrow=True)
        nodes = nodes.unionByName(level)
    return nodes


def descent(good: DataFrame, other: DataFrame, fanout: int = FANOUT) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Two trees: for each level from the highest to the leaves, the nodes compared there and those of them that mismatch, both (file, node).

    A level compares the children of the mismatches above it and the roots of the trees that begin there. Files whose trees
    differ in depth, or that one side doesn't have, are compared leaf by leaf.
    """
    side = lambda nodes, h: nodes.select("file", "level", "node", "depth", F.col("hash").alias(h))
    a, b = side(good, "ha"), side(other, "hb")
    levels = max([r[0] or 0 for r in (good.agg(F.max("level")).head(), other.agg(F.max("level")).head())])
    differ = ~F.col("ha").eqNullSafe(F.col("hb"))
    top = lambda nodes: nodes.where("level = depth").drop("level", "node")
    # The hash of a tree's root is held against that of another depth as one that mismatches.
    roots = top(a).join(top(b).withColumnRenamed("depth", "other_depth"), "file", "full").withColumn("whole", ~F.col("depth").eqNullSafe(F.col("other_depth")))
    files = written(roots.where(differ | F.col("whole")).select("file", "whole", "depth"), "roots", narrow=True)
    at = lambda nodes, i: nodes.where(F.col("level") == i).drop("level", "depth")
    found = None
    for i in range(levels, -1, -1):
        opened = files.where(~F.col("whole") & (F.col("depth") == i)).select("file", F.lit(0).cast("long").alias("node"))
        if found is not None:
            below = F.sequence(F.col("node") * fanout, F.col("node") * fanout + (fanout - 1))
            opened = opened.unionByName(found.select("file", F.explode(below).alias("node")))
        compared = opened.join(at(a, i), ["file", "node"], "left").join(at(b, i), ["file", "node"], "left")
        if i == 0:
            whole = files.where("whole").select("file")
            every = at(a, 0).join(whole, "file", "left_semi").join(at(b, 0).join(whole, "file", "left_semi"), ["file", "node"], "full")
            compared = compared.unionByName(every.select(*compared.columns))
        compared = written(compared.where(F.col("ha").isNotNull() | F.col("hb").isNotNull()), "compared", narrow=True)
        found = compared.where(differ).select("file", "node")
        yield compared.select("file", "node"), found


def audit(good: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Two trees: (file, seq) of the leaves that differ or that only one has; only mismatching branches are read (see ``descent``)."""
    for _, found in descent(good, other, fanout):
        leaves = found
    return leaves.select("file", F.col("node").alias("seq"))


def fixity_report(pages: DataFrame, replica_html: Column | None = None, file_bytes: int = FILE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """page_id, file, seq, start, length, digest, root (of the file), damaged and shifted for every record.

    ``replica_html`` says, from a page's columns, what the replica holds as the page's body; None means an intact one.
    """
    digest, length = _digested(record(F.col("page_id"), F.col("url"), F.col("html") if replica_html is None else replica_html))
    rows = archive(pages, file_bytes, replica=digest, replica_length=length)
    copy = offsets(rows.select("file", "seq", F.col("replica").alias("digest"), F.col("replica_length").alias("length")))
    mine = tree(rows.select("file", "seq", "start", "length", "digest"), fanout)
    theirs = tree(copy, fanout)
    bad = located(audit(mine, theirs, fanout), rows, copy)
    roots = mine.where("level = depth").select("file", F.col("hash").alias("root"))
    out = rows.drop("replica", "replica_length").join(roots, "file").join(bad, ["file", "seq"], "left")
    said = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return out.select("page_id", "file", "seq", "start", "length", "digest", "root", said("damaged"), said("shifted"))


def located(mismatches: DataFrame, good: DataFrame, other: DataFrame) -> DataFrame:
    """mismatches (file, seq) of an audit: damaged (another digest, or missing on one side), or else shifted."""
    side = lambda df, n: df.select("file", "seq", F.col("digest").alias(n))
    m = mismatches.join(side(good, "a"), ["file", "seq"], "left").join(side(other, "b"), ["file", "seq"], "left")
    return m.select("file", "seq", (~F.col("a").eqNullSafe(F.col("b"))).alias("damaged"), F.col("a").eqNullSafe(F.col("b")).alias("shifted"))


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the archive as WARC files, one in each folder file=N, by Spark's own writer, so path may be in any store.

    Places are found from digests and lengths alone; texts meet them by digest and move once more, to their file.
    """
    places = archive(pages, file_bytes).select("digest", "file", "seq")
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    texts = pages.select(F.sha2(text, 256).alias("digest"), text.alias("record")).dropDuplicates(["digest"])
    rows = texts.join(places, "digest")
    rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "record").write.partitionBy("file").option("lineSep", END).text(path)


_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def parse_warc(data: bytes) -> Iterator[tuple]:
    """(seq, start, length, digest, page_id, url, html) of the records in a file; a record that can't be read ends it."""
    at, seq = 0, 0
    while m := _HEAD.match(data, at):
        head = dict(line.split(b": ", 1) for line in m[1].split(b"\r\n") if b": " in line)
        try:
            end = m.end() + int(head[b"Content-Length"])
        except (KeyError, ValueError):
            return
        page = head.get(b"WARC-Record-ID", b"")[10:-1].decode()
        yield seq, at, end + len(END) - at, hashlib.sha256(data[at:end]).hexdigest(), int(page) if page.lstrip("-").isdigit() else None, head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), data[m.end() : end].decode("utf-8", "replace")
        at, seq = end + len(END), seq + 1


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for file, content in zip(f["file"], f["content"]):
            rows = [(file, *r) for r in parse_warc(bytes(content))]
            out = pd.DataFrame(rows, columns=["file", "seq", "start", "length", "digest", "page_id", "url", "html"])
            yield out.astype({"page_id": "Int64"})


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder that write_warc made: file, seq, start, length, digest, page_id, url, html."""
    files = spark.read.format("binaryFile").load(path).select(F.col("file").cast("long").alias("file"), "content")
    return files.mapInPandas(_parse, "file long, seq long, start long, length long, digest string, page_id long, url string, html string")
