"""Files as blocks: text, Office Open XML documents and presentations, and article XML, read by Spark and parsed in its tasks.

Block: path, block_no, text, page, component_type, heading_level, style. A file that can't be parsed gives one block whose
style is 'error', so a bad file ends no job. Formats that need other libraries (PDF, images, audio) aren't read.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, block_no int, text string, page int, component_type string, heading_level int, style string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _text_blocks(data: bytes) -> Iterator[tuple]:
    for line in data.decode("utf-8", "replace").splitlines():
        if line.strip():
            yield line.strip(), 1, "paragraph", None, ""


def _word_blocks(data: bytes) -> Iterator[tuple]:
    """Paragraphs with their styles and tables row by row, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and said(e):
            mark = e.find(f"{_W}pPr/{_W}pStyle")
            style = mark.get(f"{_W}val", "") if mark is not None else ""
            level = re.search(r"(?i)heading\s*(\d+)", style)
            level = int(level[1]) if level else 1 if style.lower() == "title" else None
            yield said(e), 1, "paragraph" if level is None else "title" if level == 1 else "subtitle", level, style
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(said(c) for c in r.findall(f"{_W}tc")) for r in e.findall(f"{_W}tr")]
            if any(r.strip(" |") for r in rows):
                yield "\n".join(rows), 1, "table", None, ""


def _slide_blocks(data: bytes) -> Iterator[tuple]:
    """One block for each shape with text; the slide's number is the page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for page, name in names:
            for body in (e for e in ET.fromstring(z.read(name)).iter() if e.tag.endswith("}txBody")):
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.iter(f"{_A}p")).strip()
                if text:
                    yield text, page, "paragraph", None, ""


def _article_blocks(data: bytes) -> Iterator[tuple]:
    """Title, abstract and body of an article: distinct texts of titles and paragraphs, in order."""
    seen: set[str] = set()
    for e in ET.fromstring(data).iter():
        kind = e.tag.rsplit("}", 1)[-1]
        if kind in ("article-title", "title", "p"):
            text = " ".join("".join(e.itertext()).split())
            if text and text not in seen:
                seen.add(text)
                yield text, 1, "paragraph" if kind == "p" else "title", None if kind == "p" else 1, kind


PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"txt": _text_blocks, "md": _text_blocks, "docx": _word_blocks, "pptx": _slide_blocks, "xml": _article_blocks, "nxml": _article_blocks}


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content): the blocks of those whose suffix is known."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows = [(path, i, *b) for i, b in enumerate(PARSERS[path.rsplit(".", 1)[-1].lower()](bytes(content)))]
                except Exception as e:  # whatever a broken file raises, it ends as a row
                    rows = [(path, 0, f"{type(e).__name__}: {e}", None, "paragraph", None, "error")]
                out = pd.DataFrame(rows, columns=["path", "block_no", "text", "page", "component_type", "heading_level", "style"])
                yield out.astype({"page": "Int32", "heading_level": "Int32"})

    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*PARSERS)
    return files.where(known).select("path", "content").mapInPandas(run, SCHEMA)


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all files below a folder; Spark lists and reads them, one file at most in a task's hands."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content"))


def article_text(blocks: DataFrame) -> DataFrame:
    """path and text: an article's blocks joined by blank lines, in order."""
    rows = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    return blocks.groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def collected_chunks(spark: SparkSession, path: str, size: int = 150, overlap: int = 2, min_words: int = 60) -> DataFrame:
    """Chunks of all files below a folder, in the order of paths: path, chunk_no, section_path, text, n_words."""
    from inkwell.operators import chunking

    blocks = load_blocks(spark, path).where("style <> 'error'").withColumn("doc_id", F.xxhash64("path"))
    names = blocks.select("doc_id", "path").distinct()
    found = chunking.sections(blocks)
    return chunking.section_based(found, size, overlap, min_words).join(names, "doc_id").select("path", "chunk_no", "section_path", "text", "n_words").orderBy("path", "chunk_no")


def store_chunks(current: DataFrame | None, chunks: DataFrame, dimension: int) -> DataFrame:
    """The chunk table after a batch: its documents' old chunks are replaced; duplicates and chunks without a vector stay out.

    A vector of another dimension is an error of the whole batch. Keys are hashes of chunk ids. Write the result with
    ``mode('overwrite').partitionBy('repository_id')``.
    """
    fine = chunks.where(~F.coalesce("is_duplicate", F.lit(False)) & F.col("embedding").isNotNull())
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector's dimension isn't {dimension}")).cast("array<double>"))
    new = fine.withColumn("embedding", checked).withColumn("key", F.sha2(F.col("chunk_id").cast("string"), 256)).dropDuplicates(["key"])
    return new if current is None else current.join(chunks.select("document_id").distinct(), "document_id", "left_anti").select(new.columns).unionByName(new)


def document_chunks(table: DataFrame, document_id, repository_id=None) -> DataFrame:
    """One document's chunks; the repository, if given, prunes partitions."""
    rows = table if repository_id is None else table.where(F.col("repository_id") == repository_id)
    return rows.where(F.col("document_id") == document_id)


def unique_documents(table: DataFrame, limit: int = 1000) -> DataFrame:
    """The first names of documents in order, and whether there are more than the limit."""
    names = table.select(F.coalesce("doc_name", "document_name").alias("name")).where("name is not null").distinct().orderBy("name").limit(limit + 1)
    total = names.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return names.limit(limit).join(F.broadcast(total))


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (key, props), edges (parent, child, type, order) after a merge: new rows win over those with their key."""
    up = lambda old, new, keys: old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))
    return up(nodes, new_nodes, ["key"]), up(edges, new_edges, ["parent", "child", "type"])


def tree_of(nodes: DataFrame, edges: DataFrame, root) -> DataFrame:
    """The nodes below a root with their depth and the path of orders that sorts them; a level a round, until none is left."""
    level = edges.where(F.col("parent") == root).select("child", "type", F.array("order").alias("path"), F.lit(1).alias("depth"), F.array(F.col("parent"), F.col("child")).alias("met"))
    found = level
    while not level.isEmpty():
        level = level.alias("l").join(edges.alias("e"), F.col("l.child") == F.col("e.parent")).where(~F.array_contains("l.met", F.col("e.child"))).select(
            F.col("e.child").alias("child"), F.col("e.type").alias("type"), F.array_append("l.path", F.col("e.order")).alias("path"), (F.col("l.depth") + 1).alias("depth"), F.array_append("l.met", F.col("e.child")).alias("met")
        )
        found = found.unionByName(level)
    return found.join(nodes.withColumnRenamed("key", "child"), "child", "left").drop("met")


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"\.([A-Za-z0-9]+)$", 1))
