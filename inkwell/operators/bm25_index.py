"""A stored inverted index for BM25: segments of postings in impact order, cut into blocks that know their best weight.

Folders below the index path: ``postings`` (segment, bucket of the term's hash, term, n, best, postings), ``docs`` (segment,
doc_id, dl and the scope columns), ``removed`` (segment, doc_id), ``removed_terms`` (term, n), ``segments`` (one row for each
batch of documents or removals, written last: a batch without its row isn't there). Adding reads the new documents only.

A segment's postings are range-partitioned by bucket, term and falling weight, so a frequent term spreads over tasks and the
blocks of a term lie in the order of their weights. ``best`` is the largest tf / (tf + k1 (1 - b + b dl / avgdl)) of a block
with the segment's own average length; as lengths only enter through dl / avgdl, the bound for another average is at most
max(1, avgdl / the segment's) times that.

Searching is exact. Few postings are scored at once. More of them are gathered by document where the queries fit a table of
terms by queries, and documents are scored whole, of which each task keeps its k best. For more queries, a first look at the best block of
every asked term gives each query a score that k documents reach.
Terms whose best weights together stay below it can't make a result (they are the tail of the query); of the other
terms only blocks are read that can reach it with the best weights of all others, and documents whose weight so far and
the tail's best weights stay below it go before the tail is looked up for what is left.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import retrieval as R
from inkwell.operators.retrieval import K1, B, small, top
from inkwell.sources.shared import application_dir, written

#: Postings of a block, and folders that terms are dealt to.
BLOCK, BUCKETS = 128, 32
#: Up to so many asked terms are also given to the scan as a list.
LISTED = 50
#: Up to so many pairs of a query and a posting are scored at once; beyond it the bounds save more than their jobs cost.
DIRECT = 40_000_000
#: Room for rounding in bounds and scores.
SLACK = 1e-5

_BLOCKS = "bucket int, term string, n int, best double, postings array<struct<doc_id: bigint, tf: int, dl: int>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings as blocks: a new one at every term and behind BLOCK postings."""
    for b in batches:
        if not b.num_rows:
            continue
        term = b.column("term")
        code = pc.dictionary_encode(term).indices.to_numpy(zero_copy_only=False)
        new = np.flatnonzero(np.diff(code, prepend=-1))
        at = np.arange(len(code)) - np.repeat(new, np.diff(np.append(new, len(code))))
        starts = np.flatnonzero(at % BLOCK == 0)
        ends = np.append(starts[1:], len(code))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.StructArray.from_arrays([b.column(c) for c in ("doc_id", "tf", "dl")], ["doc_id", "tf", "dl"]))
        best = np.maximum.reduceat(b.column("part").to_numpy(), starts)
        yield pa.RecordBatch.from_arrays(
            [b.column("bucket").take(pa.array(starts)), term.take(pa.array(starts)), pa.array((ends - starts).astype(np.int32)), pa.array(best), lists], names=["bucket", "term", "n", "best", "postings"]
        )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, t: tokens) to their terms and how often they have them; a document's tokens are one row, so nothing is shuffled."""

    def told(rows: list[tuple[int, int, Counter]]) -> pa.RecordBatch:
        n = [len(c) for _, _, c in rows]
        ids, lengths = (pa.array(np.repeat(np.array([r[i] for r in rows], kind), n)) for i, kind in ((0, np.int64), (1, np.int32)))
        return pa.RecordBatch.from_arrays([ids, lengths, pa.array([w for _, _, c in rows for w in c], pa.string()), pa.array([x for _, _, c in rows for x in c.values()], pa.int32())], names=["doc_id", "dl", "term", "tf"])

    for b in batches:
        rows, held = [], 0
        for i in range(b.num_rows):
            words = b.column("t")[i].as_py()
            rows.append((b.column("doc_id")[i].as_py(), len(words), Counter(words)))
            held += len(rows[-1][2])
            if held > 50_000:
                yield told(rows)
                rows, held = [], 0
        if rows:
            yield told(rows)


class Bm25Index:
    """The index below a path; ``scopes`` are columns of the documents that searches may be narrowed by."""

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b

    def _part(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        if not there:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read if name == "docs" else self.spark.read.schema(schema)).parquet(f"{self.path}/{name}")

    def _ledger(self) -> list:
        """One row for each batch; their number is the number of calls, not of documents."""
        return self._part("segments", "segment long, kind string, n long, length long").collect()

    def _live(self, ledger: list | None = None) -> dict[int, float]:
        """Segments with their average lengths."""
        return {r["segment"]: r["length"] / max(r["n"], 1) for r in (self._ledger() if ledger is None else ledger) if r["kind"] == "add"}

    def _commit(self, segment: int, kind: str, n: int, length: int) -> None:
        self.spark.createDataFrame([(segment, kind, n, length)], "segment long, kind string, n long, length long").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", body: str = "text", scopes: tuple[str, ...] = ()) -> int:
        """Append a segment of documents that aren't in the index; rows without an id stay out, null texts are empty."""
        segment = uuid.uuid4().int >> 66
        t = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), *scopes, text.tokens(body).alias("t"))
        out = f"{self.path}/docs/segment={segment}"
        t.select("doc_id", *scopes, F.size("t").alias("dl")).write.parquet(out)
        n, length = self.spark.read.parquet(out).agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).head()
        counted = t.select("doc_id", "t").mapInArrow(_counts, "doc_id long, dl int, term string, tf int")
        part = F.col("tf") / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / max(length / max(n, 1), 1e-9)))
        rows = counted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "term", "doc_id", "tf", "dl", part.alias("part"))
        rows = written(rows, "counted_terms")  # the range partitioning samples its input first
        laid = rows.repartitionByRange("bucket", "term", F.desc("part"), "doc_id").sortWithinPartitions("bucket", "term", F.desc("part"), "doc_id")
        laid.mapInArrow(_cut, _BLOCKS).write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        self._commit(segment, "add", n, length)
        return segment

    def remove(self, ids: DataFrame, doc_id: str = "doc_id") -> None:
        """Documents go from the segments that are there now, with their share of the statistics; later ones may have their ids again."""
        live = list(self._live())
        gone = self._alive(live).join(ids.select(F.col(doc_id).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").select("segment", "doc_id", "dl")
        gone = written(gone, "removed_documents")
        n, length = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).head()
        if not n:
            return
        batch = uuid.uuid4().int >> 66
        postings = self._part("postings", f"segment long, {_BLOCKS}").where(F.col("segment").isin(live)).select("segment", "term", F.explode("postings").alias("p")).select("segment", "term", "p.doc_id")
        terms = postings.join(small(gone.select("segment", "doc_id")), ["segment", "doc_id"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        terms.write.parquet(f"{self.path}/removed_terms/batch={batch}")
        gone.select("segment", "doc_id").write.parquet(f"{self.path}/removed/batch={batch}")
        self._commit(batch, "remove", n, length)

    def _removed(self, name: str, schema: str, ledger: list | None = None) -> DataFrame | None:
        """Rows of finished removals; None before the first."""
        batches = [r["segment"] for r in (self._ledger() if ledger is None else ledger) if r["kind"] == "remove"]
        return None if not batches else self._part(name, schema + ", batch long").where(F.col("batch").isin(batches)).drop("batch")

    def _alive(self, live: list[int]) -> DataFrame:
        docs = self._part("docs", "segment long, doc_id long, dl int").where(F.col("segment").isin(live))
        gone = self._removed("removed", "segment long, doc_id long")
        return docs if gone is None else docs.join(gone, ["segment", "doc_id"], "left_anti")

    def blocks(self, asked: DataFrame, live: list[int] | None = None) -> DataFrame:
        """The blocks of asked terms (term) in live segments: segment, term, n, best, postings."""
        rows = self._part("postings", f"segment long, {_BLOCKS}").where(F.col("segment").isin(list(self._live()) if live is None else live))
        terms = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        buckets = [str(r[0]) for r in terms.select("bucket").distinct().collect()]
        rows = rows.where(f"bucket in ({', '.join(buckets)})") if buckets else rows.limit(0)
        few = [r["term"] for r in terms.limit(LISTED + 1).collect()]
        if len(few) <= LISTED:  # row groups are skipped by their terms
            rows = rows.where(F.col("term").isin(few))
        return rows.join(small(terms.select("term")), "term", "left_semi")

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, min_score: float | None = None, digits: int = 9) -> DataFrame:
        """queries (query_id, terms: distinct tokens): query_id, doc_id, bm25 (rounded) and rank of the k best live documents.

        where: a condition on the scope columns; statistics stay those of all live documents. min_score: on the rounded score.
        """
        asked = written(queries.select("query_id", F.explode("terms").alias("term")).distinct(), "asked_terms")
        ledger = self._ledger()
        live = self._live(ledger)
        n, length = (sum((1 if r["kind"] == "add" else -1) * r[c] for r in ledger) for c in ("n", "length"))
        found = self.blocks(asked, list(live))
        avgdl = max(length / max(n, 1), 1e-9)
        # Document frequencies of live documents, the best weight of each term, and of each block.
        own = reduce(lambda c, s: c.when(F.col("segment") == s[0], F.lit(max(1.0, avgdl / max(s[1], 1e-9)))), live.items(), F.when(F.lit(False), F.lit(1.0))).otherwise(1.0)
        df = found.groupBy("term").agg(F.sum("n").alias("df"), F.max(F.least(F.col("best") * own, F.lit(1.0))).alias("best"))
        lost = self._removed("removed_terms", "term string, n long", ledger)
        if lost is not None:
            df = df.join(lost.groupBy("term").agg(F.sum("n").alias("lost")), "term", "left").withColumn("df", F.col("df") - F.coalesce("lost", F.lit(0)))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms = df.where("df > 0").select("term", "df", idf.alias("idf"), (idf * F.col("best") * (self.k1 + 1)).alias("most"))
        wanted = written(asked.join(terms, "term"), "wanted_terms")
        scope = None if where is None else self._alive(list(live)).where(where).select("segment", "doc_id")
        gone = self._removed("removed", "segment long, doc_id long", ledger)

        def weights(rows: DataFrame) -> DataFrame:
            """rows (query_id, term, idf, segment, postings): the weights of live documents in scope."""
            p = rows.select("query_id", "segment", "idf", F.explode("postings").alias("p")).select("query_id", "segment", "p.doc_id", "idf", "p.tf", "p.dl")
            if scope is not None:
                p = p.join(scope, ["segment", "doc_id"], "left_semi")
            elif gone is not None:
                p = p.join(gone, ["segment", "doc_id"], "left_anti")
            w = F.col("idf") * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("dl") / avgdl))
            return p.select("query_id", "segment", "doc_id", w.alias("w"))

        def scored(rows: DataFrame) -> DataFrame:
            return rows.groupBy("query_id", "segment", "doc_id").agg(F.sum("w").alias("s"))

        pairs = wanted.agg(F.coalesce(F.sum("df"), F.lit(0))).head()[0]
        if pairs <= DIRECT:
            total = scored(weights(found.join(small(wanted.select("query_id", "term", "idf")), "term")))
            return self._ranked(total, k, min_score, digits)
        size = wanted.agg(F.count_distinct("term").alias("t"), F.count_distinct("query_id").alias("q"), F.count_if(F.col("query_id").isNull()).alias("unnamed")).head()
        if size["t"] * size["q"] <= R.CELLS and not size["unnamed"]:
            return self._whole(found, wanted, scope, gone, avgdl, k, min_score, digits)
        # The k-th best of what the best blocks alone give.
        order = Window.partitionBy("segment", "term").orderBy(F.desc("best"), F.desc("n"))
        first = found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
        look = top(scored(weights(first.join(small(wanted.select("query_id", "term", "idf")), "term"))).withColumn("key", F.struct("segment", "doc_id")), "s", "key", k)
        reached = look.where(F.col("rank") == k).select("query_id", (F.col("s") - SLACK).alias("least"))
        before = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy("query_id")
        plan = wanted.join(reached, "query_id", "left").withColumns({"upto": F.sum("most").over(before), "total": F.sum("most").over(every)})
        plan = plan.withColumns({"is_tail": F.coalesce(F.col("upto") < F.col("least"), F.lit(False)), "others": F.col("total") - F.col("most")})
        plan = small(written(plan.withColumn("tail_most", F.coalesce(F.sum(F.when(F.col("is_tail"), F.col("most"))).over(every), F.lit(0.0))), "search_plan"))
        bound = F.col("idf") * F.least(F.col("best") * own, F.lit(1.0)) * (self.k1 + 1) + F.col("others")
        essential = found.join(plan.where("not is_tail"), "term").where(F.col("least").isNull() | (bound >= F.col("least")))
        leads = scored(weights(essential)).join(plan.groupBy("query_id").agg(F.first("least").alias("least"), F.first("tail_most").alias("tail_most")), "query_id")
        leads = written(leads.where(F.col("least").isNull() | (F.col("s") + F.col("tail_most") >= F.col("least"))).select("query_id", "segment", "doc_id", F.col("s").alias("w")), "leads")
        tail = weights(found.join(plan.where("is_tail"), "term")).join(leads.select("query_id", "segment", "doc_id"), ["query_id", "segment", "doc_id"], "left_semi")
        return self._ranked(scored(leads.unionByName(tail)), k, min_score, digits)

    def _whole(self, found: DataFrame, wanted: DataFrame, scope: DataFrame | None, gone: DataFrame | None, avgdl: float, k: int, min_score: float | None, digits: int) -> DataFrame:
        """Postings of asked terms, shuffled by document once, and scored as matrix products; neither weights nor scores of pairs are shuffled."""
        pairs = wanted.select("query_id", "term", "idf").collect()  # bounded by CELLS
        idf = {r["term"]: r["idf"] for r in pairs}
        terms, ids = {t: i for i, t in enumerate(sorted(idf))}, sorted({r["query_id"] for r in pairs})
        at, asks = {q: i for i, q in enumerate(ids)}, np.zeros((len(terms), len(ids)), bool)
        asks[[terms[r["term"]] for r in pairs], [at[r["query_id"]] for r in pairs]] = True
        held = self.spark.sparkContext.broadcast((terms, ids, asks))
        numbers = self.spark.createDataFrame(list(terms.items()), "term string, number int")
        p = found.join(small(numbers), "term").select("segment", "number", F.explode("postings").alias("p")).select("segment", "p.doc_id", "number", "p.tf", "p.dl")
        if scope is not None:
            p = p.join(scope, ["segment", "doc_id"], "left_semi")
        elif gone is not None:
            p = p.join(gone, ["segment", "doc_id"], "left_anti")
        docs = p.groupBy("segment", "doc_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("number", "tf")).alias("x"))
        docs = docs.select("doc_id", "dl", F.col("x.number").alias("terms"), F.col("x.tf").alias("tfs"))
        score = R.whole_scorer(held, np.array([idf[t] for t in terms]), avgdl, k, k1=self.k1, b=self.b, digits=digits)
        best = docs.mapInPandas(score, f"query_id {wanted.schema['query_id'].dataType.simpleString()}, doc_id long, bm25 double")
        return top(best if min_score is None else best.where(F.col("bm25") >= min_score), "bm25", "doc_id", k)

    @staticmethod
    def _ranked(total: DataFrame, k: int, min_score: float | None, digits: int) -> DataFrame:
        rows = total.select("query_id", "doc_id", F.round("s", digits).alias("bm25"))
        return top(rows if min_score is None else rows.where(F.col("bm25") >= min_score), "bm25", "doc_id", k)


def index_of(docs: DataFrame, body: str = "text", scopes: tuple[str, ...] = ()) -> Bm25Index:
    """The application's index over a table of files, built once; the files' names, sizes and times tell whether it is another table."""
    spark = docs.sparkSession
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    states = [p.getFileSystem(conf).getFileStatus(p) for p in map(path_of, docs.inputFiles())]
    key = uuid.uuid5(uuid.NAMESPACE_URL, repr((body, scopes, sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in states)))).hex
    index = Bm25Index(spark, f"{application_dir(spark)}/bm25-{key}")
    if not index._ledger():
        index.add(docs, body=body, scopes=scopes)
    return index
