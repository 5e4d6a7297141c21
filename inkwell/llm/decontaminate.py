"""Benchmark decontamination as a prefix-filtered set join.

Every item contributes its windows of ``window`` consecutive words (an item with fewer words, but not none, is one
window). A window is a set of word shingles; for exact containment the necessary prefix is one shingle, and the plan
takes the one that is rarest in the corpus. The corpus is probed for these shingles only. A hit at position p of a
shingle with offset o in its window fixes where the window would start (p - o); the start must not be negative, the
window must end inside the text, and the words there must equal the window's words.

Nulls and empty texts have no words: such documents get zeros, such items no windows. Repeated items and windows are
joined once. Every row of the documents gives one result row, also where its id is null, repeats or has several texts:
rows are told apart by hashes of id and text. Very long texts are read whole, as one row for each word. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import is_small, n_words_of, row_key, small_side, words_of, written

WINDOW = 13
SHINGLE = 3


def _shingle(words: str, at: Column, width: int) -> Column:
    """Hash of the words at, at + 1, ...; a hash is enough here because every candidate is verified on the words."""
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(width)])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item (as a string), words, and w1, w2 (128 bits that stand for the words) of every window of every item, once."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = words.select("item", "words", F.explode(starts).alias("start")).select("item", F.slice("words", F.col("start") + 1, window).alias("words")).distinct()
    return cut.select("item", "words", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit("second"), "words").alias("w2"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(F.col("doc_id"), F.col("text")), words_of(F.col("text")).alias("words"))


def _probe(docs: DataFrame, widths: list[int]) -> DataFrame:
    """Each word position of each row with the hashes of the shingles that begin there."""
    exploded = docs.select("r1", "r2", "words", F.posexplode("words").alias("pos", "_word"))
    keys = [_shingle("words", F.col("pos"), w) for w in widths]
    key = keys[0] if len(keys) == 1 else F.explode(F.array_distinct(F.array(*keys)))
    return exploded.select("r1", "r2", "words", "pos", key.alias("key"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The verified windows (r1, r2 of the row, start, size, w1, w2), and the items (item, w1, w2) that have each window.

    The prefixes, one shingle with its window's words each, are broadcast if they are measured to be small. Otherwise
    only positions travel to the join, and the words come back by the row's key. Both ways give the same rows.
    """
    owners = written(item_windows(items, window=window), "windows", narrow=True)
    windows = owners.select("w1", "w2", "words", F.size("words").alias("size")).dropDuplicates(["w1", "w2"])
    widths = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.col("size"))).distinct().collect()) or [shingle]
    width = F.least(F.lit(shingle), F.col("size"))
    offsets = windows.select("w1", "w2", "words", "size", F.explode(F.sequence(F.lit(0), F.col("size") - width)).alias("offset"))
    key = F.coalesce(*[F.when(width == w, _shingle("words", F.col("offset"), w)) for w in widths])
    shingles = written(offsets.select("w1", "w2", "offset", key.alias("key")), "shingles", narrow=True)

    # Rarity: how often each benchmark shingle occurs in the whole corpus.
    docs = _keyed(docs)
    wanted = written(shingles.select("key").distinct(), "wanted", narrow=True)
    seen = _probe(docs, widths).select("key").join(small_side(wanted, broadcast_rows), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    ranked = shingles.join(seen, "key", "inner")  # a shingle that no text has rules its window out
    possible = ranked.groupBy("w1", "w2").agg(F.min(F.struct("seen", "offset", "key")).alias("rare"), F.count(F.lit(1)).alias("n"))
    full = shingles.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("all"))
    prefix = possible.join(full, ["w1", "w2"]).where(F.col("n") == F.col("all")).join(windows, ["w1", "w2"])
    prefix = written(prefix.select(F.col("rare.key").alias("key"), F.col("rare.offset").alias("offset"), F.col("words").alias("wanted"), "size", "w1", "w2"), "prefix", narrow=True)

    if is_small(prefix, broadcast_rows):
        found = _probe(docs, widths).join(F.broadcast(prefix), "key")
    else:
        positions = _probe(docs, widths).select("r1", "r2", "pos", "key")
        found = positions.join(prefix.hint("shuffle_merge"), "key").join(docs.dropDuplicates(["r1", "r2"]), ["r1", "r2"])
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.size("words"))
    same = F.slice("words", F.when(fits, start + 1).otherwise(F.lit(1)), F.col("size")) == F.col("wanted")
    found = found.where(fits & same).select("r1", "r2", start.alias("start"), "size", "w1", "w2")
    return written(found, "hits"), owners.select("item", "w1", "w2")


def _contaminated_rows(docs: DataFrame, items: DataFrame, window: int, shingle: int, broadcast_rows: int) -> DataFrame:
    """r1, r2, n_hit and items of the rows that hold a window."""
    found, owners = hits(docs, items, window, shingle, broadcast_rows)
    # The occurrences of one row stay within its length, so they can be gathered; merged left to right they give the covered words.
    longest = found.groupBy("r1", "r2", "start").agg(F.max("size").alias("size"))
    spans = longest.groupBy("r1", "r2").agg(F.array_sort(F.collect_list(F.struct("start", "size"))).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        to = F.greatest(acc["to"], x["start"] + x["size"])
        return F.struct(to.alias("to"), (acc["n"] + to - F.greatest(acc["to"], x["start"])).cast("int").alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    which = found.select("r1", "r2", "w1", "w2").distinct().join(small_side(owners), ["w1", "w2"]).select("r1", "r2", "item").distinct()
    which = which.groupBy("r1", "r2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return written(spans.select("r1", "r2", covered.cast("long").alias("n_hit")).join(which, ["r1", "r2"]), "contaminated", narrow=True)


def _judged(docs: DataFrame, items: DataFrame, window: int, shingle: int, share: int, broadcast_rows: int) -> DataFrame:
    """Each row as a struct _row, with n_words, n_hit, items and contaminated."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), n_words_of(F.col("text")).alias("n_words"), *row_key(F.col("doc_id"), F.col("text")))
    out = rows.join(small_side(_contaminated_rows(docs, items, window, shingle, broadcast_rows)), ["r1", "r2"], "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20, broadcast_rows: int = 200_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    ``n_hit`` counts words inside any occurrence of any window; ``n_items`` the items with an occurring window.
    """
    out = _judged(docs.select("doc_id", "text"), items, window, shingle, share, broadcast_rows)
    sha = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    return _judged(docs, items, window, shingle, share, 200_000).where(~F.col("contaminated")).select("_row.*")
