"""Near-duplicate classes with ProbMinHash.

Texts become weighted sets of five-word shingles (weight 1 + ln count). Every shingle is a Poisson process whose rate is
its weight; arrivals fall on random registers, each register keeps its earliest arrival, and a shingle stops as soon as
its next arrival comes later than every register. The share of equal registers estimates the probability Jaccard.
Texts that repeat shingles get a second sketch with equal weights, whose share of equal registers estimates the plain
Jaccard. Bands of registers give candidates, which are verified on the texts: a link needs a Jaccard or a probability Jaccard of
``threshold`` or more. Classes are the connected components.

Texts with the same words are one class beforehand and are represented by the smallest id. In a bucket each member is
first held against the smallest and the largest id there. Links already implied by a class are not verified again.
Where the other members of a bucket are then still in several classes, all their pairs across classes are compared
exactly, in tiles of bounded size; so every pair of a bucket is in one class or refuted. There, shingles of the same texts count
as one column, and a bound tells which pairs need the exact probability Jaccard.

Null texts are classes of their own. Texts without words, such as empty ones, are a class where they are equal. Rows
that repeat an id give one result row; where their texts differ, they are in one class all the same, since the id is. Rows
without an id are left out. Very long texts are sketched whole, one at a time. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import small_side, ship, written
from inkwell.llm.components import components
from inkwell.llm.shingles import alike, counted, digest, mix, shingles, similarity, weighted, word_hashes

ship(__name__)

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 128
ROWS = 4
#: Characters handled at once; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: Draws that a sketch makes at once where few elements are left.
DRAWS = 30_000
#: Characters of a tile of bucket members; two tiles are compared at once.
TILE_CHARS = 4_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xA0761D6478BD642F)


def sketch(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n owners x m, 32 bits of the winning element; 0 where an owner has no element)."""
    first = np.full(n * m, np.inf)
    won = np.zeros(n * m, np.uint32)
    top = np.full(n, np.inf)
    time = np.zeros(len(element))
    k = 0
    while len(element):
        # Where few elements are left they draw several times at once: a draw after an element's end comes too late to win.
        steps = min(max(DRAWS // len(element), 1), 64)
        draw = mix(element[:, None] + np.arange(k + 1, k + steps + 1, dtype=np.uint64) * _STEP)
        k += steps
        times = time[:, None] + np.cumsum(-np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / weight[:, None], axis=1)
        at = owner[:, None] * m + (mix(draw ^ _OTHER) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at.ravel(), times.ravel())
        best = first[at] == times
        won[at[best]] = (mix(element[np.nonzero(best)[0]] ^ _STEP) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        time, live = times[:, -1], np.flatnonzero(np.bincount(owner, minlength=n))
        top[live] = first.reshape(n, m)[live].max(1)
        go = time <= top[owner]  # termination: nothing later can win
        element, weight, time, owner = element[go], weight[go], time[go], owner[go]
    return won.reshape(n, m)


def _sketches(m: int, rows: int, shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def banded(regs: np.ndarray) -> np.ndarray:
            bands = regs.reshape(len(regs), m // rows, rows).astype(np.uint64)
            h = np.arange(m // rows, dtype=np.uint64)[None, :] + np.zeros((len(regs), 1), np.uint64)
            for i in range(rows):
                h = mix(h * _STEP + bands[:, :, i])
            return h.view(np.int64)

        def chunk(ids: list[int], texts: list[str]) -> pd.DataFrame:
            h, bounds = word_hashes(texts)
            digests = []
            for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist()):
                if a < b:
                    digests.append(digest(h[a:b]))
                else:
                    digests.append((int.from_bytes(xxhash.xxh3_64_digest((text or "").encode("utf-8", "surrogatepass")), "little", signed=True), 0))
            out = pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "d1": [d[0] for d in digests], "d2": [d[1] for d in digests]})
            s, count, bounds = counted(*shingles(h, bounds, shingle))
            size = np.diff(bounds)
            owner = np.repeat(np.arange(len(texts)), size)
            bands = banded(sketch(owner, s, 1.0 + np.log(count), len(texts), m))
            # The weighted sketch finds the probability Jaccard, one of equal weights the plain one. They are the same
            # for a text that repeats no shingle.
            again = np.zeros(len(texts), bool)
            again[owner[count > 1]] = True
            plain, pick = {}, again[owner]
            if pick.any():
                to = np.cumsum(again) - 1
                flat = banded(sketch(to[owner[pick]], s[pick], np.ones(int(pick.sum())), int(again.sum()), m))
                plain = dict(zip(np.flatnonzero(again).tolist(), flat))
            out["bands"] = [x[:0] if not n else np.union1d(x, plain[i]) if i in plain else x for i, (x, n) in enumerate(zip(bands, size.tolist()))]
            return out

        for frame in frames:
            ids, texts, held = [], [], 0
            for i, text in zip(frame["doc_id"], frame["text"]):
                ids.append(i)
                texts.append(text)
                held += len(text or "")
                if held > CHUNK:
                    yield chunk(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield chunk(ids, texts)

    return run


def _verify(shingle: int, threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunk(f: pd.DataFrame) -> pd.DataFrame:
            texts = list(dict.fromkeys([*f["ta"], *f["tb"]]))
            sets = dict(zip(texts, weighted(texts, shingle)))
            good = [alike(sets[ta], sets[tb], threshold) for ta, tb in zip(f["ta"], f["tb"])]
            return f.loc[good, ["a", "b"]]

        for f in frames:
            # Pairs of a bounded number of characters at once.
            chars = np.cumsum([len(ta) + len(tb) for ta, tb in zip(f["ta"], f["tb"])]) // (2 * CHUNK)
            for _, part in f.groupby(chars, sort=False):
                yield chunk(part)

    return run


def verified(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough. Only texts that occur in a pair travel."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").where("text is not null").join(small_side(ids), "doc_id", "left_semi")
    joined = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return joined.select("a", "b", "ta", "tb").mapInPandas(_verify(shingle, threshold), "a long, b long").distinct()


def _merged(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What sets have in common, as columns: shingles of the same sets and weights are one column, those of one set are left out.

    For each set and each of its columns: column, number of shingles, their weight; and the bounds of the sets there. Each set
    ends with a column of no shingles, so that none is without.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    cat, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    order = np.argsort(cat, kind="stable")
    cat, owner, weight = cat[order], owner[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], cat[1:] != cat[:-1]))[: len(cat)])
    sets_of = np.diff(np.append(first, len(cat)))
    shared = np.repeat(sets_of > 1, sets_of)
    owner, weight, sets_of = owner[shared], weight[shared], sets_of[sets_of > 1]
    who = mix(mix(owner.astype(np.uint64) + _STEP) + weight.view(np.uint64))
    who = np.add.reduceat(who, np.cumsum(sets_of) - sets_of) if len(who) else who
    known, column = np.unique(who, return_inverse=True)
    last = len(known)
    key = np.concatenate((owner * (last + 1) + np.repeat(column, sets_of), np.arange(n) * (last + 1) + last))
    key, at = np.unique(key, return_inverse=True)
    times = np.bincount(at[: len(owner)], minlength=len(key)).astype(np.float64)
    mass = np.bincount(at[: len(owner)], weight, minlength=len(key))
    return key % (last + 1), times, mass, np.searchsorted(key, np.arange(n + 1) * (last + 1))


def _across(shingle: int, threshold: float):
    """Links between members of different classes in two tiles, as few as connect what is linked."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        rank = pd.factorize(f["root"])[0]
        if rank.max(initial=0) == 0:
            return none
        f = f.reset_index(drop=True)
        sets = weighted(list(f["text"]), shingle)
        size = np.array([len(s[0]) for s in sets])
        ids, tile = f["doc_id"].to_numpy(), f["tile"].to_numpy()
        one = bool((f["first"] == f["second"]).iloc[0])
        whole = np.array([s[1].sum() for s in sets])
        column, times, mass, bounds = _merged(sets)
        mark, mine = np.zeros(column.max() + 1), np.zeros(column.max() + 1)
        a, b = [], []
        for i in range(len(sets) - 1):
            other = rank[i + 1 :] != rank[i]
            if not one:
                other &= tile[i + 1 :] != tile[i]
            if not other.any():
                continue
            at, rest = slice(bounds[i], bounds[i + 1]), slice(bounds[i + 1], None)
            begin = bounds[i + 1 : -1] - bounds[i + 1]
            mark[column[at]], mine[column[at]] = times[at], mass[at]
            both = np.add.reduceat(mark[column[rest]], begin)
            plain = both / (size[i] + size[i + 1 :] - both) >= threshold
            # What passes a bound of the probability Jaccard (see alike) is computed.
            x = mine[column[rest]]
            y = np.where(x > 0, mass[rest], 0.0)
            x, y, most = (np.add.reduceat(v, begin) for v in (x, y, np.maximum(x, y)))
            near = most / (whole[i] + whole[i + 1 :] - np.minimum(x, y)) >= threshold - 1e-9
            mark[column[at]], mine[column[at]] = 0.0, 0.0
            for j in np.flatnonzero(other & (plain | near)) + i + 1:
                if rank[j] != rank[i] and (plain[j - i - 1] or similarity(sets[i], sets[j])[1] >= threshold):
                    rank[rank == rank[j]] = rank[i]
                    a.append(max(ids[i], ids[j]))
                    b.append(min(ids[i], ids[j]))
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def remaining(members: DataFrame, buckets: DataFrame, labels: DataFrame, docs: DataFrame, shingle: int, threshold: float, tile_chars: int = TILE_CHARS) -> DataFrame:
    """Links between the members of each bucket, other than its smallest and largest id, that are in different classes."""
    inner = members.join(buckets.where("n > 3"), "band").where("doc_id <> low and doc_id <> high").select("band", "doc_id").distinct()
    inner = inner.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    inner = written(inner, "inner")
    # Buckets of the same members are compared once.
    sums = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    split = inner.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"), *sums).where("r0 < r1")
    split = written(split.groupBy("x1", "x2", "n").agg(F.min("band").alias("band")).select("band"), "split", narrow=True)
    inner = written(inner.join(small_side(split), "band", "left_semi"), "apart")
    texts = docs.where("text is not null").join(small_side(inner.select("doc_id").distinct()), "doc_id", "left_semi")
    chars = inner.join(texts.select("doc_id", F.length("text").alias("n_chars")), "doc_id").groupBy("band").agg(F.ceil(F.sum("n_chars") / tile_chars).cast("int").alias("tiles"))
    dealt = inner.join(chars, "band").withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.greatest("tiles", F.lit(1))).cast("int"))
    k, last = F.col("tile"), F.greatest(F.col("tiles"), F.lit(1)) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda x: F.struct(F.least(x, k).alias("first"), F.greatest(x, k).alias("second")))
    dealt = dealt.select("band", "doc_id", "root", "tile", F.explode(pairs).alias("p")).select("band", "doc_id", "root", "tile", "p.first", "p.second")
    return dealt.join(texts, "doc_id").groupBy("band", "first", "second").applyInPandas(_across(shingle, threshold), "a long, b long").distinct()


def near_dup(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class), keep (it is that id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    schema = "doc_id long, d1 long, d2 long, bands array<long>"
    marks = written(docs.where("text is not null").mapInPandas(_sketches(registers, rows, shingle), schema), "sketches")
    same = marks.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    members = marks.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    pairs = members.join(buckets, "band").select("doc_id", F.explode(F.array("low", "high")).alias("b")).where("doc_id <> b")
    pairs = written(pairs.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct(), "pairs", narrow=True)

    first = written(pairs.groupBy("a").agg(F.min("b").alias("b")), "first", narrow=True)
    links = written(verified(first, docs, shingle, threshold), "links", narrow=True)
    labels = components(links)
    left = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = pairs.join(left("a"), "a", "left").join(left("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    apart = written(apart.join(first, ["a", "b"], "left_anti"), "apart", narrow=True)
    more = written(verified(apart, docs, shingle, threshold), "links", narrow=True)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    rest = written(remaining(members, buckets, labels, docs, shingle, threshold), "links", narrow=True)
    # An id with several texts links the representatives of all of them.
    rep = written(marks.select("doc_id", "d1", "d2").distinct().join(same, ["d1", "d2"]).select("doc_id", "rep"), "reps", narrow=True)
    several = rep.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b < top").select("doc_id", "b")
    rest = rest.unionByName(written(rep.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"), "links", narrow=True))
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))

    classes = rep.join(labels.toDF("rep", "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    null_text = docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id")).distinct()
    classes = classes.unionByName(null_text).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return classes.withColumn("keep", F.col("doc_id") == F.col("class_id"))
