"""Phrase collocations: counts of all word n-grams per language, scored at their weakest cut.

The n-grams of 1 to ``max_n`` words are exploded into rows (lang, words, phrase, count): every task splits its texts with
Arrow's kernels, numbers the words of a chunk, counts equal n-grams of the chunk, and gives one row for each. Spark sums them
by language and phrase. No n-gram is more frequent than an n-gram inside it; so the rows come level by level, and an n-gram
is exploded only where the n-grams inside it may have reached the minimum (``pruned``; without it all are exploded at once).
Pairs of words, the most numerous, are first counted by 64-bit hashes. What reached the minimum is told by a bit map over
hashes, 16 bits and more for each frequent n-gram, at most ``MOST_BITS``; its errors, and those of hashes, let rows pass that
the sums by phrase drop later, so counts are exact at any size.

Cuts of candidates meet the counts of their parts by joins on language and phrase. Scores are decimals of 38 digits, divided
as whole numbers. A candidate inside a longer one that is at least ``inside`` percent as frequent goes; as every phrase between
the two is as frequent as the longer one, it's enough to look at the extensions by one word. Ranks are taken per language,
of the best of each of its ``SHARES`` shares.

Null texts are empty, a null language is ``und`` (together with rows that say so). Repeated rows and ids count each time they
occur; other columns are ignored. An empty table has no phrases. A chunk holds one text at least, so memory follows the longest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import ship, written

ship(__name__)

#: Characters of texts that are counted together.
CHUNK = 500_000
#: Places of pairs whose hashes a task counts at once.
PAIRS = 1_000_000
LEAST_BITS, MOST_BITS = 20, 30
#: Shares of a language that are ranked before it is.
SHARES = 32
_GRAMS = "lang string, n_words int, phrase string, f long"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(texts, lang: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, mixed with a language's hash."""
    h = pd.util.hash_array(np.asarray(texts, object), categorize=False) if len(texts) else np.zeros(0, np.uint64)
    return _mixed(h ^ lang, np.uint64(1))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _GOLD) ^ (b + (a >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _lang_hash(langs: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(langs, object), categorize=False)


def _phrase_hashes(phrases: list[str], langs: list[str]) -> np.ndarray:
    """The hash of whole phrases: folded from their words' hashes, as the exploding tasks have these at hand."""
    lang = _lang_hash(langs)
    parts = [p.split(" ") for p in phrases]
    out = np.zeros(len(parts), np.uint64)
    for i in range(max(map(len, parts), default=0)):
        has = np.array([i < len(p) for p in parts])
        word = _hashes([p[i] for p in parts if i < len(p)], lang[has])
        out[has] = word if i == 0 else _mixed(out[has], word)
    return out


def _marker(bits: int):
    """Where the hashes (h) or phrases of rows stand in the map. One step for both, as every step in a row holds a worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h = f["h"].to_numpy().view(np.uint64) if "h" in f.columns else _phrase_hashes(f["phrase"].tolist(), f["lang"].tolist())
            at = h >> np.uint64(64 - bits)
            yield pd.DataFrame({"block": (at >> np.uint64(16)).astype(np.int64), "bit": (at & np.uint64(0xFFFF)).astype(np.int32)})

    return run


def _bitmap(frequent: DataFrame) -> tuple[int, dict[int, bytes]]:
    """Bits and blocks of the map of a written table of hashes (h) or phrases; the blocks have 8 KB each, 128 MB in all at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * frequent.count()).bit_length()))
    known = frequent.select("h") if "h" in frequent.columns else frequent.select("lang", "phrase")
    marks = known.mapInPandas(_marker(bits), "block long, bit int").distinct()

    def block(key, f):
        bit = np.zeros(1 << 16, bool)
        bit[f["bit"].to_numpy()] = True
        return pd.DataFrame([(key[0], np.packbits(bit).tobytes())], columns=["block", "held"])

    return bits, {r["block"]: bytes(r["held"]) for r in marks.groupBy("block").applyInPandas(block, "block long, held binary").toLocalIterator()}


class _Map:
    """A bit map at hand in a task."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits, self.held = bits, np.zeros(1 << (bits - 3), np.uint8)
        for i, held in blocks.items():
            self.held[i << 13 : (i + 1) << 13] = np.frombuffer(held, np.uint8)

    def may(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.held[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


class _Chunk:
    """Texts as places: word numbers (a word of two languages has two; -1 is a border, also behind every text)."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        low = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts, "")), pa.scalar("."), pa.scalar(" "))
        parts = pc.split_pattern_regex(pc.replace_substring_regex(low, r"[.,;:!?\x0A-\x0D]", " . "), r"[\x20\x09]+")
        coded = parts.flatten().dictionary_encode()
        self.words = coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        border = pc.is_in(self.words, pa.array([".", ""])).to_numpy(zero_copy_only=False)  # empty ones only lie at a text's ends
        lang = pc.fill_null(langs, "und").dictionary_encode()
        self.langs = lang.dictionary
        lang_of = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        self.at, self.whole = pd.factorize(np.where(border[code], -1, lang_of * len(self.words) + code), use_na_sentinel=False)
        self.at = self.at.astype(np.int64)
        none = np.flatnonzero(self.whole == -1)
        if len(none):
            self.at[self.at == none[0]] = -1
        self._hashes = None

    def places(self, n: int) -> np.ndarray:
        """Where n words follow one another without a border."""
        ok = self.at >= 0
        run = ok.copy()
        for k in range(1, n):
            run[: len(run) - k] &= ok[k:]
            run[len(run) - k :] = False
        return np.flatnonzero(run)

    def hashes(self, places: np.ndarray, n: int) -> np.ndarray:
        if self._hashes is None:
            lang = _lang_hash(self.langs.to_pylist())[self.whole // len(self.words)]
            words = self.words.to_numpy(zero_copy_only=False)
            self._hashes = _hashes(words[self.whole % len(self.words)], lang)
        out = self._hashes[self.at[places]]
        for k in range(1, n):
            out = _mixed(out, self._hashes[self.at[places + k]])
        return out

    def within(self, n: int, part: int, held: _Map | None) -> np.ndarray:
        """The places of n-grams all of whose ``part``-grams may be frequent."""
        places = self.places(n)
        if held is None:
            return places
        shorter = self.places(part)
        may = np.zeros(len(self.at), bool)
        may[shorter] = held.may(self.hashes(shorter, part))
        for k in range(n - part + 1):
            places = places[may[places + k]]
        return places

    def rows(self, n: int, places: np.ndarray) -> pa.RecordBatch:
        """The n-grams at the places, each once with its count."""
        ids = self.at[places]
        for k in range(1, n):
            ids = pd.factorize(ids * len(self.whole) + self.at[places + k])[0]
        f = np.bincount(ids)
        first = np.zeros(len(f), np.int64)
        first[ids] = places
        there = np.flatnonzero(f)
        f, first = f[there], first[there]
        word = lambda k: self.words.take(pa.array(self.whole[self.at[first + k]] % len(self.words)))
        phrase = word(0) if n == 1 else pc.binary_join_element_wise(*[word(k) for k in range(n)], pa.scalar(" "))
        lang = self.langs.take(pa.array(self.whole[self.at[first]] // len(self.words)))
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(f), n, np.int32)), phrase, pa.array(f.astype(np.int64))], names=["lang", "n_words", "phrase", "f"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    for whole in batches:
        size = pc.fill_null(pc.utf8_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHUNK)) + 1), len(size)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield _Chunk(whole.column("text").slice(a, b - a), whole.column("lang").slice(a, b - a))


def _exploder(levels: list[tuple[int, int]], bitmap):
    """levels: lengths n of n-grams, each with the length of its parts that the bit map (None: all may be) must know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bitmap is None else _Map(*bitmap.value)
        for chunk in _chunks(batches):
            for n, part in levels:
                places = chunk.within(n, part, held)
                if len(places):
                    yield chunk.rows(n, places)

    return run


def _pair_hasher(bitmap):
    """Hashes of pairs of words that may be frequent, with their counts; equal ones of many chunks are counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = _Map(*bitmap.value), [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            h, f = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(f[i : i + 100_000].astype(np.int64))], names=["h", "f"])

        for chunk in _chunks(batches):
            held.append(chunk.hashes(chunk.within(2, 1, words), 2))
            n += len(held[-1])
            if n > PAIRS:
                yield from counted()
                held, n = [], 0
        if n:
            yield from counted()

    return run


def counts(docs: DataFrame, max_n: int, least: int, pruned: bool = True) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to max_n words that occur ``least`` times or more (lang, n_words, phrase, f), and each language's words (lang, n)."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = docs.select("lang", "text")

    def level(levels: list[tuple[int, int]], bitmap) -> DataFrame:
        return texts.mapInArrow(_exploder(levels, bitmap), _GRAMS).groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))

    def frequent(rows: DataFrame) -> DataFrame:
        return written(rows.where(F.col("f") >= least), "phrase_counts", narrow=True)

    if not pruned:
        every = level([(n, n) for n in range(1, max_n + 1)], None)
        return frequent(every), written(every.where("n_words = 1").groupBy("lang").agg(F.sum("f").alias("n")), "language_words", narrow=True)
    words = written(level([(1, 1)], None), "word_counts")
    total = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "language_words", narrow=True)
    out = frequent(words)
    pairs = frequent(texts.mapInArrow(_pair_hasher(share(_bitmap(out))), "h long, f long").groupBy("h").agg(F.sum("f").alias("f")))
    longest = frequent(level([(n, 2) for n in (2, 3) if n <= max_n], share(_bitmap(pairs))))
    out = out.unionByName(longest)
    for n in range(4, max_n + 1):
        longest = frequent(level([(n, n - 1)], share(_bitmap(longest.where(F.col("n_words") == n - 1)))))
        out = out.unionByName(longest)
    return out, total


def phrases(docs: DataFrame, max_n: int = 4, least: int = 30, inside: int = 80, top: int = 2000, factor: int = 2_000_000, pruned: bool = True) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to max_n words."""
    known, total = counts(docs, max_n, least, pruned)
    words = F.split("phrase", " ")
    of = lambda w, start, size: F.array_join(F.slice(w, start, size), " ")
    candidates = known.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words", words.alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", of(F.col("w"), F.lit(1), F.col("k")).alias("head"), of(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast(a as decimal(19,0)) * cast({factor} as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    longer = known.where("n_words > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array(of(words, F.lit(1), F.size(words) - 1), of(words, F.lit(2), F.size(words) - 1))).alias("phrase"))
    covered = candidates.join(longer, ["lang", "phrase"]).where(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * inside).select("lang", "phrase")
    kept = worst.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # Spark's own cut before the shuffle ends at 1,000 rows: each share of a language keeps its best first.
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    first = kept.select("*", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).where(F.col("place") <= top).drop("place", "share")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
