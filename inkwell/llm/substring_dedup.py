"""Substring dedup over sliding sentence spans.

A text is cut into sentences (up to and including its end mark and the space after it, or a line end). Sentences of more
than ``PIECE`` words are cut further, before each word whose hash is the smallest of some ``PIECE`` neighbours in the
sentence: no piece is longer, and copies of a passage are cut alike wherever they stand. Pieces count as sentences from
here on. Characters of scripts written without spaces count as words.

A run is ``min_sentences`` consecutive sentences or more with ``min_words`` words or more. Runs that occur more than once
are repeated; their first occurrence (smallest id, then position) stays, and every sentence covered by another occurrence
of any run goes. Of all runs it is enough to hash (128 bits; case and spacing don't matter) the shortest one from every
sentence forward and the shortest one to every sentence backward. For let R be a repeated run, at one of its other
occurrences. The shortest runs forward from its sentences that end inside R are parts of R, so they repeat, and their
occurrences here aren't their first. If the one from sentence j is the last that ends inside R, what follows j in R is no
run, so the shortest run backward to R's end begins at j. Together these cover R.

With 25 words a run and 13 a piece, every repeated stretch of more than 50 words holds a whole run, even in mid-sentence;
it is covered to its first and last whole sentence.

Null texts stay null and have no sentences; empty texts stay. Rows without an id keep their text and make no run repeat.
Repeated rows are copies of each other: of rows with one id the first stays whole, in the order of their texts' hashes, and
equal rows of one id stay all (nothing tells them apart). Very long texts are read whole; a text's runs grow with its
length. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, ship, small_side, written
from inkwell.llm.shingles import WordHashes, mix

ship(__name__)

MIN_SENTENCES = 2
MIN_WORDS = 25
#: A sentence: text up to its end mark, closing quotes and white space; a line end closes one too.
SENTENCE = r"[^.!?\n]*[.!?\n]+[\"')\]]*[ \t\r\n]*|[^.!?\n]+"

#: The most words of a piece of a longer sentence.
PIECE = 13

#: Characters of the texts that are cut, hashed and compared at a time; a longer text goes alone.
GROUP = 500_000

_SENTENCE = re.compile(SENTENCE)
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Thai to Burmese, Khmer, Kana, Han and full-width forms: each character is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_UNIT = re.compile(f"[{_UNSPACED}]|{WORD[:-2]}{_UNSPACED}]+")

_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _kinds() -> np.ndarray:
    """For each code point 0 (separator), 1 (part of a word) or 2 (a word of its own), as the unit's expression has it."""
    out = np.ones(0x110000, np.uint8)
    out[:128] = [bool(re.match(WORD, chr(c).lower())) for c in range(128)]
    for m in re.finditer("(.)-(.)", _UNSPACED):
        out[ord(m[1]) : ord(m[2]) + 1] = 2
    return out


class Hashing:
    """Hashes of words, powers of both bases and the kinds of characters, kept for a task."""

    def __init__(self, words: WordHashes | None = None):
        self.words = WordHashes() if words is None else words
        self.kinds = _kinds()
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base**j and base**-j modulo 2**64, j to n at least."""
        if base not in self.tables or len(self.tables[base][0]) <= n:
            both = [np.full(n + n // 4 + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
            for x in both:
                x[0] = 1
            self.tables[base] = tuple(map(np.multiply.accumulate, both))
        return self.tables[base]

    def stretches(self, values: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
        """The sum of values[a + j] * base**-j from a to b for each pair: by prefix sums, wherever the stretch stands."""
        power, inverse = self.powers(base, len(values))
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * inverse[: len(values)], out=prefix[1:])
        return (prefix[b] - prefix[a]) * power[a] + (b - a).astype(np.uint64)


def _fold(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_LOWER)


def _word_hashes(text: str, low: np.ndarray, a: np.ndarray, b: np.ndarray, known: Hashing) -> np.ndarray:
    """The hash of each word text[a:b]: different words are told apart by sums of their characters and looked up once."""
    mark = known.stretches(mix(low.astype(np.uint64)), a, b, _A)
    for i in np.flatnonzero(b - a > 64):  # such sums are safe for short words only
        mark[i] = known.words[_fold(text[a[i] : b[i]])]
    code, different = pd.factorize(mark)
    one = np.empty(len(different), np.int64)
    one[code] = np.arange(len(code))
    return known.words.of([_fold(text[x:y]) for x, y in zip(a[one].tolist(), b[one].tolist())])[code]


def cut_all(texts: list[str], known: Hashing) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all texts: where each begins in the joined texts (and their end), its words, the first piece of each text (and the last's end), and the hashes of all words."""
    text = "".join(texts)
    begin = np.cumsum(np.fromiter(chain([0], map(len, texts)), np.int64, len(texts) + 1))
    length = np.fromiter(chain.from_iterable(map(len, _SENTENCE.findall(t)) for t in texts), np.int64)
    bound = np.concatenate(([0], np.cumsum(length)))
    low = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = known.kinds[low]
    low = low + np.uint32(32) * (low - np.uint32(65) < np.uint32(26))
    alone = kind == 2
    first = kind > 0
    goes_on = np.zeros(len(low) + 1, bool)  # whether a character is a further one of its word
    goes_on[1:-1] = (first[:-1] & first[1:]) & ~(alone[:-1] | alone[1:])
    goes_on[bound] = False
    a = np.flatnonzero(first & ~goes_on[:-1])
    b = np.flatnonzero(first & ~goes_on[1:]) + 1
    h = _word_hashes(text, low, a, b, known)
    word = np.searchsorted(a, bound)
    size = np.diff(word)
    if (size > PIECE).any():
        owner = np.repeat(np.arange(len(size)), size)
        w = np.arange(len(h) - PIECE + 1)
        w = w[(owner[: len(w)] == owner[PIECE - 1 :]) & (size[owner[: len(w)]] > PIECE)]
        m, at = mix(h), w + PIECE - 1
        for k in range(2, PIECE + 1):  # the smallest of each PIECE neighbours, the last of equal ones
            x = w + PIECE - k
            at = np.where(m[x] < m[at], x, at)
        at = np.unique(at)
        at = at[at > word[owner[at]]]  # a sentence begins a piece anyway
        bound = np.sort(np.concatenate((bound, a[at])))
        size = np.diff(np.searchsorted(a, bound))
    return bound, size, np.searchsorted(bound[:-1], begin), h


def cut(text: str, known: WordHashes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of a text (joined they are the text), how many words each has, and the hashes of all words."""
    bound, size, _, h = cut_all([text], Hashing(known))
    return [text[x:y] for x, y in zip(bound, bound[1:])], size, h


def runs(size: np.ndarray, of: np.ndarray, h: np.ndarray, known: Hashing, min_sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
    """Text, start, end (exclusive) and two hashes of the runs of the texts' pieces, of ``size`` words each; ``of`` has each text's first piece, h the hashes of words."""
    # Pieces without a word (bullets, rules) count as neither sentence nor content.
    full = np.flatnonzero(size)
    n = len(full)
    total = np.concatenate(([0], np.cumsum(size[full])))
    edge = np.searchsorted(full, of)
    text = np.repeat(np.arange(len(of) - 1), np.diff(edge))
    i, j = np.arange(n), np.arange(1, n + 1)
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words, "left"), i + min_sentences)
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, j - min_sentences)
    forward, backward = to <= edge[1:][text], back >= edge[:-1][text]
    backward &= to[np.maximum(back, 0)] != j  # else it's a forward run
    start = np.concatenate((i[forward], back[backward]))
    end = np.concatenate((to[forward], j[backward]))
    h1, h2 = (mix(known.stretches(h, total[start], total[end], base)).view(np.int64) for base in (_A, _B))
    text = text[start]
    return text, full[start] - of[text], full[end - 1] + 1 - of[text], h1, h2


_SPANS = "h1 long, h2 long, later boolean, doc_id long, t int, start int, end int"


def _groups(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Consecutive rows of ``GROUP`` characters together."""
    share = (f["text"].str.len().cumsum() // GROUP).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(share)) + 1), len(f)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield f.iloc[a:b]


def _settle(f: pd.DataFrame) -> pd.DataFrame:
    """Mark rows that come after another one of their run here, and give those a key of their own: a frequent run sends one row a group to be ranked."""
    k = np.flatnonzero(f["h1"].duplicated(keep=False))
    later = np.zeros(len(f), bool)
    if len(k):
        h1, h2, doc_id, t, start = (f[c].to_numpy()[k] for c in ("h1", "h2", "doc_id", "t", "start"))
        order = np.lexsort((start, t, doc_id, h2, h1))
        h1, h2, doc_id, t, start = (c[order] for c in (h1, h2, doc_id, t, start))
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        later[k[order]] = (doc_id != doc_id[first]) | (t != t[first]) | (start != start[first])
        f.loc[later, "h1"] += np.arange(1, later.sum() + 1)
    return f.assign(later=later)


def _spans(min_sentences: int, min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashing()
        for f in frames:
            for g in _groups(f):
                _, size, of, h = cut_all(g["text"].tolist(), known)
                text, start, end, h1, h2 = runs(size, of, h, known, min_sentences, min_words)
                if len(text):
                    yield _settle(pd.DataFrame({"h1": h1, "h2": h2, "later": False, "doc_id": g["doc_id"].to_numpy()[text], "t": g["t"].to_numpy()[text], "start": start, "end": end}))

    return run


def _without(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Hashing()
    for f in frames:
        for g in _groups(f):
            texts, out = g["text"].tolist(), []
            bound, _, of, _ = cut_all(texts, known)
            for i, (text, spans) in enumerate(zip(texts, g["removed"])):
                chars = bound[of[i] : of[i + 1] + 1] - bound[of[i]]
                keep, at = [], 0
                for start, end in spans:
                    keep.append(text[at : chars[start]])
                    at = chars[end]
                out.append("".join(keep) + text[at:])
            yield pd.DataFrame({"doc_id": g["doc_id"], "n_removed": g["n_removed"], "removed": g["removed"], "text": out})


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, t (hash of the row's text), start, end (sentence numbers, end exclusive) of every occurrence of a repeated run but its first.

    Each run is moved once: ranked among its occurrences, all but the first (and what equals it) are later ones.
    """
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("t"), "text")
    spans = rows.mapInPandas(_spans(min_sentences, min_words), _SPANS)
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("later", "doc_id", "t", "start"))
    return spans.withColumn("place", place).where("later or place > 1").select("doc_id", "t", "start", "end")


def substring_dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row: doc_id, n_removed, removed (list of [start, end) sentence spans), text without them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("t"))
    gone = repeated_spans(docs, min_sentences, min_words).groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    begin = F.array().cast("array<struct<start:int,end:int>>")

    def merge(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]), grown).otherwise(F.concat(acc, F.array(x)))

    gone = gone.select("doc_id", "t", F.transform(F.aggregate("spans", begin, merge), lambda s: F.array(s["start"], s["end"])).alias("removed"))
    gone = written(gone.withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (F.get(s, F.lit(1)) - F.get(s, F.lit(0))))), "gone", narrow=True)
    side = small_side(gone)
    none = [F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<array<int>>").alias("removed")]
    whole = docs.join(side, ["doc_id", "t"], "left_anti").select("doc_id", *none, "text")
    return whole.unionByName(docs.join(side, ["doc_id", "t"]).mapInPandas(_without, "doc_id long, n_removed long, removed array<array<int>>, text string"))
