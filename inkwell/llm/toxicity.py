"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its whole form and its character 3- to 5-grams (with end marks), hashed to ``buckets`` vectors, so
unseen misspellings share vectors with known words. A window of ``span`` words is the average of its words' bags; a
linear softmax over the average gives its class, and embeddings and softmax are trained together. A text scores as its
worst window. Labels are for texts, so training alternates: every window of toxic texts counts as toxic at first, then
only those that the model finds worst, against the worst windows of the other texts. A sigmoid fitted on held-back
training texts makes the score.

Fitted on the driver from at most ``per_class`` labelled texts of either class, whose characters are bounded too (see
``labelled.sample``). Every text, very long ones too, is scored whole, every row by itself, also repeated ones; null texts
and texts without words get the score of the offset. If one class has no label all scores are that of the other (0.0 or 1.0).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import held_out, ship
from inkwell.llm.labelled import platt, sample, sigmoid
from inkwell.llm.shingles import words as all_words

ship(__name__)

PER_CLASS = 1500
BUCKETS = 1 << 17
DIM = 12
SPAN = 6
CUT = 0.7
WINDOWS = 16
#: Characters of a word; texts without spaces have longer ones, which become pieces that overlap by half.
LONG = 40


def words(text: str | None) -> list[str]:
    """The words of a text; a run of the same word counts once. Longer words are overlapping pieces of ``LONG`` characters."""
    found = all_words(text)
    if found and len(max(found, key=len)) > LONG:
        half = LONG // 2
        found = [w[i : i + LONG] for w in found for i in range(0, max(len(w) - half, 1), half)]
    return [w for w, _ in groupby(found)]


def subwords(word: str, buckets: int) -> list[int]:
    w = f"<{word}>"
    n = len(w)
    out = [zlib.crc32(w[i : i + k].encode("utf-8", "surrogatepass")) for k in (3, 4, 5) for i in range(n - k + 1)]
    out.append(zlib.crc32(b"\x00" + w.encode("utf-8", "surrogatepass")))
    return [h % buckets for h in out]


class WordScores(dict):
    """word -> the margin its average subword adds; remembered up to a bound."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float:
        at = subwords(word, len(self.table))
        out = self[word] = float(self.table[at].sum()) / len(at)
        return out


def worst(values: np.ndarray, span: int) -> tuple[float, int]:
    """The largest mean over any ``span`` neighbours (all of them, if there are fewer) and where it begins."""
    if not len(values):
        return 0.0, 0
    span = min(span, len(values))
    c = np.concatenate(([0.0], np.cumsum(values)))
    mean = (c[span:] - c[:-span]) / span
    at = int(mean.argmax())
    return float(mean[at]), at


class Model:
    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0, span: int = SPAN):
        self.table, self.bias, self.slope, self.offset, self.span = table, bias, slope, offset, span

    def margin(self, tokens: list[str], known: WordScores) -> float:
        return worst(np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens)), self.span)[0] + self.bias

    def score(self, tokens: list[str], known: WordScores) -> float:
        return sigmoid(self.slope * self.margin(tokens, known) + self.offset)


class _Trainer:
    """Adagrad on the cross-entropy of windows. Words are numbered; their subwords lie one after the other."""

    def __init__(self, vocab: list[str], buckets: int, dim: int, rate: float = 0.25):
        rng = np.random.default_rng(11)
        sub, ends = array("l"), array("l", [0])
        for w in vocab:
            sub.extend(subwords(w, buckets))
            ends.append(len(sub))
        self.indptr, self.sub = np.array(ends, np.int64), np.array(sub, np.int32)
        self.e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (dim, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge, self.gw, self.gb = np.full(buckets, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        self.rate, self.rng = rate, rng

    def bags(self, windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all subwords of the windows: bucket, window and its share of the average."""
        word = np.concatenate(windows)
        owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        size = (self.indptr[word + 1] - self.indptr[word]).astype(np.int64)
        first = np.repeat(self.indptr[word] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        at = self.sub[first + np.arange(size.sum())]
        length = np.array([len(w) for w in windows])[owner]
        return at, np.repeat(owner, size), np.repeat(1.0 / (size * length), size).astype(np.float32)

    def train(self, windows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 512) -> None:
        for _ in range(epochs):
            order = self.rng.permutation(len(windows))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                at, owner, share = self.bags([windows[i] for i in pick])
                bound = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
                mean = np.add.reduceat(self.e[at] * share[:, None], bound, axis=0)
                z = mean @ self.w + self.b
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                g = p * weight[pick, None]
                gw, gb = mean.T @ g, g.sum(0)
                gm = g @ self.w.T
                order_at = np.argsort(at, kind="stable")
                s = at[order_at]
                cut = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
                ge = np.add.reduceat((gm[owner] * share[:, None])[order_at], cut, axis=0)
                rows = s[cut]
                self.ge[rows] += (ge * ge).mean(1)
                self.e[rows] -= self.rate * ge / np.sqrt(self.ge[rows])[:, None]
                self.gw += gw * gw
                self.w -= self.rate * gw / np.sqrt(self.gw)
                self.gb += gb * gb
                self.b -= self.rate * gb / np.sqrt(self.gb)

    def table(self) -> tuple[np.ndarray, float]:
        out = (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float64)
        met = np.zeros(len(out), bool)
        met[self.sub] = True
        out[~met] = out[met].mean()  # grams that no training word has say nothing: they count as the average gram
        return out, float(self.b[1] - self.b[0])

    def word_values(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.sub], self.indptr[:-1]) / np.diff(self.indptr)


def fit(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, span: int = SPAN, rounds: int = 3) -> Model:
    y = (np.asarray(labels) > 0).astype(np.int64)
    if len(set(y)) < 2:
        return Model(np.zeros(buckets), 0.0, 1.0, 0.0 if not len(y) else 30.0 * (2 * y[0] - 1), span)
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int32) for t in texts]
    fold = (np.arange(len(y)) % 5 == 0) & np.array([len(i) > 0 for i in ids])
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.array([len(i) > 0 for i in ids])
        use = np.flatnonzero(fold)
    else:
        use = np.flatnonzero(~fold & np.array([len(i) > 0 for i in ids]))
    if not len(vocab) or len(set(y[use])) < 2:
        return Model(np.zeros(buckets), 0.0, 1.0, 0.0, span)
    trainer = _Trainer(list(vocab), buckets, dim)
    rng = np.random.default_rng(5)

    def at(i: int, start: int) -> np.ndarray:
        return ids[i][start : start + span]

    def starts(i: int, n: int) -> np.ndarray:
        last = max(len(ids[i]) - span, 0)
        return np.arange(last + 1) if last < n else rng.choice(last + 1, n, replace=False)

    for r in range(rounds):
        windows, target, weight = [], [], []
        if r:
            table, _ = trainer.table()
            value = trainer.word_values(table)
        for i in use:
            if r == 0:
                chosen = [int(s) for s in starts(i, WINDOWS)]
                w = 1.0 / len(chosen)
            else:
                chosen = [worst(value[ids[i]], span)[1]]
                w = 1.0
                if not y[i]:  # negatives also keep some plain windows
                    chosen += [int(s) for s in starts(i, 6)]
            for s in chosen:
                windows.append(at(i, s))
                target.append(y[i])
                weight.append(w)
        target, weight = np.array(target), np.array(weight, np.float32)
        for c in (0, 1):
            weight[target == c] *= len(target) / (2 * max(weight[target == c].sum(), 1e-9))
        trainer.train(windows, target, weight, 4 if r == 0 else 6)
    table, bias = trainer.table()
    value = trainer.word_values(table)
    check = np.flatnonzero(fold)
    slope, offset = platt(np.array([worst(value[ids[i]], span)[0] + bias for i in check]), 2.0 * y[check] - 1)
    return Model(table, bias, slope, offset, span)


def _scores(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordScores(model.table)
        for f in frames:
            out = []
            for t in f["text"]:
                if len(known) > 300_000:
                    known.clear()
                out.append(model.score(words(t), known))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": out})

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    got = sample(docs, labels, label, usable, per_class)
    return fit(got["text"].tolist(), got["y"].tolist())


def toxicity(docs: DataFrame, labels: DataFrame, mod: int = 3, rest: int = 1, cut: float = CUT, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= cut); rows with crc32(doc_id) % mod == rest are held out of the fit."""
    model = train(docs, labels, ~held_out(F.col("doc_id"), mod, rest), per_class=per_class)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scores(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
