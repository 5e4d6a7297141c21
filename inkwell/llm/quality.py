"""Quality classifier: naive Bayes support vectors.

Features are indicators of word 1- and 2-grams and of 1- to 4-grams of word shapes (runs of upper case, lower case,
digits and marks; a mark that the word repeats its predecessor). Each indicator is scaled by its class log-count ratio,
rows are scaled to length one, and a linear hinge-loss model is fitted by dual coordinate descent. A sigmoid fitted on margins of held-back
training rows makes the score.

Fitted on the driver from at most ``per_class`` labelled texts of either class, whose characters are bounded too (see
``labelled.sample``), and ``features`` n-grams; every text, very long ones too, is scored whole. Rows with other columns of
any name are read for doc_id and text alone. Null and empty texts have no features and get the score of the offset. Rows that repeat are scored each.
If one class has no usable label, all scores are 1.0 or 0.0 for the class that has; without any label they are 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import held_out, ship
from inkwell.llm.labelled import platt, sample, sigmoid
from inkwell.llm.shingles import WordHashes, mix

ship(__name__)

PER_CLASS = 1200
FEATURES = 100_000
CUT = 0.3
#: Characters of a token; longer ones, as of texts without spaces, are cut into pieces that each count.
LONG = 64

_RUN = re.compile(r"(.)\1+")
_STEP, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Shapes(dict):
    """word -> a hash of its shape: letters, digits and marks as runs."""

    def __missing__(self, word: str) -> int:
        s = "".join("X" if ch.isupper() else "x" if ch.isalpha() else "0" if ch.isdigit() else ch for ch in word)
        out = self[word] = xxhash.xxh3_64_intdigest(_RUN.sub(r"\1", s).encode("utf-8", "surrogatepass"), 1)
        return out


class Features:
    """Turns texts into sorted arrays of the hashes of their n-grams; remembers words up to a bound."""

    def __init__(self):
        self.words, self.shapes = WordHashes(), Shapes()

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if not tokens:
            return np.zeros(0, np.uint64)
        if len(max(tokens, key=len)) > LONG:
            tokens = [w[i : i + LONG] for w in tokens for i in range(0, len(w), LONG)]
        if len(self.shapes) > self.words.limit:
            self.shapes.clear()
        h = self.words.of(tokens)
        s = np.fromiter(map(self.shapes.__getitem__, tokens), np.uint64, len(tokens))
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        s[again] = _AGAIN  # a word that repeats its predecessor has a shape of its own
        out = [h, mix(h[:-1] * _STEP + h[1:])]
        g = s
        for n in range(2, 6):
            out.append(g)
            g = mix(g[: len(s) - n + 1] * _STEP + s[n - 1 :])
        return np.unique(np.concatenate(out))


def dual_coordinate_descent(indptr: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, cost: np.ndarray, epochs: int = 30, tol: float = 1e-3) -> np.ndarray:
    """Weights of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i), by passes over the duals in seeded random order."""
    w, alpha, rng = np.zeros(n), np.zeros(len(y)), np.random.default_rng(7)
    square = np.add.reduceat(np.append(x * x, 0.0), indptr[:-1]) * (np.diff(indptr) > 0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            if square[i] <= 0:
                continue
            at = slice(indptr[i], indptr[i + 1])
            c, v = cols[at], x[at]
            g = y[i] * (w[c] @ v) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w[c] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < tol:
            break
    return w


class Model:
    """keys: sorted feature hashes; margin = sum of gain / root of the sum of square, over the features found, + bias."""

    def __init__(self, keys: np.ndarray, gain: np.ndarray, square: np.ndarray, bias: float, slope: float, offset: float):
        self.keys, self.gain, self.square, self.bias, self.slope, self.offset = keys, gain, square, bias, slope, offset

    def margin(self, found: np.ndarray) -> float:
        if not len(self.keys) or not len(found):
            return self.bias
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        at = at[self.keys[at] == found]
        norm = self.square[at].sum()
        return float(self.gain[at].sum() / norm**0.5 + self.bias) if norm > 0 else self.bias

    def score(self, found: np.ndarray) -> float:
        return sigmoid(self.slope * self.margin(found) + self.offset)


def _linear(rows: list[np.ndarray], y: np.ndarray, n: int, smooth: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, log-count ratios and bias for indicator rows; the bias is one more feature of every row."""
    pos, neg = np.full(n, smooth), np.full(n, smooth)
    for r, t in zip(rows, y):
        (pos if t > 0 else neg)[r] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    indptr, cols, x = [0], [], []
    for r in rows:
        v = ratio[r]
        cols += [np.append(r, n)]
        x += [np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)]
        indptr.append(indptr[-1] + len(r) + 1)
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    w = dual_coordinate_descent(np.array(indptr), np.concatenate(cols), np.concatenate(x), y, n + 1, 4 * cost)
    return w[:n], ratio, float(w[n])


def fit(texts: list[str], labels: list[int], max_features: int = FEATURES, smooth: float = 1.0) -> Model:
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    none = np.zeros(0)
    if len(set(y)) < 2:
        return Model(np.zeros(0, np.uint64), none, none, 0.0, 1.0, 0.0 if not len(y) else 30.0 * y[0])
    made = Features()
    found = [made.of(t) for t in texts]
    # Of the features that occur in three texts, the most frequent ones are kept (ties by hash).
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    often = n >= min(3, max(1, len(y) // 10))
    keys, n = keys[often], n[often]
    keys = np.sort(keys[np.lexsort((keys, -n))[:max_features]])

    def known(f: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, f), max(len(keys) - 1, 0))
        return at[keys[at] == f] if len(keys) else np.zeros(0, np.int64)

    rows = [known(f) for f in found]

    def model(index: np.ndarray) -> Model:
        w, ratio, bias = _linear([rows[i] for i in index], y[index], len(keys), smooth)
        return Model(keys, w * ratio, ratio**2, bias, 1.0, 0.0)

    fold = np.arange(len(y)) % 4 == 0
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        part, fold = model(np.arange(len(y))), np.ones(len(y), bool)
    else:
        part = model(np.flatnonzero(~fold))
    slope, offset = platt(np.array([part.margin(found[i]) for i in np.flatnonzero(fold)]), y[fold])
    out = model(np.arange(len(y)))
    out.slope, out.offset = slope, offset
    return out


def _scores(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Features()
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64"), "score": [model.score(made.of(t)) for t in f["text"]]})

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    got = sample(docs, labels, label, usable, per_class)
    return fit(got["text"].tolist(), got["y"].tolist())


def score_documents(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted (1 if score >= cut) for every row."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_scores(model), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, cut: float = CUT, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted; rows with crc32(doc_id) % mod == rest are held out of the fit."""
    model = train(docs, labels, ~held_out(F.col("doc_id"), mod, rest), per_class=per_class)
    return score_documents(docs, model, cut).select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows whose text scores cut or more, with all their columns."""

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Features()
        for t in texts:
            yield pd.Series([model.score(made.of(x)) for x in t], dtype="float64")

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(scores, "double")(F.col("text")) >= cut)
