"""Bounded labelled samples, and scores made of margins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import ship

ship(__name__)


#: A text of more characters takes no part in a fit, and the texts of a class have so many together at most.
LONGEST = 200_000
CHARS = 24_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, longest: int = LONGEST, chars: int = CHARS) -> pd.DataFrame:
    """Whole texts of either label (0, 1), those with the smallest id hashes; sorted by id. A doc with several labels counts as its smallest.

    Bounds, for each class: ``per_class`` ids are drawn; texts of more than ``longest`` characters are left out, and the
    rest is taken in the order of the hashes up to ``chars`` characters in all. Nothing beyond them reaches the driver.
    """
    y = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"))
    chosen = None
    for c in (0, 1):
        part = y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of two numbers are broadcast. Of the rows of a repeated id the smallest hash counts.
    got = docs.select("doc_id", "text").where((F.col("text").isNotNull()) & (F.length("text") <= longest)).join(F.broadcast(chosen), "doc_id")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    got = got.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    before = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("_c", F.sum(F.length("text")).over(before)).where(F.col("_c") <= chars).drop("_c")
    return got.toPandas().sort_values("doc_id").reset_index(drop=True)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of sigmoid(slope * margin + offset), by Newton's method on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg) * len(y)
    a, b = 1.0 / max(np.abs(margin).mean(), 1e-9), 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-4 * np.array([a, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-6)), float(b)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))
