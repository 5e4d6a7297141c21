"""Vectors in compact tiles, and the pairs of tiles that can hold a product of a wanted size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shared import broadcast_if, written

#: Centers that vectors are dealt to: a bounded sample.
CENTERS = 1024


def tiled(vectors: DataFrame, tile: int) -> DataFrame:
    """vectors (id, embedding, ...) with the tile that each belongs to, of about ``tile`` vectors at most; nulls have none."""
    rows = written(vectors.where("embedding is not null"), "vectors")
    n = rows.count()
    k = min(CENTERS, max(1, n // tile))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(k).select("embedding").collect()
    centers = np.array([r[0] for r in sample], np.float64)
    schema = rows.withColumn("cell", F.lit(0)).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["embedding"].tolist(), np.float64)
            cell = np.concatenate([((centers**2).sum(1)[None, :] - 2 * x[i : i + 1000] @ centers.T).argmin(1) for i in range(0, len(x), 1000)] or [np.zeros(0)])
            yield f.assign(cell=cell.astype(np.int32))

    celled = written(rows.mapInPandas(run, schema), "cells") if k > 1 else rows.withColumn("cell", F.lit(0))
    parts = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("_n"))  # as many rows as there are centers
    dealt = celled.join(F.broadcast(parts), "cell").withColumn("tile", F.concat_ws("-", "cell", F.pmod(F.xxhash64("id"), F.col("_n")).cast("string")))
    return dealt.drop("_n", "cell")


def summaries(tiles: DataFrame) -> DataFrame:
    """tile, center and radius of each tile."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.array(f["embedding"].tolist(), np.float64)
        c = x.mean(0)
        return pd.DataFrame({"tile": [key[0]], "center": [c], "radius": [float(np.sqrt(((x - c) ** 2).sum(1).max()))]})

    return written(tiles.select("tile", "embedding").groupBy("tile").applyInPandas(run, "tile string, center array<double>, radius double"), "tiles")


def reaching(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of tile summaries whose best product may be ``least`` or more; they meet in parts of bounded size."""
    parts = max(1, -(-right.count() // 2000))
    x = left.select(F.col("tile").alias("a"), F.col("center").alias("ca"), F.col("radius").alias("ra"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    y = right.select(F.col("tile").alias("b"), F.col("center").alias("cb"), F.col("radius").alias("rb"), F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int").alias("part"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    norm = lambda u: F.sqrt(dot(F.col(u), F.col(u)))
    best = dot(F.col("ca"), F.col("cb")) + F.col("ra") * norm("cb") + F.col("rb") * norm("ca") + F.col("ra") * F.col("rb")
    return written(x.join(y, "part").where(best >= F.lit(least) - 1e-6).select("a", "b"), "reaching")


def met(pairs: DataFrame, left: DataFrame, right: DataFrame, product, schema: str) -> DataFrame:
    """product(left rows, right rows) for each pair of tiles; one pair is in memory at a time."""
    x = left.join(broadcast_if(pairs.withColumnRenamed("a", "tile"), 100_000), "tile").groupBy("tile", "b")
    y = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).join(broadcast_if(pairs.select(F.col("a").alias("r_a"), F.col("b").alias("r_tile")), 100_000), "r_tile").groupBy("r_a", "r_tile")

    def run(key: tuple, f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        return product(f, g.rename(columns=lambda c: c[2:]))

    return x.cogroup(y).applyInPandas(run, schema)
