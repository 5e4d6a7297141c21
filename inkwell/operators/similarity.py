"""Cosine similarity over unit vectors: tiled pairs, match percentages, greedy near duplicates, cross-document clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.blocks import met, reaching, summaries, tiled
from inkwell.sources.shared import written

TILE = 4096


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", group: str | None = None, tile: int = TILE) -> DataFrame:
    """Pairs a < b with a product >= threshold (and, with group, from different groups).

    Vectors lie in compact tiles; only tiles whose bounds let them hold such a pair meet, as one matrix product, and only
    pairs that pass leave it. Exact: the bound is the largest product that two balls allow.
    """
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    tiles = tiled(vectors.select(F.col(key).cast("long").alias("id"), "embedding", g.alias("g")).where("id is not null"), tile)
    s = summaries(tiles)
    pairs = reaching(s, s, threshold).where("a <= b")

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64"})
        dots = np.stack(x["embedding"]).astype(np.float64) @ np.stack(y["embedding"]).astype(np.float64).T
        i, j = np.nonzero(dots >= threshold)
        a, b = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
        ok = (a < b) if x["tile"].iloc[0] == y["tile"].iloc[0] else a != b
        if group:
            ok &= x["g"].to_numpy()[i] != y["g"].to_numpy()[j]
        return pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "similarity": dots[i, j][ok]})

    return met(pairs, tiles, tiles, product, "a long, b long, similarity double")


def match_percentages(vectors: DataFrame, threshold: float, key: str = "vec_id", group: str | None = None, eligible: Column | None = None) -> DataFrame:
    """Each vector's best match elsewhere, in percent; 0 under the threshold. eligible: which rows may match (long enough, no duplicates)."""
    p = similar_pairs(vectors if eligible is None else vectors.where(eligible), threshold, key, group)
    best = p.select("a", "similarity").unionByName(p.select(F.col("b").alias("a"), "similarity")).groupBy("a").agg(F.max("similarity").alias("s"))
    return vectors.select(key).join(best.withColumnRenamed("a", key), key, "left").select(key, F.coalesce(F.round(F.least(F.col("s"), F.lit(1.0)) * 100, 2), F.lit(0.0)).alias("match_pct"))


def greedy_near_duplicates(pairs: DataFrame) -> DataFrame:
    """Ids that a scan in id order drops: those with an earlier similar id that the scan keeps.

    Each round decides every id all of whose earlier neighbours are decided, the smallest open id at least; rounds follow
    the longest such chain and end when nothing is open. A written table cuts the lineage of each round.
    """
    pairs = written(pairs.select("a", "b").where("a < b"), "greedy-pairs")
    state = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    while True:
        seen = pairs.join(state.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.count_if(F.col("kept").isNull()).alias("open"))
        state = state.join(seen.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce(F.col("kept"), F.when(F.col("hit"), False).when(F.coalesce(F.col("open"), F.lit(0)) == 0, True)).alias("kept"))
        state = written(state, "greedy")
        if state.where("kept is null").isEmpty():
            return state.where("not kept").select("id")


def components(links: DataFrame) -> DataFrame:
    """links (a, b): node and root, the smallest node of its component, for every node that has a link.

    Every node points at its smallest neighbour (a minimum, so hubs are pre-aggregated) and chains are halved until they
    are flat; links between different roots go to the next round. Rounds are logarithmic; each is a written table.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = None
    while True:
        up = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
            jumped = written(up.join(above, "root").select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), "up")
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        step = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        label = up if label is None else written(label.join(step, "root", "left").select("node", F.coalesce("over", "root").alias("root")), "label")
        side = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = edges.join(side("a"), "a").join(side("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = written(edges, "edges")
        if edges.isEmpty():
            return label


def clusters(pairs: DataFrame, vectors: DataFrame, threshold: float, key: str = "vec_id", group: str = "label") -> DataFrame:
    """id, cluster_id: components over the pairs, members near their centroid, from two groups at least; numbered by their first member.

    Numbers come from counts over ranges of roots, so no task holds all of them.
    """
    member = components(pairs).join(vectors.select(F.col(key).alias("node"), "embedding", F.col(group).alias("g")), "node")
    parts = member.select("root", F.col("node").alias("id"), "g", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("root", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy("root").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    near = parts.join(mean, ["root", "i"]).groupBy("root", "id", "g").agg(F.sum(F.col("x") * F.col("m")).alias("dot")).join(norm, "root").where(F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0) >= threshold)
    near = written(near.select("root", "id", "g"), "near")
    good = near.groupBy("root").agg(F.count_distinct("g").alias("n")).where("n >= 2").select("root")
    return near.join(numbered(good, "root").withColumnRenamed("number", "cluster_id"), "root").select("id", "cluster_id")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with number, from 1 in the order of a distinct column: ranges are numbered by themselves and shifted by what lies before them."""
    ranged = written(rows.repartitionByRange(by).withColumn("_p", F.spark_partition_id()), "ranged")
    size = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as partitions
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(by))
    return ranged.join(F.broadcast(before), "_p").withColumn("number", (within + F.col("_before")).cast("int")).drop("_p", "_before")


def pairwise_report(pairs: DataFrame, chunks: DataFrame, min_similarity: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b, similarity) of chunks (id, doc_id, section): the best similarity of each ordered pair of documents, and of their sections."""
    side = lambda c: chunks.select(F.col("id").alias(c), F.col("doc_id").alias(f"doc_{c}"), F.col("section").alias(f"section_{c}"))
    m = pairs.where(F.col("similarity") >= max(min_similarity, 0.75)).join(side("a"), "a").join(side("b"), "b").where("doc_a <> doc_b")
    turn = m.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b"), F.col("section_b").alias("section_a"), F.col("section_a").alias("section_b"), "similarity")
    both = m.select("doc_a", "doc_b", "section_a", "section_b", "similarity").unionByName(turn)
    per_doc = both.groupBy("doc_a", "doc_b").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("matches"))
    per_section = both.groupBy("doc_a", "doc_b", "section_a", "section_b").agg(F.max("similarity").alias("similarity"))
    return per_doc, per_section
