"""Exact top-k inner-product search with dual cover trees.

Vectors are dealt to compact blocks: each goes to the nearest of some centers (vectors with the smallest id hashes, a
bounded number of them), and a cell of more than a block's size is split by hash. Each block of candidates and each block
of queries becomes a tree. A node covers its points with a ball; the level below has scale half the node's radius: its
centers, found farthest first, are more than that scale apart and every point lies within it of one of them. Centers that
would cover nothing but themselves stay in a bucket of the node, so vectors without any structure give flat trees.

First each block of queries is searched against the candidate block of its own cell, which gives every query a kth score.
Then only the pairs of blocks go on whose best possible product c_q c_c + r_q |c_c| + r_c |c_q| + r_q r_c reaches the worst
kth score of the query block. Pairs of trees are searched together from these scores on; pairs of nodes are left out by the
same bound, and in a pair of buckets the queries whose own bound q c_c + |q| r_c stays under their kth score. What is left
is multiplied as matrices.

Exact: components are integers, products (which must fit 64 bits) are computed exactly, ties go to the smaller id, and of
equal vectors the k + 1 smallest ids are kept (no other can be among the k best). Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id; vectors of another length are not compared. Repeated rows
of an id count once. Extra columns are ignored. An empty table has no results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import ship, small_side, written

ship(__name__)

BLOCK = 2048
QUERY_BLOCK = 512
LEAF = 128
QUERY_LEAF = 32
#: Cells: at most so many centers, and about one for each so many vectors.
CENTERS = 4096


def build(points: np.ndarray, leaf: int) -> dict:
    """Nodes in preorder: [from, to) rows of the subtree, [from, own) of its bucket, next node after it, center, radius, scale."""
    order: list[int] = []
    nodes: list[list] = []

    def grow(rows: np.ndarray, center: np.ndarray) -> None:
        at = len(nodes)
        far = np.sqrt(((points[rows] - center) ** 2).sum(1))
        radius = float(far.max())
        nodes.append([len(order), 0, 0, 0, center, radius, radius / 2])
        bucket, parts = rows, []
        if len(rows) > leaf and radius > 0:
            chosen, owner = _cover(points[rows], far, radius / 2)
            size = np.bincount(owner, minlength=len(chosen))
            # a center that covers nothing but itself stays in the bucket
            bucket = rows[size[owner] == 1]
            parts = [(rows[owner == i], points[rows[c]]) for i, c in enumerate(chosen) if size[i] > 1]
        order.extend(bucket)
        nodes[at][2] = len(order)
        for part, c in parts:
            grow(part, c)
        nodes[at][1], nodes[at][3] = len(order), len(nodes)

    if len(points):
        grow(np.arange(len(points)), points.mean(0))
    column = lambda i: [x[i] for x in nodes]
    return {
        "order": np.array(order, np.int64), "from": column(0), "to": column(1), "own": column(2), "next": column(3),
        "center": np.array(column(4)), "radius": np.array(column(5)), "scale": np.array(column(6)),
    }


def _cover(points: np.ndarray, far: np.ndarray, scale: float) -> tuple[list[int], np.ndarray]:
    """Centers more than ``scale`` apart, and the center within ``scale`` of every point: farthest first."""
    chosen = [int(far.argmax())]
    near = np.sqrt(((points - points[chosen[0]]) ** 2).sum(1))
    owner = np.zeros(len(points), np.int64)
    while near.max() > scale:
        chosen.append(int(near.argmax()))
        d = np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1))
        owner[d < near] = len(chosen) - 1
        near = np.minimum(near, d)
    return chosen, owner


def _slack(bound: np.ndarray) -> np.ndarray:
    """Room for rounding: bounds are floats, scores are whole numbers."""
    return bound + 1e-9 * np.abs(bound) + 1e-3


def search(queries: tuple, candidates: tuple, k: int, least: np.ndarray | None = None, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, points, tree) twice: query ids, candidate ids and scores of the k best for each query, its own id left out.

    least: a score for each query below which nothing is wanted. counts: gets the products made and those of all pairs.
    """
    qi, q, qt = queries
    ci, c, ct = candidates
    least = np.full(len(qi), -np.inf) if least is None else least.astype(np.float64)
    q, qi, least, c, ci = q[qt["order"]], qi[qt["order"]], least[qt["order"]], c[ct["order"]], ci[ct["order"]]
    qlen = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    qf = q.astype(np.float64)
    most = float(max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))) ** 2 * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 30 else object
    q, c = (q.astype(kind), c.astype(kind)) if kind is not object else (np.array([[int(x) for x in r] for r in q], object), np.array([[int(x) for x in r] for r in c], object))
    rank = np.empty(len(ci), np.int64)
    rank[np.argsort(ci, kind="stable")] = np.arange(len(ci))
    whole = np.int64 if kind is not object else object
    later = ((1 << 32) - 1 - rank).astype(whole)  # a smaller id is the larger key among equal scores
    low = -(1 << 62) if kind is not object else -(1 << 200)
    top = np.full((len(qi), k), low, dtype=whole)
    kth = least.copy()
    qn, cn = np.sqrt((qt["center"] ** 2).sum(1)), np.sqrt((ct["center"] ** 2).sum(1))
    bound = _slack(qt["center"] @ ct["center"].T + qt["radius"][:, None] * cn[None, :] + qn[:, None] * ct["radius"][None, :] + qt["radius"][:, None] * ct["radius"][None, :])
    made = 0

    def children(t: dict, i: int) -> list[int]:
        out, j = [], i + 1
        while j < t["next"][i]:
            out.append(j)
            j = t["next"][j]
        return out

    below = [children(qt, i) for i in range(len(qt["from"]))], [children(ct, i) for i in range(len(ct["from"]))]

    def multiply(a: int, b: int) -> None:
        """The bucket of a query node with the bucket of a candidate node."""
        nonlocal made
        rows, cols = np.arange(qt["from"][a], qt["own"][a]), slice(ct["from"][b], ct["own"][b])
        n = ct["own"][b] - ct["from"][b]
        if not len(rows) or not n:
            return
        rows = rows[_slack(qf[rows] @ ct["center"][b] + qlen[rows] * ct["radius"][b]) >= kth[rows]]
        if not len(rows):
            return
        made += len(rows) * n
        keys = ((q[rows] @ c[cols].T).astype(whole) << 32) + later[None, cols]
        keys[qi[rows, None] == ci[None, cols]] = low
        keys = np.concatenate([top[rows], keys], axis=1)
        keys = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k:] if kind is not object else np.sort(keys, axis=1)[:, -k:]
        top[rows] = keys
        worst = keys.min(1)
        kth[rows] = np.maximum(kth[rows], np.where(worst > low, worst >> 32, -np.inf).astype(np.float64) if kind is not object else np.array([float(w >> 32) if w > low else -np.inf for w in worst]))

    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        if bound[a, b] < kth[qt["from"][a] : qt["to"][a]].min():
            continue
        multiply(a, b)
        # The rest of the pair: bucket of a with children of b, children of a with bucket of b, children with children.
        qa, cb = below[0][a], below[1][b]
        for y in cb:
            if qt["own"][a] > qt["from"][a]:
                _bucket_down(a, y, qt, ct, below[1], bound, kth, multiply)
        for x in qa:
            if ct["own"][b] > ct["from"][b]:
                _down_bucket(x, b, qt, below[0], bound, kth, multiply)
        stack.extend(sorted(((x, y) for x in qa for y in cb), key=lambda p: bound[p]))  # the most promising pair first
    if counts is not None:
        counts["made"], counts["all"] = made, len(qi) * len(ci)
    i, j = np.nonzero(top > low)
    key = top[i, j]
    by_rank = np.sort(ci, kind="stable")
    return qi[i], by_rank[((1 << 32) - 1 - (key & ((1 << 32) - 1))).astype(np.int64)], (key >> 32).astype(np.int64)


def _bucket_down(a: int, b: int, qt: dict, ct: dict, below: list, bound: np.ndarray, kth: np.ndarray, multiply) -> None:
    """A query node's bucket with all buckets of a candidate subtree, the best bound first."""
    todo = [b]
    while todo:
        y = todo.pop()
        if bound[a, y] >= kth[qt["from"][a] : qt["own"][a]].min():
            multiply(a, y)
            todo.extend(sorted(below[y], key=lambda z: bound[a, z]))


def _down_bucket(a: int, b: int, qt: dict, below: list, bound: np.ndarray, kth: np.ndarray, multiply) -> None:
    """All buckets of a query subtree with a candidate node's bucket."""
    todo = [a]
    while todo:
        x = todo.pop()
        if bound[x, b] >= kth[qt["from"][x] : qt["to"][x]].min():
            multiply(x, b)
            todo.extend(below[x])


def _block(leaf: int):
    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id")
        points = np.array(f["q"].tolist(), np.float64).reshape(len(f), -1)
        made = build(points, leaf)
        blob = pickle.dumps((f["vec_id"].to_numpy(np.int64), points, made))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "block": ["-".join(map(str, key))], "center": [made["center"][0]], "radius": [float(made["radius"][0])], "blob": [blob]})

    return run


_BLOCKS = "dim int, cell int, block string, center array<double>, radius double, blob binary"


def _pair(k: int):
    """One pair of blocks, with the kth scores that the queries have so far."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        queries = pickle.loads(left["blob"].iloc[0])
        ids, kth = left["ids"].iloc[0], left["kth"].iloc[0]
        known = {} if ids is None else dict(zip(ids, kth))
        least = np.array([known.get(i, -np.inf) for i in queries[0]], np.float64)
        a, b, s = search(queries, pickle.loads(right["blob"].iloc[0]), k, least)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s}).astype("int64")

    return run


def _searched(pairs: DataFrame, asking: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """pairs (qb, cb) of blocks; asking (qb, blob, ids, kth) and trees (cb, blob). One pair is in memory at a time."""
    left = pairs.join(asking, "qb").groupBy("qb", "cb")
    other = pairs.select(F.col("qb").alias("with_qb"), F.col("cb").alias("with_cb"))
    right = other.join(trees.withColumnRenamed("cb", "with_cb"), "with_cb").groupBy("with_qb", "with_cb")
    return left.cogroup(right).applyInPandas(_pair(k), "query_id long, vec_id long, score long")


def quantized(vectors: DataFrame, scale: int = 64, embedding: str = "embedding") -> DataFrame:
    """vec_id, q (integers floor(scale * x)), dim, for the vectors that take part."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where("vec_id is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"), F.size(x).alias("dim")).where("dim > 0")


def _celled(df: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """df with the number of the nearest center of its length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = np.zeros(len(f), np.int64)
            dims = f["dim"].to_numpy()
            for d in np.unique(dims):
                every, c = np.flatnonzero(dims == d), centers[int(d)]
                for i in range(0, len(every), 1000):
                    at = every[i : i + 1000]
                    x = np.array(f["q"].iloc[at].tolist(), np.float64)
                    cell[at] = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            yield f.assign(cell=cell)

    return df.mapInPandas(run, "vec_id long, q array<long>, dim int, cell int")


def topk(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, counts: list | None = None) -> DataFrame:
    """vectors (vec_id, q, dim): query_id, rank, vec_id, score of the k best for each query. is_query: a condition on vec_id.

    counts: gets the number of pairs of blocks searched and of all there are.
    """
    same = Window.partitionBy("dim", F.xxhash64("q"), F.xxhash64(F.lit("second"), F.col("q"))).orderBy("vec_id")
    # The rank limit works in every scan task before its shuffle; repeated ids share a rank and are dropped behind it.
    held = vectors.select("vec_id", "q", "dim").withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    held = written(held.dropDuplicates(["vec_id"]), "candidates")
    asked = written(vectors.select("vec_id", "q", "dim").where(is_query).dropDuplicates(["vec_id"]), "queries")

    # Centers: a bounded sample for each length; their number bounds what is compared and sent.
    sizes = {r[0]: min(CENTERS, max(1, r[1] // block)) for r in held.unionByName(asked).groupBy("dim").agg(F.count(F.lit(1))).collect()}
    pick = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    sample = held.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= CENTERS).groupBy("dim", "_n").agg(F.first("q").alias("q")).collect()
    centers = {d: np.array([r.q for r in sorted(sample, key=lambda r: r._n) if r.dim == d][:n], np.float64).reshape(-1, d) for d, n in sizes.items()}
    if not centers:
        return held.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    centers = {d: c if len(c) else np.zeros((1, d)) for d, c in centers.items()}

    def blocks(df: DataFrame, size: int, leaf: int, name: str) -> DataFrame:
        celled = written(_celled(df, centers), "cells")
        n = celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        dealt = celled.join(small_side(written(n, "sizes", narrow=True)), ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int").alias("part"), "vec_id", "q")
        return written(dealt.groupBy("dim", "cell", "part").applyInPandas(_block(leaf), _BLOCKS), name)

    trees, asking = blocks(held, block, LEAF, "trees"), blocks(asked, query_block, QUERY_LEAF, "asking")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cut = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # First round: each block of queries against one candidate block, that of its cell if there is one, else the nearest.
    q = asking.select("dim", F.col("block").alias("qb"), F.col("cell").alias("qcell"), F.col("center").alias("qc"), F.col("radius").alias("qr"))
    c = trees.select("dim", F.col("block").alias("cb"), F.col("cell").alias("ccell"), F.col("center").alias("cc"), F.col("radius").alias("cr"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    inner = dot(F.col("qc"), F.col("cc"))
    qn, cn = F.sqrt(dot(F.col("qc"), F.col("qc"))), F.sqrt(dot(F.col("cc"), F.col("cc")))
    reach = inner + F.col("qr") * cn + F.col("cr") * qn + F.col("qr") * F.col("cr")
    # The summaries meet in parts of bounded size; only numbers of blocks and their bound leave the join.
    parts = max(1, -(-trees.count() // 2000))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = c.withColumn("part", F.pmod(F.xxhash64("cb"), F.lit(parts)).cast("int"))
    met = q.join(c, ["dim", "part"]).select("qb", "cb", (F.col("qcell") == F.col("ccell")).alias("own"), inner.alias("inner"), (reach + F.abs(reach) * 1e-9 + 1e-3).alias("reach"))
    pairs = written(met, "pairs", narrow=True)
    first = written(pairs.groupBy("qb").agg(F.max_by("cb", F.struct("own", "inner", "cb")).alias("cb")), "first", narrow=True)
    left = asking.select(F.col("block").alias("qb"), "blob")
    right = trees.select(F.col("block").alias("cb"), "blob")
    nothing = {"ids": F.lit(None).cast("array<long>"), "kth": F.lit(None).cast("array<double>")}
    begun = written(_searched(first, left.withColumns(nothing), right, k), "first-round")

    # Second round: the pairs of blocks that can still reach a query's kth score. A query without k results has none.
    owner = asked.select(F.col("vec_id").alias("query_id"))
    kth = begun.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    kth = owner.join(kth, "query_id", "left").select("query_id", F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    ids = asking.select(F.col("block").alias("qb"), "blob").mapInPandas(_ids, "qb string, query_id long")
    known = written(ids.join(kth, "query_id").groupBy("qb").agg(F.collect_list("query_id").alias("ids"), F.collect_list("kth").alias("kth"), F.min("kth").alias("worst")), "known", narrow=True)  # a block's size bounds the lists
    go = pairs.join(first, ["qb", "cb"], "left_anti").join(known.select("qb", "worst"), "qb").where("reach >= worst").select("qb", "cb")
    go = written(go, "going", narrow=True)
    if counts is not None:
        counts += [first.count() + go.count(), pairs.count()]
    rest = _searched(go, left.join(known.select("qb", "ids", "kth"), "qb"), right, k)
    return cut(begun.unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def _ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for block, blob in zip(f["qb"], f["blob"]):
            yield pd.DataFrame({"query_id": pickle.loads(blob)[0]}).assign(qb=block)[["qb", "query_id"]]
