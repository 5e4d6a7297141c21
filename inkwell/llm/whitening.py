"""Whitening of embeddings by a covariance that is computed in tiles.

Vectors become whole numbers, floor(scale * c) + shift. One pass of exact sums gives the means. Then each partition packs its
rows into blocks of up to ``BLOCK`` rows and cuts these into tiles of columns; the column blocks, whole numbers about the
means' floors in the narrowest type that holds them, are shuffled by row block. Where the blocks of a row block meet, each
pair of tiles is centred (by the means' fractions, so before multiplying) and multiplied, and the products are summed per
tile pair, entry by entry, with partial sums in every task. Only the finished tiles, dimensions squared in all, come to the
driver, which assembles them and finds the eigenvectors. Vectors of more than ``MOST_DIMENSIONS`` are an error, so what the
driver holds is bounded.

Components are unit eigenvectors by falling eigenvalue; of the two signs the one whose largest entry is positive. Those whose
eigenvalue is 0 (under 1e-12 of the trace; fewer rows than dimensions, constant columns) can't be scaled to 1 and are left out.
identity_error is measured on the whitened rows, by the same tiled covariance.

Rows whose vector is null or holds null or non-finite entries take no part, nor do vectors of another length than most have
(of equally frequent lengths the longest counts; empty vectors never). Repeated rows, ids and null ids count each time they
occur. Other columns are ignored. An empty table has no rows. deviation is exact; values that leave 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ship, written

ship(__name__)

BLOCK = 4096
TILE = 32
MOST_DIMENSIONS = 4096
COMPONENTS = 32
#: Eigenvalues below so much of the trace count as 0.
RANK = 1e-12

_BLOCKS = "row_block long, tile int, kind string, rows int, data binary"
_PRODUCTS = "tile_a int, tile_b int, entries array<double>"


def integers(table: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and x, the whole numbers of vectors that take part (of all lengths)."""
    c = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return table.where(fine).select("vec_id", F.transform(c, lambda v: F.floor(v * scale) + F.lit(shift).cast("long")).alias("x"))


def moments(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors, which have the most frequent length: one row per dimension comes to the driver."""
    sizes = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    if sizes is None:
        return 0, []
    d, n = sizes
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; {MOST_DIMENSIONS} at most")
    long = vectors.where(F.size("x") == d).select(F.posexplode("x"))
    sums = long.groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    return n, [int(r["s"]) for r in sorted(sums)]


def _cutter(column: str, floors: list, tile: int, block: int):
    """Rows of a partition as blocks of columns about the floors."""
    d, base = len(floors), np.array(floors)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def cut(part: np.ndarray) -> pd.DataFrame:
            if part.dtype != np.float64:
                most = int(np.abs(part).max())
                part = part.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))
            tiles = [(number, i, part.dtype.str, len(part), np.ascontiguousarray(part[:, i * tile : (i + 1) * tile]).tobytes()) for i in range(-(-d // tile))]
            return pd.DataFrame(tiles, columns=["row_block", "tile", "kind", "rows", "data"])

        for f in frames:
            at = 0
            if not len(f):
                continue
            values = np.array(f[column].tolist()) - base
            while at < len(values):
                take = values[at : at + block - rows]
                held.append(take)
                rows += len(take)
                at += len(take)
                if rows == block:
                    yield cut(np.concatenate(held))
                    number, held, rows = number + 1, [], 0
        if rows:
            yield cut(np.concatenate(held))

    return run


def _multiplier(fractions: np.ndarray, tile: int):
    def run(key, f):
        """One row block: the products of all pairs of its tiles, centred first."""
        parts = {}
        for i, kind, rows, data in zip(f["tile"], f["kind"], f["rows"], f["data"]):
            parts[i] = np.frombuffer(data, kind).reshape(rows, -1).astype(np.float64) - fractions[i * tile : (i + 1) * tile]
        out = [(i, j, (a.T @ b).ravel()) for i, a in parts.items() for j, b in parts.items() if i <= j]
        return pd.DataFrame(out, columns=["tile_a", "tile_b", "entries"])

    return run


def covariance(rows: DataFrame, column: str, n: int, sums: list, tile: int = TILE, block: int = BLOCK) -> np.ndarray:
    """The covariance (divisor n) of an array column of n rows with the given sums per dimension."""
    d = len(sums)
    if isinstance(sums[0], int):
        floors, fractions = [s // n for s in sums], np.array([(s % n) / n for s in sums])
    else:
        floors, fractions = [0.0] * d, np.array(sums) / n
    cut = rows.select(column).mapInPandas(_cutter(column, floors, tile, block), _BLOCKS)
    products = cut.groupBy("row_block").applyInPandas(_multiplier(fractions, tile), _PRODUCTS)
    entries = products.select("tile_a", "tile_b", F.posexplode("entries").alias("entry", "value"))
    tiles = entries.groupBy("tile_a", "tile_b", "entry").agg(F.sum("value").alias("value"))
    out = np.zeros((d, d))
    for i, j, values in tiles.groupBy("tile_a", "tile_b").agg(F.array_sort(F.collect_list(F.struct("entry", "value"))).alias("v")).select("tile_a", "tile_b", "v.value").toLocalIterator():
        a, b = slice(i * tile, min(d, (i + 1) * tile)), slice(j * tile, min(d, (j + 1) * tile))
        out[a, b] = np.array(values).reshape(a.stop - a.start, -1)
        out[b, a] = out[a, b].T
    return out / n


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors as rows, by falling eigenvalue, and the eigenvalues; those without variance left out."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > max(RANK * np.trace(v), 0.0)][:most]
    u = u[:, order].T
    sign = np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)]) if len(u) else np.ones(0)
    return u * sign[:, None], e[order]


def _whitener(n: int, sums: list[int], axes: np.ndarray, roots: np.ndarray):
    floors, rest = np.array([s // n for s in sums]), [s % n for s in sums]
    fractions = np.array([r / n for r in rest])
    exact = np.array(rest, object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            y = np.array(f["x"].tolist()) - floors
            most = n * (int(np.abs(y).max()) + 1)  # n * x - S = n * (x - floor) - rest
            if most * most * y.shape[1] < 1 << 62:
                deviation = ((n * y - np.array(rest)) ** 2).sum(1)
            else:
                deviation = ((n * y.astype(object) - exact) ** 2).sum(1)
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation leaves 64 bits")
            w = ((y - fractions) @ axes.T) / roots
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "deviation": np.array(deviation, np.int64), "w": list(w)})

    return run


def whiten(table: DataFrame, most: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component up to ``most``."""
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    vectors = written(integers(table.select("vec_id", "embedding"), scale, shift), "whole_vectors")
    n, sums = moments(vectors)
    if not n:
        return spark.createDataFrame([], result)
    vectors = vectors.where(F.size("x") == len(sums))
    v = covariance(vectors, "x", n, sums, tile, block)
    axes, e = components(v, most)
    if not len(e):
        return spark.createDataFrame([], result)
    white = written(vectors.mapInPandas(_whitener(n, sums, axes, np.sqrt(e)), "vec_id long, deviation long, w array<double>"), "whitened")
    got = covariance(white, "w", n, [0.0] * len(e), tile, block)  # centred vectors: their means are 0
    error = float(np.abs(got - np.eye(len(e))).max())
    explained = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    rows = white.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return rows.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")
    )
