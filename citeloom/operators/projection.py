"""Neighbour graphs of vectors, and a layout in two dimensions that keeps neighbours together.

Columns of inputs must not begin with an underscore: such names are used inside.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.linkage import dense_rank_from_zero
from citeloom.plans.checkpoint import BROADCAST_BYTES, forget, made, sized_broadcast, written

#: Positions are whole multiples of 1 / GRID, so that their sums are exact and don't depend on the order of rows.
GRID = 1 << 20


def numbered(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """(_n, key, _v), written: usable vectors with dense numbers from 0 in the order of their keys, which must be unique.

    Null vectors and those with null or non-finite entries are left out.
    """
    rows = vectors.select(key, F.col(column).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < 1e100)))
    return written(dense_rank_from_zero(rows, key, "_n").select(F.col("_n").cast("long").alias("_n"), key, "_v"), "numbered")


def _codes(pivots: np.ndarray):
    """For each vector and table a code, one bit for each pair of pivots that it may be nearer to, and its place between the first."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for t, pairs in enumerate(pivots):
                # Element by element, as a product of matrices rounds by the size of its batch.
                side = [((v - (p + q) / 2) * (p - q)).sum(1) for p, q in pairs]
                code = np.zeros(len(v), np.int64)
                for s in side:
                    code = code * 2 + (s > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(v), t, np.int32)), pa.array(code), pa.array(side[0])], ["_n", "table", "code", "fine"])

    return run


def _nearest_in_leaf(k: int):
    def run(table):
        n, v = table["_n"].to_numpy(), np.array(table["_v"].to_pylist())
        d = np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in v])
        np.fill_diagonal(d, np.inf)
        src, dst, far = [], [], []
        for i in range(len(n)):
            near = np.lexsort((n, d[i]))[: min(k, len(n) - 1)]
            src += [n[i]] * len(near)
            dst += n[near].tolist()
            far += d[i][near].tolist()
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(far, pa.float64())], ["src", "dst", "distance"])

    return run


def neighbour_edges(rows: DataFrame, k: int = 12, tables: int = 6, leaf: int = 128, seed: str = "pivots") -> DataFrame:
    """(src, dst, distance): about k nearest others of each row of numbered(), by Euclidean distance; a written table.

    In each table a vector's code tells on which side of some hyperplanes it lies, each between two pivot vectors that a hash
    picks; there are about as many codes as leaves. Rows in the order of their codes are cut into leaves of leaf rows, and a
    leaf's rows are compared with each other, so that work is leaf comparisons a row and table, also where a third of all
    vectors are equal. Each row keeps the k nearest of all tables; recall grows with tables and leaf. Up to leaf rows are
    compared completely. The driver gets the pivots: two for each bit of each table.
    """
    n = rows.count()
    bits = max(1, ceil(log2(max(1, n / leaf))) + 1)
    picked = rows.select("_v", F.md5(F.concat_ws("\t", F.lit(seed), F.col("_n").cast("string"))).alias("_h"), "_n").orderBy("_h", "_n").limit(2 * bits * tables).collect()
    pivots = np.array([r["_v"] for r in picked], np.float64)
    if not len(pivots):
        return written(rows.select(F.col("_n").alias("src"), F.col("_n").alias("dst"), F.lit(0.0).alias("distance")), "edges")
    pivots = pivots[np.arange(2 * bits * tables) % len(pivots)].reshape(tables, bits, 2, -1)
    coded = written(rows.select("_n", "_v").mapInArrow(_codes(pivots), "_n long, table int, code long, fine double"), "codes")
    placed = dense_rank_from_zero(coded.select("_n", "table", F.struct("table", "code", "fine", "_n").alias("_at")), "_at", "_rank")
    leaves = written(placed.select("_n", "table", F.floor(F.col("_rank") / leaf).alias("leaf")), "leaves")
    found = leaves.join(sized_broadcast(rows.select("_n", "_v")), "_n").groupBy("table", "leaf").applyInArrow(_nearest_in_leaf(k), "src long, dst long, distance double")
    best = Window.partitionBy("src").orderBy("distance", "dst")
    return written(found.distinct().withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"), "edges")


def principal_axes(vectors: DataFrame, key: str) -> DataFrame:
    """(key, x, y) on the two principal axes; an axis points where its largest coefficient (of equal ones the first) is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("_v"))
    axes = PCA(k=2, inputCol="_p", outputCol="_o").fit(rows.select(array_to_vector("_v").alias("_p"))).pc.toArray().T
    axes = [axis * (1 if axis[np.abs(axis).argmax()] >= 0 else -1) for axis in axes]
    on = lambda axis: F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(c)) for c in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, on(axes[0]).alias("x"), on(axes[1]).alias("y"))


def neighbour_layout(vectors: DataFrame, key: str, k: int = 12, epochs: int = 16, draws: int = 5, pull: float = 0.6, push: float = 2.0, seed: str = "layout") -> DataFrame:
    """(key, x, y): places in the plane in which the k nearest neighbours of a vector stay near it.

    Places begin on the principal axes, within 10 of the middle. In each epoch, one DataFrame round that is written, a vector is
    drawn towards the mean place of its neighbours (edges of neighbour_edges() taken both ways), and pushed from draws other
    vectors, picked by a hash of seed, epoch and number, by their distance's inverse; both steps shrink to nothing over the
    epochs. Places are rounded to multiples of 1 / GRID and summed as whole numbers, so reruns agree. Vectors stay in their
    table; the driver holds two axes and the pivots. Keys must be unique and vectors of one length, at least 2; unusable vectors
    are left out as in numbered(); no vectors give no rows.
    """
    spark = vectors.sparkSession
    rows = numbered(vectors, key)
    n = rows.count()
    if not n:
        return rows.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    one_way = neighbour_edges(rows, k, seed=seed)
    edges = one_way.select("src", "dst").unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    edges = written(edges, "both-ways")
    first = written(principal_axes(rows.select("_n", F.col("_v").alias("embedding")), "_n"), "axes")
    middle = first.agg((F.max("x") + F.min("x")).alias("x"), (F.max("y") + F.min("y")).alias("y"), F.max("x").alias("_x"), F.min("x").alias("_z"), F.max("y").alias("_y"), F.min("y").alias("_w")).first()
    wide = max(middle["_x"] - middle["_z"], middle["_y"] - middle["_w"]) / 20 or 1.0
    grid = lambda c: F.round(c * GRID).cast("long")
    start = lambda c, m: grid(F.round((F.col(c) - m / 2) / wide, 6)).alias(c)
    now = written(first.select("_n", start("x", middle["x"]), start("y", middle["y"])), "places")
    small = n * 64 <= BROADCAST_BYTES
    mark = made() - 1
    for epoch in range(epochs):
        left = 1 - epoch / epochs
        of = now.select(F.col("_n").alias("_other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        of = F.broadcast(of) if small else of
        pulled = edges.select(F.col("src").alias("_n"), F.col("dst").alias("_other")).join(of, "_other").select("_n", F.col("_x").alias("ax"), F.col("_y").alias("ay"), F.lit(1).alias("c"), F.lit(0).cast("long").alias("rx"), F.lit(0).cast("long").alias("ry"))
        drawn = now.withColumn("_other", F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(i), F.col("_n")), F.lit(n)) for i in range(draws)])))
        dx, dy = (F.col("x") - F.col("_x")) / GRID, (F.col("y") - F.col("_y")) / GRID
        weight = 1 / (0.25 + dx * dx + dy * dy)
        pushed = drawn.join(of, "_other").select("_n", F.lit(0).cast("long").alias("ax"), F.lit(0).cast("long").alias("ay"), F.lit(0).alias("c"), grid(dx * weight).alias("rx"), grid(dy * weight).alias("ry"))
        sums = pulled.unionByName(pushed).groupBy("_n").agg(*[F.sum(c).alias(c) for c in ("ax", "ay", "c", "rx", "ry")])
        step = lambda c, a, r: F.round(F.col(c) + left * (pull * F.when(F.col("c") > 0, F.col(a) / F.col("c") - F.col(c)).otherwise(0) + push / draws * F.col(r))).cast("long").alias(c)  # noqa: E731, B023
        now = written(now.join(sums, "_n").select("_n", step("x", "ax", "rx"), step("y", "ay", "ry")), "places")
        forget(spark, mark, keep=now)
        mark = made() - 1
    return rows.select("_n", key).join(now, "_n").select(key, (F.col("x") / GRID).alias("x"), (F.col("y") / GRID).alias("y"))
