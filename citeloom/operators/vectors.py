"""Embedding tables: imputation, neighbours, outliers, projection, label positions.

Columns of inputs must not begin with an underscore: such names are used inside.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import abbreviate
from citeloom.functions.vectors import distance
from citeloom.operators.leaders import label_leaders
from citeloom.operators.projection import numbered, principal_axes
from citeloom.plans.checkpoint import sized_broadcast, written


def mean_vector(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row with the element-wise mean (null without rows); partial sums meet once for each element."""
    parts = vectors.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean")).select(F.when(F.size("mean") > 0, F.col("mean")).alias("mean"))


def imputed(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding, found): each id's vector, or the mean of those of the ids that have one."""
    rows = ids.select(key).join(vectors.select(key, F.col("embedding").cast("array<double>").alias("_e")), key, "left")
    mean = mean_vector(rows.where("_e is not null"), "_e")
    return rows.join(F.broadcast(mean), F.lit(True)).select(key, F.coalesce("_e", "mean").alias("embedding"), F.col("_e").isNotNull().alias("found"))


def nearest(vectors: DataFrame, query_id, key: str, k: int = 5) -> DataFrame:
    """The k rows nearest to the row query_id by Euclidean distance, itself left out by id."""
    query = vectors.where(F.col(key) == query_id).select(F.col("embedding").alias("_q")).limit(1)
    rows = vectors.where(F.col(key) != query_id).join(F.broadcast(query), F.lit(True))
    return rows.select(key, distance(F.col("embedding"), F.col("_q")).alias("distance")).orderBy("distance", key).limit(k)


def _nearest_in_tile(k: int):
    """The k rows of a tile nearest to each of its queries: found by a product of matrices, then compared exactly."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        src, dst, far = [], [], []
        if rows.num_rows and queries.num_rows:
            read = lambda t: (t["_n"].to_numpy(), t["_v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
            (n, v), (m, w) = read(rows), read(queries)
            vv, ww = (v * v).sum(1), (w * w).sum(1)
            most = min(k, len(n)) - 1
            for at in range(0, len(m), 256):
                square = vv + ww[at : at + 256, None] - 2 * w[at : at + 256] @ v.T
                square[m[at : at + 256, None] == n] = np.inf
                # What rounding may have put behind the k-th is compared too.
                limit = np.partition(square, most, axis=1)[:, most] + 1e-9 * (1 + vv.max() + ww[at : at + 256])
                for i, line in enumerate(square):
                    near = np.flatnonzero((line <= limit[i]) & np.isfinite(line))
                    exact = np.sqrt(((v[near] - w[at + i]) ** 2).sum(1))
                    first = np.lexsort((n[near], np.round(exact, 9)))[:k]
                    src.append(np.full(len(first), m[at + i]))
                    dst.append(n[near[first]])
                    far.append(exact[first])
        whole = lambda parts, kind: pa.array(np.concatenate([np.empty(0), *parts]).astype(kind))
        return pa.table([whole(src, np.int64), whole(dst, np.int64), whole(far, np.float64)], ["src", "dst", "distance"])

    return run


def nearest_of_many(vectors: DataFrame, wanted: DataFrame, key: str, k: int = 5, chunk: int = 4096) -> DataFrame:
    """(key, neighbour, rank, distance): the k rows nearest to each row that wanted (key) names, itself left out.

    The search is exact: rows and queries are cut into chunks, each two chunks meet in a tile of a task, and a tile returns at
    most k rows a query, of which a window keeps the k nearest. Work is rows times queries, spread evenly over tiles, so
    wanted should be a small share of the rows; neighbour_edges() finds about the nearest of all rows in less. Distances are
    ranked by nine digits, then by key. Keys must be unique and vectors of one length; unusable vectors (null, or with null or
    non-finite entries) are neither found nor answered, and names without a row have no answer. Repeated names count once.
    """
    rows = numbered(vectors, key)
    asked = written(rows.join(sized_broadcast(written(wanted.select(key).distinct(), "wanted")), key, "left_semi"), "asked")
    across, down = max(1, ceil(rows.count() / chunk)), max(1, ceil(asked.count() / chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("_n", "_v", F.pmod("_n", F.lit(across)).cast("int").alias("_a"), every(down).alias("_b"))
    right = asked.select("_n", "_v", every(across).alias("_a"), F.pmod(F.xxhash64("_n"), F.lit(down)).cast("int").alias("_b"))
    found = left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(_nearest_in_tile(k), "src long, dst long, distance double")
    nearest_first = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    found = found.withColumn("rank", F.row_number().over(nearest_first).cast("long")).where(F.col("rank") <= k)
    names = lambda number, name: rows.select(F.col("_n").alias(number), F.col(key).alias(name))
    return found.join(names("src", key), "src").join(names("dst", "neighbour"), "dst").select(key, "neighbour", "rank", "distance")


def without_outliers(vectors: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Rows nearer than threshold to the mean of all."""
    rows = vectors.join(F.broadcast(mean_vector(vectors)), F.lit(True))
    return rows.withColumn("distance", distance(F.col("embedding"), F.col("mean"))).where(F.col("distance") < threshold).drop("mean")


def project_2d(vectors: DataFrame, key: str) -> DataFrame:
    """(key, x, y) on the two principal axes; neighbour_layout() starts from them and keeps neighbours together."""
    return principal_axes(vectors, key)


def plot_labels(points: DataFrame, radius: float = 4.0) -> DataFrame:
    """(label, short, x, y, size): the leaders of label_leaders() with the short form of their label beside its full name."""
    return label_leaders(points, radius).select("label", abbreviate(F.col("label")).alias("short"), "x", "y", "size")


def sampled_with_replacement(rows: DataFrame, key: str, rate: float, seed: str = "background", share_of: DataFrame | None = None) -> DataFrame:
    """(draw, key) for floor(rate * n) draws from rows with replacement, drawn by hash over dense row numbers.

    n counts share_of, or rows where that isn't given. Without rows there are no draws.
    """
    from citeloom.operators.graph import by_hash, ranked

    pool = rows.count()
    draws = rows.sparkSession.range(1, floor(rate * (pool if share_of is None else share_of.count())) + 1).withColumnRenamed("id", "draw")
    number = F.conv(F.substring(F.md5(F.concat_ws("\t", F.lit(seed), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    numbered = ranked(rows.select(key), by_hash(seed, key), "nth")
    return draws.select("draw", (number % max(1, pool) + 1).alias("nth")).join(numbered, "nth").select("draw", key)


def plot_points(targets: DataFrame, topics: DataFrame, vectors: DataFrame, key: str, rate: float, threshold: float = 100.0) -> DataFrame:
    """The points of a plot: (key, task, topic, embedding, distance).

    targets: key, task; each gets its task's topic, which must exist in topics (key, value). The background is a sample
    with replacement of floor(rate * all vectors) other vectors, with null task and topic. Targets without a vector are
    left out; so are points at a distance of threshold or more from the mean of all points.
    """
    from citeloom.operators.linkage import strict_lookup

    named = strict_lookup(targets.select(key, "task"), "task", topics, "topic").select(key, "task", "topic")
    others = vectors.join(targets.select(key), key, "left_anti")
    drawn = sampled_with_replacement(others.select(key), key, rate, share_of=vectors).select(key)
    nothing = [F.lit(None).cast(named.schema[c].dataType).alias(c) for c in ("task", "topic")]
    points = named.unionByName(drawn.select(key, *nothing)).join(vectors.select(key, "embedding"), key)
    return without_outliers(points, threshold).select(key, "task", "topic", "embedding", "distance")
