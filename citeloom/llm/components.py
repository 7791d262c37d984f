"""Connected components: one task for graphs of checked, small size; alternating star contractions beyond."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import forget, made, materialize

#: Edges that one task may join; at 16 bytes each and a few hundred a node in Python this is under 100 MB.
SMALL = 200_000


def _joined(batches, kind: pa.DataType):
    """(node, root) of all edges of one task, by union-find towards the smaller id."""
    above: dict = {}

    def root(x):
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
            above.setdefault(u, u)
            above.setdefault(v, v)
    ends = [(x, r) for x in above if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], kind) for i in (0, 1)], ["node", "root"])


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v: comparable ids) to (node, root): root is the smallest id that node can reach.

    Only nodes with an edge to another node are listed, and a root is not listed itself. Up to SMALL edges are joined in one
    task. Of more, large-star and small-star steps alternate until the edge set stands still, in O(log² n) rounds; each
    round is a few key-wise minima and joins, never a whole component in one task, and nothing comes to the driver. Every
    round is written to the shared folder. Null ends, self-edges and repeated edges are ignored; no edges give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, mark = edges.sparkSession, made()
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.limit(SMALL + 1).count() <= SMALL:
        kind = edges.schema["u"].dataType
        small = now.repartition(1).mapInArrow(lambda batches, of=to_arrow_type(kind): _joined(batches, of), f"node {kind.simpleString()}, root {kind.simpleString()}")
        out = materialize(small, "components")
        forget(spark, mark, keep=out)
        return out
    last, count = None, _signature(now)
    while count[0] and last != count:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        forget(spark, mark, keep=now)
        last, count = count, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
