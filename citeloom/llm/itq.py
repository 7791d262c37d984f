"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, sized_broadcast
from citeloom.llm.components import connected_components

#: Bits of a table and tables of a shell, at most; both are chosen from the sample.
MAX_BITS, MAX_TABLES = 32, 64
#: Pairs at the threshold that the tables of a shell must find, by the model in Index.
AIM = 0.97
#: Lower limits of the shells, in units of the largest distance between linked unit vectors.
SHELLS = (0.0, 0.75, 1.0, 1.4, 2.0, 2.75, 3.75)
#: What sending a row to a table costs, in comparisons.
ROW_COST = 64
#: Rows that meet each other in one step; larger buckets are cut into blocks, and every two blocks meet.
BLOCK = 4096


@dataclass(frozen=True)
class Index:
    """Learned projections of centred vectors, and for each shell its (tables, bits of a table).

    Linked unit vectors are at most reach = sqrt(2 - 2 threshold) apart, wherever the mean lies. Two points at radius r
    around the mean differ by an angle of at most 2 asin(reach / 2r), so they agree on a bit with probability 1 - angle /
    pi. Points near the mean (as when all vectors share a large component) therefore need shorter codes and more tables.
    Points are dealt into shells by radius. A pair is sought in the shell of its inner point; outer points within reach
    are entered there too.
    """

    mean: np.ndarray
    projection: np.ndarray
    width: int
    reach: float
    plan: tuple[tuple[int, int], ...]

    def limits(self) -> np.ndarray:
        return np.array(SHELLS) * self.reach

    def bits(self, x: np.ndarray, tables: int) -> np.ndarray:
        """Sign bits of the first tables: vector, table, bit."""
        return ((x - self.mean) @ self.projection[:, : tables * self.width] > 0).reshape(len(x), tables, self.width)

    def shells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own shell, and the innermost it is entered in."""
        radius = np.linalg.norm(x - self.mean, axis=1)
        own = np.searchsorted(self.limits(), radius, "right") - 1
        return own, np.maximum(np.searchsorted(self.limits(), radius - self.reach - 1e-9, "right") - 1, 0)


def codes(bits: np.ndarray, width: int) -> np.ndarray:
    """The first width bits of each table as a number: one row for each vector, one column for each table."""
    return bits[:, :, :width] @ (1 << np.arange(width, dtype=np.int64)) if width else np.zeros(bits.shape[:2], np.int64)


def tables_needed(radius: float, reach: float, width: int) -> int:
    """How many tables of width bits find AIM of the pairs that are reach apart at this radius."""
    if not width:
        return 1
    half = reach / (2 * radius) if radius > 0 else 1.0
    agree = (1 - 2 * np.arcsin(min(1.0, half)) / np.pi) ** width
    return max(1, int(np.ceil(np.log(1 - AIM) / np.log1p(-agree)))) if 1e-9 < agree < 1 else MAX_TABLES + 1


def rotations(x: np.ndarray, bits: int, rounds: int = 20, rows: int = 2048, seed: int = 0) -> np.ndarray:
    """Projections for so many bits of centred rows, by iterative quantisation on their principal axes.

    Each rotation of the axes (all up to 64) starts at random and alternates: codes by sign, then the rotation that best
    fits the codes (orthogonal Procrustes) of so many rows, each rotation from rows of its own. In few dimensions all starts end in one rotation, whose boundaries would part
    the same pairs in every table; there only the first is learned and the others stay random.
    """
    rng, have, out = np.random.default_rng(seed), 0, []
    dim = x.shape[1]
    axes = np.linalg.svd(x, full_matrices=False)[2][: min(dim, 64)].T if len(x) > dim else np.eye(dim)
    v, k = x @ axes, axes.shape[1]
    while have < bits:
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        drawn = v[rng.permutation(len(v))[:rows]]
        for _ in range(rounds if len(v) and (k >= 16 or not out) else 0):
            u, _, w = np.linalg.svd(np.where(drawn @ r > 0, 1.0, -1.0).T @ drawn)
            r = (u @ w).T
        out.append(axes @ r)
        have += k
    return np.ascontiguousarray(np.concatenate(out, axis=1)[:, :bits])


def train(vectors: np.ndarray, labels: np.ndarray, total: int, threshold: float = 0.98, seed: int = 0) -> Index:
    """Learn an index for total vectors from a sample of them (rows of unit length, and numbers for their labels).

    The bits of a shell's tables are those that cost least: rows sent to its tables, and points that meet in them, as the
    sample counts them in one table. Where the sample is too small to tell, each further bit halves those that meet.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    mean = vectors.mean(0)
    trial = Index(mean, rotations(vectors - mean, MAX_BITS, seed=seed), MAX_BITS, reach, ())
    first, (own, low) = trial.bits(vectors, 1), trial.shells(vectors)
    plan = []
    for shell, radius in enumerate(trial.limits()):
        inside = (low <= shell) & (shell <= own)
        if total <= len(vectors) and not (own == shell).any():
            plan.append((1, 0))  # the sample is all there is, and the shell is empty
            continue
        least, best, meet = np.inf, (1, 0), 2.0 * total / len(vectors)
        for width in range(MAX_BITS + 1):
            tables = tables_needed(radius, reach, width)
            if tables > MAX_TABLES:
                break
            met = np.unique(np.stack([labels[inside], codes(first[inside], width)[:, 0]]), axis=1, return_counts=True)[1]
            pairs = (met * (met - 1)).sum()
            meet = pairs / met.sum() * total / len(vectors) if pairs >= 200 else meet / 2
            if tables * (meet + ROW_COST) < least:
                least, best = tables * (meet + ROW_COST), (tables, width)
        plan.append(best)
    width = max(1, *(w for _, w in plan))
    return Index(mean, rotations(vectors - mean, width * max(t for t, _ in plan), seed=seed), width, reach, tuple(plan))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(ends: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (two rows of ends)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[ends[0]], root[ends[1]])
        for side in ends:
            np.minimum.at(root, side, low)
            np.minimum.at(root, before[side], low)
        root = root[root]
        if (root == before).all():
            return root


def _usable(e, dim: int):
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, sample: int = 8192, min_dim: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings (vec_id, embedding, label).

    Rows with equal, non-null labels whose cosine in double precision is at least threshold are linked, if the index finds
    them; none below is. Null and zero vectors, and those with null or non-finite components, link with nothing. Vectors of
    different length never link. n_links counts other rows; component_id is the smallest vec_id that links reach. Equal
    vectors of a label are one point of the index, so copies are never multiplied out. Rows that repeat a vec_id with an
    equal vector count as further rows. The index is fitted on at most sample vectors (the smallest xxhash64(vec_id));
    every vector is indexed, with codes whose length follows the sample, so that at least 0.9 of the pairs are found also
    where all vectors lie close together. A pair is compared in the first table on which it agrees, in a bucket or in two
    blocks of it, and a task returns only counts and one edge for each vector, so nothing grows with the number of links.
    No rows, no rows.
    """
    e = F.col("embedding")
    rows = embeddings.select("vec_id", "label", "embedding")
    sized = rows.where(F.size(e) >= min_dim).groupBy(F.size(e).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    dims = [r["dim"] for r in sized.collect()]
    out = []
    for dim in sorted(dims):  # in practice one
        out.append(_linked(rows.where(_usable(e, dim) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()), threshold, sample))
    kind = embeddings.schema["vec_id"].dataType
    linked = out[0] if out else None
    for more in out[1:]:
        linked = linked.unionByName(more)
    if linked is None:
        linked = embeddings.select(F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).limit(0)
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    found = embeddings.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id").cast(kind)
    return found.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked(rows: DataFrame, threshold: float, sample: int) -> DataFrame:
    """(vec_id, n_links, component_id) of usable rows of one length."""
    points = materialize(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "points")
    drawn = points.select("rep", "label", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(sample).toArrow()
    if not drawn.num_rows:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    of_label = np.unique(np.array(drawn.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
    index = train(_matrix(drawn.column("embedding").combine_chunks()), of_label, points.count(), threshold)

    def coded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2))
            own, low = index.shells(x)
            for shell, (tables, width) in enumerate(index.plan):
                at = np.flatnonzero((low <= shell) & (shell <= own))
                if not len(at):
                    continue
                code = codes(index.bits(x[at], tables), width).astype(np.uint32)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * tables), len(at), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                label, rep, mine = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(own[at] == shell)
                for t in range(tables):
                    bucket = pa.array((np.int64(shell) << 40) | (np.int64(t) << 32) | code[:, t].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([label, rep, bucket, mine, packed], ["label", "rep", "bucket", "mine", "codes"])

    label, rep = (rows.schema[c].dataType.simpleString() for c in ("label", "vec_id"))
    keys = materialize(points.select("label", "rep", "embedding").mapInArrow(coded, f"label {label}, rep {rep}, bucket long, mine boolean, codes binary"), "codes")
    sizes = keys.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("mine").alias("any")).where("n > 1 and any")
    sizes = materialize(sizes.select("label", "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    shared = keys.join(sized_broadcast(sizes), ["label", "bucket"])
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # A row goes to (its block, every later or equal block) and to (every earlier block, its own).
    ways = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, block).alias("low"), F.greatest(b, block).alias("high"), block.alias("own")))
    shared = shared.select("label", "bucket", "rep", "mine", "codes", F.explode(ways).alias("w")).select("label", "bucket", "w.low", "w.high", "w.own", "rep", "mine", "codes")
    shared = shared.join(points.select("rep", "label", "embedding", "copies"), ["rep", "label"])

    def met(key, table):
        low, high = key[2].as_py(), key[3].as_py()
        t = key[1].as_py() >> 32 & 0xFF
        own = table.column("own").to_numpy()
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = _matrix(table.column("embedding").combine_chunks())
        code = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint32).reshape(len(ids), -1)
        mine = table.column("mine").to_numpy()
        a = np.flatnonzero(own == low)
        b = np.flatnonzero(own == high) if low != high else a
        links, ends = np.zeros(len(ids), np.int64), []
        for at in range(0, len(a), 512):
            part = a[at : at + 512]
            near = (x[part] @ x[b].T >= threshold) & (mine[part][:, None] | mine[b])
            if low == high:
                near[np.arange(len(part)), np.arange(at, at + len(part))] = False
            i, j = np.nonzero(near)
            if t and len(i):
                first = ~(code[part[i], :t] == code[b[j], :t]).any(1)
                i, j = i[first], j[first]
            i, j = part[i], b[j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64)
            if low != high:
                links += np.bincount(j, copies[i], len(ids)).astype(np.int64)
            ends.append(np.stack([i, j]))
        order = np.argsort(ids)
        root = _roots(np.argsort(order)[np.concatenate(ends, axis=1)] if ends else np.zeros((2, 0), np.int64), len(ids))
        roots = ids[order][root][np.argsort(order)]
        hit = links > 0
        return pa.table({"rep": pa.array(ids[hit]), "links": pa.array(links[hit]), "root": pa.array(roots[hit])})

    near = materialize(shared.groupBy("label", "bucket", "low", "high").applyInArrow(met, f"rep {rep}, links long, root {rep}"), "near")
    counts = near.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(near.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "root")
    found = points.select("label", "embedding", "rep", "copies").join(counts, "rep", "left").join(roots, "rep", "left")
    found = materialize(found.select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "found")
    same = points.where("copies > 1").select("label", "embedding", "rep")
    single = points.where("copies = 1").select(F.col("rep").alias("vec_id"), "rep")
    copies = rows.join(same, ["label", "embedding"]).select("vec_id", "rep")
    return single.unionByName(copies).join(found, "rep").select("vec_id", "n_links", "component_id")
