"""Embedding whitening: streamed moments by rank-one updates, merged over partitions, and a symmetric QR eigen-solve."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from math import copysign, hypot

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import forget, made, materialize

#: Entries become floor(SCALE * c) + SHIFT. Entries of ENTRY or more in size count as not finite, so that x stays a long.
SCALE, SHIFT, ENTRY = 1024, 100_000, float(2**40)
#: States that one merging task reads.
FAN = 32
#: A component whose eigenvalue is below this share of the first has no variance that double precision can tell.
FLAT = 1e-9

_STATE = "part long, n long, sums array<decimal(38,0)>, mean array<double>, m2 array<double>"


@dataclass(frozen=True)
class Moments:
    """n vectors: exact sums of whole-numbered entries (else None), means, and the sum of centred products."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    m2: np.ndarray


def _matrix(column) -> np.ndarray:
    """The lists of an Arrow column, of equal length and without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The whole-numbered x of vectors."""
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def _row(part: int, m: Moments) -> pa.RecordBatch:
    sums = pa.array([m.sums and [Decimal(s) for s in m.sums]], pa.list_(pa.decimal128(38, 0)))
    rows = [pa.array([part]), pa.array([m.n]), sums, pa.array([m.mean], pa.list_(pa.float64())), pa.array([m.m2.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(rows, ["part", "n", "sums", "mean", "m2"])


def _streamed(whole: bool):
    """Welford's update, one vector at a time: the mean moves, and the product of both distances from it is added."""

    def run(batches):
        from pyspark import TaskContext

        n, sums, mean, m2 = 0, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0))
            if whole:
                rows = scaled(rows)
                sums = [a + int(b) for a, b in zip(sums or [0] * rows.shape[1], rows.astype(object).sum(0) if abs(rows).max() > 2**40 else rows.sum(0), strict=True)]
            if mean is None:
                mean, m2 = np.zeros(rows.shape[1]), np.zeros((rows.shape[1],) * 2)
            product = np.empty_like(m2)
            for x in rows.astype(np.float64):
                n += 1
                delta = x - mean
                mean += delta / n
                m2 += np.multiply.outer(delta, x - mean, out=product)
        if n:
            yield _row(TaskContext.get().partitionId(), Moments(n, sums, mean, (m2 + m2.T) / 2))

    return run


def _state(row) -> Moments:
    mean = np.array(row["mean"], np.float64)
    return Moments(row["n"], row["sums"] and [int(s) for s in row["sums"]], mean, np.array(row["m2"], np.float64).reshape(len(mean), -1))


def merged(a: Moments, b: Moments) -> Moments:
    """The moments of both: the parallel update formula."""
    n, delta = a.n + b.n, b.mean - a.mean
    sums = a.sums and [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    return Moments(n, sums, a.mean + delta * (b.n / n), a.m2 + b.m2 + np.multiply.outer(delta, delta) * (a.n * (b.n / n)))


def _merge(table):
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    out = _state(rows[0])
    for row in rows[1:]:
        out = merged(out, _state(row))
    return pa.Table.from_batches([_row(rows[0]["part"] // FAN, out)])


def moments(rows: DataFrame, column: str, whole: bool = False) -> Moments | None:
    """The moments of an array column of rows (all of one length, without nulls); of scaled() entries with whole.

    Each partition streams its rows into one state; FAN states at a time are merged in a task, level by level, in the order
    of their partitions. The driver gets the last state: the square of the vector length, whatever the rows. None without rows.
    """
    spark, mark = rows.sparkSession, made()
    states = materialize(rows.select(F.col(column).cast("array<double>")).mapInArrow(_streamed(whole), _STATE), "moments")
    left = states.agg(F.max("part")).first()[0]
    while left is not None:
        states = materialize(states.groupBy(F.floor(F.col("part") / FAN).alias("_of")).applyInArrow(_merge, _STATE), "moments")
        forget(spark, mark, keep=states)
        left = left // FAN or None
    last = states.first()
    forget(spark, mark)
    return _state(last) if last else None


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a symmetric matrix, by falling value.

    Householder reflections make it tridiagonal; then implicit QR steps with Wilkinson's shift chase each off-diagonal entry
    below the rounding of the whole matrix.
    """
    a, n = np.array(matrix, np.float64), len(matrix)
    q = np.eye(n)  # rows become eigenvectors
    least = np.finfo(np.float64).eps * np.linalg.norm(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if (size := np.linalg.norm(v)) > least * 1e-3:  # else the column is done, up to rounding
            v[0] += copysign(size, v[0])
            v /= np.linalg.norm(v)
            a[k + 1 :] -= np.multiply.outer(2 * v, v @ a[k + 1 :])
            a[:, k + 1 :] -= np.multiply.outer(a[:, k + 1 :] @ v, 2 * v)
            q[k + 1 :] -= np.multiply.outer(2 * v, v @ q[k + 1 :])
    d, e, end = a.diagonal().copy(), a.diagonal(-1).copy(), n - 1
    while end > 0:
        e[np.abs(e) <= least] = 0
        if not e[end - 1]:
            end -= 1
            continue
        begin = end - 1
        while begin and e[begin - 1]:
            begin -= 1
        half, last = (d[end - 1] - d[end]) / 2, e[end - 1]
        x, z = d[begin] - (d[end] - last * last / (half + copysign(hypot(half, last), half))), e[begin]
        for k in range(begin, end):
            r = hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                e[k - 1] = r
            p, w, t = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * w + s * s * t, s * s * p - 2 * c * s * w + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * w
            if k + 1 < end:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


def _whitened(fit: Moments, axes: np.ndarray, names: list[str]):
    """axes: components divided by the roots of their eigenvalues, as rows."""

    def run(batches):
        centre, low = np.array([s / fit.n for s in fit.sums]), np.array(fit.sums, object)
        for batch in batches:
            x = scaled(_matrix(batch.column(1))) if batch.num_rows else np.empty((0, len(centre)), np.int64)
            large = fit.n * int(abs(x).max(initial=1)) >= 2**62 or max(map(abs, fit.sums)) >= 2**62
            far = x.astype(object) * fit.n - low if large else x * fit.n - low.astype(np.int64)
            if x.shape[1] * int(abs(far).max(initial=0)) ** 2 >= 2**63:
                far = far.astype(object)
            deviation = pa.array([Decimal(int(v)) for v in (far * far).sum(1)], pa.decimal128(38, 0))
            white = (x - centre) @ axes.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, max(1, len(axes)), dtype=np.int32) if len(axes) else np.zeros(len(x) + 1, np.int32)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names)

    return run


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component from 1 on.

    Entries become whole numbers x = floor(1024 c) + 100000. n and the per-dimension sums S are those of all usable rows;
    the covariance has divisor n, its eigenvectors are numbered by falling eigenvalue e. deviation: the exact sum of
    (n x - S)^2 as decimal(38,0). whitened: x - S/n along the component, over sqrt(e). explained: e over the trace.
    identity_error: the largest absolute entry of the covariance of all whitened values minus the identity, measured.

    Unusable, and left out: null vectors, those that hold null, NaN, infinite or huge (2^40) entries, empty ones, and those of
    another length than the most frequent (of equally frequent lengths the greatest). There are at most as many components
    as dimensions; one without variance (below FLAT of the first) has null in whitened and 0 in explained, and
    identity_error is that of the others (null if there is none). Null and repeated keys are rows of their own; no
    rows give no rows. Other columns don't matter, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", lambda c: c.isNotNull() & (F.abs(c) < ENTRY)))
    kind = rows.schema["_key"].dataType.simpleString()
    length = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], f"{key} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    rows = rows.where(F.size("_v") == length["d"])
    fit = moments(rows, "_v", whole=True)
    values, axes = symmetric_qr(fit.m2 / fit.n)
    values, axes, trace = values[:components], axes[:components], float(np.trace(fit.m2)) / fit.n
    known = int((values > max(values[0], 0) * FLAT).sum())
    white = rows.mapInArrow(_whitened(fit, axes[:known] / np.sqrt(values[:known, None]), ["_key", "deviation", "_w"]), f"_key {kind}, deviation decimal(38,0), _w array<double>")
    white = materialize(white, "whitened")
    again = moments(white, "_w") if known else None
    error = float(np.abs(again.m2 / again.n - np.eye(known)).max()) if again else None
    explained = [float(v / trace) if i < known else 0.0 for i, v in enumerate(values)]
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(len(explained))).alias("component"), F.concat("_w", F.array_repeat(F.lit(None).cast("double"), len(explained) - known)).alias("whitened"), F.array(*map(F.lit, explained)).alias("explained")))
    out = white.select("_key", "deviation", each.alias("_c"))
    return out.select(F.col("_key").alias(key), "_c.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "_c.whitened", "_c.explained", F.lit(error).cast("double").alias("identity_error"))
