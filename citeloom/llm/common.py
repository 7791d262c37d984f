"""Shared pieces of the training-data operators: scratch tables, word hashing, bucketed running totals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import forget, made, scratch_path, shared_folder, sized_broadcast
from citeloom.plans.checkpoint import written as materialize

__all__ = ["forget", "made", "materialize", "scratch_path", "shared_folder", "sized_broadcast"]

#: White space that separates words: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def buckets(spark: SparkSession) -> int:
    """How many buckets to deal rows into: the session's shuffle partitions, which are sized to the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(col: Column) -> Column:
    """A to Z lower-cased, all else kept."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(df: DataFrame, value: str, out: str, bucket: str, order: Sequence[Column | str], keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running total of value in (bucket, order) order, per keys, without one task for all rows.

    bucket is a whole number that never falls along the order. Rows are summed per (keys, bucket); these sums get offsets
    from windows over ranges of 1024 buckets, the ranges from one window over their sums, and a last window runs inside
    each bucket. keys may hold nulls.
    """
    part = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    tag = F.concat_ws("\x00", *[F.concat(F.col(k).isNull().cast("string"), p) for k, p in zip(keys, part)]) if keys else F.lit("")
    sums = df.groupBy(tag.alias("_k"), F.col(bucket).cast("long").alias("_b")).agg(F.sum(value).alias("_s")).withColumn("_g", F.shiftright("_b", 10))
    before = lambda by, at: F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.groupBy("_k", "_g").agg(F.sum("_s").alias("_s")).select("_k", "_g", before(["_k"], "_g").alias("_base"))
    offsets = sums.select("_k", "_g", "_b", before(["_k", "_g"], "_b").alias("_inner")).join(ranges, ["_k", "_g"])
    offsets = offsets.select("_k", "_b", (F.col("_base") + F.col("_inner")).alias("_offset"))
    rows = df.withColumn("_k", tag).withColumn("_b", F.col(bucket).cast("long")).join(offsets, ["_k", "_b"])
    inside = F.sum(value).over(Window.partitionBy("_k", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, F.col("_offset") + inside).drop("_k", "_b", "_offset")


_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (splitmix64's finaliser)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def ascii_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z lower-cased, as UTF-8. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle; no words, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    h = mix(w[: n - width + 1] + _M3)
    for j in range(1, width):
        h = mix(h * _M3 + w[j : n - width + 1 + j])
    return np.unique(h)
