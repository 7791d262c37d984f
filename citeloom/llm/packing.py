"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import buckets, materialize
from citeloom.llm.tokens import encoder

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[size] items of each size: (number of equal bins, [(size, how many in each), ...]).

    Large items (above a third of the capacity) come first, from the largest down: two at most fit in a bin, and each takes
    the largest partner that fits. Then small items, from the largest down, go to the tightest gap that holds them. Equal
    items and equal bins are handled together, so the work depends on the number of sizes and not of items.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    large = sorted(s for s in left if 3 * s > capacity)
    gaps: dict[int, list] = defaultdict(list)  # gap -> [bins, contents]
    while large:
        s = large[-1]
        n = left[s]
        at = bisect_left(large, capacity - s + 1) - 1
        if at < 0:
            gaps[capacity - s].append([n, [(s, 1)]])
            large.pop()
            continue
        t = large[at]
        if t == s:
            pairs = n // 2
            if pairs:
                gaps[capacity - 2 * s].append([pairs, [(s, 2)]])
            left[s] = n % 2
            if left[s] and at:  # the odd one takes the next largest partner
                t, pairs = large[at - 1], 1
                gaps[capacity - s - t].append([1, [(s, 1), (t, 1)]])
                left[s], left[t] = 0, left[t] - 1
            elif left[s]:
                gaps[capacity - s].append([1, [(s, 1)]])
                left[s] = 0
        else:
            pairs = min(n, left[t])
            gaps[capacity - s - t].append([pairs, [(s, 1), (t, 1)]])
            left[s], left[t] = n - pairs, left[t] - pairs
        large = [x for x in large if left[x]]
    open_gaps = sorted(gaps)

    def put(gap, bins, contents):
        if not gaps[gap]:
            insort(open_gaps, gap)
        gaps[gap].append([bins, contents])

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(open_gaps, s)
            gap = open_gaps[at] if at < len(open_gaps) else None
            group = gaps[gap][-1] if gap is not None else [n, []]
            room = gap if gap is not None else capacity
            each = min(room // s, n)
            bins = min(group[0], n // each)
            group[0] -= bins
            if gap is not None and not group[0]:
                gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            put(room - each * s, bins, [*group[1], (s, each)])
            n -= bins * each
    return [(bins, contents) for groups in gaps.values() for bins, contents in groups]


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Ranges of places, sorted by (size, first rank): columns size, first rank, first sequence, offset.

    The i-th item of a size (from 0) belongs to the last range of its size whose first rank is at most i, in sequence
    first sequence + i - first rank.
    """
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for n, contents in bins:
        offset = 0
        for size, each in contents:
            for _ in range(each):
                out.append((size, used[size], sequence, offset))
                used[size] += n
                offset += size
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each whole document's ids and then end_id, cut only if above capacity.

    Full pieces come last: a long document's first piece holds what is left over. Null and empty texts are one end_id.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py()) + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    of.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """pieces() with sequence_id and offset: places in sequences of at most capacity tokens, gapless from 0.

    The plan is made on the driver from counts per size alone (capacity rows). Pieces of one size are ranked in salted
    buckets, so that a size that many documents share is no single task, and each finds its place by rank. Repeated rows
    and null ids are packed like any others; no rows give no sequences. Columns besides doc_id and text are not read.
    """
    spark = documents.sparkSession
    salted = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets(spark))).cast("int")
    cut = materialize(pieces(documents, path, capacity, end_id).withColumn("salt", salted), "pieces")
    by_salt = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = by_salt.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(counts, capacity))
    first = (table[:, 0] << 44) + table[:, 1]
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "salt"]).withColumn("nth", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(first, (length << 44) + nth, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 2] + nth - table[at, 1]), pa.array(table[at, 3])], [*names, "sequence_id", "offset"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "nth").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
