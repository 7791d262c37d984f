"""Sharding by a consistent-hash ring with virtual nodes and bounded loads: keys of a full shard go on clockwise."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize
from citeloom.operators.linkage import dense_rank_from_zero

#: Hexadecimal digits of an md5 that make a place on the ring: 60 bits, so that a place is a non-negative long.
DIGITS = 15


def ring(shards: int, virtual: int, seed: str = "ring") -> tuple[np.ndarray, np.ndarray]:
    """(places in ascending order, the shard that owns each): virtual nodes of each shard. A key belongs to the first
    node at or after its own place; beyond the last node the ring begins anew."""
    nodes = sorted((int(md5(f"{seed}:{s}:{v}".encode()).hexdigest()[:DIGITS], 16), s) for s in range(shards) for v in range(virtual))
    return np.array([place for place, _ in nodes], np.int64), np.array([s for _, s in nodes], np.int64)


def room(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard may hold. Without slack the rooms add up to rows and are at most one apart."""
    if slack:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: Sequence[int], owners: np.ndarray, rooms: Sequence[int]) -> list[tuple[int, int, int]]:
    """(first row, shard, first slot) of each run of rows in ring order, from the rows of each arc alone.

    counts[i] are the rows of the arc that ends at node i; the last count is that of the arc beyond the last node, which
    belongs to node 0. Every arc first leaves with its own shard what that has room for, in ring order; what overflows goes
    on clockwise, node by node, to the shards that are not full. So as few rows leave their own shard as the rooms allow.
    """
    left, nodes = list(rooms), [int(s) for s in owners]
    runs: list[list[tuple[int, int]]] = []
    for n, s in zip(counts, [*nodes, nodes[0]], strict=True):
        stay = min(n, left[s])
        left[s] -= stay
        runs.append([(s, stay)])
    for arc, n in enumerate(counts):
        over, at = n - runs[arc][0][1], arc
        while over:
            at += 1
            s = nodes[at % len(nodes)]
            take = min(over, left[s])
            if take:
                left[s] -= take
                over -= take
                runs[arc].append((s, take))
    out, first, used = [], 0, [0] * len(left)
    for s, n in (run for arc in runs for run in arc):
        if n:
            out.append((first, s, used[s]))
            first, used[s] = first + n, used[s] + n
    return out


def _arcs(places: np.ndarray):
    def run(batches):
        counts = np.zeros(len(places) + 1, np.int64)
        for batch in batches:
            counts += np.bincount(np.searchsorted(places, batch.column(0).to_numpy(), "left"), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["arc", "n"])

    return run


def _shards(runs: list[tuple[int, int, int]], rank: int, names: list[str]):
    def run(batches):
        first, shard, slot = (np.array(x, np.int64) for x in zip(*runs, strict=True))
        for batch in batches:
            ranks = batch.column(rank).to_numpy()
            at = np.searchsorted(first, ranks, "right") - 1
            kept = [batch.column(i) for i in range(batch.num_columns) if i != rank]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shard[at].astype(np.int32)), pa.array(slot[at] + ranks - first[at])], names)

    return run


def assign(documents: DataFrame, shards: int = 40, virtual: int = 64, slack: float = 0.0, seed: str = "ring") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of documents (doc_id, text): slots of a shard run from 0 on.

    A row's place on the ring is an md5 of its doc_id. A shard holds its share of the rows, rounded up or down, so that counts
    are at most one apart; with slack, up to (1 + slack) times its share, and fewer rows move when a shard is added. Rows are
    ranked in ring order by a range sort in which rows of one place are parted by text and position, so neither a doc_id nor a
    text that a third of the rows share is a task of its own. Only the rows of each arc are counted on the driver: shards *
    virtual numbers, whatever the input. size is the text's UTF-8 bytes plus 16.

    Null doc_ids are one key, null texts count as empty, repeated rows are rows of their own; no rows give no rows.
    """
    spark = documents.sparkSession
    places, owners = ring(shards, virtual, seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-key:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, DIGITS), 16, 10).cast("long")
    keyed = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("_place"), F.monotonically_increasing_id().alias("_row"))
    keyed = materialize(keyed, "keyed")
    counts = [0] * (len(places) + 1)
    for arc, n in keyed.select("_place").mapInArrow(_arcs(places), "arc long, n long").groupBy("arc").agg(F.sum("n").alias("n")).collect():
        counts[arc] = n
    runs = plan(counts, owners, room(sum(counts), shards, slack))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    if not runs:
        return spark.createDataFrame([], f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    rows = keyed.select("doc_id", "size", "text_crc32", F.struct("_place", "doc_id", "text_crc32", "size", "_row").alias("_at"))
    ranked = dense_rank_from_zero(rows, "_at", "_rank").select("doc_id", "size", "text_crc32", F.col("_rank").cast("long").alias("_rank"))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return ranked.mapInArrow(_shards(runs, 3, names), f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")


def write_shards(documents: DataFrame, folder: str, shards: int = 40, virtual: int = 64, slack: float = 0.0, seed: str = "ring") -> None:
    """documents with all their columns as Parquet under folder, one subfolder shard=n for each shard.

    doc_id must name rows. A shard is as many files as range-sorted tasks have rows of it, in slot order; a column of
    documents named shard or slot is an error.
    """
    if {"shard", "slot"} & set(documents.columns):
        raise ValueError("documents have a column named shard or slot: rename it")
    placed = assign(documents, shards, virtual, slack, seed).select("doc_id", "shard", "slot")
    documents.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
