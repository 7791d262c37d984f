"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import WORD_PATTERN, materialize, running_total, sized_broadcast

WEIGHTS = (5, 2, 1)
#: Buckets for the shuffled order (2 ** 12) and for virtual time (per unit).
SHUFFLE_BITS, TIME_STEPS = 12, 4096


def words(text: Column) -> Column:
    """The number of words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from sizes (source, size).

    Sources by code point, null last, get the weights in turn. They share share * all sizes by weight; a target stops at
    most * its source's size, and the excess is shared again by weight until none is above: the target is
    min(most * size, level * weight) with one level for all. The windows run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("_weight", turn).withColumn("_cap", F.col("source_size") * float(most)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(all_rows) * float(share)
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward))
    rows = rows.withColumn("_free", F.max(F.when(F.col("_ratio") >= F.col("_level"), F.col("_level"))).over(all_rows))
    return rows.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_free") * F.col("_weight"), F.col("_cap"))).alias("target"))


def mix(documents: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[float] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of documents (doc_id, text, source).

    Documents are shuffled by an md5 of seed and doc_id and queued most times over. A copy's virtual finish time is its
    source's running total of words divided by the source's target; the copies are taken in that order, over all sources,
    up to share * all words. taken is size times the copies taken. Running totals are summed in buckets of the shuffled
    order and of virtual time, so a hot source is no single task. Null texts have size 0 and take nothing; null sources
    are a source of their own; repeated rows are documents of their own; an empty table gives no rows. Reruns agree.
    """
    rows = documents.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_row"))
    mixed_rows = _mix(rows, share, most, weights, seed)
    return mixed_rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _mix(rows: DataFrame, share: float, most: int, weights: Sequence[float], seed: str) -> DataFrame:
    """mix() of rows (doc_id, source, text, _row), with _row, which names a row."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = rows.select("doc_id", "source", words(F.col("text")).alias("size"), "_row").withColumn("_h", h)
    rows = materialize(rows.withColumn("_part", F.shiftright("_h", 60 - SHUFFLE_BITS)), "sizes")
    goal = materialize(targets(rows, share, float(most), weights), "targets")
    rows = running_total(rows, "size", "_total", "_part", ["_h", "doc_id", "size", "_row"], keys=["source"])
    rows = rows.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
    per_source = goal.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "source_size", "target")
    copies = rows.join(per_source, ["_s", "_n"]).withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    copies = copies.withColumn("_finish", F.when(F.col("target") > 0, (F.col("_total") + F.col("_copy") * F.col("source_size")) / F.col("target")))
    copies = copies.withColumn("_time", F.coalesce(F.floor(F.col("_finish") * TIME_STEPS), F.lit(2**40)))
    copies = materialize(copies.select("doc_id", "source", "size", "source_size", "target", "_row", "_h", "_copy", "_finish", "_time"), "queue")
    budget = goal.agg((F.sum("source_size") * float(share)).alias("_budget"))
    copies = running_total(copies, "size", "_running", "_time", ["_finish", "source", "_h", "doc_id", "size", "_row", "_copy"])
    copies = copies.join(F.broadcast(budget), F.lit(True))
    in_mix = F.col("_finish").isNotNull() & (F.col("_running") <= F.col("_budget"))
    return copies.groupBy("_row", "doc_id", "source", "size", "source_size", "target").agg(F.count_if(in_mix).cast("int").alias("copies"))


def mixed(documents: DataFrame, share: float = 1.5, most: int = 2, weights: Sequence[float] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The rows of documents that mix() takes, each as often as it is taken, with all their columns as they are.

    Each row gets its own number of copies, also where doc_id is null or repeats: the rows are written once with a number of
    their own. Rows of size 0 (null or wordless texts) weigh nothing and are dropped. No rows give no rows.
    """
    rows = materialize(documents.select(F.struct(*documents.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    taken = _mix(rows.select("_doc.doc_id", "_doc.source", "_doc.text", "_row"), share, most, weights, seed)
    taken = materialize(taken.where("copies > 0 and size > 0").select("_row", "copies"), "taken")
    return rows.join(sized_broadcast(taken), "_row").select(F.explode(F.array_repeat("_doc", F.col("copies"))).alias("_doc")).select("_doc.*")
