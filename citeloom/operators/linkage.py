"""Record linkage between target documents and a catalogue.

Columns of inputs must not begin with an underscore: such names are used inside.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import dealt, sized_broadcast, task_count, written

# Two target ids that are known to be bad, and what replaces them.
KNOWN_BAD = {
    "0c278ecf472f42ec1140ca2f1a0a3dd60cbe5c48": "9f67b3edc67a35c884bd532a5e73fa3a7f3660d8",
    "1a6b67622d04df8e245575bf8fb2066fb6729720": "f0ccb215faaeb1e9e86af5827b76c27a8d04e5a7",
}


def usable(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def remap_ids(ids: Column, table: Mapping[str, str] = KNOWN_BAD) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ids), ids)


def hash_link(catalogue: DataFrame, targets: DataFrame, key: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """The catalogue row of each target key; of several the last by ordinal wins. max_by keeps one row a key map-side."""
    hits = catalogue.join(targets.select(key).distinct(), key, "left_semi")
    return hits.groupBy(key).agg(*[F.max_by(c, ordinal).alias(c) for c in columns])


def link_or_fetch(ids: DataFrame, links: DataFrame, fetched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linked ids get the link's doc_id and nothing else; all others get the fetched row as a whole.

    ids: id. links: id, doc_id. fetched: id, doc_id and columns.
    """
    rows = ids.join(links.select("id", F.col("doc_id").alias("_linked")), "id", "left").join(fetched, "id", "left")
    linked = usable(F.col("_linked"))
    return rows.select("id", F.when(linked, F.col("_linked")).otherwise(F.col("doc_id")).alias("doc_id"), *[F.when(~linked, F.col(c)).alias(c) for c in columns])


#: Rows of either side of a tile: a key's larger groups of pairs are made in several tasks.
TILE = 1024


def or_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, tile: int = TILE) -> DataFrame:
    """Distinct pairs that agree on any usable key: one equi-join for each key (an OR would be a nested loop).

    left and right have all keys and an id each; the ids' names must differ. A pair is made by the first key it agrees on, so
    nothing is made twice, and only where an id has several different rows are pairs made distinct. Pairs are as many as the
    texts share keys, the square of a frequent key's rows: such a key is cut into tiles of at most about tile by tile rows, and tasks
    follow the number of pairs, which is counted first.
    """
    narrow = lambda rows, id_, side: rows.select(F.col(id_).alias(f"_{side}"), *[F.col(k).alias(f"_{side}{i}") for i, k in enumerate(keys)]).distinct()
    lefts, rights = written(narrow(left, left_id, "l"), "left"), written(narrow(right, right_id, "r"), "right")
    agree = lambda i: F.coalesce(usable(F.col(f"_l{i}").cast("string")) & (F.col(f"_l{i}") == F.col(f"_r{i}")), F.lit(False))
    parts = []
    for i in range(len(keys)):
        mine, theirs = (rows.where(usable(F.col(f"_{side}{i}").cast("string"))).withColumn("_key", F.col(f"_{side}{i}")) for rows, side in ((lefts, "l"), (rights, "r")))
        sizes = mine.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).join(theirs.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "_key")
        sizes = written(sizes, "sizes")
        pairs = sizes.agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0
        cut = sizes.where(F.col("_m") * F.col("_n") > tile * tile).select("_key", F.ceil(F.col("_m") / tile).alias("_a"), F.ceil(F.col("_n") / tile).alias("_b"))
        cut = sized_broadcast(written(cut, "large-keys"))

        def tiled(rows: DataFrame, id_: str, own: str, other: str, cut: DataFrame = cut, pairs: int = pairs) -> DataFrame:
            rows = rows.join(cut, "_key", "left")
            rows = rows.withColumn(own, F.coalesce(F.pmod(F.xxhash64(id_), own), F.lit(0))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)))
            return dealt(rows, pairs, "_key", "_a", "_b")

        found = tiled(mine, "_l", "_a", "_b").join(tiled(theirs, "_r", "_b", "_a"), ["_key", "_a", "_b"])
        for j in range(i):
            found = found.where(~agree(j))
        parts.append(found.select(F.col("_l").alias(left_id), F.col("_r").alias(right_id)))
    out = reduce(DataFrame.unionByName, parts)
    several = lambda rows, id_: not rows.groupBy(id_).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()
    return out.distinct() if several(lefts, "_l") or several(rights, "_r") else out


#: Rounds of priority_match() before what is left is parted into components, and candidates of one that a task finishes.
ROUNDS, SERIAL = 3, 100_000


def _mutual_best(live: DataFrame, most: int | None) -> tuple[list[DataFrame], DataFrame]:
    """(accepted pairs, candidates still open) after at most so many rounds: in each, pairs that are each other's best."""
    accepted: list[DataFrame] = []
    for_rounds = 0
    while for_rounds != most and not live.isEmpty():
        for_rounds += 1
        by_target, by_row = Window.partitionBy("target").orderBy("row"), Window.partitionBy("row").orderBy("priority", "target")
        best = live.withColumn("_t", F.row_number().over(by_target)).withColumn("_r", F.row_number().over(by_row))
        new = written(best.where("_t = 1 and _r = 1").select("row", "target", "priority"), "accepted")
        accepted.append(new)
        if len(accepted) == 16:  # a long chain must not grow the plan
            accepted = [written(reduce(DataFrame.unionByName, accepted), "accepted")]
        live = written(live.join(new.select("row"), "row", "left_anti").join(new.select("target"), "target", "left_anti"), "candidates")
    return accepted, live


def _in_row_order(table):
    """The accepted of one component's candidates: rows in order, each the free target of its smallest priority."""
    import pyarrow as pa

    taken, matched, at = set(), set(), []
    rows, targets = table["row"].to_pylist(), table["target"].to_pylist()
    ordered = table.append_column("_i", pa.array(range(len(rows)))).sort_by([("row", "ascending"), ("priority", "ascending"), ("target", "ascending")])
    for i in ordered["_i"].to_pylist():
        if rows[i] not in matched and targets[i] not in taken:
            matched.add(rows[i])
            taken.add(targets[i])
            at.append(i)
    return table.take(pa.array(at, pa.int64())).select(["row", "target", "priority"])


def priority_match(catalogue: DataFrame, targets: DataFrame, keys: Sequence[str], row: str, target: str, serial: int = SERIAL) -> DataFrame:
    """(row, target, priority): in row order, the first key whose lookup yields a free target claims it; 1:1.

    Per key value the last target (by id) holds the lookup. Each round accepts the pairs of which each is the other's best:
    for a target the smallest row, for a row the smallest priority; accepted rows and targets leave. After ROUNDS rounds only
    chains are left, in which a row waits for the one before. They are parted into connected components of rows and targets, of
    which each with at most serial candidates is finished in row order in one task; only a larger one goes on by rounds.
    Candidates are the small result of equi-joins. Rows and targets without an id are skipped.
    """
    catalogue, targets, parts = catalogue.where(F.col(row).isNotNull()), targets.where(F.col(target).isNotNull()), []
    for priority, key in enumerate(keys):
        lookup = targets.where(usable(F.col(key).cast("string"))).groupBy(key).agg(F.max(target).alias("target"))
        parts.append(catalogue.select(F.col(row).alias("row"), key).join(lookup, key).select("row", "target", F.lit(priority).alias("priority")))
    live = reduce(DataFrame.unionByName, parts)
    live = written(live.groupBy("row", "target").agg(F.min("priority").alias("priority")), "candidates")
    accepted, live = _mutual_best(live, ROUNDS)
    if not live.isEmpty():
        from citeloom.operators.graph import components

        # A row and a target may share an id: they are told apart by a prefix.
        node = lambda side: F.concat(F.lit(side), F.col("row" if side == "r" else "target").cast("string"))
        roots = components(live.select(node("r").alias("src"), node("t").alias("dst")))
        named = written(live.withColumn("node", node("r")).join(roots, "node").drop("node"), "chains")
        large = written(named.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > serial).select("root"), "large")
        small = named if large.isEmpty() else named.join(large, "root", "left_anti")
        schema = ", ".join(f"{c} {live.schema[c].dataType.simpleString()}" for c in ("row", "target", "priority"))
        accepted.append(written(small.groupBy("root").applyInArrow(_in_row_order, schema), "accepted"))
        if not large.isEmpty():
            accepted += _mutual_best(named.join(large, "root", "left_semi").drop("root"), None)[0]
    return reduce(DataFrame.unionByName, accepted) if accepted else live


def forward_mapping(matches: DataFrame, target: str = "target", row: str = "row") -> DataFrame:
    """(target, row): which catalogue row each target was matched to."""
    return matches.select(target, row)


def inverse_mapping(matches: DataFrame, catalogue: DataFrame, row: str, paper: str, target: str = "target") -> DataFrame:
    """(paper, target) of matches (row, target): a paper id that several matched rows share maps to the last of them."""
    named = matches.join(catalogue.select(F.col(row).alias("row"), paper), "row")
    return named.groupBy(paper).agg(F.max_by(target, "row").alias(target))


def chained_lookup(rows: DataFrame, key: str, tables: Sequence[DataFrame], out: str, missing=-1) -> DataFrame:
    """rows with out, the value that key leads to through tables (key, value) in turn, and missed, the hop that failed.

    Where a hop misses (or leads to null), out is missing and missed its number from 1. Keys must be unique in a table.
    """
    now = rows.withColumn("_k", F.col(key)).withColumn("missed", F.lit(None).cast("int"))
    for hop, table in enumerate(tables, 1):
        step = table.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
        now = now.join(step, "_k", "left").withColumn("missed", F.coalesce("missed", F.when(F.col("_v").isNull(), F.lit(hop))))
        now = now.drop("_k").withColumnRenamed("_v", "_k")
    return now.withColumn(out, F.coalesce("_k", F.lit(missing))).select(*rows.columns, out, "missed")


def strict_lookup(rows: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """rows with out, the value of key in table (key, value; keys unique); a key that table lacks is an error."""
    found = rows.join(table.select(F.col("key").alias(key), F.col("value").alias("_v"), F.lit(True).alias("_known")), key, "left")
    lost = F.raise_error(F.concat(F.lit("no entry for: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(table.schema["value"].dataType)
    return found.withColumn(out, F.when(F.col("_known"), F.col("_v")).otherwise(lost)).select(*rows.columns, out)


def first_missing(columns: Sequence[str]) -> Column:
    """The name of the first column that is null, else null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])


def first_copies(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, ordinal, line): the first row of each key, and its rank from 0 among those kept.

    The rank is made from counts per range of ordinals and ranks inside each range, so that no task has to hold all rows.
    """
    first = rows.groupBy(key).agg(F.min(ordinal).alias(ordinal))
    return dense_rank_from_zero(first, ordinal, "line")


def places(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """rows with place, their rank from 0 inside their group by a unique ordinal, without a task for a whole group.

    Rows are ranked over all groups in (group, ordinal) order, and each group's smallest rank is taken off. Null groups are
    a group.
    """
    key = F.struct(F.col(group), F.col(ordinal)).alias("_at")
    ranked = written(dense_rank_from_zero(rows.select("*", key), "_at", "place").drop("_at"), "places")
    first = ranked.groupBy(group).agg(F.min("place").alias("_first")).select(F.col(group).alias("_group"), "_first")
    found = ranked.join(sized_broadcast(written(first, "first-places")), F.col(group).eqNullSafe(F.col("_group")))
    return found.withColumn("place", F.col("place") - F.col("_first")).select(*rows.columns, "place")


def dense_rank_from_zero(rows: DataFrame, ordinal: str, out: str) -> DataFrame:
    """rows with their rank by a unique ordinal: rows are range-sorted, which samples for even ranges whatever the values,
    written with the number of their range and their place in it, and ranked on top of the counts of the ranges before.

    Rows are written first, as the sample reads them once more, and as their number says how many ranges there must be for
    a task to sort TASK_ROWS of them, whatever the number of shuffle partitions.
    """
    rows = written(rows, "unranked")
    ranges = task_count(rows.sparkSession, rows.count())
    # The id is the number of the range, and in its lower 33 bits the place in it.
    placed = written(rows.repartitionByRange(ranges, ordinal).sortWithinPartitions(ordinal).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")
