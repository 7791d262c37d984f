"""Citation graphs as edge tables (src, dst).

Columns of inputs must not begin with an underscore: such names are used inside.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.linkage import dense_rank_from_zero, places
from citeloom.plans.checkpoint import cached, dealt, sized_broadcast, written


def undirected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Both directions of every edge, distinct; rows: how many edges there are at most, else they are counted."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return dealt(both, 2 * (edges.count() if rows is None else rows), "src", "dst").distinct()


def adjacency(edges: DataFrame, ordinal: str) -> DataFrame:
    """(src, list): each node's neighbours in order of ordinal. A list is one value: keep the edge table for hot nodes."""
    items = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("at"), F.col("dst").alias("dst"))))
    return edges.groupBy("src").agg(F.transform(items, lambda x: x["dst"]).alias("list"))


def adjacency_chunks(edges: DataFrame, ordinal: str, size: int = 1000) -> DataFrame:
    """(src, chunk, list): adjacency() in lists of size neighbours, numbered from 0 in order of a unique ordinal.

    Neighbours are ranked over range-sorted tasks, so a node with most of the edges is many rows, none larger than a list.
    from_lists() reads them like whole lists.
    """
    placed = places(edges.select("src", "dst", ordinal), "src", ordinal).withColumn("chunk", F.floor(F.col("place") / size))
    items = F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), F.col("dst").alias("dst"))))
    return placed.groupBy("src", "chunk").agg(F.transform(items, lambda x: x["dst"]).alias("list"))


def from_lists(rows: DataFrame, key: str, items: str) -> DataFrame:
    """(src, dst) from adjacency lists; rows without a key and lists that are null or empty give nothing."""
    listed = rows.where(F.col(key).isNotNull() & (F.coalesce(F.size(items), F.lit(0)) > 0))
    return listed.select(F.col(key).alias("src"), F.explode(items).alias("dst"))


def expand(out_edges: DataFrame, in_edges: DataFrame, seeds: DataFrame, radius: int = 2, folder: str | None = None, inputs: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with hop, edges of expanded nodes): bounded breadth-first search over both directions.

    seeds: node. Only the newly found nodes are joined in the next round (semi-naive), and each round is a written table.
    Edges are those of nodes at a distance below radius, with their direction. The edge tables are scanned once a round:
    pass written ones if they are costly to make. A frontier of checked size is broadcast; a larger one is shuffled. With
    folder, rounds are kept there under a hash of inputs (all that the edges and seeds depend on), and a later call, also
    with another radius, goes on from the last finished round.
    """
    if radius < 1:
        raise ValueError("the radius must be at least 1")
    if folder and inputs is None:
        raise ValueError("name the inputs of the rounds that are kept")
    spark = seeds.sparkSession

    def kept(name: str, build):
        return cached(spark, folder, build, {**inputs, "round": name}) if folder else written(build(), name)

    frontier = kept("hop0", lambda: seeds.select("node").where("node is not null").distinct().withColumn("hop", F.lit(0)))
    seen, found = frontier, None
    both = out_edges.select("src", "dst", F.lit("out").alias("direction")).unionByName(in_edges.select("src", "dst", F.lit("in").alias("direction")))
    for hop in range(1, radius + 1):
        ends = frontier.select(F.col("node").alias("src"))
        of_round = kept(f"edges{hop}", lambda ends=ends: both.join(sized_broadcast(ends), "src", "left_semi"))
        found = of_round if found is None else found.unionByName(of_round)
        new = lambda edges=of_round, seen=seen, hop=hop: edges.select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        frontier = kept(f"hop{hop}", new)
        seen = seen.unionByName(frontier)
    return seen, found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every end of edges (src, dst): root is the smallest node that node is connected with.

    In each round every node of the contracted graph points at the first node beside it, in an order that a hash deals anew,
    pointers are followed one step further, and the edges are drawn anew between what their ends point at. In such an order
    no chain is long, whatever the nodes' names, so each round leaves about a third of the nodes, and the rounds end when no edge
    is left. A round is a minimum for each node and joins; no component is gathered in one place.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null"), "component-edges")
    roots = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    left, turn = edges.where("src <> dst"), 0
    while not left.isEmpty():
        at = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy("src").agg(F.min(at("dst")).alias("_first"))
        point = written(first.select("src", F.least("_first", at("src"))["node"].alias("_to")), "pointers")
        onward = point.select(F.col("src").alias("_to"), F.col("_to").alias("to"))
        point = point.join(onward, "_to").select("src", "to")
        roots = written(roots.join(point.withColumnRenamed("src", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        ends = left.join(point, "src").select(F.col("to").alias("_a"), "dst").join(point.withColumnRenamed("src", "dst"), "dst")
        left = written(ends.select(F.least("_a", "to").alias("src"), F.greatest("_a", "to").alias("dst")).where("src <> dst").distinct(), "component-edges")
        turn += 1
    least = roots.groupBy("root").agg(F.min("node").alias("_least"))
    return roots.join(least, "root").select("node", F.col("_least").alias("root"))


def candidates(*graphs: DataFrame) -> DataFrame:
    """All values (not keys) of several graphs' edges."""
    out = graphs[0].select(F.col("dst").alias("node"))
    for g in graphs[1:]:
        out = out.unionByName(g.select(F.col("dst").alias("node")))
    return out.distinct()


def remap_keys(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges whose src is mapped, with the mapped src; dst stays. mapping: src, new."""
    return edges.join(mapping, "src").select(F.col("new").alias("src"), "dst")


def number_nodes(edges: DataFrame, ordinal: str) -> DataFrame:
    """(node, node_id): dense numbers from 1 by first appearance, an edge's src before its dst."""
    ends = edges.select(F.col("src").alias("node"), (F.col(ordinal) * 2).alias("at")).unionByName(edges.select(F.col("dst").alias("node"), (F.col(ordinal) * 2 + 1).alias("at")))
    first = ends.groupBy("node").agg(F.min("at").alias("at"))
    return dense_rank_from_zero(first, "at", "node_id").select("node", (F.col("node_id") + 1).alias("node_id"))


def canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def by_hash(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("\t", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def ranked(rows: DataFrame, key: Column, out: str, digits: int = 3) -> DataFrame:
    """rows ranked from 1 by a hexadecimal digest, in 16 ** digits buckets of its first digits. rows must not have _ columns."""
    rows = rows.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, digits))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return rows.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + inside).drop("_part", "_base", "_key")


def split_edges(edges: DataFrame, train: float = 0.95, test: float = 0.025, seed: str = "split") -> DataFrame:
    """edges with a split: the first floor(train * n) in hash order, then floor(test * n); the rest is val."""
    n = edges.agg(F.count(F.lit(1)).alias("_n"))
    rows = ranked(edges, by_hash(seed, "src", "dst"), "_rank").join(F.broadcast(n), F.lit(True))
    upto = F.floor(F.lit(float(train)) * F.col("_n"))
    split = F.when(F.col("_rank") <= upto, "train").when(F.col("_rank") <= upto + F.floor(F.lit(float(test)) * F.col("_n")), "test").otherwise("val")
    return rows.withColumn("split", split).drop("_rank", "_n")


#: Attempts of a negative draw, in two rounds, before it is drawn directly among its source's free nodes.
ATTEMPTS = 32


def negative_edges(edges: DataFrame, positives: DataFrame, nodes: int, times: int = 5, seed: str = "negative", strict: bool = False, directed: bool = False) -> DataFrame:
    """times as many non-edges as positives, src and dst drawn by hash from 1 to nodes.

    Each draw has ATTEMPTS attempts in two rounds, of which the first that is no edge is taken. A draw that finds none, as its
    source is linked to nearly all nodes, gets the r-th free node of the source in node order, r by hash: how many linked nodes
    stand before it follows from ranks (see free_nodes()). A draw whose source has no non-neighbour at all gets no row, and a
    warning counts such draws. By default both directions and self-pairs are excluded; directed excludes only the drawn
    direction and self-pairs, strict only the drawn direction. edges may be any table; both it and positives are read
    several times, so pass written ones.
    """
    number = lambda *of: F.conv(F.substring(F.md5(F.concat_ws("\t", F.lit(seed), *of)), 1, 12), 16, 10).cast("long") % nodes + 1
    draws = ranked(positives, by_hash(seed, "src", "dst"), "_at").select(F.explode(F.sequence((F.col("_at") - 1) * times + 1, F.col("_at") * times)).alias("draw"))
    still = written(draws.select("draw", number(F.lit("src"), F.col("draw").cast("string")).alias("src")), "draws")
    taken = None
    for first, last in ((0, 0), (1, ATTEMPTS - 1)):
        pairs = still.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last))))
        pairs = pairs.select("draw", "attempt", "src", number(F.lit("dst"), F.col("draw").cast("string"), F.col("attempt").cast("string")).alias("dst"))
        pairs = pairs if strict else pairs.where("src <> dst")
        if strict or directed:
            free = pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        else:  # each edge is looked up once, whichever way it is stored
            ends = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
            free = pairs.select("*", *ends).join(edges.select(*ends), ["_a", "_b"], "left_anti")
        hits = written(free.groupBy("draw", "src").agg(F.min_by("dst", "attempt").alias("dst")), f"free{first}")
        taken = hits if taken is None else taken.unionByName(hits)
        still = written(still.join(hits.select("draw"), "draw", "left_anti"), f"open{first}")
    if not still.isEmpty():
        known = edges.select("src", "dst").distinct() if strict or directed else undirected(edges)
        linked = known.join(sized_broadcast(written(still.select("src").distinct(), "open-sources")), "src", "left_semi")
        own = still.select("src", F.col("src").alias("dst"))
        linked = linked if strict else linked.unionByName(own)
        found = free_nodes(still, linked.where(F.col("dst").between(1, nodes)).distinct(), nodes, seed)
        lost = still.count() - found.count()
        if lost:
            warnings.warn(f"{lost} draws get no negative edge: their source is linked to every node", stacklevel=2)
        taken = taken.unionByName(found)
    return taken.select("draw", "src", "dst", F.lit(0).alias("label"))


def free_nodes(draws: DataFrame, linked: DataFrame, nodes: int, seed: str = "free") -> DataFrame:
    """(draw, src, dst), written: for each draw a node from 1 to nodes that is not linked to src, by a hash of seed and draw.

    draws: draw, src. linked: distinct (src, dst). Before a source's i-th linked node there are dst - i free ones, so the r-th
    free node (from 0) is r + 1 + the number of linked nodes with dst - i <= r. Linked nodes and draws of a source are ranked
    together by that number, over range-sorted tasks: a source linked to all nodes but one is one row for each linked node,
    however many draws it has. Sources without a free node give no rows.
    """
    linked = written(places(linked, "src", "dst").select("src", (F.col("dst") - F.col("place") - 1).alias("at")), "gaps")
    counts = linked.groupBy("src").agg(F.count(F.lit(1)).alias("_m"))
    free = draws.select("draw", "src").join(counts, "src", "left").withColumn("_free", F.lit(nodes) - F.coalesce("_m", F.lit(0))).where("_free > 0")
    chance = F.conv(F.substring(F.md5(F.concat_ws("\t", F.lit(seed), F.lit("free"), F.col("draw").cast("string"))), 1, 12), 16, 10).cast("long")
    free = written(free.select("draw", "src", (chance % F.col("_free")).alias("at")), "chances")
    nothing = F.lit(None).cast(free.schema["draw"].dataType)
    both = linked.select("src", nothing.alias("draw"), F.struct("at", F.lit(0).alias("kind"), F.monotonically_increasing_id().alias("nth")).alias("key"))
    both = both.unionByName(free.select("src", "draw", F.struct("at", F.lit(1).alias("kind"), F.col("draw").cast("long").alias("nth")).alias("key")))
    among = places(both, "src", "key").where("draw is not null").select("draw", F.col("place").alias("_all"))
    alone = places(free.withColumn("key", F.struct("at", F.col("draw").cast("long").alias("nth"))), "src", "key")
    return written(alone.join(among, "draw").select("draw", "src", (F.col("at") + 1 + F.col("_all") - F.col("place")).alias("dst")), "direct")


def training_export(edges: DataFrame, ordinal: str, train: float = 0.95, test: float = 0.025, times: int = 5, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(numbering, lines): nodes numbered by first appearance, and the edge lists that an embedding trainer reads.

    edges: src, dst, ordinal, in citing direction. lines: split, src, dst, label. Edges are made canonical, or kept as they
    point with directed; train and val have positives only, test has them with label 1 and times as many non-edges with
    label 0. sinks.edge_files() writes lines.
    """
    edges = written(edges.select("src", "dst", ordinal), "edges")
    numbers = written(number_nodes(edges, ordinal), "numbers")
    named = lambda end, out: numbers.select(F.col("node").alias(end), F.col("node_id").alias(out))
    pairs = edges.join(named("src", "a"), "src").join(named("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = written(pairs.distinct() if directed else canonical(pairs), "numbered")
    split = written(split_edges(pairs, train, test), "split")
    drawn = negative_edges(pairs, split.where("split = 'test'").select("src", "dst"), max(1, numbers.count()), times, directed=directed)
    lines = split.select("split", "src", "dst", F.lit(1).alias("label")).unionByName(drawn.select(F.lit("test").alias("split"), "src", "dst", "label"))
    return numbers, lines
