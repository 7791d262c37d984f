"""Source divergence audit: how the words of a language's sources differ, by dense tiles of groups and terms."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, sized_broadcast

#: A tile: two blocks of at most SOURCES sources by about TERMS terms, 1 MB of longs.
SOURCES, TERMS = 64, 1024
#: Terms that a task counts before it passes them on, and bytes of a text that it cuts into words at once.
HELD, PIECE = 300_000, 1 << 20
#: Shares are whole numbers of this many parts.
PARTS = 1_000_000_000
#: ASCII letters lower-cased, bytes of other characters as they are, all else a blank.
_LETTERS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))

_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_TILE = pa.schema([("lang", pa.string()), ("gid", pa.int32()), ("other", pa.int32()), ("term", pa.binary()), ("value", pa.int64()), ("present", pa.int64())])


def _pieces(text: bytes):
    """The words of a text, a piece at a time."""
    flat, at = text.translate(_LETTERS), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _counted(batches, most: int):
    """(lang, source, term, n, docs) of a task's documents, and an empty term for each group; at most about most terms are held."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out():
        for (lang, source), (n, docs) in groups.items():
            terms = [b"", *n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], schema=_COUNT)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for words in _pieces(text.as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            held += len(n) - before
            if held > most:
                yield from out()
                groups, held = {}, 0
    yield from out()


def shares(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * counts / sizes), by long division in three steps: exact for sizes below 9e15."""
    out, rest = np.zeros(np.broadcast_shapes(counts.shape, sizes.shape), np.int64), counts
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, sizes)
        out = out * 1000 + digit
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tile(most: int, sources: int):
    """One tile: rows of heads (null term; n and total are the sizes of group and language) and cells.

    Gives a partial sum for each pair of its groups, over the terms that are present in it, and on the diagonal the best
    terms of each group.
    """

    def run(key, table):
        lang, a, b = key[0].as_py(), key[2].as_py(), key[3].as_py()
        head = pc.is_null(table["term"])
        heads, cells = table.filter(head).sort_by("gid"), table.filter(pc.invert(head))
        gids, sizes, whole = heads["gid"].to_numpy(), heads["n"].to_numpy(), heads["total"][0].as_py()
        coded = pa.array(cells["term"].to_pylist(), pa.binary()).dictionary_encode()
        at, terms = np.searchsorted(gids, cells["gid"].to_numpy()), coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        tile = np.zeros((len(gids), len(terms)), np.int64)
        tile[at, codes] = cells["n"].to_numpy()
        p = shares(tile + 2, sizes[:, None]) if terms else tile
        block = gids // sources
        gid, other, value = [], [], []
        for i in np.flatnonzero(block == a):
            js = np.flatnonzero((block == b) & (gids > gids[i]))
            gid += [gids[i]] * len(js)
            other += gids[js].tolist()
            value += _distance(p[i][None, :], p[js]).sum(1).tolist()
        out = [pa.Table.from_arrays([pa.array([lang] * len(gid), pa.string()), pa.array(gid, pa.int32()), pa.array(other, pa.int32()), pa.nulls(len(gid), pa.binary()), pa.array(value, pa.int64()), pa.array([len(terms)] * len(gid), pa.int64())], schema=_TILE)]
        if a == b and terms:
            total = np.zeros(len(terms), np.int64)
            total[codes] = cells["total"].to_numpy()
            q = shares(total + 2, np.array([whole]))
            best = []
            for i in range(len(gids)):
                own = np.flatnonzero((tile[i] > 0) & (p[i] > q))
                f = _distance(p[i][own], q[own])
                if len(own) > most:  # all that tie with the last stay until terms decide
                    own, f = (x[f >= np.partition(f, -most)[-most]] for x in (own, f))
                best += [(int(gids[i]), terms[t], v) for v, t in sorted(zip(f.tolist(), own.tolist(), strict=True), key=lambda x: (-x[0], terms[x[1]]))[:most]]
            out.append(pa.Table.from_arrays([pa.array([lang] * len(best), pa.string()), pa.array([x[0] for x in best], pa.int32()), pa.nulls(len(best), pa.int32()), pa.array([x[1] for x in best], pa.binary()), pa.array([x[2] for x in best], pa.int64()), pa.nulls(len(best), pa.int64())], schema=_TILE))
        return pa.concat_tables(out)

    return run


def term_counts(documents: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs), written: occurrences of each term in a group, and documents that hold it.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased, as UTF-8. Each group has a row with an empty term.
    Tasks count into bounded tables and pass partial counts on, so that shuffles carry no text.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    partial = rows.mapInArrow(lambda batches: _counted(batches, held), "lang string, source string, term binary, n long, docs long")
    return materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def audit(documents: DataFrame, min_docs: int = 10, most: int = 10, sources: int = SOURCES, terms: int = TERMS, held: int = HELD) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) of documents.

    A language keeps the V terms that min_docs of its documents hold. With count occurrences of a term among N of kept terms,
    a group's share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)); so is its language's. Two shares differ by
    f = floor((p - q)^2 / (p + q)). Part pair: every other source of the language, with f summed over all kept terms (0
    without kept terms). Part term: the most terms of the group with p > q, the language's share, and their f. Ranks run
    from 1 by falling value, then by item. All numbers are whole and exact.

    Kept terms are dealt into blocks by hash, sources into blocks by number; each tile of two source blocks and a term block is
    one dense matrix of about two times sources by terms longs in a task. Partial sums of a pair are added up, and of the terms each tile's best are
    ranked again. Terms that no source of a tile has differ by the same f, which is added by their number.

    Null text, lang and source count as empty; groups without terms are groups; repeated rows are documents of their own;
    no rows give no rows. Other columns don't matter, whatever their names.
    """
    counts = term_counts(documents, held)
    by_term = Window.partitionBy("lang", "term")
    cells = counts.where(F.length("term") > 0).withColumn("total", F.sum("n").over(by_term)).withColumn("_docs", F.sum("docs").over(by_term))
    cells = cells.withColumn("lead", F.col("source") == F.min("source").over(by_term)).where(F.col("_docs") >= min_docs)
    cells = materialize(cells.select("lang", "source", "term", "n", "total", "lead"), "kept-terms")
    langs = cells.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum(F.when(F.col("lead"), F.col("total")).otherwise(0)).alias("whole"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where(F.length("term") == 0).select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "whole"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("gid", F.row_number().over(by_lang.orderBy("source")) - 1).withColumn("of", F.ceil(F.count(F.lit(1)).over(by_lang) / sources).cast("int"))
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / terms)).cast("int"))
    groups = materialize(groups.select("lang", "source", "gid", "of", "blocks", "terms", (F.col("size") + 2 * F.col("terms")).alias("size"), (F.col("whole") + 2 * F.col("terms")).alias("whole")), "groups")

    def tiles(rows: DataFrame) -> DataFrame:
        """rows once for each tile that their source's block is in."""
        mine = F.floor(F.col("gid") / sources).cast("int")
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        return rows.select("lang", "block", F.least(mine, "_other").alias("a"), F.greatest(mine, "_other").alias("b"), "gid", "term", "n", "total")

    named = cells.join(sized_broadcast(groups.select("lang", "source", "gid", "of", "blocks")), ["lang", "source"])
    named = named.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("term", F.lit(None).cast("binary")).withColumn("n", F.col("size")).withColumn("total", F.col("whole"))
    parts = tiles(named).unionByName(tiles(heads)).groupBy("lang", "block", "a", "b").applyInArrow(_tile(most, sources), "lang string, gid int, other int, term binary, value long, present long")
    parts = materialize(parts, "tiles")

    of = lambda gid, name: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(name), F.col("size").alias(f"{name}_size"), "terms")
    pairs = parts.where("other is not null").groupBy("lang", "gid", "other").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    pairs = pairs.join(sized_broadcast(of("gid", "x")), ["lang", "gid"]).join(sized_broadcast(of("other", "y").drop("terms")), ["lang", "other"])
    p, q = (F.expr(f"1 + (2L * {PARTS}) div if({s} = 0, 1, {s})") for s in ("x_size", "y_size"))
    pairs = pairs.withColumn("_p", p).withColumn("_q", q).withColumn("value", F.expr("value + (terms - present) * ((_p - _q) * (_p - _q) div (_p + _q))"))
    both = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = pairs.select("lang", both.alias("_e"), "value").select("lang", "_e.source", F.lit("pair").alias("part"), "_e.item", "value")
    best = parts.where("other is null").join(sized_broadcast(groups.select("lang", "gid", "source")), ["lang", "gid"])
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(ranks)).unionByName(best)
