"""Queries that write with the sinks into the shared folder and read back with the sources, with SQL as in the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import graph
from citeloom.plans.catalogue import _DRAWN, _SPLIT, ORACLE_SQL, E, P, T, _counts, _negatives, _weights, edges, papers, query, table, targets
from citeloom.plans.checkpoint import cached, scratch_path, written
from citeloom.sources import readers, sinks
from citeloom.streaming import linkage

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _target_rows(s, d):
    return table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), X.split_words(F.col("text")).alias("words"), "lang")


def _digest(words):
    return F.md5(F.array_join(words, " ").cast("binary"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, len({_WORDS}) AS n_words, md5(array_to_string({_WORDS}, ' ')) AS digest FROM documents")
def json_lines(s, d):
    """Documents written as JSON lines and read with the targets' schema."""
    path = scratch_path(s, "json")
    sinks.json_lines(_target_rows(s, d).drop("lang"), path)
    return readers.targets(s, all=path).select("doc_id", F.size("words").cast("long").alias("n_words"), _digest("words").alias("digest"))


@query(f"SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'en' THEN 'train' WHEN lang = 'fr' THEN 'dev' ELSE 'test' END AS split, len({_WORDS}) AS n_words FROM documents")
def target_splits(s, d):
    """Three files of targets, read as one table that names the split."""
    rows, folder = _target_rows(s, d), scratch_path(s, "splits")
    for split, of in (("train", F.col("lang") == "en"), ("dev", F.col("lang") == "fr"), ("test", ~F.coalesce(F.col("lang").isin("en", "fr"), F.lit(False)))):
        sinks.json_lines(rows.where(of).drop("lang"), f"{folder}/{split}")
    got = readers.targets(s, **{split: f"{folder}/{split}" for split in ("train", "dev", "test")})
    return got.select("doc_id", "split", F.size("words").cast("long").alias("n_words"))


def _shard_folder(s, d):
    """documents as catalogue shards whose numbers have gaps and don't start at 0."""
    folder = scratch_path(s, "shards")
    rows = papers(s, d).select("paper_id", "title", (F.col("ord") % 7 * 10 + 3).cast("int").alias("shard_id"))
    sinks.shard_files(rows, folder)
    return folder


@query("SELECT doc_id::VARCHAR AS paper_id, split_part(text, chr(10), 1) AS title, (doc_id % 7 * 10 + 3)::INT AS shard_id FROM documents")
def shard_scan(s, d):
    return readers.shards(s, _shard_folder(s, d)).select("paper_id", "title", "shard_id")


@query("SELECT doc_id::VARCHAR AS paper_id, (doc_id % 7 * 10 + 3)::INT AS shard_id FROM documents WHERE doc_id % 7 * 10 + 3 IN (SELECT DISTINCT doc_id % 7 * 10 + 3 AS n FROM documents ORDER BY n LIMIT 3)")
def shard_limit(s, d):
    """The first three shards of the list: the limit is the operator."""
    return readers.shards(s, _shard_folder(s, d), limit=3).select("paper_id", "shard_id")


@query(r"WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS t FROM l) SELECT array_to_string(t, ' ') AS command, len(t) AS n FROM t WHERE len(t) > 0")
def command_list(s, d):
    """All lines of all documents as a command list; blank lines drop out."""
    path = scratch_path(s, "commands")
    table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return readers.commands(s, path).select(F.array_join("tokens", " ").alias("command"), F.size("tokens").cast("long").alias("n"))


@query(f"WITH {P}, {T} SELECT hash, min(ord) AS ord, arg_min(paper_id, ord) AS paper_id FROM p WHERE hash IN (SELECT hash FROM t) GROUP BY hash")
def streamed_links(s, d):
    """All documents as arriving shards, two files a batch; of each target's text the first document, kept as state."""
    folder, claims, check = (scratch_path(s, tag) for tag in ("arriving", "claims", "progress"))
    kind = "ord long, paper_id string, hash string"
    rows = papers(s, d).select("ord", "paper_id", "hash", (F.col("ord") % 7).alias("shard_id"))
    rows.repartition("shard_id").write.partitionBy("shard_id").json(folder)
    stream = s.readStream.schema(kind).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).json(folder)
    linkage.keep_lowest(stream, targets(s, d), "hash", ["paper_id"], claims, check).trigger(availableNow=True).start().awaitTermination()
    return linkage.lowest(s, claims, kind, "hash")


@query("SELECT n_name AS name, n_regionkey::VARCHAR AS value FROM nation")
def json_map(s, d):
    """A JSON object of all nations, written as one line and read as rows."""
    path = scratch_path(s, "map")
    sinks.json_object(table(s, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("region")), "n_name", "region").write.text(path)
    return readers.key_values(s, path).select(F.col("key").alias("name"), "value")


@query("SELECT n_nationkey::VARCHAR AS name, n_name AS value FROM nation")
def inverted_map(s, d):
    """A map from names to numbers, inverted as a value."""
    rows = table(s, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string")))).alias("m"))
    return rows.select(F.explode(X.inverted(F.col("m"))).alias("name", "value"))


@query("SELECT vec_id::VARCHAR AS name, unnest(range(len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 6) AS v FROM embeddings")
def matrix_file(s, d):
    path = scratch_path(s, "matrix")
    sinks.matrix(table(s, d, "embeddings").select(F.col("vec_id").alias("name"), "embedding"), path)
    return readers.embeddings(s, path).select("name", F.posexplode("embedding").alias("i", "v")).select("name", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(ORACLE_SQL["tfidf"])
def sparse_matrix_file(s, d):
    path = scratch_path(s, "sparse")
    sinks.matrix(_weights(s, d), path)
    return readers.sparse_matrix(s, path).select("doc", "term", F.round("weight", 6).alias("weight"))


@query(ORACLE_SQL["term_frequencies"])
def cached_terms(s, d):
    """Term counts from a cache: made once, found again, and made anew with overwrite."""

    def never():
        raise AssertionError("the cache was not used")

    folder, inputs = scratch_path(s, "cache"), {"tables": d, "what": "terms"}
    cached(s, folder, lambda: _counts(s, d).limit(0), inputs)
    cached(s, folder, lambda: _counts(s, d), inputs, overwrite=True)
    return cached(s, folder, never, inputs)


@query(f"WITH {E} SELECT src, dst FROM e")
def edges_from_lists(s, d):
    """Edges written as adjacency lists and read back; orders without lines have null or empty lists."""
    lists = graph.adjacency(edges(s, d), "ord")
    orders = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), "o_orderstatus")
    rows = orders.join(lists, "src", "full").withColumn("list", F.when(F.col("list").isNotNull(), F.col("list")).when(F.col("o_orderstatus") == "O", F.array().cast("array<string>")))
    return graph.from_lists(rows, "src", "list")


def _export(s, d, directed):
    folder = scratch_path(s, "export")
    numbers, lines = graph.training_export(edges(s, d), "ord", directed=directed)
    sinks.edge_files(written(lines, "lines"), folder)
    return s.read.text(folder).select("split", F.col("value").alias("line")).unionByName(numbers.select(F.lit("nodes").alias("split"), F.concat_ws("\t", "node", F.col("node_id").cast("string")).alias("line")))


_LINES = (
    " SELECT split, concat_ws(chr(9), src, dst, CASE split WHEN 'test' THEN 1 END) AS line FROM sp"
    " UNION ALL SELECT 'test', concat_ws(chr(9), src, dst, 0) FROM ng UNION ALL SELECT 'nodes', concat_ws(chr(9), node, node_id) FROM n"
)


@query((_SPLIT + _DRAWN + _LINES).replace("WITH ", "WITH RECURSIVE ", 1))
def training_export(s, d):
    """Numbering, canonical edges, split, non-edges and labels, through the files that the trainer reads."""
    return _export(s, d, False)


_ONE_WAY = "(src, dst) IN (SELECT (c.src, c.dst) FROM c)"
_DIRECTED = _SPLIT.replace("SELECT DISTINCT least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst FROM e", "SELECT DISTINCT x.node_id AS src, y.node_id AS dst FROM e")


@query((_DIRECTED + _negatives(_ONE_WAY) + f", ng AS (SELECT draw, src, dst FROM pr WHERE NOT (src = dst OR {_ONE_WAY}))" + _LINES).replace("WITH ", "WITH RECURSIVE ", 1))
def training_export_directed(s, d):
    """The same with edges as they point."""
    return _export(s, d, True)

