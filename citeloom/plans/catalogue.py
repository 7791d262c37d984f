"""The engine's queries over the driver's tables, each with SQL that DuckDB runs on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import citances, graph, linkage, matching, projection, segmenter, text, vectors
from citeloom.plans.checkpoint import dealt, scratch_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(s, d) -> DataFrame:
    """documents as papers: string id, first line as title, md5 of the text, shard."""
    docs = table(s, d, "documents")
    return docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("paper_id"), "text", "lang", "n_chars", F.col("source").alias("shard"), F.md5(F.col("text").cast("binary")).alias("hash"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))


def targets(s, d) -> DataFrame:
    """Papers that have labels."""
    return papers(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi")


def edges(s, d) -> DataFrame:
    """Orders cite parts: distinct (src, dst) with a unique ordinal."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = dealt(lines, lines.count(), "l_orderkey", "l_partkey").distinct()
    return rows.select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), (F.col("l_orderkey") * 100_000_000 + F.col("l_partkey")).alias("ord"))


def reverse(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


P = "p AS (SELECT doc_id AS ord, doc_id::VARCHAR AS paper_id, text, lang, n_chars, source AS shard, md5(text) AS hash, split_part(text, chr(10), 1) AS title FROM documents)"
T = "t AS (SELECT * FROM p WHERE ord IN (SELECT doc_id FROM labels))"
E = "e AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, l_orderkey * 100000000 + l_partkey AS ord FROM lineitem)"
B = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("SELECT doc_id::VARCHAR AS doc_id FROM labels UNION SELECT doc_id::VARCHAR FROM documents WHERE lang = 'fr'")
def distinct_target_ids(s, d):
    ids = table(s, d, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return ids.unionByName(table(s, d, "documents").where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("doc_id"))).distinct()


@query(f"WITH {P}, {T} SELECT hash, arg_max(paper_id, ord) AS paper_id, arg_max(shard, ord) AS shard FROM p WHERE hash IN (SELECT hash FROM t) GROUP BY hash")
def hash_link(s, d):
    return linkage.hash_link(papers(s, d), targets(s, d), "hash", "ord", ["paper_id", "shard"])


@query("SELECT d.doc_id::VARCHAR AS id, d.doc_id::VARCHAR AS doc_id, CASE WHEN l.doc_id IS NULL THEN lang END AS lang, CASE WHEN l.doc_id IS NULL THEN source END AS source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def link_or_fetch(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id"), "lang", "source")
    links = table(s, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_id")).distinct()
    return linkage.link_or_fetch(docs.select("id"), links, docs, ["lang", "source"])


@query(f"WITH {P}, {T} SELECT DISTINCT t.paper_id AS target_id, p.paper_id FROM t JOIN p ON (t.paper_id = p.paper_id OR t.hash = p.hash OR (t.title = p.title AND t.title <> ''))")
def or_match(s, d):
    left = targets(s, d).select(F.col("paper_id").alias("target_id"), "paper_id", "hash", "title")
    return linkage.or_match(left, papers(s, d).select(F.col("paper_id").alias("found"), "paper_id", "hash", "title"), ["paper_id", "hash", "title"], "target_id", "found").withColumnRenamed("found", "paper_id")


@query(f"""WITH RECURSIVE {P}, {T}, pk AS (SELECT ord, [hash, lang || '|' || n_chars, title] AS ks FROM p), tk AS (SELECT ord, [hash, lang || '|' || n_chars, title] AS ks FROM t),
lk AS (SELECT i, ks[i] AS k, max(ord) AS target FROM tk, range(1, 4) AS r(i) WHERE ks[i] <> '' GROUP BY ALL),
cd AS (SELECT ord AS row, list(target ORDER BY i) AS ts, list(i - 1 ORDER BY i)::INT[] AS ps FROM pk, range(1, 4) AS r(i) JOIN lk USING (i) WHERE lk.k = ks[i] GROUP BY ord),
nr AS (SELECT *, row_number() OVER (ORDER BY row) AS nth FROM cd),
st AS (SELECT 0::BIGINT AS nth, NULL::BIGINT AS row, NULL::BIGINT AS target, NULL::INT AS priority, []::BIGINT[] AS taken
UNION ALL SELECT x.nth, x.row, hit, ps[list_position(ts, hit)], CASE WHEN hit IS NULL THEN taken ELSE list_append(taken, hit) END FROM
(SELECT n.*, st.taken, list_filter(n.ts, lambda v: NOT list_contains(st.taken, v))[1] AS hit FROM st JOIN nr n ON n.nth = st.nth + 1) x)
SELECT row, target, priority FROM st WHERE target IS NOT NULL""")
def priority_match(s, d):
    rows = lambda p: p.select("ord", "hash", F.concat_ws("|", "lang", "n_chars").alias("shape"), "title")
    return linkage.priority_match(rows(papers(s, d)), rows(targets(s, d)), ["hash", "shape", "title"], "ord", "ord")


_MATCHED = ORACLE_SQL["priority_match"]


@query(_MATCHED.replace("SELECT row, target, priority FROM st WHERE target IS NOT NULL", "SELECT target, row FROM st WHERE target IS NOT NULL"))
def forward_mapping(s, d):
    return linkage.forward_mapping(priority_match(s, d))


@query(_MATCHED.replace("SELECT row, target, priority FROM st WHERE target IS NOT NULL", "SELECT p.hash, arg_max(target, row) AS target FROM st JOIN p ON p.ord = st.row WHERE target IS NOT NULL GROUP BY p.hash"))
def inverse_mapping(s, d):
    """The text's hash stands for the paper id, since several rows share it."""
    return linkage.inverse_mapping(priority_match(s, d), papers(s, d), "ord", "hash")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_filter(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


@query(f"WITH {P} SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY ord) - 1 AS place, paper_id FROM p")
def shard_index(s, d):
    """Each shard's papers in scan order, as rows: a shard may hold a large part of all papers, so a list would be one value."""
    return linkage.places(papers(s, d).select("shard", "ord", "paper_id"), "shard", "ord").select("shard", "place", "paper_id")


@query("SELECT source AS shard, count(*) AS searched, count(l.doc_id) AS hits, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def shard_hits(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return rows.groupBy(F.col("source").alias("shard")).agg(F.count(F.lit(1)).alias("searched"), F.count("hit").alias("hits"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id::VARCHAR AS paper_id, array_to_string(list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '\\s+'), lambda w: w <> ''), ' ') AS title FROM documents")
def title_first_line(s, d):
    """The first sentence's words; lines stand for sentences, and the whole text for a section."""
    lines = F.transform(F.split("text", "\n"), X.split_words)
    rows = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.slice(lines, 1, 1).alias("lines"), F.length("text").alias("n"))
    sentences, sections = F.array(F.array(F.lit(0), F.size(F.get("lines", F.lit(0))))), F.array(F.array(F.lit(0), F.col("n")))
    return rows.select("paper_id", X.title(F.flatten("lines"), sentences, sections).alias("title"))


_ID = list(linkage.KNOWN_BAD.items())


@query(f"WITH i AS (SELECT doc_id::VARCHAR AS id FROM documents UNION ALL VALUES ('{_ID[0][0]}'), ('{_ID[1][0]}')) SELECT id, CASE id WHEN '{_ID[0][0]}' THEN '{_ID[0][1]}' WHEN '{_ID[1][0]}' THEN '{_ID[1][1]}' ELSE id END AS fetched FROM i")
def known_bad_remap(s, d):
    ids = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id")).unionByName(s.createDataFrame([(a,) for a, _ in _ID], "id string"))
    return ids.select("id", linkage.remap_ids(F.col("id")).alias("fetched"))


@query("SELECT e.event_id, CASE WHEN d.text IS NULL THEN 'text' WHEN l.quality IS NULL THEN 'quality' WHEN l.toxic IS NULL THEN 'toxic' END AS missing FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN labels l ON l.doc_id = e.event_id")
def field_audit(s, d):
    rows = table(s, d, "events").select(F.col("event_id").alias("doc_id")).join(table(s, d, "documents").select("doc_id", "text"), "doc_id", "left").join(table(s, d, "labels"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("event_id"), linkage.first_missing(["text", "quality", "toxic"]).alias("missing"))


def _seeds(s, d):
    """All orders of the customers of one segment, as far as they have edges: a target set that grows with the tables."""
    buyers = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(buyers, "o_custkey", "left_semi").join(lines, "o_orderkey", "left_semi").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))


def _graph(s, d):
    """The edges and their reverse, from one written table."""
    e = written(edges(s, d).select("src", "dst"), "edges")
    return e, reverse(e)


_SEGMENT = "SELECT 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"
_H = f"WITH {E}, {B}, h0 AS (SELECT DISTINCT src AS node FROM e WHERE src IN ({_SEGMENT})), h1 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM h0) AND dst NOT IN (FROM h0)), h2 AS (SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM h1) AND dst NOT IN (FROM h0) AND dst NOT IN (FROM h1))"


@query(_H + " SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1")
def bfs_r1(s, d):
    return graph.expand(*_graph(s, d), _seeds(s, d), 1)[0]


@query(_H + " SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def bfs_r2(s, d):
    return graph.expand(*_graph(s, d), _seeds(s, d), 2)[0]


@query(ORACLE_SQL["bfs_r2"])
def bfs_resumed(s, d):
    """A search of radius 1 whose rounds are kept, and one of radius 2 that goes on from them."""
    folder, inputs = scratch_path(s, "rounds"), {"tables": d, "seeds": "BUILDING"}
    graph.expand(*_graph(s, d), _seeds(s, d), 1, folder, inputs)
    return graph.expand(*_graph(s, d), _seeds(s, d), 2, folder, inputs)[0]


@query(_H + ", k AS (SELECT node FROM h0 UNION SELECT node FROM h1) SELECT b.src, b.dst, CASE WHEN b.src LIKE 'o%' THEN 'out' ELSE 'in' END AS direction FROM b JOIN k ON k.node = b.src")
def citation_graph(s, d):
    return graph.expand(*_graph(s, d), _seeds(s, d), 2)[1]


@query(_H + " SELECT DISTINCT src AS citing FROM b WHERE src LIKE 'o%' AND dst IN (FROM h1)")
def citing_set(s, d):
    out, back = _graph(s, d)
    nodes, _ = graph.expand(out, back, _seeds(s, d), 1)
    return out.join(nodes.where("hop = 1").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("citing")).distinct()


@query(f"WITH {E}, {B} SELECT src, dst FROM b")
def undirected_merge(s, d):
    return graph.undirected(edges(s, d), table(s, d, "lineitem").count())


@query(_H + " SELECT DISTINCT dst AS node FROM b WHERE src IN (FROM h0) OR src IN (FROM h1)")
def candidate_set(s, d):
    """The ends of two cached graphs, of radius 1 and 2; the second goes on from the rounds of the first."""
    folder, inputs, both = scratch_path(s, "rounds"), {"tables": d, "seeds": "BUILDING"}, _graph(s, d)
    return graph.candidates(*[graph.expand(*both, _seeds(s, d), radius, folder, inputs)[1] for radius in (1, 2)])


@query(f"WITH {P}, f AS (SELECT hash, min(ord) AS ord FROM p GROUP BY hash) SELECT hash, ord, row_number() OVER (ORDER BY ord) - 1 AS line FROM f")
def first_copy_index(s, d):
    return linkage.first_copies(papers(s, d), "hash", "ord")


@query(_H + f", n AS (SELECT DISTINCT substr(node, 2)::BIGINT AS id FROM (FROM h1)), p AS (SELECT doc_id, text, md5(text) AS hash FROM documents), f AS (SELECT min(doc_id) AS doc_id FROM p WHERE doc_id IN (FROM n) GROUP BY hash) SELECT doc_id::VARCHAR AS paper_id, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM f")
def neighbor_texts(s, d):
    nodes, _ = graph.expand(*_graph(s, d), _seeds(s, d), 1)
    ids = nodes.where("hop = 1").select(F.substring("node", 2, 30).cast("long").alias("ord")).distinct()
    return linkage.first_copies(papers(s, d).join(ids, "ord", "left_semi"), "hash", "ord").select(F.col("ord").cast("string").alias("paper_id"), "line")


_N = f"WITH {E}, a AS (SELECT src AS node, ord * 2 AS pl FROM e UNION ALL SELECT dst, ord * 2 + 1 FROM e), f AS (SELECT node, min(pl) AS pl FROM a GROUP BY node), n AS (SELECT node, row_number() OVER (ORDER BY pl) AS node_id FROM f), c AS (SELECT DISTINCT least(x.node_id, y.node_id) AS src, greatest(x.node_id, y.node_id) AS dst FROM e JOIN n x ON x.node = e.src JOIN n y ON y.node = e.dst)"
_SPLIT = _N + ", r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(chr(9), 'split', src, dst))) AS r, count(*) OVER () AS n FROM c), sp AS (SELECT src, dst, CASE WHEN r <= floor(0.95::DOUBLE * n) THEN 'train' WHEN r <= floor(0.95::DOUBLE * n) + floor(0.025::DOUBLE * n) THEN 'test' ELSE 'val' END AS split FROM r)"


@query(_N + " SELECT node, node_id FROM n")
def node_numbering(s, d):
    return graph.number_nodes(edges(s, d), "ord")


def _numbered(s, d):
    e = written(edges(s, d), "edges")
    numbers = written(graph.number_nodes(e, "ord"), "numbers")
    rows = e.join(numbers.select(F.col("node").alias("src"), F.col("node_id").alias("a")), "src").join(numbers.select(F.col("node").alias("dst"), F.col("node_id").alias("b")), "dst")
    return graph.canonical(rows.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query(_N + " SELECT src, dst FROM c")
def edge_canonical(s, d):
    return _numbered(s, d)


@query(_SPLIT + " SELECT split, concat_ws(chr(9), src, dst) AS line FROM sp")
def edge_split(s, d):
    return graph.split_edges(written(_numbered(s, d), "numbered")).select("split", F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))


def _negatives(known):
    """Draws whose attempts go on until one is no edge in known (a condition on pr); here no source is linked to all nodes."""
    number = lambda what: f"('0x' || substr(md5(concat_ws(chr(9), 'negative', {what})), 1, 12))::BIGINT % k + 1"
    return f""", pos AS (SELECT row_number() OVER (ORDER BY md5(concat_ws(chr(9), 'negative', src, dst))) AS pl FROM sp WHERE split = 'test'), k AS (SELECT count(*) AS k FROM n),
dr AS (SELECT unnest(range((pl - 1) * 5 + 1, pl * 5 + 1)) AS draw FROM pos),
pr AS (SELECT draw, 0 AS attempt, {number("'src', draw")} AS src, {number("'dst', draw, 0")} AS dst, k FROM dr, k
UNION ALL SELECT draw, attempt + 1, src, {number("'dst', draw, attempt + 1")}, k FROM pr WHERE src = dst OR {known})"""


_LINKED = "(least(src, dst), greatest(src, dst)) IN (SELECT (c.src, c.dst) FROM c)"
_DRAWN = _negatives(_LINKED) + f", ng AS (SELECT draw, src, dst FROM pr WHERE NOT (src = dst OR {_LINKED}))"


@query((_SPLIT + _DRAWN + " SELECT draw, src, dst, 0 AS label FROM ng").replace("WITH ", "WITH RECURSIVE ", 1))
def negative_edges(s, d):
    split = written(graph.split_edges(written(_numbered(s, d), "numbered")), "split")
    n = split.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.max("x")).first()[0] or 1
    return graph.negative_edges(split, split.where("split = 'test'").select("src", "dst"), n)


_PUNCT = X.PUNCTUATION.replace("'", "''")
_TOK = f"tk AS (SELECT doc_id::VARCHAR AS doc, unnest(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: trim(w, '{_PUNCT}')), lambda w: w <> '')) AS term FROM documents), tf AS (SELECT doc, term, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
_IDF = _TOK + ", n AS (SELECT count(*) AS n FROM documents), rw AS (SELECT doc, term, tf * log2(n / df) AS w FROM tf JOIN df USING (term), n WHERE df > 1 AND df < n), wt AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM rw)"


def _counts(s, d):
    return text.term_counts(papers(s, d), "paper_id", "text")


def _weights(s, d, scaled=True):
    counts = written(_counts(s, d), "terms")
    return text.tf_idf(counts, text.vocabulary(counts), table(s, d, "documents"), scaled=scaled)


@query(f"WITH {_TOK} SELECT doc, term, tf FROM tf")
def term_frequencies(s, d):
    return _counts(s, d)


@query(f"WITH {_TOK} SELECT doc, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tk GROUP BY doc")
def token_counts(s, d):
    t = X.tokens(X.join_sections(F.col("body_text")))
    body = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text")))
    return papers(s, d).select("paper_id", body.alias("body_text")).select(F.col("paper_id").alias("doc"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms")).where("n_tokens > 0")


@query(f"WITH {_TOK} SELECT term, df FROM df")
def doc_freq(s, d):
    return text.vocabulary(_counts(s, d), min_df=1)


_STOP = "the and of to in a is it that for".split()


@query(f"WITH {_TOK} SELECT term, df FROM df WHERE df > 1 AND term NOT IN ({', '.join(repr(w) for w in _STOP)})")
def vocabulary(s, d):
    return text.vocabulary(_counts(s, d), _STOP)


_ENGLISH = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)


@query(f"WITH {_TOK} SELECT term, df FROM df WHERE df > 1 AND term NOT IN ({_ENGLISH})")
def vocabulary_english(s, d):
    """The vocabulary without the full list of English stop words."""
    return text.vocabulary(_counts(s, d), list(X.STOP_WORDS))


@query(f"WITH {_IDF.replace('df < n)', f'df < n AND term NOT IN ({_ENGLISH}))')} SELECT doc, term, round(weight, 6) AS weight FROM wt")
def tfidf_english(s, d):
    """Weights over the vocabulary without English stop words, which count in no document's length."""
    counts = written(_counts(s, d), "terms")
    weights = text.tf_idf(counts, text.vocabulary(counts, list(X.STOP_WORDS)), table(s, d, "documents"))
    return weights.select("doc", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_IDF} SELECT doc, term, round(weight, 6) AS weight FROM wt")
def tfidf(s, d):
    return _weights(s, d).select("doc", "term", F.round("weight", 6).alias("weight"))


_NB = "nb AS (SELECT a.doc_id::VARCHAR AS key, 'out' AS direction, b.doc_id::VARCHAR AS doc FROM documents a JOIN documents b ON a.lang = b.lang AND b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 5), nd AS (SELECT * FROM nb UNION ALL SELECT doc, 'in', key FROM nb UNION ALL SELECT key, 'both', doc FROM nb UNION ALL SELECT doc, 'both', key FROM nb)"


@query(f"WITH {_IDF}, {_NB}, u AS (SELECT * FROM nd WHERE doc IN (SELECT doc FROM wt)), k AS (SELECT key, direction, count(*) AS k FROM u GROUP BY ALL), m AS (SELECT key, direction, term, sum(weight) / any_value(k) AS weight FROM u JOIN wt USING (doc) JOIN k USING (key, direction) GROUP BY ALL) SELECT key, direction, term, round(weight, 6) AS weight FROM (SELECT DISTINCT key, direction FROM nd) LEFT JOIN m USING (key, direction)")
def neighbor_tfidf(s, d):
    """The next five ids of the same language stand for the papers that a paper cites."""
    ids = table(s, d, "documents").select("doc_id", "lang")
    near = ids.select(F.col("doc_id").cast("string").alias("key"), "lang", F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 5)).alias("doc_id")).join(ids, ["doc_id", "lang"])
    out = written(near.select("key", F.col("doc_id").cast("string").alias("doc")), "near")
    back = out.select(F.col("doc").alias("key"), F.col("key").alias("doc"))
    both = out.unionByName(back).distinct()
    rows = out.withColumn("direction", F.lit("out")).unionByName(back.withColumn("direction", F.lit("in"))).unionByName(both.withColumn("direction", F.lit("both")))
    return text.neighbour_average(rows, _weights(s, d, scaled=False), unit=True).withColumn("weight", F.round("weight", 6))


def _datasets(s, d):
    parts = table(s, d, "part")
    return parts.select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.array(F.concat_ws(" ", "p_brand", "p_type"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 97).cast("string"))).alias("variants"), F.col("p_brand").alias("full_name"))


@query("""WITH RECURSIVE ds AS (SELECT p_partkey AS ord, p_name || ' ' || p_partkey AS name, list_distinct([p_brand || ' ' || p_type, p_name || ' ' || (p_partkey % 97), p_brand]) AS others FROM part),
ev AS (SELECT ord, 0 AS phase, name AS raw, name FROM ds UNION ALL SELECT ord, 1, raw, name FROM (SELECT ord, name, unnest(others) AS raw FROM ds) WHERE raw <> name),
nr AS (SELECT lower(raw) AS variant, phase, name, row_number() OVER (PARTITION BY lower(raw) ORDER BY ord, phase, raw) AS nth, count(*) OVER (PARTITION BY lower(raw)) AS n FROM ev),
st AS (SELECT DISTINCT variant, 0::BIGINT AS nth, n, NULL::VARCHAR AS cur, false AS bad FROM nr
UNION ALL SELECT nr.variant, nr.nth, nr.n, CASE WHEN phase = 0 THEN nr.name WHEN cur IS NULL AND NOT bad THEN nr.name END, bad OR (phase = 1 AND cur IS NOT NULL) FROM st JOIN nr ON nr.variant = st.variant AND nr.nth = st.nth + 1)
SELECT variant, cur AS name FROM st WHERE nth = n AND cur IS NOT NULL""")
def dataset_lookup(s, d):
    return text.dataset_lookup(_datasets(s, d)).select("variant", "name")


_LINES = "ln AS (SELECT doc_id::VARCHAR AS paper_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS section FROM documents), v AS (SELECT DISTINCT item_id, trim(lower(unnest(string_split(text, chr(10))))) AS variant FROM benchmark)"


def _sections(s, d):
    return papers(s, d).select("paper_id", F.posexplode(F.split("text", "\n")).alias("section", "text"))


def _passages(s, d):
    lines = table(s, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("v")).select(F.btrim(F.lower("v")).alias("variant"), "item_id").where("variant <> ''")
    return lines.groupBy("variant").agg(F.min("item_id").alias("pos")).select("variant", F.col("pos").cast("string").alias("name"), "pos")


@query(f"WITH {_LINES}, w AS (SELECT variant, min(item_id) AS pos FROM v WHERE variant <> '' GROUP BY variant), h AS (SELECT paper_id, section, min(pos) AS pos FROM ln JOIN w ON contains(lower(ln.text), w.variant) GROUP BY ALL) SELECT DISTINCT paper_id, pos::VARCHAR AS name FROM h")
def dataset_mentions(s, d):
    return text.mentions(_sections(s, d), _passages(s, d))


def _matches(s, d):
    """Labelled papers as a map to dataset names; toxic ones have an empty list."""
    names = F.when(F.col("toxic") == 1, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("q"), F.col("quality").cast("string"))))
    return table(s, d, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), names.alias("names"))


@query("SELECT DISTINCT doc_id::VARCHAR AS paper_id, 'reference' AS kind, CASE WHEN toxic <> 1 THEN 'q' || quality END AS dataset FROM labels")
def reference_mentions(s, d):
    return text.references(_matches(s, d), "paper_id", "names").select("paper_id", F.lit("reference").alias("kind"), "dataset")


@query(f"WITH {_LINES}, w AS (SELECT variant FROM v WHERE variant <> '') SELECT doc_id::VARCHAR AS paper_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR doc_id::VARCHAR IN (SELECT paper_id FROM ln JOIN w ON contains(lower(ln.text), w.variant))")
def kept_documents(s, d):
    mentioned = text.mentions(_sections(s, d), _passages(s, d))
    return text.kept(papers(s, d), "paper_id", mentioned, text.references(_matches(s, d), "paper_id", "names")).select("paper_id", "n_chars")


@query("SELECT event_id, CASE json_extract_string(props, '$.k')::INT % 4 WHEN 0 THEN 'p0' WHEN 1 THEN 'p1' WHEN 2 THEN 'p2' END AS link FROM events")
def bib_lookup(s, d):
    bib = F.create_map(*[F.lit(x) for k in "012" for x in (k, f"p{k}")])
    ref = (F.get_json_object("props", "$.k").cast("int") % 4).cast("string")
    return table(s, d, "events").select("event_id", F.try_element_at(bib, ref).alias("link"))


_OFF = "o AS (SELECT d.doc_id, b.item_id, strpos(d.text, b.text) - 1 AS pl, length(b.text) AS len, d.text FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


def _offsets(s, d):
    bench = table(s, d, "benchmark").select("item_id", F.col("text").alias("phrase"))
    docs = table(s, d, "documents").select("doc_id", "text")
    found = matching.first_places(docs, "text", bench.select("phrase"), keep=["doc_id"])
    return found.join(bench, "phrase").select("doc_id", "item_id", "at", F.length("phrase").alias("len")).join(docs, "doc_id")


@query(f"WITH {_OFF} SELECT doc_id, item_id, substr(text, 1, pl) || '[CITE]' || substr(text, pl + len + 1) AS spliced FROM o")
def citance_splice(s, d):
    return _offsets(s, d).select("doc_id", "item_id", X.splice(F.col("text"), F.col("at"), F.col("at") + F.col("len")).alias("spliced"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), p AS (SELECT doc_id, a, unnest(range(len(a))) AS place FROM l) SELECT doc_id, place, array_to_string(a[greatest(place - 1, 0) + 1 : least(place + 2, len(a))], '|') AS ctx FROM p")
def citance_window(s, d):
    lines = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("a"))
    rows = lines.select("doc_id", "a", F.explode(F.sequence(F.lit(0), F.size("a") - 1)).alias("place"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.array_join(X.window(F.col("a"), F.col("place"), 1), "|").alias("ctx"))


def _held(x):
    """An SQL text with chr(1) where functions.text.sentences() allows no end; abbreviations take two passes, as matches can't overlap."""
    blank = r"[^\S\n]+"
    x = f"replace(replace(regexp_replace({x}, '\\n{{2,}}', chr(2), 'g'), chr(10), ' '), chr(2), chr(10) || chr(10))"
    x = f"regexp_replace({x}, '{blank}(\\S*--\\S*)', chr(1) || '\\1', 'g')"
    x = f"regexp_replace({x}, '(\\S*--\\S*|\\.\\.\\.){blank}', '\\1' || chr(1), 'g')"
    words = "|".join(a.replace(".", r"\.") for a in X.ABBREVIATIONS)
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}.])({words}){blank}', '\\1\\2' || chr(1), 'g')"
    return x


def _trimmed(x):
    return f"list_filter(list_transform(string_split({x}, chr(3)), lambda z: trim(replace(z, chr(1), ' '))), lambda z: z <> '')"


def _sentences(x):
    """The sentences of an SQL text, by the rules of functions.text.sentences()."""
    x = f"regexp_replace(regexp_replace({_held(x)}, '([.!?])\\s+', '\\1' || chr(3), 'g'), '\\n{{2,}}', chr(3), 'g')"
    return _trimmed(x)


_AROUND = f"""WITH {_OFF}, x AS (SELECT 'b' || item_id AS cited, doc_id::VARCHAR AS citing, {_sentences("substr(text, 1, pl) || '[CITE]'")} AS before,
{_sentences("substr(text, 1, pl) || '[CITE]' || substr(text, pl + len + 1)")} AS marked FROM o)
SELECT cited, citing, array_to_string(marked[greatest(len(before) - 2, 0) + 1 : least(len(before) + 1, len(marked))], '|') AS context FROM x"""


def _corpus(s, d):
    """Passages of the benchmark inside documents are the citations; the passage is the cited paper."""
    found = _offsets(s, d)
    span = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("end"), F.col("item_id").cast("string").alias("ref_id"))
    rows = found.groupBy("doc_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(span)).alias("spans"))
    bib = F.map_from_entries(F.transform("spans", lambda x: F.struct(x["ref_id"], F.struct(F.concat(F.lit("b"), x["ref_id"]).alias("link")))))
    body = F.array(F.struct("text", F.col("spans").alias("cite_spans")))
    return written(rows.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("paper_id"), body.alias("body_text"), bib.alias("bib_entries")), "corpus")


def _contexts(s, d, corpus, citing, learned=None):
    cited = table(s, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("paper_id"))
    return citances.contexts(corpus, cited, citing, k=1, learned=learned).select("cited", "citing", F.array_join("sentences", "|").alias("context"))


@query(_AROUND)
def citation_contexts(s, d):
    """Contexts of every citation of the corpus."""
    corpus = _corpus(s, d)
    return _contexts(s, d, corpus, corpus.select("paper_id"))


@query(f"{_AROUND} WHERE citing IN (SELECT doc_id::VARCHAR FROM documents WHERE lang = 'en')")
def citation_contexts_citing(s, d):
    """Contexts from the papers that may cite alone, here the English ones."""
    return _contexts(s, d, _corpus(s, d), papers(s, d).where("lang = 'en'").select("paper_id"))


@query(f"SELECT doc_id, len({_sentences('text')}) AS n, md5(array_to_string({_sentences('text')}, '|')) AS digest FROM documents")
def sentence_split(s, d):
    parts = X.sentences(F.col("text"))
    return table(s, d, "documents").select("doc_id", parts.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


def _base(w):
    return f"trim(lower({w}), '{_PUNCT}')"


def _dotted(w):
    bare = f"rtrim({w}, '{_PUNCT.translate({ord(c): None for c in '.?!'})}')"
    return f"({bare} LIKE '%.' AND {bare} NOT LIKE '%..')"


def _stops(w):
    bare = "rtrim({}, '{}')".format(w, X.CLOSERS.replace("'", "''"))
    return f"({bare} LIKE '%?' OR {bare} LIKE '%!' OR ({bare} LIKE '%.' AND {bare} NOT LIKE '%..'))"


_WORDS = f"""ws AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), pr AS (SELECT unnest(ws) AS w, unnest(list_append(ws[2:], NULL)) AS x FROM ws),
wc AS MATERIALIZED (SELECT {_base("w")} AS word, {_dotted("w")} AS dotted, {_stops("w")} AS stops, CASE WHEN {_stops("w")} THEN {_base("x")} END AS next, count(*) AS n FROM pr GROUP BY ALL),
tt AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (dotted) / sum(n) AS r FROM wc),
wa AS (SELECT word, coalesce(sum(n) FILTER (dotted), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (NOT dotted), 0)::DOUBLE AS b, length(replace(word, '.', '')) AS k FROM wc WHERE regexp_matches(word, '\\p{{L}}') GROUP BY word),
ab AS MATERIALIZED (SELECT word, 2 * (a * ln(0.99 / r) + b * ln(0.01 / (1 - r))) * exp(-k) * (length(word) - k + 1) * pow(k, -b) AS score FROM wa, tt WHERE a > 0 AND 2 * (a * ln(0.99 / r) + b * ln(0.01 / (1 - r))) * exp(-k) * (length(word) - k + 1) * pow(k, -b) >= 0.3)"""


def _ll(p, k, n):
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


_FIXED = ", ".join(f"'{a.rstrip('.')}'" for a in X.ABBREVIATIONS)
_BEGINS = f"""{_WORDS}, bg AS (SELECT next AS word, sum(n)::DOUBLE AS k FROM wc WHERE stops AND next IS NOT NULL AND NOT (dotted AND (word IN ({_FIXED}) OR word IN (SELECT word FROM ab))) GROUP BY next),
bs AS (SELECT word, k AS k1, w - k AS k2, bt.b AS n1, tt.n - bt.b AS n2, w / tt.n AS p, k / bt.b AS p1, (w - k) / (tt.n - bt.b) AS p2 FROM bg JOIN (SELECT word, sum(n)::DOUBLE AS w FROM wc GROUP BY word) USING (word), (SELECT sum(k) AS b FROM bg) bt, tt WHERE regexp_matches(word, '\\p{{L}}')),
st AS MATERIALIZED (SELECT word, 2 * ({_ll("p1", "k1", "n1")} + {_ll("p2", "k2", "n2")} - {_ll("p", "k1", "n1")} - {_ll("p", "k2", "n2")}) AS score FROM bs WHERE p1 > p)"""


def _learn(s, d):
    """The abbreviations and starters of all documents."""
    counts = segmenter.word_counts(table(s, d, "documents"), "text")
    known = written(segmenter.abbreviations(counts), "abbreviations")
    return known, segmenter.starters(counts, known)


@query(f"WITH {_WORDS} SELECT word, round(score, 6) AS score FROM ab")
def learned_abbreviations(s, d):
    """Words that the corpus shows to be abbreviations."""
    return segmenter.abbreviations(segmenter.word_counts(table(s, d, "documents"), "text")).withColumn("score", F.round("score", 6))


@query(f"WITH {_BEGINS} SELECT word, round(score, 6) AS score FROM st WHERE score >= 30")
def sentence_starters(s, d):
    """Words that the corpus shows to begin sentences."""
    return _learn(s, d)[1].withColumn("score", F.round("score", 6))


def _pieces(x):
    return f"string_split(regexp_replace({_held(x)}, '([.!?])(\\s)', '\\1' || chr(3) || '\\2', 'g'), chr(3))"


def _learned(ps):
    """The sentences of a column of pieces; a and b are the lists of abbreviations and starters."""
    plain = "translate({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(1), '      ')".format
    last, first = f"split_part({plain(f'{ps}[i - 1]')}, ' ', -1)", f"split_part(ltrim({plain('x')}), ' ', 1)"
    glued = f"""({_dotted(last)} AND list_contains(a, {_base(last)}) AND NOT regexp_matches(x, '^\\s*\\n') AND NOT (list_contains(b, {_base(first)}) AND regexp_matches(ltrim({first}, '{_PUNCT}'), '^\\p{{Lu}}')))"""
    marked = f"array_to_string(list_transform({ps}, lambda x, i: CASE WHEN i = 1 OR {glued} THEN x ELSE chr(3) || regexp_replace(x, '^\\s+', '') END), '')"
    return _trimmed(f"regexp_replace({marked}, '\n{{2,}}', chr(3), 'g')")


_LISTS = "ln AS (SELECT (SELECT coalesce(list(word), []) FROM ab) AS a, (SELECT coalesce(list(word), []) FROM st WHERE score >= 30) AS b)"


@query(f"WITH {_BEGINS}, {_LISTS}, pc AS (SELECT doc_id, {_pieces('text')} AS ps FROM documents), sg AS (SELECT doc_id, {_learned('ps')} AS p FROM pc, ln) SELECT doc_id, len(p) AS n, md5(array_to_string(p, '|')) AS digest FROM sg")
def sentence_split_learned(s, d):
    """Sentences by the rules and by what the corpus itself teaches of abbreviations and starters."""
    parts = segmenter.segmented(table(s, d, "documents").select("doc_id", "text"), "text", *_learn(s, d), out="p")
    return parts.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|").cast("binary")).alias("digest"))


_BEFORE = "substr(text, 1, pl) || '[CITE]'"


@query(f"""WITH {_BEGINS}, {_LISTS}, {_OFF}, pc AS (SELECT item_id, doc_id, {_pieces(_BEFORE)} AS p1, {_pieces(_BEFORE + " || substr(text, pl + len + 1)")} AS p2 FROM o),
x AS (SELECT 'b' || item_id AS cited, doc_id::VARCHAR AS citing, {_learned("p1")} AS before, {_learned("p2")} AS marked FROM pc, ln)
SELECT cited, citing, array_to_string(marked[greatest(len(before) - 2, 0) + 1 : least(len(before) + 1, len(marked))], '|') AS context FROM x""")
def citation_contexts_learned(s, d):
    """Contexts in sentences that are cut by what the corpus teaches as well."""
    return _contexts(s, d, _corpus(s, d), None, _learn(s, d))


@query("SELECT source AS shard, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_context(s, d):
    return table(s, d, "documents").groupBy(F.col("source").alias("shard")).agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@query("SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 10 AS good FROM conversations")
def context_quality(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", citances.good_context(F.col("text")).alias("good"))


_DIST = "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), ds AS (SELECT vec_id, label, sqrt(sum((v - m) * (v - m))) AS dist FROM x JOIN m USING (label, i) GROUP BY ALL)"


def _label_distances(s, d):
    from citeloom.functions.vectors import distance

    rows = table(s, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return rows.join(means, "label").select("vec_id", "label", distance(F.col("embedding"), F.col("mean")).alias("dist"))


def _top(order):
    return _DIST + f", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(dist, 9) {order}, vec_id) AS n FROM ds) SELECT label, vec_id, round(round(dist, 9), 6) AS dist FROM r WHERE n <= 20"


@query(_top("DESC"))
def context_topn_dist(s, d):
    rows = _label_distances(s, d).withColumn("dist", F.round("dist", 9))
    return citances.select_contexts(rows, 20, "graph_embedding_distance", "label", "vec_id", "dist", "farthest").select("label", "vec_id", F.round("dist", 6).alias("dist"))


@query(_top("ASC"))
def context_topn_nearest(s, d):
    rows = _label_distances(s, d).withColumn("dist", F.round("dist", 9))
    return citances.select_contexts(rows, 20, "graph_embedding_distance", "label", "vec_id", "dist", "nearest").select("label", "vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {E}, r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY md5(concat_ws(chr(9), 'contexts', dst, src)), src) AS n FROM e) SELECT src, dst FROM r WHERE n <= 20")
def context_topn_random(s, d):
    return citances.select_contexts(edges(s, d), 20, "random", "dst", "src").select("src", "dst")


@query("""WITH c AS (SELECT conv_id, conv_id || '/' || turn AS item, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 10 AS good, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY md5(concat_ws(chr(9), 'contexts', conv_id, item)), item) AS k FROM c WHERE n <= 3 OR good) SELECT conv_id, item FROM r WHERE k <= 3""")
def context_topn_good(s, d):
    """Three turns at random of each conversation, of those with ten words or more where there are more than three."""
    rows = table(s, d, "conversations").select("conv_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item"), "text")
    return citances.select_contexts(rows, 3, "random", "conv_id", "item", text="text").select("conv_id", "item")


@query("WITH c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations) SELECT conv_id, turn, (coalesce(sum(n) OVER w, 0))::BIGINT AS start, (coalesce(sum(n) OVER w, 0) + n)::BIGINT AS stop FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def augment_offsets(s, d):
    rows = table(s, d, "conversations").select("conv_id", "turn", F.size(X.split_words(F.col("text"))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("conv_id", "turn", before.cast("long").alias("start"), (before + F.col("n")).cast("long").alias("stop"))


def _turns(s, d):
    """Each conversation's turns in order, as texts: contexts of the document of that id."""
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", "text").alias("t"))
    return turns.groupBy("doc_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def _in_words(rows):
    """Texts and their turns as words: a document is one section of one sentence, and so is each turn. A null turn has no words."""
    contexts = F.transform("turns", lambda t: F.array(X.split_words(F.coalesce(t["text"], F.lit("")))))
    rows = rows.select("*", X.split_words(F.col("text")).alias("words"), contexts.alias("contexts")).drop("text", "turns")
    whole = F.array(F.array(F.lit(0), F.size("words")))
    return rows.select("*", whole.alias("sentences"), whole.alias("sections"))


@query("WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS n FROM documents), c AS (SELECT conv_id AS doc_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::INT AS m, count(*)::INT AS k FROM conversations GROUP BY conv_id) SELECT doc_id, n + coalesce(m, 0) AS n_words, n AS start, n + coalesce(m, 0) AS stop, 1 + coalesce(k, 0) AS n_sections FROM w LEFT JOIN c USING (doc_id)")
def augmented_documents(s, d):
    out = citances.augment(table(s, d, "documents").select("doc_id", "text"), _turns(s, d), _in_words)
    return out.select("doc_id", F.size("words").alias("n_words"), F.get("citances", F.lit(0)).alias("start"), F.get("citances", F.lit(1)).alias("stop"), F.size("sections").alias("n_sections"))


@query("""WITH w AS (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS n FROM documents), c AS (SELECT conv_id AS doc_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::INT AS m FROM conversations GROUP BY conv_id)
SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'dev' ELSE 'test' END AS split, CASE lang WHEN 'fr' THEN n ELSE n + coalesce(m, 0) END AS n_words, CASE WHEN lang <> 'fr' THEN n END AS start, CASE WHEN lang <> 'fr' THEN n + coalesce(m, 0) END AS stop FROM w LEFT JOIN c USING (doc_id)""")
def augmented_splits(s, d):
    """Languages stand for splits; French is the dev split, which passes untouched."""
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "fr", "dev").otherwise("test")
    out = citances.augmented_corpus(table(s, d, "documents").select("doc_id", split.alias("split"), "text"), _turns(s, d), shaped=_in_words)
    return out.select("doc_id", "split", F.size("words").alias("n_words"), F.get("citances", F.lit(0)).alias("start"), F.get("citances", F.lit(1)).alias("stop"))


@query("WITH x AS (SELECT d.doc_id, e.embedding::DOUBLE[] AS e FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id), u AS (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x), m AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v) AS m FROM u GROUP BY i)), f AS (SELECT doc_id, unnest(coalesce(e, m)) AS v, unnest(range(64)) AS i, e IS NOT NULL AS found FROM x, m) SELECT doc_id, i::INT AS i, round(v, 6) AS v, found FROM f")
def embedding_impute(s, d):
    ids = table(s, d, "documents").select("doc_id")
    rows = vectors.imputed(ids, table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    return rows.select("doc_id", "found", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 6))


@query("SELECT b.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id LIMIT 5")
def nearest_neighbors(s, d):
    return vectors.nearest(table(s, d, "embeddings"), 0, "vec_id", 5).withColumn("distance", F.round("distance", 6))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0), x AS (SELECT q.vec_id, e.vec_id AS neighbour, list_distance(a, e.embedding::DOUBLE[]) AS d FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), neighbour) AS rank FROM x) SELECT vec_id, neighbour, rank, round(d, 6) AS distance FROM r WHERE rank <= 5""")
def neighbors_of_many(s, d):
    """The five nearest of every vector whose id is divisible by 50, among all."""
    rows = table(s, d, "embeddings")
    return vectors.nearest_of_many(rows, rows.where("vec_id % 50 = 0"), "vec_id", 5).withColumn("distance", F.round("distance", 6))


@query("WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(v) AS m FROM x GROUP BY i), ds AS (SELECT vec_id, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN m USING (i) GROUP BY vec_id) SELECT vec_id, round(distance, 6) AS distance FROM ds WHERE distance < 0.99")
def outliers(s, d):
    return vectors.without_outliers(table(s, d, "embeddings").select("vec_id", "embedding"), 0.99).select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT user_id, arg_min(event_type, ts) AS task FROM events GROUP BY user_id")
def first_task(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", "ts").alias("task"))


@query("SELECT event_type AS task, count(DISTINCT user_id) AS documents FROM events GROUP BY event_type")
def task_doc_counts(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("task")).agg(F.countDistinct("user_id").alias("documents"))


@query("WITH u AS (SELECT DISTINCT event_type AS task, user_id FROM events) SELECT task, row_number() OVER (PARTITION BY task ORDER BY user_id) - 1 AS place, user_id FROM u")
def task_groups(s, d):
    """The users of each task in order, as rows."""
    rows = table(s, d, "events").select(F.col("event_type").alias("task"), "user_id").distinct()
    return linkage.places(rows, "task", "user_id").select("task", "place", "user_id")


_SHORT = "CASE p_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.SHORT_FORMS.items()) + " ELSE array_to_string(list_transform(list_filter(string_split(replace(p_name, ' ', '_'), '_'), lambda p: p <> ''), lambda p: CASE WHEN p = '3D' THEN p ELSE p[1] END), '') END"


@query(f"WITH x AS (SELECT DISTINCT p_name FROM part UNION ALL VALUES {', '.join(f'({k!r})' for k in X.SHORT_FORMS)}) SELECT p_name, {_SHORT} AS short FROM x")
def abbreviations(s, d):
    """Part names, and the names with fixed short forms."""
    names = table(s, d, "part").select("p_name").distinct().unionByName(s.createDataFrame([(k,) for k in X.SHORT_FORMS], "p_name string"))
    return names.select("p_name", X.abbreviate(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("short"))


@query("WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(chr(9), 'background', vec_id))) AS nth, count(*) OVER () AS n FROM embeddings), dr AS (SELECT nth AS draw, ('0x' || substr(md5(concat_ws(chr(9), 'background', nth)), 1, 12))::BIGINT % n + 1 AS nth FROM n WHERE nth <= floor(0.1::DOUBLE * n)) SELECT draw, vec_id FROM dr JOIN n USING (nth)")
def background_sample(s, d):
    return vectors.sampled_with_replacement(table(s, d, "embeddings"), "vec_id", 0.1)


@query()
def projection_2d(s, d):
    """Places of all vectors in the plane, by their twelve nearest neighbours; SQL can't express the epochs."""
    return projection.neighbour_layout(table(s, d, "embeddings"), "vec_id")


def _leaders(points):
    """SQL after points: for each label in ord order, a point within 4 of a leader enlarges the first such, else it leads."""
    return f"""WITH RECURSIVE {points}, nr AS (SELECT label, x, y, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM pt),
st AS (SELECT DISTINCT label, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE, size DOUBLE)[] AS l FROM nr
UNION ALL SELECT label, n, CASE WHEN hit IS NULL THEN list_append(l, {{'x': x, 'y': y, 'size': 0.5::DOUBLE}})
  ELSE list_transform(l, lambda p, i: CASE WHEN i = hit THEN {{'x': p.x, 'y': p.y, 'size': p.size + 0.25::DOUBLE}} ELSE p END) END FROM
  (SELECT nr.label, nr.n, nr.x, nr.y, st.l, list_position(list_transform(st.l, lambda p: (p.x - nr.x) * (p.x - nr.x) + (p.y - nr.y) * (p.y - nr.y) < 16), true) AS hit FROM st JOIN nr ON nr.label = st.label AND nr.n = st.n + 1)),
ls AS (SELECT label, unnest(arg_max(l, n)) AS p FROM st GROUP BY label)"""


_PLACE = "embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y"


def _placed(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", (F.get("embedding", F.lit(0)).cast("double") * 20).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 20).alias("y"))


@query(_leaders(f"pt AS (SELECT vec_id AS ord, label, {_PLACE} FROM embeddings)") + " SELECT label, p.x AS x, p.y AS y, p.size AS size FROM ls")
def label_leaders(s, d):
    return vectors.label_leaders(_placed(s, d).withColumnRenamed("vec_id", "ord"))


_TASKED = f"f AS (SELECT user_id AS ord, arg_min(event_type, ts) AS label FROM events GROUP BY user_id), pt AS (SELECT ord, f.label, {_PLACE} FROM f JOIN embeddings ON vec_id = ord)"


@query(_leaders(_TASKED) + " SELECT label, array_to_string(list_transform(string_split(label, '_'), lambda w: w[1]), '') AS short, p.x AS x, p.y AS y, p.size AS size FROM ls")
def plot_labels(s, d):
    """The places of the labels of a plot: the first event of a user names the label of the vector with the user's id."""
    tasks = first_task(s, d).select(F.col("user_id").alias("vec_id"), F.col("task").alias("name"))
    points = _placed(s, d).drop("label").join(tasks, "vec_id").select(F.col("vec_id").alias("ord"), F.col("name").alias("label"), "x", "y")
    return vectors.plot_labels(points)


@query(f"WITH {E} SELECT 't' || o_custkey AS src, dst FROM e JOIN orders ON src = 'o' || o_orderkey WHERE o_orderpriority LIKE '1%'")
def remap_keys(s, d):
    orders = table(s, d, "orders").where("o_orderpriority like '1%'").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("t"), "o_custkey").alias("new"))
    return graph.remap_keys(edges(s, d), orders)


@query("SELECT count(*) AS rows, count(*) FILTER (l.doc_id IS NULL) AS missed_first, count(*) FILTER (l.doc_id IS NOT NULL AND e.vec_id IS NULL) AS missed_second FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = l.doc_id")
def miss_counts(s, d):
    rows = table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", F.lit(1).alias("a")), "doc_id", "left").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("b")), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.isnull("a")).alias("missed_first"), F.count_if(F.isnotnull("a") & F.isnull("b")).alias("missed_second"))


@query("SELECT d.doc_id, coalesce(e.label, -1)::INT AS place, CASE WHEN l.doc_id IS NULL THEN 1 WHEN e.label IS NULL THEN 2 END AS missed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = l.doc_id * 3")
def chained_lookup(s, d):
    """Documents to a vector's label over two hops; -1 where a hop misses."""
    one = table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"), (F.col("doc_id") * 3).alias("value")).distinct()
    two = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    return linkage.chained_lookup(table(s, d, "documents").select("doc_id"), "doc_id", [one, two], "place").withColumn("place", F.col("place").cast("int"))


@query("SELECT n_nationkey, n_name, r_name AS topic FROM nation JOIN region ON n_regionkey = r_regionkey")
def strict_topics(s, d):
    topics = table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return linkage.strict_lookup(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", topics, "topic").drop("n_regionkey")


@query(f"WITH {E} SELECT dst AS paper_id, count(*) AS n, string_agg(src, ',' ORDER BY ord) AS citing FROM e GROUP BY dst")
def adjacency_lists(s, d):
    lists = graph.adjacency(edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord"), "ord")
    return lists.select(F.col("src").alias("paper_id"), F.size("list").cast("long").alias("n"), F.array_join("list", ",").alias("citing"))


@query(f"WITH {E}, r AS (SELECT dst AS paper_id, src, ord, (row_number() OVER (PARTITION BY dst ORDER BY ord) - 1) // 10 AS chunk FROM e) SELECT paper_id, chunk, count(*) AS n, string_agg(src, ',' ORDER BY ord) AS citing FROM r GROUP BY ALL")
def adjacency_chunks(s, d):
    """Lists of ten, so that most parts have several."""
    lists = graph.adjacency_chunks(edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ord"), "ord", 10)
    return lists.select(F.col("src").alias("paper_id"), "chunk", F.size("list").cast("long").alias("n"), F.array_join("list", ",").alias("citing"))


@query(f"WITH {P} SELECT paper_id, shard FROM p WHERE shard IN (SELECT DISTINCT shard FROM p ORDER BY shard LIMIT 2) ORDER BY ord LIMIT 50")
def limited_documents(s, d):
    """The first 50 documents of the first two shards: the limit is the operator."""
    from citeloom.sources.readers import first_documents

    rows = papers(s, d)
    return first_documents(rows.join(rows.select("shard").distinct().orderBy("shard").limit(2), "shard", "left_semi"), 50, "ord").select("paper_id", "shard")


@query("""WITH tg AS (SELECT user_id AS vec_id, arg_min(event_type, ts) AS task FROM events GROUP BY user_id),
n AS (SELECT vec_id, row_number() OVER (ORDER BY md5(concat_ws(chr(9), 'background', vec_id))) AS nth, count(*) OVER () AS n FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM tg)),
dr AS (SELECT unnest(range(1, floor(0.1::DOUBLE * (SELECT count(*) FROM embeddings))::BIGINT + 1)) AS draw),
bg AS (SELECT n.vec_id FROM dr, (SELECT DISTINCT n AS k FROM n) JOIN n ON nth = ('0x' || substr(md5(concat_ws(chr(9), 'background', draw)), 1, 12))::BIGINT % k + 1),
pt AS (SELECT row_number() OVER () AS i, * FROM (SELECT vec_id, task, 'topic of ' || task AS topic FROM tg UNION ALL SELECT vec_id, NULL, NULL FROM bg) JOIN embeddings USING (vec_id)),
x AS (SELECT i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM pt), m AS (SELECT k, avg(v) AS m FROM x GROUP BY k), ds AS (SELECT i, sqrt(sum((v - m) * (v - m))) AS distance FROM x JOIN m USING (k) GROUP BY i)
SELECT vec_id, task, topic, round(distance, 6) AS distance FROM pt JOIN ds USING (i) WHERE distance < 0.99""")
def plot_points(s, d):
    events = table(s, d, "events")
    targets = first_task(s, d).select(F.col("user_id").alias("vec_id"), "task")
    topics = events.select(F.col("event_type").alias("key"), F.concat(F.lit("topic of "), "event_type").alias("value")).distinct()
    points = vectors.plot_points(targets, topics, table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", 0.1, 0.99)
    return points.select("vec_id", "task", "topic", F.round("distance", 6).alias("distance"))
