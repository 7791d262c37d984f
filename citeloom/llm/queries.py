"""The queries of this subpackage: each operator over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import divergence, fingerprints, itq, jaccard, licenses, mixing, packing, quality, sharding, tokens, urls, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The vocabulary file of the default tokenizer; a parameter of every operator that encodes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that learns from the labels outside the held-out fifth; odd texts as in quality.score()."""
    documents = _table(spark, sf_dir, "documents")
    model = quality.train(documents, _table(spark, sf_dir, "labels"), exclude=quality.held_out(F.col("doc_id")))
    scored = quality.score(documents, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each page, written to archives and read back; nulls and repeated rows as in warc.write_archives()."""
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; odd texts as in packing.pack()."""
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe())


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles at 0.9; odd texts as in jaccard.near_duplicates()."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; odd URLs as in urls.judge()."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.train(spark)).drop("score")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; odd texts as in fingerprints.with_edits()."""
    return fingerprints.with_edits(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; odd texts and sources as in mixing.mix()."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and tags of all documents; odd texts as in licenses.scan()."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels; unusable vectors as in itq.near_duplicates()."""
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the encoded lengths of all documents, with suffix sums; odd texts as in tokens.length_histogram()."""
    return tokens.length_histogram(_table(spark, sf_dir, "documents"), byte_bpe())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ, and by which terms; odd texts and groups as in divergence.audit()."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all usable vectors; unusable ones as in whitening.whiten(). A deviation beyond a long is null."""
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard of 40 and a slot in it for every document; the law is that of rows. Odd rows as in sharding.assign()."""
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_best_fit_packing, op4_ngram_jaccard_join, op5_url_filters, op6_document_fingerprints, op7_source_mixing, op8_license_scans, op9_embedding_near_dedup, op10_token_counts, op11_source_divergence, op12_embedding_whitening, op13_sharding)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
"""



def _quoted(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)


def _grams(table: str, key: str) -> str:
    """(key, b, c): how often each row of table (key, host, path) has each bucket; -1 is the intercept."""
    lists = ", ".join(f"list_transform(range(1, len({text}) - {size - 2}), lambda i: '{kind}' || substr({text}, i, {size}))" for kind, text in ((0, "'^' || host || '$'"), (1, "path")) for size in urls.SIZES)
    bucket = f"list_transform(flatten([{lists}]), lambda g: ('0x' || substr(md5(g), 1, {urls.DIGITS}))::INT)"
    return f"(SELECT {key}, b, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest(list_append({bucket}, -1)) AS b FROM {table}) GROUP BY ALL)"


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_PARTS = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path"

ORACLE_SQL = {
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
tk AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM tk GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n)::BIGINT AS size FROM c JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.size, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 2)) // (l.size + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pr.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM x WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
""",
    "op5_url_filters": f"""
WITH RECURSIVE lab(i, url, y) AS (VALUES {_quoted((i + 1, u, y) for i, (u, y) in enumerate(urls.LABELLED_URLS))}),
lp AS (SELECT i, y, {_PARTS} FROM lab), lc AS {_grams("lp", "i")}, ln AS (SELECT i, sqrt(sum(c * c)) AS norm FROM lc GROUP BY i), x AS (SELECT i, b, c / norm AS x FROM lc JOIN ln USING (i)),
kr AS (SELECT a.i, list(coalesce(k, 0) ORDER BY a.j) AS k FROM (SELECT p.i, q.i AS j FROM lab p, lab q) a LEFT JOIN (SELECT p.i, q.i AS j, sum(p.x * q.x) AS k FROM x p JOIN x q USING (b) GROUP BY ALL) s USING (i, j) GROUP BY a.i),
m AS (SELECT list(k ORDER BY i) AS ks, list(y::DOUBLE ORDER BY i) AS ys FROM kr JOIN lab USING (i)),
gd AS (SELECT 0 AS r, list_transform(ys, lambda v: 0::DOUBLE) AS a FROM m
  UNION ALL SELECT r + 1, list_transform(a, lambda v, i: v * 0.998::DOUBLE + 0.5::DOUBLE * (ys[i] - 1 / (1 + exp(-list_dot_product(ks[i], a))))) FROM gd, m WHERE r < 200),
al AS (SELECT unnest(a) AS alpha, generate_subscripts(a, 1) AS i FROM gd WHERE r = 200), w AS (SELECT b, sum(x * alpha) AS w FROM x JOIN al USING (i) GROUP BY b),
pp AS (SELECT page_id, {_PARTS} FROM pages), dp AS (SELECT DISTINCT host, path, md5(host || ' ' || path) AS u FROM pp), pc AS {_grams("dp", "u")},
sc AS (SELECT u, sum(c * coalesce(w, 0)) AS s FROM pc LEFT JOIN w USING (b) GROUP BY u),
ru(verdict, h, p) AS (VALUES {_quoted(urls.RULES)}),
ft AS (SELECT u, arg_min(h || p, (-len(h || p), h || p)) AS rule, arg_min(verdict, (-len(h || p), h || p)) AS verdict FROM dp JOIN ru ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u)
SELECT page_id, host, path, ft.rule, coalesce(ft.verdict, CASE WHEN s >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM pp JOIN dp USING (host, path) LEFT JOIN ft USING (u) LEFT JOIN sc USING (u)
""",
    "op2_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM q
""",
    "op4_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(lowest.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN lowest ON lowest.x = d.doc_id
""",
    "op7_source_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM g),
r AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) * 1.5::DOUBLE FROM w) AS budget FROM w),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, max(level) FILTER (ratio >= level) OVER () AS free FROM v),
t AS (SELECT source, source_size, budget, least(cap, coalesce(free * weight, cap)) AS target FROM f),
c AS (SELECT s.*, t.source_size, t.budget, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS total
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0 THEN (total + copy * source_size) / target END AS finish FROM c, (VALUES (0), (1)) AS x(copy)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish NULLS LAST, source NULLS FIRST, h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS running FROM e)
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size)::BIGINT AS source_size, round(any_value(target), 6) AS target,
  sum(CASE WHEN finish IS NOT NULL AND running <= budget THEN size ELSE 0 END)::BIGINT AS taken FROM o GROUP BY doc_id
""",
    "op9_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_REACH},
n AS (SELECT x, count(*) AS n FROM both_ways GROUP BY x)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(lowest.y, d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, coalesce(lowest.y, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN n ON n.x = d.vec_id LEFT JOIN lowest ON lowest.x = d.vec_id
""",
}
