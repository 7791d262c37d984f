"""Queries against plain recomputations that share no code with the operators."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from citeloom.llm import fingerprints, mixing, quality, queries, urls, warc

DATA = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def table(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_op1_scores(spark):
    """Compressed sizes by zstandard itself; the model is the only thing taken from the operator."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.train(docs, labels, exclude=quality.held_out(F.col("doc_id")))
    plain = [zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, DATA).collect()}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        good, bad = (sum(len(c.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for c in plain)
        d, q = ((bad - good) / (bad + good), math.log((good + bad) / (2 * len(data)))) if data else (0.0, 0.0)
        d, q = min(4, max(-4, 20 * d)), min(1, max(-4, q))
        want = 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, (1, d, q, min(q + 1.5, 0)), strict=True))))
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(want) and row["predicted"] == (row["score"] >= 0.3) and row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def encoded(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.byte_bpe())
    return {r["doc_id"]: plain.encode(r["text"] or "", add_special_tokens=False).ids for r in table(spark, "documents").collect()}


def test_op3_pieces(spark):
    """Ids by the tokenizers library; pieces, cuts and places by plain loops."""
    got, ids = {}, encoded(spark)
    for r in queries.op3_best_fit_packing(spark, DATA).collect():
        got.setdefault(r["doc_id"], []).append(r)
    by_sequence = {}
    assert got.keys() == ids.keys()
    for i, rows in got.items():
        whole, at = [*ids[i], 0], 0
        for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
            part = whole[at : at + r["length"]]
            assert (r["piece"], r["start"], len(part)) == (k, at, r["length"]) and 0 < len(part) <= 2048
            assert len(rows) == 1 or k == 0 or r["length"] == 2048
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            at += r["length"]
        assert at == len(whole)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(v) + 1 for v in ids.values())
    assert len(by_sequence) <= math.ceil(total / 2048) * 1.02 + 1


def test_op10_histogram(spark):
    lengths = [len(v) for v in encoded(spark).values()]
    got = {r["length"]: r.asDict() for r in queries.op10_token_counts(spark, DATA).collect()}
    assert got.keys() == set(lengths)
    for x, r in got.items():
        assert r == {
            "length": x, "n_docs": lengths.count(x), "tokens": x * lengths.count(x), "docs_at_least": sum(y >= x for y in lengths), "tokens_at_least": sum(y for y in lengths if y >= x),
            "docs_before": sum(y < x for y in lengths), "truncated_tokens": sum(min(x, y) for y in lengths),
        }


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def url_features(url):
    host, path = url_parts(url)
    counts = {}
    for kind, text in ((0, f"^{host}$"), (1, path)):
        for size in (3, 4):
            for i in range(len(text) - size + 1):
                b = int(hashlib.md5(f"{kind}{text[i : i + size]}".encode()).hexdigest()[:3], 16) + 1
                counts[b] = counts.get(b, 0) + 1
    counts[0] = 1
    norm = math.sqrt(sum(c * c for c in counts.values()))
    return {b: c / norm for b, c in counts.items()}


@pytest.fixture(scope="module")
def url_weights():
    """Logistic regression by plain gradient descent over the labelled table."""
    rows = [(url_features(u), y) for u, y in urls.LABELLED_URLS]
    w = np.zeros(urls.BUCKETS + 1)
    for _ in range(200):
        step = np.zeros_like(w)
        for x, y in rows:
            p = 1 / (1 + math.exp(-sum(w[b] * v for b, v in x.items())))
            for b, v in x.items():
                step[b] += (y - p) * v
        w = w * (1 - 0.002) + 0.5 * step
    return w


def test_op5_weights(spark, url_weights):
    assert np.abs(np.array(urls.train(spark)) - url_weights).max() < 1e-9


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_op5_pages(spark, url_weights, folder):
    got = {r["page_id"]: r for r in queries.op5_url_filters(spark, folder).collect()}
    pages = table(spark, "pages", folder).collect()
    assert got.keys() == {r["page_id"] for r in pages}
    for r in pages:
        host, path = url_parts(r["url"])
        fitting = [(h + p, verdict) for verdict, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fitting, key=lambda x: len(x[0]), default=(None, None))
        if rule is None:
            score = sum(url_weights[b] * v for b, v in url_features(r["url"]).items())
            verdict = "block" if score >= 0 else "allow"
        row = got[r["page_id"]]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)


def test_op5_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), urls.train(spark)).count() == 0


def scramble(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def shingle_hashes(text, width=5):
    """The documented hash of each shingle in whole numbers: words by xxh3, joined by a splitmix step."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if 0 < len(words) < width:
        return {xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))}
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    out = set()
    for i in range(len(words) - width + 1):
        h = scramble((hashes[i] + 0x9E3779B97F4A7C15) & MASK)
        for j in range(1, width):
            h = scramble((h * 0x9E3779B97F4A7C15 + hashes[i + j]) & MASK)
        out.add(h)
    return out


def alike(a, b, k=128):
    a, b = set(sorted(a)[:k]), set(sorted(b)[:k])
    union = sorted(a | b)[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def check_fingerprints(rows, got):
    """rows: (id, text) in order; got: the operator's rows by id."""
    for k, (i, text) in enumerate(rows):
        then = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + then[:cut]
        a, b, c = map(shingle_hashes, (text, edited, then))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{h:016x}" for h in sorted(a)[:128]) and r["edited_fingerprint"] == "".join(f"{h:016x}" for h in sorted(b)[:128])
        assert (r["near_edited"], r["near_next"]) == (alike(a, b), alike(a, c))


def test_op6_fingerprints(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in table(spark, "documents").collect())
    check_fingerprints(rows, {r["doc_id"]: r for r in queries.op6_document_fingerprints(spark, DATA).collect()})


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_op6_ids_of_other_kinds(spark, kind):
    rows = [(str(k) if kind != "date" else f"2020-01-{k + 1:02d}", f"w{k} a b c d e f g") for k in range(25)]
    docs = spark.createDataFrame([*rows, (None, "nothing names this row")], "doc_id string, text string").repartition(3).selectExpr(f"cast(doc_id as {kind}) doc_id", "text")
    got = {r["doc_id"]: r for r in fingerprints.with_edits(docs).collect()}
    order = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0) if kind != "string" else (r[0] is not None, r[0] or ""))
    check_fingerprints([(i, t) for i, t in order], got)


def test_op6_empty_table(spark):
    assert fingerprints.with_edits(spark.createDataFrame([], "doc_id string, text string, part int")).count() == 0


def test_archives_hold_the_payloads(spark, tmp_path):
    pages = table(spark, "pages")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/warc").cache()
    got = {r["page_id"]: r for r in warc.read_archives(manifest, f"file://{tmp_path}/warc").collect()}
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    assert got.keys() == want.keys()
    for i, data in want.items():
        full = got[got[i]["refers_to"]] if got[i]["record_type"] == "revisit" else got[i]
        assert bytes(full["payload"]) == data and got[i]["payload_bytes"] == len(data)
    assert all(r["payload"] is None for r in warc.read_archives(manifest, f"file://{tmp_path}/warc", payloads=False).collect())
    with pytest.raises(ValueError, match="can't be written"):
        warc.store_uri(spark, "file:///proc/nowhere")


def test_mixed_copies_follow_the_rows(spark):
    """Rows that share an id, or have none, get copies of their own: the mix keeps to its budget."""
    rows = [(1, "a b c d", "x"), (1, "e f g h", "x"), (2, "i j k l", "x"), (None, "m n o p", "y"), (None, "q r s t", "y"), (3, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, copies string").repartition(2)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    want = {(r["doc_id"], r["size"]): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"] * (r["size"] > 0)
    found = dict.fromkeys(want, 0)
    for r in got.collect():
        found[r["doc_id"], len(r["text"].split())] += 1
    assert found == want and sum(4 * n for n in found.values()) <= 1.5 * 20
    assert mixing.mixed(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    same = lambda x: round(x, 6) if isinstance(x, float) else x
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(same(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(map(same, r))) for r in df.select(*columns).collect()) == want
