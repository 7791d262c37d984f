"""Divergence audit, whitening and sharding against plain serial code, on odd rows and on whole small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import divergence, queries, sharding, whitening

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def plain_audit(rows, min_docs=10, most=10):
    """The audit in Python's whole numbers, term by term."""
    words = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in words}:
        mine = [x for x in words if x[0] == lang]
        docs, total, by = Counter(), Counter(), defaultdict(Counter)
        for _, source, ws in mine:
            docs.update(set(ws))
            total.update(ws)
            by[source].update(ws)
        kept = [t for t, n in docs.items() if n >= min_docs]
        share = lambda count: {t: 1 + 10**9 * (count[t] + 2) // (sum(count[u] for u in kept) + 2 * len(kept)) for t in kept}
        own, q = {s: share(c) for s, c in by.items()}, share(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, p in own.items():
            pairs = [(o, sum(f(p[t], own[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, f(p[t], q[t])) for t in kept if by[s][t] and p[t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top])]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_random(spark):
    """Nulls, ties, repeated rows, groups without terms, a language without kept terms, clashing names, a text of many pieces."""
    rng = random.Random(3)
    words = ["Ab", "ab", "cé", "ÉTÉ", "日本", "x1y", "d-e", "ZZ", "it's", "q", "w"]
    text = lambda: " ".join(rng.choices(words, range(1, 12), k=rng.randrange(1, 9)))
    rows = [(text(), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S1", None])) for _ in range(150)]
    rows += [("alone", "de", "s1"), (None, "de", "s9"), ("", "en", "empty"), ("0 1 2", "en", "digits"), rows[0], rows[0], ("Ab cé " * 300_000, "en", "long")]
    df = spark.createDataFrame([(i, *r, i, i) for i, r in enumerate(rows)], f"{DOCS}, term int, gid int").repartition(5)
    assert audited(df, terms=4) == plain_audit(rows)
    assert audited(df, min_docs=2, most=3) == plain_audit(rows, 2, 3)


def test_audit_source_blocks(spark):
    """More sources than a tile holds, most of which lack most terms."""
    rng = random.Random(4)
    rows = [(" ".join(rng.choices([chr(97 + i) * 2 for i in range(20)], k=2)), "en", f"s{i % 8}") for i in range(60)]
    assert audited(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS), min_docs=3, sources=3, terms=5) == plain_audit(rows, 3)


def test_audit_nothing(spark):
    assert audited(spark.createDataFrame([], DOCS)) == []


def test_audit_counts_in_small_tables(spark):
    """Tasks that pass partial counts on after every few terms give the same rows."""
    rows = [(f"a b c d{chr(97 + i % 5)}", "en", f"s{i % 3}") for i in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    assert audited(df, held=2) == plain_audit(rows)


def test_shares_are_exact():
    rng = random.Random(5)
    counts = np.array([rng.randrange(1, 10**12) for _ in range(200)])
    sizes = np.array([rng.randrange(10**12, 8 * 10**15) for _ in range(200)])
    assert divergence.shares(counts, sizes).tolist() == [1 + 10**9 * int(c) // int(n) for c, n in zip(counts, sizes, strict=True)]


VECTORS = "vec_id long, embedding array<float>"


def test_whitening_whole_table(spark):
    """op12 over the smallest embeddings against numpy's own eigenvectors, and exact deviations in Python's whole numbers."""
    rows = queries.op12_embedding_whitening(spark, DATA).collect()
    given = {r["vec_id"]: [int(math.floor(1024 * c)) + 100_000 for c in r["embedding"]] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    ids, x = list(given), np.array(list(given.values()), np.float64)
    n, sums = len(ids), [sum(v[i] for v in given.values()) for i in range(x.shape[1])]
    cov = (x - x.mean(0)).T @ (x - x.mean(0)) / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    white = (x - x.mean(0)) @ v / np.sqrt(e)
    at = {k: i for i, k in enumerate(ids)}
    assert len(rows) == 8 * n
    sign = {}
    for r in rows:
        want = white[at[r["vec_id"]], r["component"] - 1]
        if abs(want) > 0.1:
            sign.setdefault(r["component"], math.copysign(1, want * r["whitened"]))
        assert abs(abs(want) - abs(r["whitened"])) < 1e-7
        assert abs(want) <= 0.1 or sign[r["component"]] == math.copysign(1, want * r["whitened"])
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] / (e[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(given[r["vec_id"]], sums, strict=True))


def test_whitening_odd_rows(spark):
    """Unusable vectors drop out, repeated rows and null ids stay, more partitions than states of one merge agree with one."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(90, 5)) * [9, 4, 2, 1, 0.5])]
    odd = [(None, rows[0][1]), (0, rows[0][1]), (100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [math.nan] * 5), (104, [math.inf] * 5), (105, [1.0] * 4), (106, [1e38] * 5)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], f"{VECTORS}, component int, n int")
    got = whitening.whiten(df.repartition(70)).collect()
    one = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df.coalesce(1)).collect()}
    assert Counter(r["vec_id"] for r in got) == Counter([i for i, _ in rows + odd[:2]] * 5)
    for r in got:
        other = one[r["vec_id"], r["component"]]
        assert r["n"] == 92 and r["deviation"] == other["deviation"] and abs(abs(r["whitened"]) - abs(other["whitened"])) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    """Two varying dimensions of four give two components; equal vectors, and no vectors, give none."""
    flat = [(i, [float(i), float(i * i % 7), 3.0, 3.0]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()
    assert {r["component"]: (r["whitened"] is None, r["explained"] == 0) for r in got} == {1: (False, False), 2: (False, False), 3: (True, True), 4: (True, True)}
    assert all(r["identity_error"] < 1e-9 for r in got)
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], VECTORS)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    empty = whitening.whiten(spark.createDataFrame([(1, None)], VECTORS))
    assert empty.count() == 0 and empty.columns == whitening.whiten(spark.createDataFrame(flat, VECTORS)).columns


def test_whitening_large_deviations(spark):
    """Deviations beyond a long are exact decimals."""
    rows = [(i, [float(2**38 * (-1) ** i), float(i)]) for i in range(6)]
    x = [[int(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: sum((6 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)} and got[0] > 2**63


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_symmetric_qr(size):
    rng = np.random.default_rng(size)
    for a in (rng.normal(size=(size, size)), np.diag(np.arange(size, dtype=float)), np.zeros((size, size)), np.ones((size, size))):
        a = a + a.T
        values, axes = whitening.symmetric_qr(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-10 * (1 + np.abs(a).max() * size))
        assert np.allclose(axes @ axes.T, np.eye(size), atol=1e-12) and np.allclose(axes @ a @ axes.T, np.diag(values), atol=1e-10 * (1 + np.abs(a).max() * size))


def one_at_a_time(rows, shards, virtual, seed="ring"):
    """Bounded loads key by key: first each key in ring order asks its own shard, then those left go on clockwise."""
    place = lambda text: int(md5(text.encode()).hexdigest()[:15], 16)
    nodes = sorted((place(f"{seed}:{s}:{v}"), s) for s in range(shards) for v in range(virtual))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    keyed = sorted((place(f"{seed}-key:{'' if i is None else i}"), (i is not None, i or 0), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in rows)
    home = lambda at: next((k for k, (p, _) in enumerate(nodes) if p >= at), 0)
    out, over = [], []
    for key in keyed:
        s = nodes[home(key[0])][1]
        if room[s]:
            room[s] -= 1
            out.append((key, s))
        else:
            over.append(key)
    for key in over:
        at = home(key[0])
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        room[nodes[at % len(nodes)][1]] -= 1
        out.append((key, nodes[at % len(nodes)][1]))
    return Counter((key[1][1] if key[1][0] else None, key[3], key[2], s) for key, s in out)


def laid_out(rows, shards):
    """Counts at most one apart, and slots from 0 without gaps."""
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    return max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_whole_table(spark):
    rows = queries.op13_sharding(spark, DATA).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert laid_out(rows, 40) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows) == one_at_a_time(docs, 40, 64)


def test_sharding_odd_rows(spark):
    """Null ids and texts, repeated rows, ids and texts that a third of the rows share, clashing names, string ids."""
    rows = [(i, f"t{i}") for i in range(60)] + [(None, None)] * 40 + [(7, "same")] * 50 + [(i, "same") for i in range(200, 230)] + [(300, "")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, shard int, _row int").repartition(6)
    got = sharding.assign(df, 7, 8).collect()
    assert laid_out(got, 7)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == one_at_a_time(rows, 7, 8)
    named = sharding.assign(df.withColumn("doc_id", F.col("doc_id").cast("string")), 7, 8).collect()
    assert laid_out(named, 7) and len(named) == len(rows)
    assert sharding.assign(df.limit(0), 7, 8).collect() == []
    assert laid_out(sharding.assign(df.limit(3), 7, 8).collect(), 7)


def test_sharding_hot_id_is_spread(spark):
    """Rows of one id are parted: no range of the sort holds all of them."""
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")  # several ranges of four may hash to one task
    try:
        got = sharding.assign(df, 40, 16)
        assert laid_out(got.select("shard", "slot").collect(), 40)
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sharding_moves_little(spark):
    """With slack a further shard moves rows mostly into itself: at most twice its share of the rows moves."""
    df = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = lambda k: {r["doc_id"]: r["shard"] for r in sharding.assign(df, k, 64, slack=0.25).collect()}
    before, after = at(10), at(11)
    moved = sum(before[i] != after[i] for i in before)
    assert moved <= 2 * len(before) / 11
    assert max(Counter(before.values()).values()) <= 1.25 * 800 and max(Counter(after.values()).values()) <= math.ceil(1.25 * 8000 / 11)


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(50)], "doc_id long, text string, lang string")
    sharding.write_shards(docs, f"{tmp_path}/s", 4, 8)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert laid_out(back.collect(), 4) and {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, f"t{i}") for i in range(50)}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("slot", F.lit(1)), f"{tmp_path}/t")
