"""Each operator on small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from citeloom.llm import fingerprints, itq, jaccard, licenses, mixing, packing, quality, queries, tokens, urls, warc
from citeloom.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, size string, part int"


def corpus(n=60, seed=3):
    """Words from a small vocabulary, copies with small edits, and the odd cases."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            words = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"W{rng.randrange(99)}"
        else:
            words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 30, 60, 200]))]
        out.append(" ".join(words))
    return [*out, None, "", " \t\n", "one", "Two words", "é  ü 漢字", "x " * 20000, "one"]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0, 1, "k", "z", 0) for i, t in enumerate(corpus())]
    return spark.createDataFrame([*rows, rows[5]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (9, 5)], "u long, v long")
    assert {(r["node"], r["root"]) for r in connected_components(edges).collect()} == {(4, 3), (5, 3), (9, 3), (8, 7)}
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_large_graphs(spark, monkeypatch):
    """Star contractions, which take over above a checked size, end in the same roots as one task; ids may be text."""
    from citeloom.llm import components

    rng = random.Random(8)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3)]
    edges = spark.createDataFrame(rows, "u long, v long")
    text = edges.selectExpr("cast(u as string) u", "cast(v as string) v")
    small = [set(map(tuple, connected_components(e).collect())) for e in (edges, text)]
    monkeypatch.setattr(components, "SMALL", 0)
    assert [set(map(tuple, connected_components(e).collect())) for e in (edges, text)] == small and (460, 400) in small[0]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard(documents, width, num):
    sets = {}
    for i, t in texts(documents):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    group[a] = group[b] = min(group[a], group[b])
        if len({(group[a], a) for a in sets}) == len(sets):
            break
    for _ in range(10):
        group = {i: group[g] for i, g in group.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(documents, width, num, 100).collect()}
    assert got == {i: (len(s), group[i]) for i, s in sets.items()}
    kept = sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(documents, width, num, 100).collect())
    assert kept == sorted({i for i in sets if group[i] == i})


def test_jaccard_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_without_ids(spark):
    """A ~ T ~ B where only T links A and B and has no doc_id; groups without any doc_id keep one row."""
    words = [f"w{i}" for i in range(100)]
    a, b = [*words[:90], *[f"a{i}" for i in range(10)]], [*[f"b{i}" for i in range(10)], *words[10:]]
    rows = [(1, " ".join(a)), (None, " ".join(words)), (2, " ".join(b)), *[(None, " ".join(f"n{i}" for i in range(60)))] * 50, (None, " ".join(f"n{i}" for i in range(62))), (None, None), (None, " "), (None, "other")]
    docs = spark.createDataFrame([(i, t, {"k": "v"}) for i, t in rows], "doc_id long, text string, tags map<string,string>").repartition(3)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert (got[1, 96], got[2, 96], got[None, 96]) == (1, 1, 1)
    kept = sorted((r["doc_id"] or 0, len((r["text"] or "").split())) for r in jaccard.drop_near_duplicates(docs).collect())
    assert kept[:4] in ([(0, 0), (0, 0), (0, 1), (0, 60)], [(0, 0), (0, 0), (0, 1), (0, 62)]) and kept[4:] == [(1, 100)]


def test_quality(spark, documents, empty):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.train(docs, labels)
    assert quality.train(docs, labels) == model
    got = quality.score(docs, model).join(labels, "doc_id").toPandas()
    assert ((got.score >= 0.3).astype(int) == got.quality).mean() > 0.9
    odd = quality.score(documents, model).collect()
    assert len(odd) == documents.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(documents, model, 0.0).columns == documents.columns
    assert quality.score(empty, quality.train(empty, labels.limit(0))).count() == 0
    out = spark.createDataFrame([(3,), (None,)], "doc_id long").select(quality.held_out(F.col("doc_id"))).collect()
    assert [r[0] for r in out] == [zlib.crc32(b"3") % 5 == 0, False]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op1_quality_classifier(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93


def test_warc(spark):
    long = "ü" * 200_000
    rows = [(4, "http://a b/ü", long, 1), (2, None, long, 1), (9, "u", long, 1), (5, "u", "short", 1), (6, "u", "short", 1), (7, "u", None, 1), (8, "u", "", 1), (9, "u", long, 1), (None, "u", long, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()))
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = html == long and i != 2
        want.append((i or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_finds_damage():
    data = bytearray(warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), 7, None, "d"))
    import io

    member = next(warc.members(io.BytesIO(bytes(data)), 3))
    with pytest.raises(ValueError, match="payload digest"):
        warc.parse(member)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(bytes(data[:-9])), 5))


def test_encoder_equals_tokenizers(documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.byte_bpe())
    plain.encode_special_tokens = True
    enc = tokens.Encoder(queries.byte_bpe())
    rng = random.Random(5)
    odd = ["".join(rng.choice(" \n\t  \x1cab'sé1.漢<|") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in [*odd, "<|endoftext|> a", *[t for _, t in texts(documents) if t]]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_are_found(spark):
    from tokenizers import Tokenizer

    path = queries.byte_bpe()
    plain = Tokenizer.from_file(path)
    mark, rng = "<|endoftext|>", random.Random(6)
    odd = ["".join(rng.choice([mark, " ", "\n", "ab", "'s", "1", "<|", "|>", "endoftext", "é", "\t"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    rows = [f"a {mark} b", mark, mark * 3, f"{mark} a", f"a{mark}", f"x  {mark}  y", "<|endoftext|", *odd]
    want = [plain.encode(t, add_special_tokens=False).ids for t in rows]
    enc = tokens.encoder(path)
    for t, ids in zip(rows, want):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == ids, repr(t)
    docs = spark.createDataFrame(list(enumerate(rows[:7])), "doc_id long, text string")
    assert {r["doc_id"]: r["length"] for r in tokens.lengths(docs, path).collect()} == {i: len(ids) for i, ids in enumerate(want[:7])}
    crc = {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, path).collect()}
    assert crc == {i: zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for i, ids in enumerate(want[:7])}


def test_packing(documents, empty):
    enc = tokens.Encoder(queries.byte_bpe())
    got = packing.pack(documents, queries.byte_bpe()).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts(documents.dropDuplicates(["doc_id"])):
        ids = enc.ids(t) + bytes(4)
        times = 2 if i == 5 else 1
        rows = sorted(by_doc[i], key=lambda r: r["piece"])[::times]
        assert b"".join(ids[4 * r["start"] : 4 * (r["start"] + r["length"])] for r in rows) == ids
        assert all(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in rows)
        assert all(r["length"] == 2048 for r in rows[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, queries.byte_bpe()).count() == 0


def test_plan_is_tight():
    rng = random.Random(0)
    for _ in range(30):
        counts = {rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(rng.randrange(1, 200))}
        bins = packing.plan(counts)
        used = {}
        for n, contents in bins:
            assert 0 < sum(s * k for s, k in contents) <= 2048
            for s, k in contents:
                used[s] = used.get(s, 0) + n * k
        assert used == counts
        items = sorted((s for s, c in counts.items() for _ in range(c)), reverse=True)
        gaps = []
        for s in items:  # plain best fit, largest first
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(2048 - s)
            else:
                gaps[gaps.index(fit)] = fit - s
        assert sum(n for n, _ in bins) <= len(gaps) * 1.01 + 1


def test_histogram(documents, empty):
    got = {r["length"]: r for r in tokens.length_histogram(documents, queries.byte_bpe()).collect()}
    lengths = sorted(r["length"] for r in tokens.lengths(documents, queries.byte_bpe()).collect())
    assert sorted(got) == sorted(set(lengths))
    for x, r in got.items():
        assert r["n_docs"] == lengths.count(x) and r["docs_at_least"] == sum(y >= x for y in lengths)
        assert r["tokens_at_least"] == sum(y for y in lengths if y >= x) and r["truncated_tokens"] == sum(min(x, y) for y in lengths)
        assert r["docs_before"] == sum(y < x for y in lengths) and r["tokens"] == x * r["n_docs"]
    assert tokens.length_histogram(empty, queries.byte_bpe()).count() == 0


def test_urls(spark):
    rows = [(1, "HTTPS://WWW.Example.COM/en/x?q#f"), (2, "http://a.example.com/en/1"), (3, "http://example.com/en/1"), (4, "http://b.net/es/2"), (5, "http://bnet/es/2"), (6, None), (7, "nothing"), (8, "://x.com"), (9, "http://cheap-pills.example.org/en/1"), (10, "http://garden.example.org/en/1"), (11, "http://É.com/a\nb#c"), (1, "HTTPS://WWW.Example.COM/en/x?q#f")]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urls.judge(pages, urls.train(spark)).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4, 8)] == [("www.example.com", "/en/x", "www.example.com/en/"), ("a.example.com", "/en/1", "example.com/en/"), ("example.com", "/en/1", "example.com/en/"), ("b.net", "/es/2", "net/es/"), ("x.com", "", None)]
    assert [got[i]["verdict"] for i in (1, 2, 3, 4, 9, 10)] == ["allow", "block", "block", "block", "block", "allow"]
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (6, 7)) and got[5]["rule"] is None
    assert (got[11]["host"], got[11]["path"], got[11]["rule"]) == ("É.com", "/a\nb", "com/")


def test_fingerprints(documents, spark):
    rows = sorted(((i, t or "") for i, t in texts(documents)))
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprints.with_edits(documents).collect())
    want = []
    for k, (i, t) in enumerate(rows):
        then = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + then[:cut]
        a, b, c = (fingerprints.sketch(x) for x in (t, edited, then))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.to_text(a), fingerprints.resemblance(a, b), fingerprints.resemblance(a, c)))
    assert got == sorted(want)
    parts = spark.createDataFrame([(1, fingerprints.to_text(fingerprints.sketch(t))) for _, t in rows[:9]] + [(2, "")], "key int, fingerprint string")
    merged = {r["key"]: r["fingerprint"] for r in fingerprints.merged_fingerprints(parts, "key").collect()}
    assert merged == {1: fingerprints.to_text(fingerprints.merge(fingerprints.sketch(t) for _, t in rows[:9])), 2: ""}
    a, b = (np.unique(np.random.default_rng(s).integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)) for s in (1, 2))
    assert abs(fingerprints.distinct(np.union1d(a, b)[:128]) / 8000 - 1) < 0.3
    assert abs(fingerprints.resemblance(np.union1d(a, b)[:128], a[:128]) - 0.5) < 0.2 and fingerprints.containment(a[:128], np.union1d(a, b)[:128]) > 0.9


def test_mixing(documents, empty):
    got = mixing.mix(documents)
    rows = got.collect()
    assert len(rows) == documents.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    sizes, targets = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        targets[r["source"]] = r["target"]
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, want = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    want |= {s: level * weights[s] for s in free}
    assert targets == pytest.approx(want)
    assert sorted(map(tuple, mixing.mix(documents).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert sum(r["taken"] for r in rows) <= 1.5 * sum(sizes.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(documents).columns == documents.columns


def test_licenses(spark):
    got = licenses.scan_text
    assert got("Under the MIT-License, or CC BY 4.0; cc by-nc. mit licenses")[:6] == (14, 3, 2, 9, "cc-by,mit", "cc-by,cc-by-nc,mit")
    assert got(None) == (0, 0, None, None, "", "", 0.0)
    assert got("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0")[5] == "apache-2.0,gpl-2.0,mit"
    assert licenses.parse("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.parse("(a or b") is None and licenses.parse("and a") is None and licenses.parse("mit some prose") == ["mit"]
    held = {"a": 0.2, "b": 0.9, "c": 0.5}
    assert licenses.evaluate(licenses.parse("a or b and c"), held) == 0.5
    rows = spark.createDataFrame([(1, "GNU General\nPublic License", 5), (1, "GNU General\nPublic License", 5), (2, None, 5)], "doc_id long, text string, labels int")
    assert sorted(tuple(r)[:6] for r in licenses.scan(rows).collect()) == [(1, 4, 1, 0, 0, "gpl"), (1, 4, 1, 0, 0, "gpl"), (2, 0, 0, None, None, "")]


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.04 * rng.standard_normal(16)).tolist(), int(i % 40 % 3)) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, rows[0][1], None), (305, [None] + [1.0] * 15, 0), (306, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    good = [r for r in rows if r[0] < 301]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good]))
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    links = np.array([got[i]["n_links"] for i in range(301)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum() > 0
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(301, 307))
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall(spark):
    d = "/root/testdata/sf0.1/embeddings.parquet"
    rows = spark.read.parquet(d).toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98) & (rows.label.to_numpy()[:, None] == rows.label.to_numpy())
    np.fill_diagonal(near, False)
    got = itq.near_duplicates(spark.read.parquet(d)).toPandas().set_index("vec_id").loc[rows.vec_id].n_links
    assert got.sum() >= 0.9 * near.sum() and (got.to_numpy() <= near.sum(1)).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        after = stage(spark, before, DATA)
        assert after.columns == names and after.count() > 0
        if k < 2:
            assert after.count() < before.count() and after.join(before, "doc_id", "left_anti").isEmpty()
        before = after.cache()
    packed = corpus_pipeline.STAGES[3][1](spark, before, DATA)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def serial_pipeline(rows, model):
    """The four stages in plain loops over (doc_id, text, source) rows; the pieces they end in, sorted."""
    plain = [zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]

    def good(text):
        data = (text or "").encode()
        x, y = (sum(len(c.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for c in plain)
        return model.score(np.array([((y - x) / (x + y), np.log((x + y) / (2 * len(data))))] if data else [(0.0, 0.0)]))[0] >= 0.3

    rows = [r for r in rows if good(r[1])]
    sets = []
    for _, text, _ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    lowest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    stay = {None} | {r[0] for k, r in enumerate(rows) if r[0] == lowest[group[k]]}
    kept = [r for r in rows if r[0] in stay]
    rows = sorted(set(r for r in kept if r[0] is not None), key=str) + [r for r in kept if r[0] is None]

    size = [len((t or "").encode().split()) for _, t, _ in rows]
    of = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in {r[2] for r in rows}}
    order = sorted(s for s in of if s is not None) + [None] * (None in of)
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size)
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * of[s]}:
        target |= {s: 2.0 * of[s] for s in over}
        left, free = left - sum(2 * of[s] for s in over), free - over
    target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    digest = [int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows]
    total, queue = dict.fromkeys(of, 0), []
    for k in sorted(range(len(rows)), key=lambda k: (digest[k], -1 if rows[k][0] is None else rows[k][0], size[k])):
        s = rows[k][2]
        total[s] += size[k]
        queue += [((total[s] + copy * of[s]) / target[s], s or "", digest[k], size[k], copy, k) for copy in (0, 1) if target[s]]
    copies, running = [0] * len(rows), 0
    for *_, k in sorted(queue):
        running += size[k]
        copies[k] += running <= 1.5 * sum(size)

    enc, out = tokens.Encoder(queries.byte_bpe()), []
    for k, (i, text, _) in enumerate(rows):
        ids = enc.ids(text) + bytes(4)
        cuts = [0, *range(len(ids) // 4 % 2048 or 2048, len(ids) // 4 + 1, 2048)]
        pieces = [(str(i), p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(itertools.pairwise(cuts))]
        out += pieces * (copies[k] if size[k] else 0)
    return sorted(out)


def test_pipeline_equals_serial_loops(spark, tmp_path):
    """Null ids, texts and sources, wordless and very long texts, repeated rows and columns named like inner ones."""
    import corpus_pipeline

    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    good = base.orderBy("doc_id").first()["text"]
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, good * 40), (9005, good), (9006, good + " end"), (None, "one row without an id"), (9007, good.upper()), (9008, good), (9008, base.orderBy(F.desc("doc_id")).first()["text"][::-1])]
    extra = spark.createDataFrame([(i, t, None, None if k % 2 else "web", None) for k, (i, t) in enumerate(odd)], base.schema)
    docs = base.unionByName(extra).unionByName(base.where("doc_id % 9 = 0"))
    clash = ["quality", "score", "sid", "root", "dropped", "copies", "size", "target", "length", "piece", "salt", "_row", "_h"]
    docs = docs.select("*", *[F.lit("x").alias(c) for c in clash])
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.unionByName(labels.limit(3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast(labels.schema["quality"].dataType).alias("quality"), "toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == serial_pipeline(rows, model)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
