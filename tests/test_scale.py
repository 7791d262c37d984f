"""Operators on inputs that one task, one key or the driver should not hold, against plain serial rules."""

import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.operators import graph, linkage, matching, projection, text, vectors
from citeloom.plans.checkpoint import sized_broadcast, written
from citeloom.sources import sinks


def serial_leaders(points, radius=4.0, size=0.5, step=0.25):
    """One point after the other, in ord order."""
    out = {}
    for _, label, x, y in sorted(points):
        mine = out.setdefault(label, [])
        near = next((p for p in mine if (p[0] - x) ** 2 + (p[1] - y) ** 2 < radius**2), None)
        if near:
            near[2] += step
        else:
            mine.append([x, y, size])
    return sorted((label, *p) for label, ps in out.items() for p in ps)


def test_leaders_of_one_large_label(spark):
    """200,000 points of one label, many of them in one place, are dealt over tasks and give what the serial rule gives."""
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.uniform(-25, 25, (120_000, 2)), rng.normal(3, 0.5, (79_000, 2)), np.full((1_000, 2), 3.0)])
    order = rng.permutation(len(at))
    points = [(int(o), "one", float(x), float(y)) for o, (x, y) in zip(order, at, strict=True)]
    df = spark.createDataFrame(points, "ord long, label string, x double, y double").repartition(8)
    got = vectors.label_leaders(df)
    assert sorted(tuple(r) for r in got.collect()) == serial_leaders(points)


def test_leaders_in_a_row(spark):
    """A chain of points in ord order, of which each is near the one before, and points without a place."""
    points = [(i, "ab"[i % 2], 1.5 * i, 0.0) for i in range(36)]
    odd = [(100, "a", None, 1.0), (101, "a", float("nan"), 1.0), (102, "a", float("inf"), 1.0)]
    df = spark.createDataFrame(points + odd, "ord long, label string, x double, y double")
    assert sorted(tuple(r) for r in vectors.label_leaders(df).collect()) == serial_leaders(points)


def test_two_hundred_thousand_phrases(spark):
    """A dictionary of 200,000 phrases: the hits are those of a plain search, and the join gives no phrase to the driver."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    phrases = list({" ".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(200_000)})
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(40)]
    texts = [t + rng.choice(phrases) + rng.choice(phrases) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    known = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = matching.first_places(rows, "t", known)
    want = sorted((i, p, t.index(p)) for i, t in enumerate(texts) for p in phrases if p in t)
    assert sorted((r["id"], r["phrase"], r["at"]) for r in got.collect()) == want and len(want) > 80
    full = matching.first_places(rows, "t", known, filter_bits=1024)  # a bitmap that lets nearly all places pass loses nothing
    assert full.count() == len(want)


def test_long_phrases_and_shared_grams(spark):
    """Phrases that share their beginnings, of every length around the classes' bounds, and a text that repeats one."""
    base = "the common beginning of many names "
    phrases = [base + c * n for c in "xyz" for n in (1, 7, 8, 9, 40)] + [("qw" * 70)[:n] for n in (6, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 127, 128)] + ["é" * 9, "𝒳y" * 5]
    texts = [base + "x" * 9, "qw" * 40, "w" + "qw" * 66, "é" * 8, "aé" + "é" * 9, "..𝒳y𝒳y𝒳y𝒳y𝒳y𝒳y", base * 300 + "y" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "id long, t string")
    got = matching.first_places(rows, "t", spark.createDataFrame([(p,) for p in phrases], "phrase string"), keep=["id"])
    want = [(i, p, t.index(p)) for i, t in [*enumerate(texts), (0, texts[0])] for p in phrases if p in t]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_broadcasts_are_bounded_by_bytes(spark):
    """100 rows of a megabyte are no broadcast; 100 short rows are one; nested values count too."""
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    long = written(spark.range(100).select("id", F.repeat(F.lit("x"), 1_000_000).alias("s")), "long")
    assert not hinted(sized_broadcast(long))
    assert hinted(sized_broadcast(long.where("id < 20"))) and hinted(sized_broadcast(written(spark.range(100).select("id", F.lit("x").alias("s")), "short")))
    nested = written(spark.range(100).select(F.array(F.struct(F.repeat(F.lit("x"), 1_000_000).alias("s"))).alias("a"), F.create_map(F.lit("k"), F.lit(None).cast("binary")).alias("m")), "nested")
    assert not hinted(sized_broadcast(nested)) and hinted(sized_broadcast(nested.where("false")))


def test_edge_files_are_ordered_over_their_parts(spark, tmp_path):
    """The largest split is several files, and these, one after another by name, are its lines in text order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("src"), F.col("id").alias("dst"), F.lit(1).alias("label"), F.when(F.col("id") % 40 == 0, "test").otherwise("train").alias("split"))
        sinks.edge_files(edges, f"{tmp_path}/e")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for split, files in (("train", 2), ("test", 1)):
        parts = sorted((tmp_path / "e" / f"split={split}").glob("part-*"))
        lines = [line for part in parts for line in part.read_text().splitlines()]
        assert len(parts) >= files and lines == sorted(lines) and len(lines) == edges.where(F.col("split") == split).count()


def trustworthiness(x, y, k=12):
    """1 less the share of false neighbours in the plane, weighed by how far they are in truth."""
    n = len(x)
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(far, -1)
    rank = far.argsort(1).argsort(1)
    near = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(near, np.inf)
    shown = near.argsort(1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, shown, 1) - k).sum()


def test_layout_keeps_neighbours(spark):
    """Clustered data: trustworthiness of 12 neighbours is at least 0.9 and not below that of the axes; reruns agree."""
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(10, 32))
    x = np.concatenate([m + 0.4 * rng.normal(size=(50, 32)) for m in middles])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 32)], "id long, embedding array<double>")
    at = lambda rows: np.array([[r["x"], r["y"]] for r in sorted(rows.collect())])
    first = at(projection.neighbour_layout(df, "id"))
    assert len(first) == 500 and trustworthiness(x, first) >= max(0.9, trustworthiness(x, at(vectors.project_2d(df.where("id < 500"), "id"))))
    again = [at(projection.neighbour_layout(rows, "id", epochs=3)) for rows in (df, df.repartition(5))]
    assert (again[0] == again[1]).all()
    assert projection.neighbour_layout(df.where("id >= 900"), "id").collect() == []


def test_neighbour_edges(spark):
    """Recall of the twelve nearest in clustered data, exact distances, and no row without neighbours; equal vectors in leaves."""
    rng = np.random.default_rng(6)
    x = np.concatenate([m + 0.4 * rng.normal(size=(60, 16)) for m in rng.normal(size=(20, 16))] + [np.ones((400, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {}
    for r in projection.neighbour_edges(projection.numbered(df, "id"), 12).collect():
        assert r["src"] != r["dst"] and abs(r["distance"] - np.sqrt(((x[r["src"]] - x[r["dst"]]) ** 2).sum())) < 1e-9
        got.setdefault(r["src"], []).append(r["distance"])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    last = np.sort(far, 1)[:, 11]
    assert set(map(len, got.values())) == {12} and len(got) == len(x)
    assert np.mean([np.mean(np.array(got[i]) <= last[i] + 1e-9) for i in range(len(x))]) >= 0.9


def test_components(spark):
    """Random graphs, a long chain, a star whose middle is the largest, self-edges and null ends against a serial search."""
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(300)] + [(5000, 4000 + i) for i in range(50)] + [(9, 9), (7777, 7777)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    got = graph.components(spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: root(x) for x in list(above)}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_match_of_a_long_chain(spark, monkeypatch):
    """A chain in which each of 1,500 rows waits for the one before ends after the fixed rounds, also where it is no serial one."""
    n, rounds = 1_500, []
    rows = spark.createDataFrame([(i, f"k{i}", f"k{i - 1}") for i in range(1, n)], "ord long, x string, y string")
    targets = spark.createDataFrame([(i, f"k{i}") for i in range(n)], "ord long, x string").withColumn("y", F.col("x"))
    keep = linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, tag="table": (rounds.append(tag), keep(df, tag))[1])
    # By y first, row i takes target i - 1; row 1 also holds target 1 as its second choice, and so on.
    first = spark.createDataFrame([(0, "k0", None)], "ord long, x string, y string").unionByName(rows)
    got = {r["row"]: r["target"] for r in linkage.priority_match(first, targets, ["y", "x"], "ord", "ord").collect()}
    free, want = set(range(n)), {}
    for i in range(n):
        for t in ((i - 1, i) if i else (0,)):
            if t in free:
                want[i] = t
                free.discard(t)
                break
    assert got == want and rounds.count("accepted") <= linkage.ROUNDS + 1


def test_match_of_large_components_goes_on_by_rounds(spark):
    rng = random.Random(9)
    draw = lambda n: [(i, rng.choice("abcdefgh") * 2, rng.choice("abcdefgh"), rng.choice("stuv")) for i in range(n)]
    frame = lambda r: spark.createDataFrame(r, "ord long, x string, y string, z string")
    rows, targets = frame(draw(60)), frame(draw(40))
    match = lambda **o: sorted(tuple(r) for r in linkage.priority_match(rows, targets, ["x", "y", "z"], "ord", "ord", **o).collect())
    assert match(serial=0) == match()


def serial_lookup(datasets):
    """The fold of one event after the other."""
    known, bad = {}, set()
    for _, name, variants, full in datasets:
        known[name.lower()] = name
        for v in dict.fromkeys([*variants, *([full] if full else [])]):
            if v != name:
                if v.lower() in known:
                    del known[v.lower()]
                    bad.add(v.lower())
                elif v.lower() not in bad:
                    known[v.lower()] = name
    return known


def test_lookup_in_chunks(spark):
    """Small chunks composed over several levels give what the serial fold gives; ties of case make variants collide."""
    rng = random.Random(10)
    for _ in range(2):
        word = lambda: "".join(rng.choice("abAB") for _ in range(rng.randrange(1, 3)))
        datasets = [(i, f"{word()}", sorted({word() for _ in range(rng.randrange(4))}), rng.choice(["", word()])) for i in range(60)]
        # Distinct names, as a name that differs by case only would be another event of the same variant.
        df = spark.createDataFrame(datasets, "ord int, name string, variants array<string>, full_name string")
        others = [(o, n, sorted({*v, *([f] if f else [])}), None) for o, n, v, f in datasets]
        for chunk, fan in ((2, 2), (3, 5), (1024, 64)):
            got = {r["variant"]: r["name"] for r in text.dataset_lookup(df, chunk, fan).collect()}
            assert got == serial_lookup(others)


def test_lookup_of_a_hot_variant(spark):
    """A variant that all of 300,000 datasets hold is ambiguous; its events are folded in many groups."""
    df = spark.range(300_000).select("id", F.col("id").cast("int").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.array(F.lit("Hot")).alias("variants"), F.lit(None).cast("string").alias("full_name"))
    got = text.dataset_lookup(df)
    assert got.count() == 300_000 and got.where("variant = 'hot'").isEmpty()
    named = df.withColumn("name", F.when(F.col("id") == 299_999, "Hot").otherwise(F.col("name")))
    assert [r["name"] for r in text.dataset_lookup(named).where("variant = 'hot'").collect()] == ["Hot"]


def test_negatives_of_a_source_with_one_free_node(spark, monkeypatch):
    """100,000 nodes of which the source lacks an edge to one: all its draws get that one, in two rounds and a direct draw."""
    n, free, tags = 100_000, 77_777, []
    hub = spark.range(2, n + 1).where(F.col("id") != free).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"))
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag="table": (tags.append(tag), keep(df, tag))[1])
    draws = spark.range(1, 41).select(F.col("id").alias("draw"), F.lit(1).cast("long").alias("src"))
    linked = hub.unionByName(hub.select("src", F.col("src").alias("dst")).limit(1))
    got = graph.free_nodes(draws, linked, n).collect()
    assert len(got) == 40 and {r["dst"] for r in got} == {free}
    small = spark.createDataFrame([(1, d) for d in range(2, 61) if d not in (7, 30)], "src long, dst long")
    drawn = graph.negative_edges(small, small, 60, times=4).collect()
    known = {(1, d) for d in range(2, 61) if d not in (7, 30)}
    assert len(drawn) == 4 * len(known) and all(r["src"] != r["dst"] and tuple(sorted((r["src"], r["dst"]))) not in known for r in drawn)
    assert {r["dst"] for r in drawn if r["src"] == 1} <= {7, 30} and sum(t.startswith("open") for t in tags) <= 3


def test_free_nodes_are_even(spark):
    """Every free node of several sources is drawn, none that is linked, about equally often; a full source gives no rows."""
    rng = random.Random(11)
    linked = {s: {s, *rng.sample(range(1, 31), 24)} for s in range(1, 5)} | {9: set(range(1, 31))}
    rows = spark.createDataFrame([(s, d) for s, ds in linked.items() for d in ds], "src long, dst long")
    draws = spark.range(1, 2_001).select(F.col("id").alias("draw"), F.when(F.col("id") % 5 == 0, 9).otherwise(F.col("id") % 5).alias("src"))
    got = graph.free_nodes(draws, rows, 30).collect()
    assert len(got) == 1_600
    for s in range(1, 5):
        seen = [r["dst"] for r in got if r["src"] == s]
        free = set(range(1, 31)) - linked[s]
        assert set(seen) == free and min(seen.count(d) for d in free) > 400 / len(free) / 2


def test_hot_node_in_chunks(spark):
    """A node with 200,000 neighbours is 200 lists over several ranges, and reads back as its edges."""
    edges = spark.range(200_000).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"), (F.col("id") * 7 % 200_003).alias("ord")).unionByName(spark.createDataFrame([(2, 5, -1)], "src long, dst long, ord long"))
    lists = graph.adjacency_chunks(edges, "ord")
    assert lists.agg(F.max(F.size("list")), F.count(F.lit(1))).first()[:] == (1000, 201)
    back = graph.from_lists(lists, "src", "list")
    assert back.exceptAll(edges.select("src", "dst")).isEmpty() and back.count() == 200_001


def test_contexts_rank_without_texts(spark):
    """No exchange or window of the context plan but the last join carries a text."""
    from citeloom.operators import citances

    rows = [(1, "c", [("One. Two X here.", [(10, 11, "r")]), ("Other Y.", [(6, 7, "r")])], {"r": ("t",)}), (2, "c", [("Later Z.", [(6, 7, "r")])], {"r": ("t",)})]
    kind = "ord int, paper_id string, body_text array<struct<text:string,cite_spans:array<struct<start:int,end:int,ref_id:string>>>>, bib_entries map<string,struct<link:string>>"
    got = citances.contexts(spark.createDataFrame(rows, kind), spark.createDataFrame([("t",)], "paper_id string"))
    assert [tuple(r) for r in got.collect()] == [("t", "c", ["Later [CITE]."])]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
