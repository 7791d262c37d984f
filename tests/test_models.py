"""Order-dependent operators against plain serial models, and quirks on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import citances, graph, linkage, matching, text, vectors
from citeloom.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


def greedy(rows, targets, keys):
    lookups = [{t[k]: t["ord"] for t in sorted(targets, key=lambda t: t["ord"]) if t[k]} for k in keys]
    out = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        for k, look in zip(keys, lookups, strict=True):
            if r[k] in look:
                out[r["ord"]] = hit = look[r[k]]
                for other in lookups:
                    for v in [v for v, t in other.items() if t == hit]:
                        del other[v]
                break
    return out


def test_priority_match(spark):
    rng = random.Random(1)
    draw = lambda n: [{"ord": i, **{k: rng.choice(["a", "b", "c", "d", "e", "", None]) for k in "xyz"}} for i in range(n)]
    for _ in range(4):
        rows, targets = draw(14), draw(8)
        frame = lambda r: spark.createDataFrame(r, "ord long, x string, y string, z string")
        got = {r["row"]: r["target"] for r in linkage.priority_match(frame(rows), frame(targets), ["x", "y", "z"], "ord", "ord").collect()}
        assert got == greedy(rows, targets, ["x", "y", "z"])


LOOKUPS = [
    # Two datasets share a variant: it stands for neither.
    ([("Alpha", ["Shared"], None), ("Beta", ["shared"], None)], {"alpha": "Alpha", "beta": "Beta"}),
    # A variant that differs from its own name by case only removes the name.
    ([("Gamma", ["GAMMA"], None)], {}),
    # Two variants of one dataset that differ by case only remove each other.
    ([("Delta", ["Dl", "DL"], None)], {"delta": "Delta"}),
    # A name counts even if it was found ambiguous as a variant before.
    ([("One", ["Eps"], None), ("Two", ["EPS"], None), ("Eps", None, None)], {"one": "One", "two": "Two", "eps": "Eps"}),
    # A third dataset can't bring an ambiguous variant back.
    ([("A1", ["v"], None), ("A2", ["V"], None), ("A3", ["v"], "")], {"a1": "A1", "a2": "A2", "a3": "A3"}),
    # A full name is a variant, unless it is null, empty or the name itself.
    ([("Zeta", [], "Zeta Corpus"), ("Eta", None, "Eta"), ("Theta", [None], None)], {"zeta": "Zeta", "zeta corpus": "Zeta", "eta": "Eta", "theta": "Theta"}),
    # A variant of another dataset's earlier name removes it; a later name takes over an earlier variant.
    ([("Iota", None, None), ("Kappa", ["iota", "Mu"], None), ("Mu", None, None)], {"kappa": "Kappa", "mu": "Mu"}),
]


@pytest.mark.parametrize(("datasets", "want"), LOOKUPS)
def test_dataset_lookup(spark, datasets, want):
    rows = spark.createDataFrame([(i, *d) for i, d in enumerate(datasets)], "ord int, name string, variants array<string>, full_name string")
    assert {r["variant"]: r["name"] for r in text.dataset_lookup(rows).collect()} == want


def test_dataset_lookup_order(spark):
    """A name that takes over an entry keeps its place; one that enters anew after a removal gets a new place."""
    rows = [(1, "Kappa", ["Mu", "Nu"], None), (2, "Xi", ["nu"], None), (3, "Mu", None, None), (4, "Nu", None, None)]
    got = text.dataset_lookup(spark.createDataFrame(rows, "ord int, name string, variants array<string>, full_name string"))
    assert {r["variant"]: r["pos"]["ord"] for r in got.collect()} == {"kappa": 1, "xi": 2, "mu": 1, "nu": 4}


def test_contexts(spark):
    body = "First one here. It was shown before [CITE] by XYZ today. Dr. Smith agrees. The end."
    at = body.index("XYZ")
    rows = [(1, "c", [(body, [(at, at + 3, "r"), (0, 5, "r"), (0, 5, "gone")])], {"r": ("t",)})]
    papers = spark.createDataFrame(rows, "ord int, paper_id string, body_text array<struct<text:string,cite_spans:array<struct<start:int,end:int,ref_id:string>>>>, bib_entries map<string,struct<link:string>>")
    got = citances.contexts(papers, spark.createDataFrame([("t",)], "paper_id string"), k=1).collect()
    assert [r["sentences"] for r in got] == [["First one here.", "It was shown before [CITE] by [CITE] today.", "Dr. Smith agrees."]]


def test_augment(spark):
    docs = spark.createDataFrame([("a", ["x", "y"], [[0, 2]], [[0, 2]], None), ("b", ["z"], [[0, 1]], [[0, 1]], None)], "doc_id string, words array<string>, sentences array<array<int>>, sections array<array<int>>, citances array<int>")
    added = spark.createDataFrame([("a", [[["p"], ["q", "r"]], [["s"]]])], "doc_id string, contexts array<array<array<string>>>")
    got = {r["doc_id"]: r for r in citances.augment(docs, added).collect()}
    assert got["a"]["sentences"] == [[0, 2], [2, 3], [3, 5], [5, 6]] and got["a"]["sections"] == [[0, 2], [2, 5], [5, 6]]
    assert got["a"]["citances"] == [2, 6] and got["b"]["citances"] == [1, 1] and got["a"]["words"] == ["x", "y", "p", "q", "r", "s"]


def test_selection_keeps_small_groups(spark):
    rows = spark.createDataFrame([("t", f"c{i}", float(i)) for i in range(5)] + [("u", "c", 1.0)], "cited string, citing string, dist double")
    pick = lambda **o: sorted((r["cited"], r["citing"]) for r in citances.select_contexts(rows, 2, "graph_embedding_distance", distance="dist", **o).collect())
    assert pick() == [("t", "c0"), ("t", "c1"), ("u", "c")]
    assert pick(order="farthest", strict=True) == [("t", "c3"), ("t", "c4")]
    with pytest.raises(ValueError):
        citances.select_contexts(rows, method="other")


def test_sentences_titles_abbreviations(spark):
    row = spark.createDataFrame([("He met Dr. No. Then\nhe left!  Really? \n\nNew part",)], "t string")
    assert row.select(X.sentences(F.col("t"))).first()[0] == ["He met Dr. No.", "Then he left!", "Really?", "New part"]
    names = spark.createDataFrame([("Machine_Translation",), ("3D__Object_Pose",)], "n string")
    assert [r[0] for r in names.select(X.abbreviate(F.col("n"))).collect()] == ["MT", "3DOP"]
    no_sections = spark.createDataFrame([(["a"], [[0, 1]], [])], "w array<string>, s array<array<int>>, c array<array<int>>")
    with pytest.raises(Exception, match="no title"):
        no_sections.select(X.title(F.col("w"), F.col("s"), F.col("c"))).collect()


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p1", None, None, "T", ["p2"], None, 3)], "paper_id string, doi string, arxiv_id string, title string, outbound_citations array<string>, inbound_citations array<string>, shard_id int")
    (tmp_path / "metadata").mkdir()
    rows.drop("shard_id").coalesce(1).write.option("compression", "gzip").json(f"{tmp_path}/w")
    next((tmp_path / "w").glob("*.gz")).rename(tmp_path / "metadata" / "metadata_3.jsonl.gz")
    got = readers.shards(spark, f"{tmp_path}/metadata").first()
    assert (got["paper_id"], got["shard_id"], got["outbound_citations"]) == ("p1", 3, ["p2"])
    sinks.gzip_shards(rows, f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g").first()["shard_id"] == 3
    (tmp_path / "c.txt").write_text("get  a b\n\n  \nget c\n")
    assert [r[0] for r in readers.commands(spark, f"{tmp_path}/c.txt").collect()] == [["get", "a", "b"], ["get", "c"]]
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    assert {(r[0], r[1]) for r in readers.key_values(spark, f"{tmp_path}/m.json").collect()} == {("a", "1"), ("b", "2")}
    edges = spark.createDataFrame([(2, 10, 1, "test"), (1, 3, 1, "train")], "src long, dst long, label int, split string")
    sinks.edge_files(edges, f"{tmp_path}/e")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/e").collect()} == {"2\t10\t1", "1\t3"}


def test_vectors(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, embedding array<double>")
    assert [(r["id"], r["distance"]) for r in vectors.nearest(v, 0, "id", 5).collect()] == [(1, 0.0), (2, 5.0)]
    ids = spark.createDataFrame([(2,), (9,)], "id int")
    assert {r["id"]: (r["embedding"], r["found"]) for r in vectors.imputed(ids, v, "id").collect()} == {2: ([3.0, 4.0], True), 9: ([3.0, 4.0], False)}
    points = spark.createDataFrame([(0, "a", 0.0, 0.0), (1, "a", 1.0, 1.0), (2, "a", 9.0, 9.0), (3, "b", 0.0, 0.0)], "ord int, label string, x double, y double")
    assert sorted(tuple(r) for r in vectors.label_leaders(points).collect()) == [("a", 0.0, 0.0, 0.75), ("a", 9.0, 9.0, 0.5), ("b", 0.0, 0.0, 0.5)]


def test_streaming_linkage(spark, tmp_path):
    from citeloom.streaming.linkage import link_arriving

    schema, targets = "ord long, hash string, paper_id string", spark.createDataFrame([("h1",), ("h2",)], "hash string")
    spark.createDataFrame([(1, "h1", "p1"), (2, "h1", "p2"), (3, "x", "p3")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(4, "h1", "p4"), (5, "h2", "p5")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    link_arriving(stream, targets, "hash", ["paper_id"], f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["hash"], r["paper_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [h for h, _ in got] == ["h1", "h2"]


def test_negative_edges_are_no_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    got = graph.negative_edges(edges, edges, 40).collect()
    assert len(got) == 15 and all(r["src"] != r["dst"] and tuple(sorted((r["src"], r["dst"]))) not in {(1, 2), (2, 3), (3, 4)} for r in got)


def test_first_places(spark):
    rng = random.Random(7)
    draw = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts, phrases = [*[draw(rng.randrange(60)) for _ in range(60)], "", None, "ab" * 50_000, "ab"], ["", None, "ab", "b", "abab", "é a", "a", "a", *[draw(3) for _ in range(9)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("n", F.lit(None).cast("string"))
    known = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    want = sorted((i, p, t.index(p)) for i, t in enumerate(texts) for p in set(phrases) if t and p and p in t)
    for limit in (20_000, 4):
        got = matching.first_places(rows, "t", known, max_phrases=limit)
        assert got.columns == ["id", "t", "n", "phrase", "at"]
        assert sorted((r["id"], r["phrase"], r["at"]) for r in got.collect()) == want
    assert matching.first_places(rows, "t", known.limit(0)).count() == 0 == matching.first_places(rows.limit(0), "t", known).count()


def test_lookups(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "id string")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    two = spark.createDataFrame([(1, 7), (3, 8)], "key int, value int")
    got = {r["id"]: (r["place"], r["missed"]) for r in linkage.chained_lookup(rows, "id", [one, two], "place").collect()}
    assert got == {"a": (7, None), "b": (-1, 2), "c": (-1, 1), None: (-1, 1)}
    assert linkage.strict_lookup(rows.where("id = 'a'"), "id", one, "x").first()["x"] == 1
    with pytest.raises(Exception, match="no entry for: c"):
        linkage.strict_lookup(rows.where("id = 'c'"), "id", one, "x").collect()


def test_all_users_are_plotted(spark):
    from citeloom.plans import catalogue

    points = catalogue.plot_points(spark, "/root/testdata/sf0.001").where("task is not null")
    assert points.where("vec_id % 5 <> 0").count() > 0


def test_segment_seeds_grow_with_the_tables(spark):
    from citeloom.plans import catalogue

    counts = [catalogue._seeds(spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")]
    assert counts[1] > 5 * counts[0] > 100


def test_negative_edges_of_hubs_are_all_drawn(spark):
    """Sources linked to all but one of 40 nodes need more than eight attempts; a source linked to all has no row."""
    hubs = spark.createDataFrame([(a, b) for a in range(1, 41) for b in range(1, 41) if a < b and (a, b) not in {(k, k + 1) for k in range(1, 40, 2)}], "src long, dst long")
    positives = hubs.limit(20)
    got = graph.negative_edges(hubs, positives, 40).collect()
    assert sorted(r["draw"] for r in got) == list(range(1, 101)) and all(r["dst"] == (r["src"] + 1 if r["src"] % 2 else r["src"] - 1) for r in got)
    whole = spark.createDataFrame([(a, b) for a in range(1, 6) for b in range(a + 1, 6)], "src long, dst long")
    with pytest.warns(UserWarning, match="10 draws"):
        assert graph.negative_edges(whole, whole.limit(2), 5).count() == 0


def test_five_ids_are_neighbours(spark):
    from citeloom.plans import catalogue

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = catalogue.neighbor_tfidf(spark, DATA).where("direction = 'out'").select("key").distinct()
    assert {int(r["key"]) for r in got.collect()} == {i for i, x in lang.items() if any(lang.get(i + k) == x for k in range(1, 6))}


def test_rows_without_ids_match_nothing(spark):
    frame = lambda r: spark.createDataFrame(r, "ord long, x string")
    got = linkage.priority_match(frame([(1, "a"), (None, "b"), (2, "b")]), frame([(None, "a"), (7, "b")]), ["x"], "ord", "ord")
    assert [tuple(r) for r in got.collect()] == [(2, 7, 0)]


def test_long_chain_of_matches(spark):
    """Each row's first choice is the one the row before it takes: one pair a round, and the plan stays short."""
    n = 20
    rows = [(i, f"t{max(i - 1, 0)}", f"t{i}") for i in range(n)]
    targets = [(i, f"t{i}", f"t{i}") for i in range(n)]
    frame = lambda r: spark.createDataFrame(r, "ord long, x string, y string")
    got = {r["row"]: (r["target"], r["priority"]) for r in linkage.priority_match(frame(rows), frame(targets), ["x", "y"], "ord", "ord").collect()}
    assert {i: t for i, (t, _) in got.items()} == greedy([dict(zip(("ord", "x", "y"), r)) for r in rows], [dict(zip(("ord", "x", "y"), t)) for t in targets], ["x", "y"])


def test_mappings(spark):
    matches = spark.createDataFrame([(1, 10, 0), (2, 11, 1), (3, 12, 0)], "row long, target long, priority int")
    papers = spark.createDataFrame([(1, "p"), (2, "q"), (3, "p")], "ord long, paper_id string")
    assert sorted(map(tuple, linkage.forward_mapping(matches).collect())) == [(10, 1), (11, 2), (12, 3)]
    assert sorted(map(tuple, linkage.inverse_mapping(matches, papers, "ord", "paper_id").collect())) == [("p", 12), ("q", 11)]


def test_places(spark):
    rows = spark.createDataFrame([(g, i) for i, g in enumerate("aababb")] + [(None, 9), (None, 7)], "g string, i long")
    want = {("a", 0): 0, ("a", 1): 1, ("a", 3): 2, ("b", 2): 0, ("b", 4): 1, ("b", 5): 2, (None, 7): 0, (None, 9): 1}
    assert {(r["g"], r["i"]): r["place"] for r in linkage.places(rows, "g", "i").collect()} == want
    assert linkage.places(rows.limit(0), "g", "i").count() == 0


def test_ranks_of_outlying_ordinals(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(500), 10**15]], "ord long").repartition(5)
    got = {r["ord"]: r["n"] for r in linkage.dense_rank_from_zero(rows, "ord", "n").collect()}
    assert got == {**{i: i for i in range(500)}, 10**15: 500}


def test_edges_from_lists(spark):
    rows = spark.createDataFrame([("a", ["b", "c"]), ("d", []), ("e", None), (None, ["x"])], "id string, items array<string>")
    assert sorted(map(tuple, graph.from_lists(rows, "id", "items").collect())) == [("a", "b"), ("a", "c")]


def test_rounds_are_resumed(spark, tmp_path):
    """A second search reads the rounds that are there, and only those: the edges may be gone by then."""
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    none, seeds, inputs = edges.limit(0), spark.createDataFrame([("a",), (None,), ("a",)], "node string"), {"edges": 1}
    graph.expand(edges, none, seeds, 2, f"file://{tmp_path}", inputs)
    hops = lambda e, radius, inputs: {r["node"]: r["hop"] for r in graph.expand(e, none, seeds, radius, f"file://{tmp_path}", inputs)[0].collect()}
    assert hops(none, 2, inputs) == {"a": 0, "b": 1, "c": 2} and hops(edges, 3, inputs) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert hops(none, 2, {"edges": 2}) == {"a": 0}
    with pytest.raises(ValueError, match="name the inputs"):
        graph.expand(edges, none, seeds, 1, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="radius"):
        graph.expand(edges, none, seeds, 0)


def test_directed_export(spark, tmp_path):
    edges = spark.createDataFrame([("x", "y", 1), ("y", "x", 2), ("y", "z", 3), ("x", "y", 4)], "src string, dst string, ord long")
    numbers, lines = graph.training_export(edges, "ord", train=0.4, test=0.4, times=2, directed=True)
    assert {r["node"]: r["node_id"] for r in numbers.collect()} == {"x": 1, "y": 2, "z": 3}
    rows = [(r["split"], r["src"], r["dst"], r["label"]) for r in lines.collect()]
    assert sorted(r[1:3] for r in rows if r[3]) == [(1, 2), (2, 1), (2, 3)] and sorted(r[0] for r in rows if r[3]) == ["test", "train", "val"]
    drawn = [r for r in rows if not r[3]]
    assert len(drawn) <= 2 and all(r[0] == "test" and r[1] != r[2] and r[1:3] not in [(1, 2), (2, 1), (2, 3)] for r in drawn)
    one = graph.training_export(edges, "ord")[1].where("label = 1")
    assert sorted((r["src"], r["dst"]) for r in one.collect()) == [(1, 2), (2, 3)]
    sinks.edge_files(lines, f"{tmp_path}/e")
    assert sorted(r["value"].count("\t") for r in spark.read.text(f"{tmp_path}/e").collect()) == sorted([1, 1, 2, *[2] * len(drawn)])


def test_segmenter_rules(spark):
    cases = {
        "It ends. -- Not here. Here": ["It ends. -- Not here.", "Here"],
        "A so--called. Token goes. On": ["A so--called. Token goes.", "On"],
        "Wait... what? Yes": ["Wait... what?", "Yes"],
        "One, two. and three": ["One, two.", "and three"],
        "Dr.\n\nNew part": ["Dr.", "New part"],
        "By Mr. Dr. Who. well-known - fact": ["By Mr. Dr. Who.", "well-known - fact"],
        "See [CITE]. Next": ["See [CITE].", "Next"],
        "": [], "\n\n \n\n": [],
    }
    for t, want in cases.items():
        assert spark.createDataFrame([(t,)], "t string").select(X.sentences(F.col("t"))).first()[0] == want, t


def test_only_citing_papers_give_contexts(spark):
    kind = "ord int, paper_id string, body_text array<struct<text:string,cite_spans:array<struct<start:int,end:int,ref_id:string>>>>, bib_entries map<string,struct<link:string>>"
    papers = spark.createDataFrame([(1, "c", [("By X.", [(3, 4, "r")])], {"r": ("t",)}), (2, "d", [("Of X.", [(3, 4, "r")])], {"r": ("t",)}), (3, "d", [("At X.", [(3, 4, "r")])], {"r": ("t",)})], kind)
    targets, citing = spark.createDataFrame([("t",)], "paper_id string"), spark.createDataFrame([("d",)], "paper_id string")
    assert [tuple(r) for r in citances.contexts(papers, targets, citing, 0).collect()] == [("t", "d", ["At [CITE]."])]


def test_dev_passes_untouched(spark):
    kind = "doc_id string, split string, words array<string>, sentences array<array<int>>, sections array<array<int>>"
    rows = spark.createDataFrame([("a", "train", ["x"], [[0, 1]], [[0, 1]]), ("b", "dev", ["y"], [[0, 1]], [[0, 1]])], kind)
    added = spark.createDataFrame([("a", [[["p"]]]), ("b", [[["q"]]])], "doc_id string, contexts array<array<array<string>>>")
    got = {r["doc_id"]: (r["words"], r["citances"]) for r in citances.augmented_corpus(rows, added).collect()}
    assert got == {"a": (["x", "p"], [1, 2]), "b": (["y"], None)}


def test_quality_counts_only_in_large_groups(spark):
    good = " ".join("abcdefghij")
    rows = spark.createDataFrame([("t", f"c{i}", good if i < 3 else "short") for i in range(6)] + [("u", "c", "short")], "cited string, citing string, text string")
    pick = lambda **o: sorted((r["cited"], r["citing"]) for r in citances.select_contexts(rows, 4, text="text", **o).collect())
    assert pick() == [("t", "c0"), ("t", "c1"), ("t", "c2"), ("u", "c")] and pick(strict=True) == [("t", "c0"), ("t", "c1"), ("t", "c2")]


def test_references_and_kept(spark):
    matches = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", []), ("c", None), (None, ["z"])], "paper_id string, names array<string>")
    refs = text.references(matches, "paper_id", "names")
    assert sorted((r[0], r[1] or "") for r in refs.collect()) == [("a", "x"), ("a", "y"), ("b", ""), ("c", "")]
    papers = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "paper_id string")
    found = spark.createDataFrame([("d", "n")], "paper_id string, name string")
    assert sorted(r[0] for r in text.kept(papers, "paper_id", found, refs).collect()) == ["a", "b", "d"]
    assert text.kept(papers, "paper_id").count() == 0


def test_large_vocabulary_is_joined_in_two_parts(spark, monkeypatch):
    counts = spark.createDataFrame([(f"d{i}", f"t{j}", 1 + i % 3) for i in range(30) for j in range(12) if i % (j + 1) == 0], "doc string, term string, tf long")
    docs = spark.range(30)
    weights = lambda **o: {(r["doc"], r["term"]): round(r["weight"], 9) for r in text.tf_idf(counts, text.vocabulary(counts), docs, **o).collect()}
    want = weights()
    monkeypatch.setattr(text, "sized_broadcast", lambda df: df)
    assert weights(common=3) == want and want


def test_projection_equals_eigenvectors(spark):
    import numpy as np

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ axes[:, [-1, -2]])
    got = vectors.project_2d(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id").toPandas().set_index("vec_id").loc[rows.vec_id]
    assert np.abs(np.abs(got[["x", "y"]].to_numpy()) - want).max() < 1e-6


def test_leaders_of_several_labels_in_one_task(spark):
    points = spark.createDataFrame([(i, "ab"[i % 2], float(i // 4 * 3), 0.0) for i in range(16)] + [(99, None, 0.0, 0.0)], "ord int, label string, x double, y double").coalesce(1)
    got = sorted(map(tuple, vectors.label_leaders(points).collect()), key=str)
    assert got == sorted([(x, at, 0.0, size) for x in "ab" for at, size in ((0.0, 1.25), (6.0, 1.25))] + [(None, 0.0, 0.0, 0.5)], key=str)
    assert vectors.label_leaders(points.limit(0)).count() == 0


def test_phrases_refuse_clashing_columns(spark):
    rows = spark.createDataFrame([("a b", 1)], "t string, at int")
    with pytest.raises(ValueError, match="phrase or at"):
        matching.first_places(rows, "t", spark.createDataFrame([("b",)], "phrase string"))
    assert [tuple(r) for r in matching.first_places(rows, "t", spark.createDataFrame([("b",)], "phrase string"), keep=["t"]).collect()] == [("a b", "b", 2)]


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i}", "t", n) for i, n in enumerate([3, 3, 40, 7])], "paper_id string, title string, shard_id int")
    sinks.shard_files(rows, f"{tmp_path}/m")
    assert sorted(f.name for f in (tmp_path / "m").glob("*.gz")) == ["metadata_3.jsonl.gz", "metadata_40.jsonl.gz", "metadata_7.jsonl.gz"]
    got = lambda **o: sorted((r["paper_id"], r["shard_id"]) for r in readers.shards(spark, f"file://{tmp_path}/m", **o).collect())
    assert got() == [("p0", 3), ("p1", 3), ("p2", 40), ("p3", 7)] and got(limit=2) == [("p0", 3), ("p1", 3), ("p3", 7)]
    (tmp_path / "m" / "other_1.jsonl.gz").write_bytes(b"")
    with pytest.raises(ValueError, match="not a shard path"):
        readers.shards(spark, f"file://{tmp_path}/m")
    with pytest.raises(Exception, match="not a shard path"):
        spark.createDataFrame([("x/other_1.jsonl.gz",)], "p string").select(readers.shard_id(F.col("p"))).collect()
    with pytest.raises(ValueError, match="unknown kind"):
        readers.shard_id(F.col("p"), "other")
    assert readers.shards(spark, f"file://{tmp_path}/none").count() == 0


def test_json_lines_and_cache(spark, tmp_path):
    from citeloom.plans.checkpoint import cached

    rows = spark.createDataFrame([("a", ["x"]), ("b", None)], "doc_id string, words array<string>")
    sinks.json_lines(rows, f"{tmp_path}/j")
    assert sorted((r["doc_id"], r["words"]) for r in readers.targets(spark, one=f"{tmp_path}/j").collect()) == [("a", ["x"]), ("b", None)]
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/bad.json", "a string").collect()
    made = []
    build = lambda: made.append(1) or rows
    for overwrite in (False, False, True):
        assert cached(spark, f"file://{tmp_path}/c", build, {"k": 1}, overwrite).count() == 2
    assert len(made) == 2 and cached(spark, f"file://{tmp_path}/c", build, {"k": 2}).count() == 2 and len(made) == 3
    before = cached(spark, f"file://{tmp_path}/c", build, {"k": 2})
    cached(spark, f"file://{tmp_path}/c", lambda: rows.limit(1), {"k": 2}, overwrite=True)
    with pytest.raises(Exception):  # a writing that fails leaves the last version in force
        cached(spark, f"file://{tmp_path}/c", lambda: rows.select(F.raise_error(F.lit("no"))), {"k": 2}, overwrite=True)
    assert (before.count(), cached(spark, f"file://{tmp_path}/c", build, {"k": 2}).count()) == (2, 1)
    cached(spark, f"file://{tmp_path}/c", lambda: rows, {"k": 2}, overwrite=True)
    assert cached(spark, f"file://{tmp_path}/c", build, {"k": 2}).count() == 2 and len(made) == 3


def test_scratch_tables_are_dropped(spark):
    from citeloom.plans import checkpoint

    mark = checkpoint.made()
    a, b = checkpoint.written(spark.range(3)), checkpoint.written(spark.range(4))
    checkpoint.forget(spark, mark, keep=b)
    assert b.count() == 4 and checkpoint.made() == mark + 1
    with pytest.raises(Exception):
        a.count()
    assert checkpoint.sized_broadcast(b, limit=1000) is not b and checkpoint.sized_broadcast(b, limit=24) is b


def test_no_machine_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from citeloom.plans.checkpoint import shared_folder

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None)))
    assert shared_folder(session("local[4]")).startswith("file:") and shared_folder(session("local")).startswith("file:")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))


def test_entry_without_the_training_folders(tmp_path):
    """Without citeloom/llm and corpus_pipeline.py the other queries are there; a missing package is an error, not silence."""
    import pathlib
    import shutil
    import subprocess
    import sys

    home = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(home / "citeloom", tmp_path / "citeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", tmp_path)
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    out = run("import __spark_entry__ as e; q = e.queries(); assert 'bfs_r2' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)")
    assert out.returncode == 0, out.stderr
    (tmp_path / "citeloom" / "llm").mkdir()
    (tmp_path / "citeloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "citeloom" / "llm" / "queries.py").write_text("import a_package_that_is_not_there\n")
    out = run("import __spark_entry__")
    assert out.returncode and "a_package_that_is_not_there" in out.stderr
