"""The learned segmenter, on a corpus whose abbreviations are in no fixed list."""

import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import citances, segmenter
from citeloom.plans.checkpoint import written

#: Short words that are always written with a full stop, and words that begin many sentences.
SHORT = ["fig", "eq", "vs", "al", "i.e", "approx", "resp"]
BEGIN = ["However", "Although", "Here"]


def corpus(seed, n):
    """(id, text, sentences): words of a fixed vocabulary, with abbreviations inside sentences."""
    rng = random.Random(seed)
    nouns = ["".join(random.Random(i).choices("abcdefghijklmnop", k=6 + i % 4)) for i in range(300)]
    out = []
    for i in range(n):
        made = []
        for _ in range(rng.randint(3, 9)):
            words = rng.choices(nouns, k=rng.randint(5, 12))
            for at in rng.sample(range(1, len(words)), 2):
                if rng.random() < 0.5:
                    words[at - 1] = rng.choice(SHORT) + "."
                    words[at] = words[at].capitalize()  # a capital alone ends no abbreviation
            first = rng.choice(BEGIN) if rng.random() < 0.5 else rng.choice(nouns).capitalize()
            made.append(" ".join([first, *words[:-1], rng.choice(nouns)]) + rng.choice([".", ".", ".", "?"]))
        out.append((i, " ".join(made), made))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    counts = segmenter.word_counts(spark.createDataFrame(corpus(1, 400), "id long, text string, s array<string>"), "text")
    known = written(segmenter.abbreviations(counts), "known")
    return known, written(segmenter.starters(counts, known), "begins")


def test_abbreviations_are_recovered(learned):
    known = {r["word"] for r in learned[0].collect()}
    assert known == set(SHORT)
    assert {r["word"] for r in learned[1].collect()} >= {w.lower() for w in BEGIN}


def test_held_out_texts(spark, learned):
    """Sentences of texts that nothing was learned from are those they were made of; the rules alone cut most of them up."""
    held = corpus(2, 100)
    rows = spark.createDataFrame(held, "id long, text string, s array<string>")
    got = {r["id"]: r["p"] for r in segmenter.segmented(rows, "text", *learned, out="p").collect()}
    rules = {r["id"]: r["p"] for r in rows.select("id", X.sentences(F.col("text")).alias("p")).collect()}
    assert sum(got[i] == made for i, _, made in held) == 100
    assert sum(rules[i] == made for i, _, made in held) < 10


def test_starters_and_blank_lines_end_after_abbreviations(spark, learned):
    cases = {
        "Shown by Ames et al. However it fails.": ["Shown by Ames et al.", "However it fails."],
        "Shown by Ames et al. however it fails.": ["Shown by Ames et al. however it fails."],
        "Shown by Ames et al.\n\nBut it fails.": ["Shown by Ames et al.", "But it fails."],
        "Shown by Ames et al.\nBut it  fails.": ["Shown by Ames et al. But it  fails."],
        '(See "Eq." Two.) Then (fig.) one. End': ['(See "Eq." Two.) Then (fig.) one.', "End"],
        "By Dr. Who. Fig. Two. Eq. three": ["By Dr. Who.", "Fig. Two.", "Eq. three"],
        "...": ["..."], "": [], " \n\n ": [],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id long, text string")
    got = {r["text"]: r["p"] for r in segmenter.segmented(rows, "text", *learned, out="p").collect()}
    assert got == cases


def test_nothing_learned_is_the_rules(spark, learned):
    texts = [t for _, t, _ in corpus(3, 30)] + ["Dr.\n\nNew part", "It ends. -- Not here.  Here", "A.\tB! \n C?\x0bD", "Wait... what? Yes", ". . . a. !", "x" * 300_000 + ". Y", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    none = learned[0].where("false")
    out = segmenter.segmented(rows, "text", none, none, "p").withColumn("want", X.sentences(F.col("text")))
    assert [r for r in out.collect() if r["p"] != r["want"]] == [] and out.count() == len(texts)


def test_contexts_with_the_learned_lists(spark, learned):
    """The sentence around a citation goes on behind a learned abbreviation; the rules alone end it there."""
    body = "One. As in fig. Two by XYZ and eq. Three too. However it ends. Last."
    kind = "ord int, paper_id string, body_text array<struct<text:string,cite_spans:array<struct<start:int,end:int,ref_id:string>>>>, bib_entries map<string,struct<link:string>>"
    papers = spark.createDataFrame([(1, "c", [(body, [(body.index("XYZ"), body.index("XYZ") + 3, "r")])], {"r": ("t",)})], kind)
    target = spark.createDataFrame([("t",)], "paper_id string")
    got = lambda k, lists: citances.contexts(papers, target, k=k, learned=lists).first()["sentences"]
    assert got(0, learned) == ["As in fig. Two by [CITE] and eq. Three too."] and got(0, None) == ["Two by [CITE] and eq."]
    assert got(1, learned) == ["One.", "As in fig. Two by [CITE] and eq. Three too.", "However it ends."]


def test_odd_tables(spark, learned):
    """Empty tables, null texts, copies without ids, clashing names, words that all have full stops."""
    kind = "id long, text string, word string, n long, `a.b` string"
    empty = spark.createDataFrame([], kind)
    counts = segmenter.word_counts(empty, "text")
    known = segmenter.abbreviations(counts)
    assert counts.count() == known.count() == segmenter.starters(counts, known).count() == segmenter.segmented(empty, "text", *learned).count() == 0
    rows = spark.createDataFrame([(None, "As in fig. Two. So", "w", 1, "q")] * 3 + [(1, None, None, None, None), (2, "", "x", 2, None)], kind)
    out = segmenter.segmented(rows, "text", *learned)
    assert out.columns == ["id", "text", "word", "n", "a.b", "sentences"]
    assert sorted(map(str, (r["sentences"] for r in out.collect()))) == sorted(map(str, [["As in fig. Two.", "So"]] * 3 + [None, []]))
    dots = segmenter.word_counts(spark.createDataFrame([("a. b. c.",)], "text string"), "text")
    none = segmenter.abbreviations(dots)
    assert none.count() == segmenter.starters(dots, none).count() == 0
