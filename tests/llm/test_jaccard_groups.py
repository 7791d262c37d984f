"""Large groups of near copies in the n-gram Jaccard join, against all pairs by a matrix of shingles."""

import random

import numpy as np
import pytest

from citeloom.llm import jaccard


def near_copies(n, seed):
    """Copies of one text of 120 words with two random edits each: few pairs of them link directly."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def components(texts, width, num):
    """The smallest place that each text reaches, from the matrix of all pairs' common shingles."""
    seen: dict = {}
    sets = [{seen.setdefault(tuple(w[k : k + width]), len(seen)) for k in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    has = np.zeros((len(texts), len(seen)), np.float32)
    for i, s in enumerate(sets):
        has[i, list(s)] = 1
    both, size = (has @ has.T).astype(np.int64), has.sum(1).astype(np.int64)
    link = 100 * both >= num * (size[:, None] + size - both)
    lowest = np.arange(len(texts))
    while True:
        now = np.where(link, lowest, len(texts)).min(1)
        if (now == lowest).all():
            return now.tolist(), link
        lowest = now


@pytest.mark.parametrize(("n", "block", "turns"), [(2000, 512, 4), (400, 48, 0)])
def test_near_copies_of_one_text(spark, monkeypatch, n, block, turns):
    """Blocks of a bucket meet each other, and turns end in the same components as verifying all candidates at once."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TURNS", turns)
    made: list[int] = []
    picks = jaccard._picks

    def counted(nodes, bands, every):
        out = jaccard.materialize(picks(nodes, bands, every), "test-picks")
        if not every:
            assert out.groupBy("key", "u").count().agg({"count": "max"}).first()[0] in (None, *range(1, 2 * (n // block + 2)))
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_picks", counted)
    texts = near_copies(n, seed=n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 3, 90, 100).collect()}
    want, link = components(texts, 3, 90)
    assert [got[i] for i in range(n)] == want
    assert link.sum() > n and (not turns or made)


def test_rejected_picks_are_not_picked_again(spark, monkeypatch):
    """Weak sketches allow pairs that are no links; every real link is still found."""
    monkeypatch.setattr(jaccard, "TURNS", 2)
    rng = random.Random(3)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(900)]
        for k in range(14):
            words = list(base)
            for at in rng.sample(range(900), 9 + k):
                words[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, 3, 90, 100).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts, 3, 90)[0]


def test_long_texts_that_do_not_link_are_not_verified(spark, monkeypatch):
    """120 texts of 6,000 words made from one template, at about 0.72: sketches as wide as the texts reject nearly all pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(6000)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(6000), 180):
            words[at] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    # Two real links among them, of one changed word each.
    texts += [" ".join(["start", *texts[0].split()[1:]]), " ".join([*texts[7].split()[:-1], "end"])]
    seen: list[int] = []
    verified = jaccard._verified

    def counted(near, documents, width, bands):
        seen.append(near.count())
        return verified(near, documents, width, bands)

    monkeypatch.setattr(jaccard, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    want, link = components(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == want and link.sum() == len(texts) + 4
    assert sum(seen) < 0.05 * 7140


def test_sketches_of_unlike_widths_meet_folded(spark):
    """A pair across the limit between two widths of sketch: both ways of folding give a lower bound of the difference."""
    bands = jaccard.Bands(80, 100)
    sizes = [n for n in range(700, 3000) if bands.bits(n) != bands.bits(n + 1)]
    assert sizes
    texts = []
    for g, n in enumerate(sizes):
        words = [f"g{g}w{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join([*words, *[f"more{i}" for i in range(n // 12)]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]
    hashes = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    wide, narrow = jaccard.parity(hashes, 4096).view(np.uint64), jaccard.parity(hashes, 1024).view(np.uint64)
    both = jaccard.Sketches(np.concatenate([wide, narrow]), np.array([64, 16]))
    assert (both.folded(np.array([0, 1]), 16, 0, 16) == narrow).all()
