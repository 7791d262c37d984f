"""Recall of the embedding index against all pairs, wherever the mean lies and however close the vectors are."""

import numpy as np
import pytest

from citeloom.llm import itq


def links(x, label=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    if label is not None:
        near &= label[:, None] == label
    np.fill_diagonal(near, False)
    return near.sum(1)


def found(spark, x, label=None):
    rows = [(i, v.tolist(), 0 if label is None else int(label[i])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(df).collect()}
    return np.array([got[i] for i in range(len(x))])


def clouds(mean, level, dim=64, groups=500, seed=0):
    """Groups of three points around centres that share a mean; level is the noise inside a group."""
    rng = np.random.default_rng(seed)
    centre = mean + rng.standard_normal((groups, dim))
    return np.repeat(centre, 3, axis=0) + level * rng.standard_normal((3 * groups, dim))


@pytest.mark.parametrize(("mean", "level"), [(0, 0.15), (1, 0.1), (2, 0.3), (3, 0.2), (5, 0.4)])
def test_recall_does_not_depend_on_the_mean(spark, mean, level):
    x = clouds(mean, level)
    want, got = links(x), found(spark, x)
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


@pytest.mark.parametrize(("dim", "mean"), [(2, 0), (8, 1), (200, 1)])
def test_recall_in_few_and_many_dimensions(spark, dim, mean):
    x = clouds(mean, 0.12, dim=dim, groups=200, seed=dim)
    want, got = links(x), found(spark, x)
    assert want.sum() and (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_one_tight_cluster(spark):
    x = 3 + 0.02 * np.random.default_rng(1).standard_normal((500, 64))
    assert (links(x) == 499).all() and found(spark, x).sum() >= 0.9 * 500 * 499


def test_tight_clusters_of_labels_and_a_cloud(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([5 * rng.standard_normal(64) + 0.4 * rng.standard_normal((300, 64)) for _ in range(4)] + [rng.standard_normal((900, 64))])
    label = rng.integers(0, 3, len(x))
    want, got = links(x, label), found(spark, x, label)
    assert want.sum() and (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_two_rows(spark):
    assert found(spark, np.array([[1.0, 0.0], [1.0, 0.001]])).tolist() == [1, 1]


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 100)
    x = 3 + 0.3 * np.random.default_rng(3).standard_normal((700, 16))
    want, got = links(x), found(spark, x)
    assert want.sum() and (got <= want).all() and got.sum() >= 0.9 * want.sum()
