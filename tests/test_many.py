"""Neighbours of many vectors, and claims over arriving shards."""

import json

import numpy as np

from citeloom.operators import vectors
from citeloom.streaming import linkage


def test_nearest_of_many(spark):
    """Several tiles, with repeated vectors and unusable ones, against all distances."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 12))
    v[300:500] = v[7]  # a third of all rows are one vector
    rows = [(f"k{i:04d}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("odd", [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    wanted = spark.createDataFrame([(f"k{i:04d}",) for i in [*range(0, 600, 50), 7, 7]] + [("null",), ("nobody",)], "id string")
    got: dict = {}
    for r in vectors.nearest_of_many(df, wanted, "id", 5, chunk=64).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], round(r["distance"], 9)))
    assert sorted(got) == sorted({f"k{i:04d}" for i in [*range(0, 600, 50), 7]})
    for name, found in got.items():
        i = int(name[1:])
        d = np.round(np.sqrt(((v - v[i]) ** 2).sum(1)), 9)
        best = [j for j in np.lexsort((np.arange(600), d)) if j != i][:5]
        assert [(n, f"k{j:04d}") for n, j in enumerate(best, 1)] == [(n, b) for n, b, _ in found]
    empty = df.where("false")
    assert vectors.nearest_of_many(empty, wanted, "id").count() == 0 == vectors.nearest_of_many(df, wanted.where("false"), "id").count()


def test_claims_over_arriving_shards(spark, tmp_path):
    """Later shards may hold earlier rows; a second start goes on from the state, and a replayed batch replaces its part."""
    shards, claims, check = (str(tmp_path / x) for x in ("in", "claims", "check"))
    (tmp_path / "in").mkdir()
    kind, targets = "ord long, hash string, name string", spark.createDataFrame([("a",), ("b",), ("z",)], "hash string")

    def arrive(name, *rows):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("ord", "hash", "name"), r, strict=True))) for r in rows))

    def run():
        stream = spark.readStream.schema(kind).json(shards)
        linkage.keep_lowest(stream, targets, "hash", ["name"], claims, check).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in linkage.lowest(spark, claims, "hash string, ord long, name string", "hash").collect())

    assert run() == []
    arrive("one", (5, "a", "five"), (7, "b", "seven"), (1, "c", "no target"), (2, None, "no key"))
    assert run() == [("a", 5, "five"), ("b", 7, "seven")]
    arrive("two", (3, "a", "three"), (9, "b", "nine"))
    assert run() == [("a", 3, "three"), ("b", 7, "seven")]
    # The last batch is run again after a failure that lost its commit.
    last = max(tmp_path.glob("check/commits/[0-9]*"), key=lambda p: int(p.name))
    for name in (last.name, f".{last.name}.crc"):
        (last.parent / name).unlink(missing_ok=True)
    assert run() == [("a", 3, "three"), ("b", 7, "seven")]
