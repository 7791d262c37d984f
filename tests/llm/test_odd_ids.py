"""WARC ids that are no numbers, licence tags by the thousand, and scores that don't depend on held-out labels."""

import time

import pytest
from pyspark.sql import functions as F

from citeloom.llm import licenses, quality, warc

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_warc_ids_of_any_type(spark, kind):
    long, ids = "x" * 300, {"string": ["a b", "", "é>%3E\n", None, "%", "7"], "int": [1, -5, 0, None, 9, 7], "date": ["2020-01-02", "1999-12-31", "0900-01-01", None, "2021-01-01", "2020-06-01"]}[kind]
    pages = spark.createDataFrame([(None if i is None else str(i), None, long if n % 2 else f"short {n}") for n, i in enumerate(ids)], "page_id string, url string, html string")
    pages = pages.withColumn("page_id", F.col("page_id").cast(kind))
    got = warc.round_trip(pages)
    assert got.schema["page_id"].dataType == pages.schema["page_id"].dataType == got.schema["refers_to"].dataType
    rows = {r["page_id"]: r for r in got.collect()}
    assert set(rows) == {r["page_id"] for r in pages.collect()}
    copies = [r["page_id"] for r in pages.where("length(html) >= 100").collect()]
    first = min(i for i in copies if i is not None)
    for i, r in rows.items():
        revisit = i in copies and i != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if revisit else ("response", None))


def test_many_tags_are_read_in_linear_time():
    tag = "SPDX-License-Identifier: mit "
    start = time.monotonic()
    for text in (tag * 100_000, (tag + "\n") * 100_000, "SPDX-License-Identifier: " + "(" * 50_000 + "mit" + ")" * 50_000):
        assert licenses.scan_text(text)[5] == "mit"
    assert time.monotonic() - start < 6


def test_lines_end_tags():
    found = licenses.scan_text("SPDX-License-Identifier: mit or\nSPDX-License-Identifier: isc\nSPDX-License-Identifier: (zlib SPDX-License-Identifier: bsd-3-clause\n)")
    assert found[5] == "bsd-3-clause,isc"


def test_held_out_labels_leave_scores_equal(spark):
    """Flipping every label of the held-out fold changes no score."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert flipped.exceptAll(labels).count() > 0
    fit = lambda marks: quality.score(docs, quality.train(docs, marks, exclude=quality.held_out(F.col("doc_id"))))
    scores = [{r["doc_id"]: r["score"] for r in fit(marks).collect()} for marks in (labels, flipped)]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 10
