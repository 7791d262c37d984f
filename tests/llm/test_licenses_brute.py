"""Licence scans against plain loops over words, and expressions against a recursive reading."""

import re

import pytest

from citeloom.llm import licenses, queries

DATA = "/root/testdata/sf0.001"


def value(text):
    """The degree of an expression by recursive descent: or is looser than and, and looser than with."""
    tokens = re.findall(r"\(|\)|[A-Za-z0-9.+:-]+", text)

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            out = either()
            assert tokens.pop(0) == ")"
            return out
        return licenses.degree(tokens.pop(0).lower())

    def level(word, below, join):
        out = below()
        while tokens and tokens[0].lower() == word:
            tokens.pop(0)
            out = join(out, below())
        return out

    def excepted():
        return level("with", atom, min)

    def both():
        return level("and", excepted, min)

    def either():
        return level("or", both, max)

    return either()


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    base = {label: places(p) for p, label in licenses.BASE.items() if places(p)}
    more = {}
    for phrase, (label, sure) in licenses.NOTICES.items():
        if places(phrase):
            more[label] = max(sure, more.get(label, 0))
    tags, names = {}, set()
    for m in re.finditer(r"(?i)spdx-license-identifier:([^\n]*)", text or ""):
        found = re.match(r"[ \t]*((?:[A-Za-z0-9][A-Za-z0-9.+:-]*|[() \t])+)", m[1])
        if found and (rpn := licenses.parse(found[1])):
            tags[tuple(rpn)] = value(found[1])
            names |= {t for t in rpn if t not in ("and", "or", "with") and t not in licenses.EXCEPTIONS}
    doubt = 1.0
    for sure in [licenses.BASE_SURE] * len(base) + [*more.values(), *tags.values()]:
        doubt *= 1 - sure
    starts = [i for at in base.values() for i in at]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *more, *names})), 1 - doubt


def test_query_equals_plain_loops(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op8_license_scans(spark, DATA).collect()
    assert len(got) == len(docs) and sum(r["n_base"] for r in got)
    for r in got:
        assert tuple(r)[1:7] == brute(docs[r["doc_id"]])[:6]
        assert r["score"] == pytest.approx(brute(docs[r["doc_id"]])[6])


def test_tags_equal_a_recursive_reading():
    texts = [
        "x\n// SPDX-License-Identifier: MIT\ny", "SPDX-License-Identifier: MIT OR GPL-2.0", "SPDX-License-Identifier: MIT AND GPL-2.0",
        "spdx-license-identifier: (MIT OR own-1) AND (Apache-2.0 OR GPL-3.0) ", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT\nmit license",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: Apache-2.0 AND own-1 OR GPL-2.0",
    ]
    for t in texts:
        got = licenses.scan_text(t)
        assert got[:6] == brute(t)[:6] and got[6] == pytest.approx(brute(t)[6]), t


def test_operators_give_different_scores():
    score = lambda e: licenses.scan_text(f"SPDX-License-Identifier: {e}")[6]
    assert score("MIT") == pytest.approx(0.95) and score("MIT OR GPL-2.0") == pytest.approx(0.95)
    assert score("MIT AND GPL-2.0") == pytest.approx(0.9) and score("MIT AND own-1") == pytest.approx(0.5)
    assert score("GPL-2.0 WITH Classpath-exception-2.0") == pytest.approx(0.85) and score("GPL-2.0 WITH own-1") == pytest.approx(0.5)
    assert score("MIT OR (GPL-2.0 AND own-1)") > score("(MIT OR GPL-2.0) AND own-1")
    assert score("MIT AND") == 0.0 and score("(MIT") == 0.0


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "doc_id string, text string, labels string, score double, n_words int")
    assert licenses.scan(rows).count() == 0
    one = rows.unionByName(spark.createDataFrame([("a", "CC BY", "x", 1.0, 1)], rows.schema))
    assert tuple(licenses.scan(one).first())[:7] == ("a", 2, 1, 0, 0, "cc-by", "cc-by")
