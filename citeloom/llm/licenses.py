"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases; tag expressions are parsed."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, with the label and how sure they are.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9), "gnu affero general public license": ("agpl", 0.9), "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9), "bsd license": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.9),
    "creative commons attribution": ("cc-by", 0.9), "creative commons zero": ("cc0", 0.9), "cc0 1 0": ("cc0", 0.8), "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9), "cc by nd": ("cc-by-nd", 0.9), "permission is hereby granted free of charge": ("mit", 0.9), "isc license": ("isc", 0.8),
    "public domain": ("public-domain", 0.5), "all rights reserved": ("proprietary", 0.6), "boost software license": ("bsl", 0.9), "the unlicense": ("unlicense", 0.7),
}
TAG = "spdx-license-identifier:"
# Identifiers of licences and of exceptions, in lower case; the older short forms leave open which version holds.
KNOWN = frozenset(
    "0bsd agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 "
    "cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 epl-1.0 epl-2.0 eupl-1.2 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc "
    "lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later mit mit-0 mpl-1.1 mpl-2.0 ms-pl ofl-1.1 postgresql python-2.0 unlicense wtfpl zlib".split()
)
OLDER = frozenset("agpl-3.0 gpl-1.0 gpl-2.0 gpl-2.0+ gpl-3.0 gpl-3.0+ lgpl-2.0 lgpl-2.1 lgpl-2.1+ lgpl-3.0 lgpl-3.0+ bsd".split())
EXCEPTIONS = frozenset("autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 classpath-exception-2.0 gcc-exception-3.1 linux-syscall-note llvm-exception openssl-exception".split())
BASE_SURE, KNOWN_SURE, OLDER_SURE, EXCEPTION_SURE, UNKNOWN_SURE = 0.8, 0.95, 0.9, 0.85, 0.5

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_POWER = {"with": 3, "and": 2, "or": 1}


def text_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters (A to Z lower-cased) and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def parse(expression: str, start: int = 0, stop: int | None = None) -> list[str] | None:
    """A licence expression, from start to stop, in reverse Polish order by the shunting-yard algorithm; None if it is malformed.

    Operators are with, and, or, from the tightest to the loosest, without regard to case. Reading ends at the first token
    that can't follow, as prose may stand behind a tag; what was read must be whole.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, deep = True, 0  # whether an operand is expected next; open parentheses
    for m in _TOKEN.finditer(expression, start, len(expression) if stop is None else stop):
        token, low = m[0], m[0].lower()
        if token == "(":
            if not operand:
                break
            stack.append(token)
            deep += 1
        elif token == ")":
            if operand or not deep:
                break
            deep -= 1
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif low in _POWER:
            if operand:
                return None
            while stack and stack[-1] != "(" and _POWER[stack[-1]] >= _POWER[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            if not operand:
                break
            out.append(low)
            operand = False
    if operand or deep:
        return None
    return out + stack[::-1]


def degree(identifier: str) -> float:
    """How sure it is what an identifier names: a licence, an older short form of one, an exception, or something unknown."""
    for known, sure in ((KNOWN, KNOWN_SURE), (OLDER, OLDER_SURE), (EXCEPTIONS, EXCEPTION_SURE)):
        if identifier in known:
            return sure
    return UNKNOWN_SURE


def evaluate(rpn: list[str], granted: Mapping[str, float], default: float = 0.0) -> float:
    """The degree to which an expression holds: or is the greater of its sides; and, and a licence with its exception, the lesser."""
    stack: list[float] = []
    for token in rpn:
        if token in _POWER:
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "or" else min(a, b))
        else:
            stack.append(granted.get(token, default))
    return stack[0]


def identifiers(rpn: list[str]) -> list[str]:
    """The licences of an expression, without the exceptions that follow with."""
    out: list[tuple[list[str], bool]] = []
    for token in rpn:
        if token == "with":
            out.pop()
        elif token in _POWER:
            b, a = out.pop(), out.pop()
            out.append((a[0] + b[0], False))
        else:
            out.append(([token], True))
    return out[0][0]


@lru_cache(maxsize=1)
def _automata():
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    tags.add_word(TAG, TAG)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one whole text."""
    phrases, tags = _automata()
    words = text_words(text)
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    starts, base, more, tagged = [], set(), {}, {}
    for end, phrase in phrases.iter(line):
        if phrase in BASE:
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        else:
            label, sure = NOTICES[phrase]
            more[label] = max(sure, more.get(label, 0))
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    if TAG[:5].encode() in low:
        stop = -1  # the end of the line that holds the tag
        for end, _ in tags.iter(low.decode("utf-8", "surrogatepass")):
            if stop <= end:
                stop = text.find("\n", end + 1)
                stop = len(text) if stop < 0 else stop
            if rpn := parse(text, end + 1, stop):
                tagged[tuple(rpn)] = evaluate(rpn, {i: degree(i) for i in rpn})
    doubt = 1.0
    for sure in sorted([BASE_SURE] * len(base) + [*more.values(), *tagged.values()]):
        doubt *= 1 - sure
    named = {i for rpn in tagged for i in identifiers(list(rpn))}
    number = lambda at: line.count(" ", 0, at)
    first, last = (number(min(starts)), number(max(starts))) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | set(more) | named)), 1 - doubt


def scan(documents: DataFrame) -> DataFrame:
    """One row for each row of documents (doc_id, text).

    n_words; n_base, first_word and last_word: the places of base phrases, and the smallest and largest of them as word
    numbers from 0 (null if there are none); base_labels; labels, with those of further notices and of licence tags; score:
    1 - product of the doubts about each distinct base label, notice and tag, 0 without any. A tag counts once, by the
    degree of its whole expression; a malformed one says nothing. Null and empty texts have no words; whole texts are read,
    however long. Rows are scanned one by one without a shuffle; repeated rows scan alike; an empty table gives no rows;
    other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = zip(*(scan_text(t.as_py()) for t in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(found, types, strict=True))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
