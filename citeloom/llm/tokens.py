"""Token ids of whole texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import materialize, running_total

#: Distinct words a worker keeps encoded; beyond it, the table starts anew, so memory is bounded.
CACHED_WORDS = 250_000


class Encoder(dict):
    """Encodes text by the vocabulary of a tokenizers file, with ids as little-endian unsigned 32-bit bytes.

    The pattern of the byte-level vocabularies never joins what stands left and right of a blank that follows or precedes
    a non-blank. A text is therefore cut at blanks, and each piece (with its blank) is encoded once and then looked up. A text
    in which a blank stands between two white-space characters is encoded in one go. The merges run in tiktoken, on ranks
    read from the tokenizers file; the ids are those of tokenizers without post-processing. With added, the file's added
    tokens are found in the text first, as tokenizers does by default; else they count as ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without prefix space and normaliser are supported")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in spec["added_tokens"]}
        if added and any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only added tokens that match as they stand are supported")
        self._added = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]} if added else {}
        # Of tokens that start at one place, tokenizers takes the longest.
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self._bpe = tiktoken.Encoding(f"file:{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._odd: set[str] = {""}  # pieces that begin or end with white space

    def _pack(self, text: str) -> bytes:
        ids = self._bpe.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            self._odd.add(piece)
        out = self[piece] = self._pack(" " + piece)
        return out

    def ids(self, text: str | None) -> bytes:
        """The text's ids; null and empty texts have none."""
        if not text:
            return b""
        if self._marks:
            parts = self._marks.split(text)
            if len(parts) > 1:
                return b"".join(self._added[t] if i % 2 else self._plain(t) for i, t in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if len(self) > CACHED_WORDS:
            self.clear()
            self._odd = {""}
        packed = b"".join(map(self.__getitem__, rest))
        if not self._odd.isdisjoint(rest):
            before = first
            for piece in rest:
                if (not before or before[-1].isspace()) and (not piece or piece[0].isspace()):
                    return self._pack(text)
                before = piece
        return self._pack(first) + packed


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, which finds added tokens."""
    return Encoder(path, added=True)


def lengths(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, length) for each row: the number of token ids of the whole text; null and empty texts have 0."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(enc.ids(t.as_py())) // 4 for t in batch.column(1)], pa.int64())], ["doc_id", "length"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, length long")


def length_histogram(documents: DataFrame, path: str) -> DataFrame:
    """One row for each encoded length that occurs, with suffix sums that answer for that length as a context limit.

    length, n_docs and tokens (documents of that length and their tokens), docs_at_least and tokens_at_least (suffix sums),
    docs_before (so that quantile q is the length with docs_before < ceil(q * all) <= docs_before + n_docs), and
    truncated_tokens: all tokens that are left when every document is cut to this length. Other limits follow from the row
    of the next larger length L: with limit x, truncated(x) = truncated(L) - (L - x) * docs_at_least(L). Lengths are summed
    in the tasks that encode them; only histogram rows are shuffled. An empty table gives no rows; repeated rows each count.
    """
    kind = "length long, n_docs long"

    def run(batches):
        enc, count = encoder(path), {}
        for batch in batches:
            for t in batch.column(0):
                n = len(enc.ids(t.as_py())) // 4
                count[n] = count.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"length": list(count), "n_docs": list(count.values())}, pa.schema([("length", pa.int64()), ("n_docs", pa.int64())]))

    rows = documents.select("text").mapInArrow(run, kind).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    rows = materialize(rows, "lengths")
    rows = rows.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_down", -F.col("length")).withColumn("_block", F.floor(F.col("_down") / 1024))
    rows = running_total(rows, "n_docs", "docs_at_least", "_block", ["_down"])
    rows = running_total(rows, "tokens", "tokens_at_least", "_block", ["_down"])
    total = rows.agg(F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    rows = rows.join(F.broadcast(total), F.lit(True))
    return rows.select(
        "length", "n_docs", "tokens", "docs_at_least", "tokens_at_least", (F.col("_docs") - F.col("docs_at_least")).alias("docs_before"),
        (F.col("_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
    )
