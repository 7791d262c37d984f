"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from citeloom.llm.common import ascii_words, buckets, shingles

K = 128
WIDTH = 5


def sketch(text: str | None, width: int = WIDTH, k: int = K) -> np.ndarray:
    """The k smallest distinct shingle hashes, sorted; fewer if the text has fewer; none for no words."""
    return shingles(ascii_words(text), width)[:k]


def to_text(s: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, in order."""
    return s.astype(">u8").tobytes().hex()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s or ""), ">u8").astype(np.uint64)


def merge(sketches: Iterator[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the parts' union: bottom-k sketches merge without loss."""
    out = np.empty(0, np.uint64)
    for s in sketches:
        out = np.union1d(out, s)[:k]
    return out


def distinct(s: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a fraction."""
    return float(len(s)) if len(s) < k else (k - 1) / ((int(s[-1]) + 1) / 2.0**64)


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[float, float, float]:
    """Of the union's sketch: its size, and how many of it are in both and in a."""
    union = np.union1d(a, b)[:k]
    in_a, in_b = np.isin(union, a, assume_unique=True), np.isin(union, b, assume_unique=True)
    return len(union), float((in_a & in_b).sum()), float(in_a.sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact if the union has at most k shingles. Two empty sketches resemble fully."""
    n, both, _ = _shared(a, b, k)
    return both / n if n else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    _, both, in_a = _shared(a, b, k)
    return both / in_a if in_a else 1.0 if not len(a) else 0.0


def merged_fingerprints(parts: DataFrame, key: str, fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint) of the union of each key's parts.

    Hashes are made distinct and ranked by the JVM. A first ranking in salted groups leaves k hashes for each, so that a hot
    key is no single task. Parts that are null or empty add nothing; a key with only those has an empty fingerprint.
    """
    from pyspark.sql import Window

    place = F.sequence(F.lit(0), (F.length("_f") / 16).cast("int") - 1)
    rows = parts.select(F.col(key).alias("_key"), F.coalesce(F.col(fingerprint), F.lit("")).alias("_f"))
    hashes = rows.select("_key", F.explode_outer(F.when(F.length("_f") > 0, F.transform(place, lambda i: F.substr("_f", i * 16 + 1, F.lit(16))))).alias("_h")).distinct()
    first = Window.partitionBy("_key", F.crc32(F.col("_h").cast("binary")) % 64).orderBy("_h")
    hashes = hashes.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    hashes = hashes.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k)
    return hashes.groupBy("_key").agg(F.array_join(F.array_sort(F.collect_list("_h")), "").alias(fingerprint)).withColumnRenamed("_key", key)


def neighbours(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) dealt into id ranges: (part, ahead, doc_id, text), sorted by all of them in each partition.

    A part holds the rows of one range. The first row of the next range comes with it once more as ahead = 1 (the last part
    gets the very first row), so that every row's successor is in its part. Limits are approximate quantiles, one for each
    shuffle partition, as in any range sort; ids that are no numbers get them from at most 100 ids a partition, drawn by
    hash. Null ids come first; rows of one id are ordered by text.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, kind = buckets(spark), documents.schema["doc_id"].dataType
    if isinstance(kind, NumericType):
        limits = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    else:
        drawn = rows.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(100 * n)
        drawn = [r["doc_id"] for r in drawn.orderBy("doc_id").collect()]
        limits = [drawn[len(drawn) * i // n] for i in range(1, n)] if drawn else []
    limits = list(dict.fromkeys(limits))
    key = F.col("doc_id")
    step = 64  # compare with every 64th limit, then with the limits between two of these
    literal = lambda values: F.from_json(F.lit(json.dumps(values, default=str)), f"array<{kind.simpleString()}>")
    below = lambda values: F.size(F.filter(values, lambda x: x < key))
    block = below(literal(limits[step - 1 :: step])) * step
    rows = rows.withColumn("part", block + below(F.slice(literal(limits), block + 1, F.lit(step))))
    least = F.min(F.struct(key.isNotNull().alias("known"), key.alias("id")))  # nulls come first
    firsts = [(r["part"], r["first"]["id"]) for r in rows.groupBy("part").agg(least.alias("first")).orderBy("part").collect()]
    first, before = [None] * n, [None] * n
    for i, (part, value) in enumerate(firsts):
        first[part], before[part] = value, firsts[i - 1][0]
    ahead = F.when(key.eqNullSafe(F.get(literal(first), F.col("part"))), F.get(F.from_json(F.lit(json.dumps(before)), "array<int>"), F.col("part")))
    both = F.array(F.struct(F.col("part"), F.lit(0).alias("ahead")), F.struct(ahead.alias("part"), F.lit(1).alias("ahead")))
    dealt = rows.select(F.explode(F.filter(both, lambda x: x["part"].isNotNull())).alias("to"), "doc_id", "text").select("to.part", "to.ahead", "doc_id", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def with_edits(documents: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, by ascending doc_id (after the last comes the first; a lone row is its own next). Null texts are empty.
    Repeated rows each count as a document. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, distinct_shingles, contained_in_next.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "contained_in_next"]

    def line(row, after):
        (doc_id, text, s), (_, then, t) = row, after
        cut = len(text) // 4
        edited = text[: len(text) - cut] + then[:cut]
        e = sketch(edited, width, k)
        return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, t, k), distinct(s, k), containment(s, t, k))

    def run(batches):
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        last, last_part, over = None, None, False
        for batch in batches:
            out = []
            for part, ahead, doc_id, text in zip(*(c for c in batch.columns), strict=True):
                part, ahead, doc_id, text = part.as_py(), ahead.as_py(), doc_id.as_py(), text.as_py()
                if part != last_part:
                    last, last_part, over = None, part, False
                if over:
                    continue  # more rows with the id that is ahead
                row = (doc_id, text, sketch(text, width, k))
                if last is not None:
                    out.append(line(last, row))
                last, over = row, bool(ahead)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(documents.schema["doc_id"].dataType)
    return neighbours(documents).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_next double")
