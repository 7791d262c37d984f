"""Which of many phrases stand in a text, and where first: a join on grams, verified at their places."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.plans.checkpoint import sized_broadcast, written

#: Code points of the longest gram, and bits of a class's filter: what the tasks hold of the dictionary, whatever its size.
GRAM, FILTER_BITS = 8, 1 << 22
#: Arrow rows that a task passes on at once, and the characters beside them.
ROWS, CHARS = 20_000, 4_000_000
#: Code points of texts that a task hashes at once, one text after another; a longer text goes alone.
CHUNK = 1 << 20

_ODD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def size_class(length: int) -> int:
    """Phrases of 1 to 7 code points have a class each; longer ones share one up to the next power of two."""
    return length if length < GRAM else length.bit_length() + GRAM


def bounds(of: int) -> tuple[int, int]:
    """(code points of a class's grams, most code points of its phrases)."""
    return (of, of) if of < GRAM else (GRAM, (1 << (of - GRAM)) - 1)


def grams(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of width code points."""
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * _ODD + points[j : j + n]
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _phrase_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, class, gram, offset) of every distinct gram of each phrase, where it first stands."""
    for batch in batches:
        for i, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = size_class(len(phrase))
            found, at = np.unique(grams(_points(phrase), bounds(of)[0]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array([of] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(at.astype(np.int32))], ["id", "class", "gram", "offset"])


def _anchors(phrases: DataFrame) -> DataFrame:
    """(class, gram, offset, phrase): each phrase by the gram of it that fewest phrases hold."""
    known = written(phrases.select("phrase").where("phrase <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "phrase"), "phrases")
    each = written(known.mapInArrow(_phrase_grams, "id long, class int, gram long, offset int"), "phrase-grams")
    shared = each.groupBy("class", "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(shared, ["class", "gram"]).groupBy("id").agg(F.min_by(F.struct("class", "gram", "offset"), F.struct("n", "offset")).alias("a"))
    return written(rare.join(known, "id").select("a.class", "a.gram", "a.offset", "phrase"), "anchors")


def _filters(anchors: DataFrame, bits: int) -> dict[int, np.ndarray]:
    """For each class a bitmap of its anchors' grams: at most bits / 8 bytes, however many phrases there are."""
    slot = F.pmod(F.col("gram"), F.lit(bits))
    words = anchors.groupBy("class", F.shiftright(slot, 5).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(32)).cast("int"))).alias("mask"))
    out: dict[int, np.ndarray] = {}
    table = words.toArrow()
    for of in set(table["class"].to_pylist()):
        mine = table.filter(pc.equal(table["class"], of))
        out[of] = np.zeros(bits // 32, np.uint32)
        out[of][mine["word"].to_numpy()] = mine["mask"].to_numpy().astype(np.uint32)
    return out


def _chunks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK code points together."""
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > CHUNK:
            yield begin, i
            begin, total = i, 0
        total += n
    if total:
        yield begin, len(lengths)


def _candidates(filters: dict[int, np.ndarray], bits: int, names: Sequence[str]):
    """Every place of a text whose gram may be an anchor, with the characters around that a phrase of the class may take."""
    widths: dict[int, list[int]] = {}
    for of in filters:
        widths.setdefault(bounds(of)[0], []).append(of)

    def places(points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(class, most code points, row, place, gram) of texts that stand one after another; grams over an end are none."""
        for width, classes in widths.items():
            hashed = grams(points, width)
            any_ = filters[classes[0]] if len(classes) == 1 else np.bitwise_or.reduce([filters[of] for of in classes])
            set_ = lambda bitmap, h: np.flatnonzero(bitmap[(h & np.uint64(bits - 1)) >> np.uint64(5)] >> (h & np.uint64(31)).astype(np.uint32) & np.uint32(1))
            at = set_(any_, hashed)
            row = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[row]
            at, row = at[inside], row[inside]
            for of in classes:
                most, mine = bounds(of)[1], set_(filters[of], hashed[at])
                found, rows, gram = at[mine], row[mine], hashed[at[mine]].view(np.int64)
                if most == width:  # the gram is the phrase: its first place in a text is enough
                    order = np.lexsort((found, gram, rows))
                    first = np.ones(len(order), bool)
                    first[1:] = (np.diff(gram[order]) != 0) | (np.diff(rows[order]) != 0)
                    found, rows, gram = found[order][first], rows[order][first], gram[order][first]
                yield of, most - width, rows, found, gram

    def run(batches):
        out: list[list] = [[], [], [], [], [], []]

        def flush(kept):
            of, gram, at, lead, around = (pa.array(x, kind) for x, kind in zip(out[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True))
            rows = pa.array(out[0], pa.int64())
            made = pa.RecordBatch.from_arrays([*[c.take(rows) for c in kept], of, gram, at, lead, around], names)
            for x in out:
                x.clear()
            return made

        for batch in batches:
            chars, texts, kept = 0, batch.column(0), batch.columns[1:]
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, end in _chunks(lengths):
                joined = "".join(x for x in texts.slice(begin, end - begin).to_pylist() if x)
                ends = np.cumsum(lengths[begin:end])
                starts = ends - lengths[begin:end]
                for of, more, rows, found, gram in places(_points(joined), ends):
                    for row, at, g, low, high in zip(rows.tolist(), found.tolist(), gram.tolist(), starts[rows].tolist(), ends[rows].tolist(), strict=True):
                        first = max(low, at - more)
                        around = joined[first : min(high, at + bounds(of)[1])]
                        for x, v in zip(out, (begin + row, of, g, at - low, at - first, around), strict=True):
                            x.append(v)
                        chars += len(around)
                        if len(out[0]) >= ROWS or chars >= CHARS:
                            yield flush(kept)
                            chars = 0
            yield flush(kept)

    return run


def first_places(rows: DataFrame, text: str, phrases: DataFrame, max_phrases: int = 20_000, keep: list[str] | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """rows once for each phrase that text contains, with phrase and at, the code point (from 0) where it first stands.

    keep: the columns of rows to return, by default all; others, such as the text, don't leave the tasks. rows must have no
    column named phrase or at among them, and none that begins with an underscore.

    phrases: phrase; any number of them. Each is anchored at the one of its grams (8 code points; a shorter phrase is one
    itself) that fewest phrases share. Texts are read once: a task looks up a text's rolling grams in a bitmap of the anchors,
    of bounded size, and passes on only places that may be anchors, with the characters around. These join the anchors by
    gram, and the phrase is compared at its offset; at most max_phrases anchors of checked size are broadcast for that, more are
    shuffled. A fuller bitmap lets more places pass but loses none. No phrase comes to
    the driver, and none but those of its own join partition to a task. Null and empty phrases stand nowhere; null texts hold
    nothing; repeated rows are rows of their own.
    """
    keep = list(rows.columns) if keep is None else keep
    if {"phrase", "at"} & set(keep):
        raise ValueError("rows have a column named phrase or at: rename it, or leave it out of keep")
    if filter_bits & (filter_bits - 1) or filter_bits < 32:
        raise ValueError("filter_bits must be a power of two, at least 32")
    anchors = _anchors(phrases)
    found = ["_class", "_gram", "_at", "_lead", "_around"]
    kinds = (T.IntegerType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.StringType())
    kept = T.StructType([*[rows.schema[c] for c in keep], T.StructField("_row", T.LongType())])
    schema = T.StructType([*kept, *map(T.StructField, found, kinds)])
    # The text comes first, under a name of its own, as it may or may not be among keep.
    narrow = rows.select(F.col(text).alias("_text"), *keep, F.monotonically_increasing_id().alias("_row"))
    places = narrow.mapInArrow(_candidates(_filters(anchors, filter_bits), filter_bits, schema.names), schema)
    side = anchors.select(F.col("class").alias("_class"), F.col("gram").alias("_gram"), F.col("offset").alias("_offset"), "phrase")
    side = sized_broadcast(side) if anchors.limit(max_phrases + 1).count() <= max_phrases else side
    begin = F.col("_lead") - F.col("_offset")
    stands = (begin >= 0) & (F.substr("_around", begin + 1, F.length("phrase")) == F.col("phrase"))
    hits = places.join(side, ["_class", "_gram"]).where(stands).withColumn("at", F.col("_at") - F.col("_offset"))
    one = hits.groupBy("_row", "phrase").agg(F.min("at").alias("at"), F.first(F.struct(*keep) if keep else F.lit(None)).alias("_kept"))
    return one.select(*[F.col("_kept")[c].alias(c) for c in keep], "phrase", "at")
