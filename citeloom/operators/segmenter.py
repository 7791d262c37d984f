"""A sentence segmenter whose abbreviations and sentence starters are learned from the corpus by aggregations alone.

Scores follow Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection (2006). Columns of inputs must not begin
with an underscore: such names are used inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.plans.checkpoint import sized_broadcast, written

_LETTER = r"\p{L}"


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """(word, dotted, stops, next, n): how often each word stands with and without a full stop, as a written table.

    next is the word behind, only where the word stops; so one row for each word and one for each pair around a possible end,
    counted before the shuffle. Null and empty texts have no words.
    """
    pairs = documents.select(X.split_words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    pairs = pairs.select(F.explode(F.arrays_zip("_w", F.slice("_w", F.lit(2), F.size("_w")).alias("_x"))).alias("_p")).select("_p.*")
    rows = pairs.select(X.base(F.col("_w")).alias("word"), X.dotted(F.col("_w")).alias("dotted"), X.stops(F.col("_w")).alias("stops"), F.when(X.stops(F.col("_w")), X.base(F.col("_x"))).alias("next"))
    return written(rows.groupBy("word", "dotted", "stops", "next").agg(F.count(F.lit(1)).alias("n")), "word-counts")


def abbreviations(counts: DataFrame, least: float = 0.3) -> DataFrame:
    """(word, score) of the words that stand with a full stop too often for ends of sentences: those of at least the score least.

    The log likelihood ratio of a full stop being nearly certain (0.99) to its rate over all words, weighted for short words,
    full stops inside, and few places without one. Words without a letter are none. An empty table gives no rows.
    """
    total = counts.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("dots")).first()
    each = counts.where(F.col("word").rlike(_LETTER)).groupBy("word")
    each = each.agg(F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("dotted"), 0).otherwise(F.col("n"))).alias("_b")).where("_a > 0")
    rate = (total["dots"] or 0) / (total["n"] or 1)
    with_dot, without = math.log(0.99 / rate) if rate else 0.0, math.log(0.01 / (1 - rate)) if rate < 1 else 0.0
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    ratio = 2 * (F.col("_a") * F.lit(with_dot) + F.col("_b") * F.lit(without))
    score = ratio * F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -F.col("_b"))
    return each.select("word", score.alias("score")).where(F.col("score") >= least)


def _log_likelihood(p: Column, k: Column, n: Column) -> Column:
    part = lambda m, q: F.when(m > 0, m * F.ln(q)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def starters(counts: DataFrame, known: DataFrame, least: float = 30.0) -> DataFrame:
    """(word, score) of the words that begin sentences more often than they stand anywhere, by a log likelihood ratio of at least least.

    known: word, the abbreviations, behind which no sentence counts as begun; the fixed ones count as well.
    """
    fixed = [a.rstrip(".") for a in X.ABBREVIATIONS]
    ends = counts.where(F.col("stops") & F.col("next").isNotNull() & ~(F.col("dotted") & F.col("word").isin(fixed)))
    sure = ends.where(~F.col("dotted"))
    begun = sure.unionByName(ends.where("dotted").join(known.select("word"), "word", "left_anti").select(*sure.columns))
    begun = written(begun.groupBy(F.col("next").alias("word")).agg(F.sum("n").alias("_k")), "begun")
    every = counts.agg(F.sum("n")).first()[0] or 0
    breaks = begun.agg(F.sum("_k")).first()[0] or 0
    all_, n1, n2 = F.lit(float(every)), F.lit(float(breaks)), F.lit(float(every - breaks))
    rows = begun.where(F.col("word").rlike(_LETTER)).join(counts.groupBy("word").agg(F.sum("n").alias("_w")), "word")
    k1, k2 = F.col("_k").cast("double"), (F.col("_w") - F.col("_k")).cast("double")
    p, p1, p2 = F.col("_w") / all_, k1 / n1, F.when(n2 > 0, k2 / n2)
    score = 2 * (_log_likelihood(p1, k1, n1) + _log_likelihood(p2, k2, n2) - _log_likelihood(p, k1, n1) - _log_likelihood(p, k2, n2))
    return rows.where(p1 > p).select("word", score.alias("score")).where(F.col("score") >= least)


def told(documents: DataFrame, text: str, known: DataFrame, begins: DataFrame) -> DataFrame:
    """documents with _known and _begins: which of a text's own words around possible ends are in known and begins (word), as arrays or null.

    Neither list has a bound, so no text gets them whole: the words of the texts are joined with them, and the few found come back
    to the text by its digest; copies of a text share them.
    """
    around = lambda parts, p, i: F.array(
        F.struct(F.lit(True).alias("_a"), F.when(i > 0, X.base(X.last_word(F.get(parts, i - 1)))).alias("word")),
        F.struct(F.lit(False).alias("_a"), F.when(i > 0, X.base(X.first_word(p))).alias("word")),
    )
    near = X.once(X.pieces(F.col(text)), lambda parts: F.flatten(F.transform(parts, lambda p, i: around(parts, p, i))))
    words = documents.select(F.md5(F.col(text).cast("binary")).alias("_text"), F.explode(near).alias("_x")).select("_text", "_x.*")
    learned = known.select(F.lit(True).alias("_a"), "word").unionByName(begins.select(F.lit(False).alias("_a"), "word")).distinct()
    marks = words.where("word <> ''").join(sized_broadcast(written(learned, "learned-words")), ["_a", "word"])
    found = marks.groupBy("_text").agg(F.collect_set(F.when(F.col("_a"), F.col("word"))).alias("_known"), F.collect_set(F.when(~F.col("_a"), F.col("word"))).alias("_begins"))
    return documents.withColumn("_text", F.md5(F.col(text).cast("binary"))).join(found, "_text", "left").drop("_text")


def segmented(documents: DataFrame, text: str, known: DataFrame, begins: DataFrame, out: str = "sentences") -> DataFrame:
    """documents with the column out: sentences by the rules, the learned abbreviations and the learned starters.

    known, begins: word; see told(). A null text has null sentences, an empty one has none.
    """
    cut = X.learned_sentences(F.col(text), F.col("_known"), F.col("_begins"))
    return told(documents, text, known, begins).select(*[F.col(f"`{c}`") for c in documents.columns if c != out], cut.alias(out))
