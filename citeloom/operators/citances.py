"""Citation contexts: extraction, selection, and augmentation of documents.

Columns of inputs must not begin with an underscore: such names are used inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import MARKER, learned_sentences, sentences, splice, split_words, window
from citeloom.operators.graph import by_hash
from citeloom.operators.segmenter import told
from citeloom.plans.checkpoint import TASK_ROWS, dealt, sized_broadcast, written


def contexts(papers: DataFrame, targets: DataFrame, citing: DataFrame | None = None, k: int = 1, learned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(cited, citing, sentences): for each cited target the first citation in a paper, with k sentences around it.

    papers: ord (unique), paper_id, body_text, bib_entries. targets: paper_id. Spans whose reference is unknown or no target are
    dropped; a paper_id that repeats counts by its last row. The marked sentence is found by the spliced offset, so other
    markers in the text do no harm. Spans are ranked by their places alone; only then the one section of each chosen span is
    read, so no text goes through the ranking. learned: abbreviations and starters of operators.segmenter, beside the rules.
    """
    rows = papers if citing is None else papers.join(citing.select("paper_id"), "paper_id", "left_semi")
    spans = rows.select("ord", "paper_id", "bib_entries", F.posexplode(F.transform("body_text", lambda s: s["cite_spans"])).alias("section", "s"))
    spans = spans.select("ord", "paper_id", "bib_entries", "section", F.posexplode("s").alias("nth", "span"))
    linked = spans.select("ord", "paper_id", F.try_element_at("bib_entries", F.col("span.ref_id"))["link"].alias("cited"), F.struct("section", "nth", F.col("span.start").alias("start"), F.col("span.end").alias("end")).alias("at"))
    linked = linked.join(targets.select(F.col("paper_id").alias("cited")).distinct(), "cited", "left_semi")
    first = linked.groupBy("ord", "paper_id", "cited").agg(F.min("at").alias("at"))
    one = first.groupBy("cited", "paper_id").agg(F.max_by(F.struct("ord", "at"), "ord").alias("_o"))
    chosen = one.select("cited", "paper_id", "_o.ord", F.col("_o.at.section").alias("section"), F.col("_o.at.start").alias("start"), F.col("_o.at.end").alias("end"))
    sections = rows.select("ord", F.posexplode("body_text").alias("section", "s")).select("ord", "section", F.col("s.text").alias("text"))
    found = sections.join(sized_broadcast(written(chosen, "chosen-spans")), ["ord", "section"])
    found = found.withColumn("_marked", splice(F.col("text"), F.col("start"), F.col("end")))
    cut = sentences
    if learned:
        found = told(found, "_marked", *learned)
        cut = lambda x: learned_sentences(x, F.col("_known"), F.col("_begins"))
    before = cut(F.concat(F.substr("text", F.lit(1), F.col("start")), F.lit(MARKER)))
    return found.select("cited", F.col("paper_id").alias("citing"), window(cut(F.col("_marked")), F.size(before) - 1, k).alias("sentences"))


def good_context(joined: Column, min_tokens: int = 10) -> Column:
    return F.size(split_words(joined)) >= min_tokens


def select_contexts(rows: DataFrame, n: int = 20, method: str = "random", group: str = "cited", item: str = "citing", distance: str | None = None, order: str = "nearest", text: str | None = None, strict: bool = False, seed: str = "contexts") -> DataFrame:
    """At most n contexts of each group: the nearest (or farthest) by distance, or n at random of those of good quality.

    Groups of at most n contexts are kept whole, whatever their quality, or dropped with strict.
    """
    if method not in ("random", "graph_embedding_distance") or order not in ("nearest", "farthest"):
        raise ValueError("method is random or graph_embedding_distance; order is nearest or farthest")
    if method == "random":
        by = [by_hash(seed, group, item), F.col(item)]
        good = good_context(F.col(text)) if text else F.lit(True)
    else:
        by = [F.col(distance).asc() if order == "nearest" else F.col(distance).desc(), F.col(item)]
        good = F.lit(True)
    # Only a group's size decides how it is cut: counted map-side and joined back. The sizes also tell how many tasks rank.
    sizes = written(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "sizes")
    total, most = (x or 0 for x in sizes.agg(F.sum("_size"), F.max("_size")).first())
    sized = rows.join(sized_broadcast(sizes), group).withColumn("_large", F.col("_size") > n)
    sized = sized.where(F.col("_large") & good) if strict else sized.where(~F.col("_large") | good)
    top = lambda of, keys: dealt(of, total, *keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= n).drop("_n")
    if most > TASK_ROWS:  # first the best of each part of a large group
        sized = top(sized.withColumn("_part", F.pmod(F.xxhash64(item), F.ceil(F.col("_size") / TASK_ROWS))), [group, "_part"])
    return top(sized, [group]).select(*rows.columns)


def _met(documents: DataFrame, added: DataFrame) -> DataFrame:
    """documents joined with added by doc_id, null where a document has none.

    Where the ids of added can be broadcast, only documents with contexts go through the join's shuffle; the others stay where
    they are read. documents is then read twice. Contexts are texts, so they never go whole through the driver.
    """
    added = added.hint("merge")
    ids = written(added.select("doc_id").distinct(), "docs-with-contexts")
    known = sized_broadcast(ids)
    if known is ids:
        return documents.join(added, "doc_id", "left")
    both = documents.join(known, "doc_id", "left_semi").join(added, "doc_id")
    return both.unionByName(documents.join(known, "doc_id", "left_anti"), allowMissingColumns=True)


def augment(documents: DataFrame, added: DataFrame, shaped: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """documents (doc_id, words, sentences, sections) with contexts appended; citances = [start, end) over words.

    added: doc_id, contexts as array<array<array<string>>> (contexts of sentences of words). Each context is a section.
    Documents without contexts are unchanged, with citances [n, n].

    Both may have other columns in place of these, from which shaped makes them once the rows have met (those of added are null
    for documents without contexts): a text is a fraction of its words, so texts travel and words are cut behind the join.
    """
    none = F.array().cast("array<array<array<string>>>")
    rows = shaped(_met(documents.drop("citances"), added)).withColumn("_c", F.coalesce("contexts", none)).withColumn("_n", F.size("words"))
    flat = F.flatten("_c")

    def bounds(lengths: Column) -> Column:
        start = F.struct(F.array().cast("array<array<int>>").alias("out"), F.col("_n").alias("at"))
        grown = lambda s, n: F.struct(F.concat(s["out"], F.array(F.array(s["at"], s["at"] + n))).alias("out"), (s["at"] + n).alias("at"))
        return F.aggregate(lengths, start, grown, lambda s: s["out"])

    by_sentence = bounds(F.transform(flat, lambda s: F.size(s)))
    by_context = bounds(F.transform("_c", lambda c: F.size(F.flatten(c))))
    words = F.concat("words", F.flatten(flat))
    return rows.withColumn("sentences", F.concat("sentences", by_sentence)).withColumn("sections", F.concat("sections", by_context)).withColumn("words", words).withColumn("citances", F.array("_n", F.size("words"))).drop("_c", "_n", "contexts")


def augmented_corpus(splits: DataFrame, added: DataFrame, untouched: tuple[str, ...] = ("dev",), shaped: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """augment() of all splits but the untouched, which pass as they are and have null citances.

    splits: the columns of augment() and split. added: doc_id, contexts. shaped: see augment().
    """
    changed = augment(splits.where(~F.col("split").isin(*untouched)), added, shaped)
    same = splits.where(F.col("split").isin(*untouched)).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in added.schema if f.name != "doc_id"])
    same = shaped(same).withColumn("citances", F.lit(None).cast("array<int>"))
    return changed.unionByName(same.select(*changed.columns))
