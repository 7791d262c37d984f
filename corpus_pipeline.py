"""A corpus pipeline of four stages: drop low quality, drop near copies, mix sources to weights, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import jaccard, mixing, packing, quality
from citeloom.llm.common import forget, made, materialize
from citeloom.llm.queries import byte_bpe


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more; it learns from all labels of docs' rows.

    Null and empty texts have neutral features; repeated rows stay together; other columns are kept as they are.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Null and wordless texts are copies of nothing and stay; rows that repeat id and text leave one.
    """
    return jaccard.drop_near_duplicates(docs, width=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and wordless texts weigh nothing and drop out."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens; a copy is packed like any document."""
    return packing.pack(docs, byte_bpe())


STAGES = [("quality classifier", keep_good_quality), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: SQL can't express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again.

    What a stage wrote for itself, and its input, is dropped once its result is written. Empty tables give no rows.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
            forget(spark, mark, keep=docs)
    return docs
