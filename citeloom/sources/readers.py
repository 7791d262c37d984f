"""Scans: JSON lines, gzip shards, command lists, key-value JSON, embeddings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.plans.checkpoint import hadoop_path
from citeloom.sources import schemas

KINDS = {"metadata": "metadata", "full_text": "pdf_parses"}


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line (plain or gzip), with an explicit schema; malformed lines stop the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def shard_id(path: Column, kind: str = "metadata") -> Column:
    """The number of a shard file .../<kind>/..._<number>.jsonl.gz; other paths raise when evaluated."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of shard: {kind}")
    number = F.regexp_extract(path, rf"{KINDS[kind]}_(\d+)\.jsonl\.gz$", 1)
    return F.when(number == "", F.raise_error(F.concat(F.lit("not a shard path: "), path)).cast("int")).otherwise(number.cast("int"))


def shards(spark: SparkSession, folder: str, kind: str = "metadata", limit: int | None = None) -> DataFrame:
    """All shards of a folder with shard_id; limit keeps the first so many by number, whatever the numbers are.

    Each gzip file is one task. The files are listed by the store that Spark reads, and with limit only those kept are read.
    """
    schema = schemas.METADATA if kind == "metadata" else schemas.FULL_TEXT
    store, path = hadoop_path(spark, f"{folder.rstrip('/')}/*.jsonl.gz")
    files = [status.getPath().toString() for status in store.globStatus(path) or []]
    numbers = {file: re.search(rf"{KINDS[kind]}_(\d+)\.jsonl\.gz$", file) for file in files}
    if odd := [file for file, number in numbers.items() if not number]:
        raise ValueError(f"not a shard path: {odd[0]}")
    files = sorted(files, key=lambda file: int(numbers[file][1]))[:limit]
    if not files:
        return spark.createDataFrame([], f"{schema}, shard_id int")
    return json_lines(spark, files, schema).withColumn("shard_id", shard_id(F.col("_metadata.file_path"), kind))


def commands(spark: SparkSession, path: str) -> DataFrame:
    """The whitespace-separated tokens of each non-blank line. Nothing in them is ever evaluated."""
    tokens = F.filter(F.split("value", r"(?U)\s+"), lambda x: x != "")
    return spark.read.text(path).select(tokens.alias("tokens")).where(F.size("tokens") > 0)


def targets(spark: SparkSession, **splits: str) -> DataFrame:
    """The union of named splits (train=path, ...) with a split column."""
    parts = [json_lines(spark, path, schemas.TARGET).withColumn("split", F.lit(name)) for name, path in splits.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_documents(rows: DataFrame, n: int | None, ordinal: str) -> DataFrame:
    """All rows, or the first n by ordinal."""
    return rows if n is None else rows.orderBy(ordinal).limit(n)


def key_values(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object as (key, value) rows."""
    kind = T.MapType(T.StringType(), T._parse_datatype_string(value))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) from Parquet; pickles are not read."""
    return spark.read.parquet(path).select(F.col("name").cast("string").alias("name"), F.col("embedding").cast("array<double>").alias("embedding"))


def sparse_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(doc, term, weight) of a matrix in long form."""
    return spark.read.schema("doc string, term string, weight double").parquet(path)
