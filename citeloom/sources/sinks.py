"""Writers: JSON lines, gzip shards, JSON objects, edge files, Parquet matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import hadoop_path
from citeloom.sources.readers import KINDS


def json_lines(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).json(path)


def gzip_shards(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One folder for each shard_id, in gzip JSON lines."""
    rows.write.mode(mode).partitionBy("shard_id").option("compression", "gzip").json(path)


def shard_files(rows: DataFrame, folder: str, kind: str = "metadata") -> None:
    """One gzip file <kind>_<shard_id>.jsonl.gz for each shard_id, as readers.shards() finds them.

    A shard is one file and so one task: choose shard ids that keep shards small. Files are named by renames in the store
    that Spark writes to, after all tasks have ended.
    """
    spark = rows.sparkSession
    store, target = hadoop_path(spark, folder)
    store.mkdirs(target)
    work = f"{folder.rstrip('/')}/_parts"
    rows.repartition("shard_id").write.mode("overwrite").partitionBy("shard_id").option("compression", "gzip").json(work)
    for shard in store.globStatus(hadoop_path(spark, f"{work}/shard_id=*/*.json.gz")[1]) or []:
        number = shard.getPath().getParent().getName().removeprefix("shard_id=")
        if not store.rename(shard.getPath(), hadoop_path(spark, f"{folder.rstrip('/')}/{KINDS[kind]}_{number}.jsonl.gz")[1]):
            raise OSError(f"{shard.getPath().toString()} can't be renamed")
    store.delete(hadoop_path(spark, work)[1], True)


def json_object(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a JSON object of all (key, value) rows, keys in order: for small maps only, as a table is better."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))))
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def edge_files(edges: DataFrame, path: str, mode: str = "error") -> None:
    """Tab-separated lines in one folder for each split; test lines carry their label.

    Lines are range-sorted over all splits, so a split is as many part files as ranges, and its parts in the order of their
    names, one after another, are its lines in text order. The largest split is dealt over tasks like the others.
    """
    line = F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.when(F.col("split") == "test", F.col("label").cast("string")))
    edges.select("split", line.alias("value")).repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.mode(mode).partitionBy("split").text(path)


def matrix(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).parquet(path)
