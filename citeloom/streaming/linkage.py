"""Linkage of shards as they arrive: an extension, since all inputs of the engine's own operators are finite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from citeloom.plans.checkpoint import hadoop_path


def link_arriving(stream: DataFrame, targets: DataFrame, key: str, columns: list[str], claimed: str, checkpoint: str):
    """Append (key, columns) of each target key's first hit to the table folder claimed; keys claimed before are skipped.

    stream: a streaming DataFrame of catalogue rows with ord. A batch that is replayed replaces its own part, so that
    restarts neither lose nor repeat a claim. Returns the started query's writer.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hits = batch.join(targets.select(key).distinct(), key, "left_semi").groupBy(key).agg(*[F.min_by(c, "ord").alias(c) for c in columns])
        store, _ = hadoop_path(spark, claimed)
        parts = [f"{claimed}/batch={i}" for i in range(batch_id)]
        parts = [p for p in parts if store.exists(hadoop_path(spark, f"{p}/_SUCCESS")[1])]
        if parts:
            hits = hits.join(spark.read.schema(hits.schema).parquet(*parts).select(key), key, "left_anti")
        hits.write.mode("overwrite").parquet(f"{claimed}/batch={batch_id}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def keep_lowest(stream: DataFrame, targets: DataFrame, key: str, columns: Sequence[str], folder: str, checkpoint: str) -> DataStreamWriter:
    """The writer of a query that keeps each target key's row with the smallest ord as state, in whatever order shards arrive.

    stream: a streaming DataFrame of catalogue rows with a unique ord. Each batch writes the claims that it changes as a part of
    its own under folder, and replaces that part when it is replayed; lowest() reads what holds. State is one row for each
    target key that was met. Rows without key are no hits.
    """
    hits = stream.join(targets.select(key).distinct(), key, "left_semi")
    claims = hits.groupBy(key).agg(F.min_by(F.struct("ord", *columns), "ord").alias("claim"))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "claim.*").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return claims.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def lowest(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """The claims that hold after all parts of keep_lowest() under folder: of each key the one with the smallest ord.

    schema: key, ord and columns. A folder without parts gives no rows.
    """
    store, path = hadoop_path(spark, folder)
    store.mkdirs(path)
    rows = spark.read.schema(schema).parquet(folder)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "ord").alias("claim")).select(key, "claim.*")
