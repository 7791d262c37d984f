"""Written tables that cut lineage, in the folder that the driver and executors share."""

from __future__ import annotations

import getpass
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a broadcast side may take, by the bytes of its rows; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows that dealt() gives to one task.
TASK_ROWS = 2_000_000
#: Scratch folders made by this driver and not yet dropped, oldest first.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local master and an error for a cluster.

    local-cluster counts as a cluster: its executors are processes of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    return f"file://{tempfile.gettempdir()}/checkpoints/{getpass.getuser()}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, by which Spark itself resolves the path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed by forget() or when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/citeloom-{tag}-{uuid.uuid4().hex}"
    store, found = hadoop_path(spark, path)
    store.deleteOnExit(found)
    _made.append(path)
    return path


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage is cut, and lost executors cost no recompute."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path  # for forget()
    return out


def made() -> int:
    """A mark for forget(): how many scratch folders there are now."""
    return len(_made)


def forget(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Delete the scratch folders made since mark, but for that of keep, a written table. Nothing else may need them."""
    for path in _made[mark:]:
        if keep is None or path != keep._written_to:
            store, found = hadoop_path(spark, path)
            store.delete(found, True)
            _made.remove(path)


def _bytes(column, kind) -> Column:
    """What a value of kind takes in a row, as an expression: the lengths of strings, the elements of arrays and maps."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.octet_length(column) + 8
    elif isinstance(kind, T.StructType):
        own = sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    elif isinstance(kind, T.ArrayType):
        own = F.aggregate(column, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        own = _bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes(F.map_values(column), T.ArrayType(kind.valueType))
    else:
        own = F.lit(16 if isinstance(kind, (T.DecimalType, T.VariantType)) else 8)
    return F.coalesce(own.cast("long"), F.lit(8).cast("long"))


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table, cheap to read) with a broadcast hint if its rows take at most limit bytes, else as it is.

    A row counts as the measured bytes of its columns (strings by their lengths, arrays by their elements) and 32 bytes for its
    place in the hash table. Rows are counted first, so that a large table is not read through.
    """
    most = max(1, limit // (32 + 8 * len(df.columns)))
    if df.limit(most + 1).count() > most:
        return df
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32))
    taken = df.agg(F.sum(row).alias("n")).first()["n"] or 0
    return F.broadcast(df) if taken <= limit else df


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows, TASK_ROWS each at most; no fewer than shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys to so many tasks that each gets about TASK_ROWS of its rows at most, if no key has more.

    rows: how many df has, about. What a task holds of them then doesn't grow with the table, whatever the number of shuffle
    partitions; grouping by keys, or by more columns, needs no further shuffle.
    """
    return df.repartition(task_count(df.sparkSession, rows), *keys)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Paths of the complete versions of a cached table, oldest first."""
    store, found = hadoop_path(spark, path)
    names = sorted(f.getPath().getName() for f in store.listStatus(found)) if store.exists(found) else []
    return [f"{path}/{n}" for n in names if store.exists(hadoop_path(spark, f"{path}/{n}/_SUCCESS")[1])]


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame], inputs: dict, overwrite: bool = False) -> DataFrame:
    """build() as a table under folder, named by a hash of all inputs; read back if it exists, unless overwrite.

    Each overwriting writes a new version, which counts once it is complete, so a reader of the one before goes on undisturbed
    and a failed writing leaves it in force. Versions older than that one are deleted.
    """
    path = f"{folder.rstrip('/')}/{hashlib.sha256(repr(sorted(inputs.items())).encode()).hexdigest()[:32]}"
    old = _versions(spark, path)
    if old and not overwrite:
        return spark.read.parquet(old[-1])
    number = int(old[-1].rsplit("/", 1)[1].split("-")[0][1:]) + 1 if old else 0
    new = f"{path}/v{number:09d}-{uuid.uuid4().hex}"
    build().write.parquet(new)
    for gone in old[:-1]:
        store, found = hadoop_path(spark, gone)
        store.delete(found, True)
    return spark.read.parquet(new)
