"""Places in the folder that all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a new temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: its lineage ends there, whichever executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place from 1 on, by ``order``, in a column ``name``: sorted by ranges, so no task has all rows.

    A range's first place is a prefix sum over the ranges' sizes, of which there are as many as shuffle partitions.
    """
    n = partitions(df.sparkSession)
    row = F.monotonically_increasing_id()  # the partition above bit 33, the row in it below
    sorted_ = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__row", row), f"numbered-{name}")
    part = F.shiftright("__row", 33)
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    met = sorted_.withColumn("__part", part).join(F.broadcast(bases), "__part")
    return met.withColumn(name, F.col("__base") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__base", "__row")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The frame over as many partitions as the cluster has cores, if it comes in fewer, as a table of few files does.

    Large tables come in more partitions than that and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
