"""Ranking without single-task windows.

``global_row_number`` numbers rows 1..n in a total order, per group, even when one
group holds most of the data: a range partitioning spreads the order over many
tasks, each task numbers its own rows, and a tiny per-(partition, group) count table
supplies the offsets (the distributed zipWithIndex pattern).

``top_k_per_group`` keeps k rows per group with ``row_number() <= k``; Spark inserts
a partial window-group limit before the shuffle, so at most k rows per group and
map task move."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .filters import maybe_broadcast


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def global_row_number(df: DataFrame, order_cols, partition_cols=(), out: str = "rank",
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order_cols`` order within its
    ``partition_cols`` group. ``order_cols`` must make the order total."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pcols = list(partition_cols)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)       # sampled by the range partitioner
    keyed = (df.repartitionByRange(n, *_cols(pcols), *_cols(order_cols))
             .sortWithinPartitions(*_cols(pcols), *_cols(order_cols))
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_local", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    df.unpersist()
    stats = keyed.groupBy("_pid", *pcols).agg(F.min("_local").alias("_first"),
                                              F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*pcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    stats = stats.select("_pid", *pcols, "_first", "_before")
    j = keyed.join(maybe_broadcast(stats), ["_pid", *pcols])
    return j.withColumn(out, F.col("_before") + (F.col("_local") - F.col("_first")) + 1) \
        .drop("_pid", "_local", "_first", "_before")


def top_k_per_group(df: DataFrame, k: int | None, order_cols, partition_cols=(),
                    out: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group (k None or 0 -> all rows, ranked globally)."""
    if not k:
        return global_row_number(df, order_cols, partition_cols, out)
    w = Window.partitionBy(*_cols(partition_cols)).orderBy(*_cols(order_cols))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def desc(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc()
