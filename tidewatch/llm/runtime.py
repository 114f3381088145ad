"""Plumbing shared by the operators: checkpoints, range partitions, running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.shared import scratch, shared_dir
from tidewatch.shipping import ship

__all__ = ["cut", "ranged", "scratch", "shared_dir", "ship", "spill", "table", "with_running_start"]


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame) -> DataFrame:
    """Like ``cut``, as Parquet: columnar, compressed, and without a partitioning that later joins would keep.

    A join with it shuffles both sides itself, which lets the adaptive planner split the partitions of hot keys.
    """
    path = scratch(df.sparkSession, "spill")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranged(df: DataFrame, order: Sequence[str | Column], bucket: str) -> DataFrame:
    """Deal rows to range partitions of ``order``, names or sort columns, and number the partitions in that order.

    The result is cut, so every later reading sees the same partition bounds. Pass narrow rows.
    """
    return cut(df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id()))


def with_running_start(df: DataFrame, order: Sequence[str], value: str, start: str, keep: str | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over all rows before this one in ascending ``order``.

    Sums run inside range partitions; only one total for each partition meets in a single task. ``keep`` names a
    column for the number of the row's range partition.
    """
    b = "__tw_bucket"
    rows = ranged(df, order, b)
    totals = rows.groupBy(b).agg(F.sum(value).alias("__tw_total"))
    before = totals.select(b, F.coalesce(F.sum("__tw_total").over(Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__tw_before"))
    inside = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition, so the broadcast is bounded by their number
    out = rows.withColumn(start, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(before), b).withColumn(start, F.col(start) + F.col("__tw_before")).drop("__tw_before")
    return out.withColumnRenamed(b, keep) if keep else out.drop(b)
