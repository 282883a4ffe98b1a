"""Appending rows and numbering them densely in arrival order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def append(*slices: DataFrame) -> DataFrame:
    """All rows of all slices, which must agree in column names."""
    return reduce(DataFrame.unionByName, slices)


def with_sequence(df: DataFrame, *order_by: str | Column, start: int = 0) -> DataFrame:
    """df with seq: start, start + 1, ... in the given order. Rows are range-partitioned and numbered within their partition, and the partitions'
    offsets (one number each) are joined on, so no task holds more than its share. The ranged rows are written once to the shared folder, as
    two exchanges of them might be cut at different bounds."""
    ranged = written(df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()), "sequence")
    by_part = Window.partitionBy("_part").orderBy(*order_by)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    # one row for each partition of the range exchange: a bounded window
    offsets = counts.withColumn("before", F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("before", F.lit(0)).alias("before"))
    placed = ranged.withColumn("_at", F.row_number().over(by_part)).join(F.broadcast(offsets), "_part")
    return placed.withColumn("seq", (F.col("before") + F.col("_at") - 1 + F.lit(start)).cast("long")).drop("_part", "_at", "before")


def batch(df: DataFrame, start: int, size: int) -> DataFrame:
    """The rows with sequences start .. start + size - 1 if all of them are there, else none."""
    if start < 0 or size < 0:
        raise ValueError("start and size must not be negative")
    rows = df.where(F.col("seq").between(start, start + size - 1))
    return rows.where(rows.agg(F.count_distinct("seq")).scalar() == size)


def progress(df: DataFrame, size: int) -> DataFrame:
    """What compaction in batches of size has committed: last_committed (-1: nothing), backlog (rows that wait)."""
    n = F.count("*")
    done = (F.floor(n / F.lit(size)) * size).cast("long")
    return df.agg((done - 1).alias("last_committed"), (n - done).cast("long").alias("backlog"))
