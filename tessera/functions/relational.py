"""What the codecs do, as relations: bit costs, running differences and runs, each within its chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta_of_deltas(df: DataFrame, chunk: str, time: str, *tie: str) -> DataFrame:
    """df with place (from 1), delta and dod (null where there is none). For values whose differences fit a long."""
    by = Window.partitionBy(chunk).orderBy(time, *tie)
    out = df.withColumn("place", F.row_number().over(by)).withColumn("delta", F.col(time) - F.lag(time).over(by))
    return out.withColumn("dod", F.col("delta") - F.lag("delta").over(by))


def dod_bits(df: DataFrame, chunk: str, time: str, *tie: str) -> DataFrame:
    """Rows and encoded bits of each chunk's timestamps."""
    d = F.col("dod")
    cost = F.when(F.col("place") <= 2, 64).when(d == 0, 1).when(d.between(-63, 64), 9).when(d.between(-255, 256), 12).when(d.between(-2047, 2048), 16).otherwise(68)
    return delta_of_deltas(df, chunk, time, *tie).groupBy(chunk).agg(F.count("*").alias("rows"), F.sum(cost).cast("long").alias("bits"))


def undo_dod(df: DataFrame, chunk: str, first: str = "first", delta: str = "delta", dod: str = "dod") -> DataFrame:
    """df with value: two prefix sums over place of the first value, the first delta and the deltas of deltas."""
    by = Window.partitionBy(chunk).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("place") == 1, F.lit(0)).when(F.col("place") == 2, F.col(delta)).otherwise(F.col(dod)).cast("long")
    run = df.withColumn("_step", F.sum(step).over(by))
    return run.withColumn("value", (F.first(first).over(by) + F.sum("_step").over(by)).cast("long")).drop("_step")


def runs(df: DataFrame, order: str, value: str, chunk: str | None = None) -> DataFrame:
    """chunk (if given), start, value, length of each maximal run of equal values; order is dense within a chunk.

    A run's rows share order minus their rank among equal values, so a partition is a (chunk, value) and not the whole table.
    """
    keys = [chunk] if chunk else []
    rank = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    islands = df.withColumn("_island", F.col(order) - rank)
    return islands.groupBy(*keys, F.col(value).alias("value"), "_island").agg(F.min(order).alias("start"), F.count("*").alias("length")).drop("_island")


def rle_bits(run_rows: DataFrame, *keys: str) -> DataFrame:
    """Encoded bits of runs: 32, and 33 for each single value or 65 for each longer run."""
    return run_rows.groupBy(*keys).agg((F.lit(32) + F.sum(F.when(F.col("length") == 1, 33).otherwise(65))).cast("long").alias("bits"))


def expand(run_rows: DataFrame) -> DataFrame:
    """Runs back to rows: all columns but length, with order instead of start."""
    keep = [c for c in run_rows.columns if c not in ("start", "length")]
    return run_rows.select(*keep, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("order"))
