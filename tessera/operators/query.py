"""Filtered averages over chunks, one for each metric and category."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TableSpec


def average(df: DataFrame, metric: str, category: str, target: int, alias: str = "average") -> DataFrame:
    """One row: the mean of metric where category equals target, 0.0 where nothing does. Accumulates in double; a NaN in a matching row gives NaN."""
    return df.where(F.col(category) == F.lit(target)).agg(F.coalesce(F.avg(F.col(metric).cast("float")), F.lit(0.0)).alias(alias))


def averages(df: DataFrame, metric: str, category: str, alias: str = "average") -> DataFrame:
    """The same for every category at once, with its row count: one partial aggregate, whatever the number of chunks."""
    return df.groupBy(category).agg(F.avg(F.col(metric).cast("float")).alias(alias), F.count("*").alias("rows"))


def masked_totals(df: DataFrame, metric: str, category: str, targets: list[int]) -> DataFrame:
    """Sum, count and average for several targets in one scan: target, total, matches, average."""
    pairs = df.where(F.col(category).isin(targets)).groupBy(F.col(category).alias("target")).agg(F.sum(F.col(metric).cast("float")).alias("total"), F.count("*").alias("matches"))
    wanted = df.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(targets)], "target int")
    joined = wanted.join(pairs, "target", "left")
    total, matches = F.coalesce("total", F.lit(0.0)), F.coalesce("matches", F.lit(0))
    return joined.select("target", total.alias("total"), matches.alias("matches"), F.when(matches > 0, total / matches).otherwise(F.lit(0.0)).alias("average"))


def generated(spec: TableSpec) -> dict[str, Callable[[DataFrame, int], DataFrame]]:
    """average_<metric>_for_<category>(df, target) for each pair that the table declares."""
    return {f"average_{m}_for_{c}": (lambda df, target, m=m, c=c: average(df, m, c, target)) for m in spec.metrics for c in spec.categories}


def register(spark: SparkSession, spec: TableSpec, path: str) -> list[str]:
    """SQL views over a chunk table: <table>, and <table>_<metric>_by_<category> for each pair."""
    spark.read.parquet(path).createOrReplaceTempView(spec.name)
    names = [spec.name]
    for m in spec.metrics:
        for c in spec.categories:
            names.append(f"{spec.name}_{m}_by_{c}")
            averages(spark.table(spec.name), m, c).createOrReplaceTempView(names[-1])
    return names
