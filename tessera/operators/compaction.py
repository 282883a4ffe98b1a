"""Count-based chunks: assign, withhold the incomplete tail, sort, pivot to columns, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TableSpec
from ..shared import drop_written, exists, written

CHUNK_ROWS = 10_000
CHUNKS_PER_BUCKET = 100


def assign(df: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """df with chunk_seq: which batch of size consecutive sequences a row arrived in."""
    if size <= 0:
        raise ValueError("a chunk holds at least one row")
    return df.withColumn("chunk_seq", F.expr(f"CAST(seq DIV {int(size)} AS BIGINT)"))


def complete(df: DataFrame, size: int = CHUNK_ROWS, include_partial: bool = False) -> DataFrame:
    """Rows of chunks that have all of their size sequences, each once or more often. Counting is a partial aggregate, first of one row a sequence, then of one a chunk."""
    chunks = assign(df, size)
    if include_partial:
        return chunks
    whole = chunks.groupBy("chunk_seq").agg(F.count_distinct("seq").alias("n")).where(F.col("n") == size).select("chunk_seq")
    return chunks.join(whole, "chunk_seq", "left_semi")


def sort_chunks(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Each chunk's rows together, in table order; equal keys by arrival."""
    return df.repartition("chunk_seq").sortWithinPartitions("chunk_seq", *spec.sort_keys, "seq")


def positions(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with pos: a row's place in its sorted chunk, from 1."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("chunk_seq").orderBy(*spec.sort_keys, "seq")).cast("long"))


def pivot(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A row for each chunk with an array for each column, in table order. A chunk is the bound on a row's size."""
    keys = [*spec.sort_keys, "seq"]
    rest = [c for c in spec.columns if c not in keys]
    rows = F.array_sort(F.collect_list(F.struct(*keys, *rest)))
    return df.groupBy("chunk_seq").agg(rows.alias("r")).select("chunk_seq", F.size("r").alias("rows"), *(F.col(f"r.{c}").alias(c) for c in spec.columns))


def write(df: DataFrame, spec: TableSpec, path: str, size: int = CHUNK_ROWS, include_partial: bool = False) -> None:
    """Write complete chunks as Parquet, many to a file: chunk_seq is a sorted column whose statistics prune, chunk_bucket a coarse partition.

    Chunks in df replace those of the same number, all others stay: a retry gives the same table. Nothing but the buckets that df touches is rewritten.
    """
    chunks = complete(df, size, include_partial).withColumn("chunk_bucket", F.expr(f"chunk_seq DIV {CHUNKS_PER_BUCKET}")).select("chunk_bucket", "chunk_seq", "seq", *spec.columns)
    spark, staged = df.sparkSession, None
    if exists(spark, path):
        new = chunks.select("chunk_bucket", "chunk_seq").distinct()
        others = spark.read.parquet(path).join(new.select("chunk_bucket").distinct(), "chunk_bucket", "left_semi").join(new.select("chunk_seq"), "chunk_seq", "left_anti")
        chunks = staged = written(chunks.unionByName(others.select(*chunks.columns)), "chunks")
    ordered = chunks.repartitionByRange("chunk_bucket", "chunk_seq").sortWithinPartitions("chunk_bucket", "chunk_seq", *spec.sort_keys, "seq")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_bucket").parquet(path)
    if staged is not None:
        drop_written(staged)
