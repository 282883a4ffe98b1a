"""Streaming ingest: rows wait in a hot table until a batch of them is complete, then become a sorted chunk.

Chunks are cut by arrival count, not by event time, so a late row lands in the
chunk it arrives with and nothing is dropped. Everything a micro-batch writes
goes to a folder named by its id and is overwritten on a retry, and what it
writes depends only on what the id before it left: a restart repeats the last
batch with the same result.

Each micro-batch stores where its sequences end (one row), and the rows that complete no
chunk yet as the hot rows that wait. The next batch reads these two, so its cost does not grow
with history, and what the batch before the last one left is deleted: hot rows are released once their chunk is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compaction import CHUNK_ROWS, assign
from ..operators.ingest import with_sequence
from ..schema import TableSpec
from ..shared import delete, drop_written, exists, written


def _state(spark: SparkSession, hot: str, batch_id: int) -> tuple[int, DataFrame | None]:
    """Where the sequences of the batches before this one end, and the rows of theirs that wait."""
    path = f"{hot}/batch={batch_id - 1}"
    if batch_id == 0 or not exists(spark, f"{path}/end"):
        return 0, None
    return spark.read.parquet(f"{path}/end").first()[0], spark.read.parquet(f"{path}/rows")


def compact_batch(batch: DataFrame, batch_id: int, spec: TableSpec, size: int, hot: str, chunks: str) -> None:
    """Number a micro-batch's rows after all earlier ones, write the chunks that are complete now, and keep the rest as hot rows."""
    spark = batch.sparkSession
    start, waiting = _state(spark, hot, batch_id)
    numbered = with_sequence(spec.project(batch), *spec.sort_keys, *[c for c in spec.columns if c not in spec.sort_keys], start=start).select("seq", *spec.columns)
    rows = numbered if waiting is None else waiting.select("seq", *spec.columns).unionByName(numbered)
    rows = written(rows, "arrivals")
    last = rows.agg(F.max("seq")).first()[0]
    end = start if last is None else last + 1
    ordered = assign(rows.where(F.col("seq") < end // size * size), size).repartitionByRange("chunk_seq").sortWithinPartitions("chunk_seq", *spec.sort_keys, "seq")
    ordered.select("chunk_seq", "seq", *spec.columns).write.mode("overwrite").parquet(f"{chunks}/batch={batch_id}")
    rows.where(F.col("seq") >= end // size * size).write.mode("overwrite").parquet(f"{hot}/batch={batch_id}/rows")
    spark.createDataFrame([(end,)], "end long").write.mode("overwrite").parquet(f"{hot}/batch={batch_id}/end")
    drop_written(rows)
    delete(spark, f"{hot}/batch={batch_id - 2}")  # a retry of this batch reads the one before it, no older one


def compact_stream(stream: DataFrame, spec: TableSpec, hot: str, chunks: str, checkpoint: str, size: int = CHUNK_ROWS, **trigger) -> StreamingQuery:
    """Start the compaction of a stream. The source's own limits (such as maxFilesPerTrigger) hold producers back; trigger defaults to availableNow."""
    if size <= 0:
        raise ValueError("a chunk holds at least one row")
    run = lambda batch, batch_id: compact_batch(batch, batch_id, spec, size, hot, chunks)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_chunks(spark: SparkSession, chunks: str) -> DataFrame:
    return spark.read.parquet(chunks).drop("batch")


def backlog(spark: SparkSession, hot: str) -> DataFrame:
    """last_committed (-1: nothing) and backlog (rows that wait) after the last batch."""
    ends = spark.read.parquet(f"{hot}/batch=*/end").agg(F.max("end")).first()[0]
    last = spark.read.option("basePath", hot).parquet(f"{hot}/batch=*/end").where(F.col("end") == ends).agg(F.max("batch")).first()[0]
    waiting = spark.read.parquet(f"{hot}/batch={last}/rows").count()
    return spark.createDataFrame([(ends - waiting - 1, waiting)], "last_committed long, backlog long")
