"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_written, shared_dir, written  # noqa: F401

ROW_BITS = 40  # rows are known by their doc_id only where it has no more bits than this, so that a line number fits beside it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, row: str = "_row") -> tuple[DataFrame, bool]:
    """docs with a column row, a long that no two rows share and that orders them as doc_id does, nulls first; and whether it is doc_id itself.

    That is so where every row has a doc_id of its own, and none is large. Else rows are numbered once, in a written table, without gaps;
    those of one doc_id by a hash of their texts, so what comes first does not depend on the input's files.
    """
    doc_id = F.col("doc_id").cast("long")
    rows, ids, least, most = docs.select(doc_id.alias("i")).agg(F.count("*"), F.count_distinct("i"), F.min("i"), F.max("i")).first()
    if rows == ids and max(abs(least or 0), abs(most or 0)).bit_length() <= ROW_BITS:
        return docs.withColumn(row, doc_id), True
    at, part, before = named(docs, "_at", "_part", "_before")
    # the last key only spreads copies that share an id over tasks
    placed = docs.withColumn(at, F.monotonically_increasing_id()).orderBy(doc_id, F.xxhash64("text"), at)
    placed = written(placed.withColumn(at, F.monotonically_increasing_id()), "keyed")
    task, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in placed.groupBy(task.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number for each task
    start, starts = 0, []
    for p in sorted(counts):
        starts.append((p, start))
        start += counts[p]
    offsets = docs.sparkSession.createDataFrame(starts, f"{part} long, {before} long")
    joined = placed.withColumn(part, task).join(F.broadcast(offsets), part)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), (F.col(before) + place).alias(row)), False


def named(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that docs has none of: the given ones, with as many underscores before them as it takes."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def labelled(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """doc_id, y, text of at most rows labelled documents of each class, the first by a hash of their id.

    An id that several rows share gives one of their texts, the one whose hash is least, so the bound holds whatever is repeated;
    an id with both labels counts as the lower one.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64(F.col("doc_id"))
    picked = marks.where("y = 1").orderBy(order, "doc_id").limit(rows).unionByName(marks.where("y = 0").orderBy(order, "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "y", F.col("t.text").alias("text"))


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect garbage: Spark then deletes the shuffle files of finished jobs, which otherwise stay until it happens to."""
    spark.sparkContext._jvm.System.gc()
