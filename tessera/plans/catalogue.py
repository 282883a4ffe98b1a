"""The engine's queries over the test tables, and the SQL that gives the same rows.

events is read as telemetry: seq = event_id, time = ts in microseconds, metric
value, categories user_id and event_type; lineitem gives a table of more columns.
Chunks hold 1000 rows; CHUNK_ODD leaves an incomplete tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, relational
from ..operators import compaction, ingest, query
from ..schema import TableSpec
from ..shared import shared_path
from ..sources import chunk_format
from ..streaming import ingest as streaming

CHUNK, CHUNK_ODD = 1000, 999
EVENTS = TableSpec("event_metrics", "t", ("v",), ("u",))
LINES = TableSpec("line_metrics", "t", ("quantity", "price", "discount"), ("line", "supplier"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return EVENTS.project(raw.withColumn("seq", F.col("event_id")), t=time, v=F.col("value"), u=F.col("user_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    time = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("l_shipdate"))
    return LINES.project(raw, t=time, quantity=F.col("l_quantity"), price=F.col("l_extendedprice"), discount=F.col("l_discount"), line=F.col("l_linenumber"), supplier=F.col("l_suppkey"))


def _arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as they might arrive out of time order: seq = event_id * 7919 mod 10000 within each 10000 ids."""
    at = (F.col("seq") - F.col("seq") % 10_000) + (F.col("seq") * 7919) % 10_000
    return events(spark, sf_dir).withColumn("id", F.col("seq")).withColumn("seq", at)


def avg_metric_for_category(spark, sf_dir):
    return query.generated(EVENTS)["average_v_for_u"](events(spark, sf_dir), 5).select(F.round("average", 6).alias("average"))


def avg_absent_category(spark, sf_dir):
    return query.average(events(spark, sf_dir), "v", "u", -1)


def avg_all_categories(spark, sf_dir):
    return query.averages(events(spark, sf_dir), "v", "u").select("u", F.round("average", 6).alias("average"), "rows")


def avg_line_metrics(spark, sf_dir):
    """Every generated average of a table with more columns than the binary header has slots."""
    df, out = lines(spark, sf_dir), []
    for name, run in query.generated(LINES).items():
        out.append(run(df, 3).select(F.lit(name).alias("name"), F.round("average", 6).alias("average")))
    return ingest.append(*out)


def masked_totals(spark, sf_dir):
    got = query.masked_totals(events(spark, sf_dir), "v", "u", [1, 2, 3, -7])
    return got.select("target", F.round("total", 4).alias("total"), "matches", F.round("average", 6).alias("average"))


def project_columns(spark, sf_dir):
    return events(spark, sf_dir).select("v", "u")


def append_rows(spark, sf_dir):
    df = events(spark, sf_dir)
    return ingest.append(df.where("seq % 2 = 0"), df.where("seq % 2 = 1")).select("seq", "t", "v", "u")


def dense_sequence(spark, sf_dir):
    df = events(spark, sf_dir).drop("seq")
    return ingest.with_sequence(df, "t", "u").select("seq", "t", "u", "v")


def read_batch(spark, sf_dir):
    """One whole batch, and one that reaches beyond the end and so is empty."""
    df = events(spark, sf_dir)
    return ingest.append(ingest.batch(df, 200, 300), ingest.batch(df, 900, 1 << 40)).select("seq", "u")


def chunk_assignment(spark, sf_dir):
    return compaction.assign(events(spark, sf_dir), CHUNK).groupBy("chunk_seq").agg(F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def complete_chunks(spark, sf_dir):
    return compaction.complete(events(spark, sf_dir), CHUNK_ODD).select("chunk_seq", "seq")


def commit_progress(spark, sf_dir):
    return ingest.progress(events(spark, sf_dir), CHUNK_ODD)


def sorted_chunk(spark, sf_dir):
    chunks = compaction.assign(_arrival(spark, sf_dir), CHUNK)
    return compaction.positions(chunks, EVENTS).select("id", "chunk_seq", "pos")


def pivot_columns(spark, sf_dir):
    return compaction.pivot(compaction.complete(_arrival(spark, sf_dir), CHUNK), EVENTS)


def chunk_table(spark, sf_dir):
    """Rows of the chunk table after it has been written and read again."""
    path = shared_path(spark, "chunks")
    compaction.write(events(spark, sf_dir), EVENTS, path, CHUNK_ODD)
    return spark.read.parquet(path).select("chunk_seq", "seq", "t", "v", "u")


def sql_view(spark, sf_dir):
    """The generated SQL view over the chunk table."""
    path = shared_path(spark, "chunks")
    compaction.write(events(spark, sf_dir), EVENTS, path, CHUNK)
    query.register(spark, EVENTS, path)
    return spark.sql("SELECT u, round(average, 6) AS average, rows FROM event_metrics_v_by_u")


def dod_bits_per_chunk(spark, sf_dir):
    return relational.dod_bits(compaction.assign(events(spark, sf_dir), CHUNK), "chunk_seq", "t", "seq")


def dod_roundtrip(spark, sf_dir):
    rows = relational.delta_of_deltas(compaction.assign(events(spark, sf_dir), CHUNK), "chunk_seq", "t", "seq")
    return relational.undo_dod(rows, "chunk_seq", "t", "delta", "dod").select("seq", F.col("value").alias("t"))


def rle_runs(spark, sf_dir):
    return relational.runs(compaction.assign(events(spark, sf_dir), CHUNK), "seq", "u", "chunk_seq")


def rle_bits(spark, sf_dir):
    return relational.rle_bits(rle_runs(spark, sf_dir), "chunk_seq")


def rle_roundtrip(spark, sf_dir):
    return relational.expand(rle_runs(spark, sf_dir)).select(F.col("order").alias("seq"), F.col("value").alias("u"))


def _blocks(spark, sf_dir):
    return codecs.encoded(compaction.assign(events(spark, sf_dir), CHUNK), EVENTS)


def codec_roundtrip(spark, sf_dir):
    """Every column through its byte codec and back, in table order."""
    return codecs.decoded(_blocks(spark, sf_dir), EVENTS)


def codec_sizes(spark, sf_dir):
    return codecs.sizes(_blocks(spark, sf_dir), EVENTS).drop("v_bytes")


def binary_average(spark, sf_dir):
    """The filtered average over binary chunks, of which two blocks are decoded."""
    rows = chunk_format.from_chunks(chunk_format.to_chunks(_blocks(spark, sf_dir), EVENTS), EVENTS, ["v", "u"])
    return query.average(rows, "v", "u", 5).select(F.round("average", 6).alias("average"))


def streamed_chunks(spark, sf_dir):
    """events as a stream, compacted by micro-batches: the chunk table's rows, without the tail that waits."""
    base = shared_path(spark, "stream")
    source = f"{base}/source"
    events(spark, sf_dir).repartitionByRange(5, "t").sortWithinPartitions("t").select("t", "v", "u").write.parquet(source)
    stream = spark.readStream.schema("t long, v float, u int").option("maxFilesPerTrigger", 2).parquet(source)
    streaming.compact_stream(stream, EVENTS, f"{base}/hot", f"{base}/chunks", f"{base}/checkpoint", CHUNK_ODD).awaitTermination()
    rows = streaming.read_chunks(spark, f"{base}/chunks")
    return rows.groupBy("chunk_seq").agg(F.count("*").alias("rows"), F.min("seq").alias("first"), F.max("seq").alias("last"))


_E = "(SELECT event_id AS seq, epoch_us(ts) AS t, CAST(value AS FLOAT) AS v, CAST(user_id AS INTEGER) AS u FROM events)"
_L = "(SELECT epoch_us(l_shipdate) AS t, CAST(l_quantity AS FLOAT) AS quantity, CAST(l_extendedprice AS FLOAT) AS price, CAST(l_discount AS FLOAT) AS discount, l_linenumber AS line, CAST(l_suppkey AS INTEGER) AS supplier FROM lineitem)"
_A = "(SELECT seq AS id, seq - seq % 10000 + seq * 7919 % 10000 AS seq, t, v, u FROM " + _E + ")"
_RUNS = f"""(SELECT chunk_seq, u AS value, min(seq) AS start, count(*) AS length FROM (
  SELECT *, seq - row_number() OVER (PARTITION BY chunk_seq, u ORDER BY seq) AS island FROM (SELECT *, seq // {CHUNK} AS chunk_seq FROM {_E})) GROUP BY chunk_seq, u, island)"""
_DOD = f"""(SELECT *, delta - lag(delta) OVER (PARTITION BY chunk_seq ORDER BY t, seq) AS dod FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_seq ORDER BY t, seq) AS place, t - lag(t) OVER (PARTITION BY chunk_seq ORDER BY t, seq) AS delta FROM (SELECT *, seq // {CHUNK} AS chunk_seq FROM {_E})))"""
_BITS = "CASE WHEN place <= 2 THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 68 END"
_DOD_BITS = f"SELECT chunk_seq, count(*) AS rows, CAST(sum({_BITS}) AS BIGINT) AS bits FROM {_DOD} GROUP BY chunk_seq"
_RLE_BITS = f"SELECT chunk_seq, CAST(32 + sum(CASE WHEN length = 1 THEN 33 ELSE 65 END) AS BIGINT) AS bits FROM {_RUNS} GROUP BY chunk_seq"
_AVG = f"SELECT round(coalesce(avg(CAST(v AS DOUBLE)), 0.0::DOUBLE), 6) AS average FROM {_E} WHERE u = 5"
_AVG_ALL = f"SELECT u, round(avg(CAST(v AS DOUBLE)), 6) AS average, count(*) AS rows FROM {_E} GROUP BY u"

CATALOGUE = {
    "avg_metric_for_category": (avg_metric_for_category, _AVG),
    "avg_absent_category": (avg_absent_category, "SELECT 0.0::DOUBLE AS average"),
    "avg_all_categories": (avg_all_categories, _AVG_ALL),
    "avg_line_metrics": (avg_line_metrics, " UNION ALL ".join(f"SELECT 'average_{m}_for_{c}' AS name, round(coalesce(avg(CAST({m} AS DOUBLE)), 0.0::DOUBLE), 6) AS average FROM {_L} WHERE {c} = 3" for m in LINES.metrics for c in LINES.categories)),
    "masked_totals": (masked_totals, f"SELECT target, round(coalesce(sum(CAST(v AS DOUBLE)), 0.0::DOUBLE), 4) AS total, count(u) AS matches, round(coalesce(avg(CAST(v AS DOUBLE)), 0.0::DOUBLE), 6) AS average FROM (VALUES (1), (2), (3), (-7)) w(target) LEFT JOIN {_E} ON u = target GROUP BY target"),
    "project_columns": (project_columns, f"SELECT v, u FROM {_E}"),
    "append_rows": (append_rows, f"SELECT seq, t, v, u FROM {_E}"),
    "dense_sequence": (dense_sequence, f"SELECT row_number() OVER (ORDER BY t, u) - 1 AS seq, t, u, v FROM {_E}"),
    "read_batch": (read_batch, f"SELECT seq, u FROM {_E} WHERE seq BETWEEN 200 AND 499"),
    "chunk_assignment": (chunk_assignment, f"SELECT seq // {CHUNK} AS chunk_seq, count(*) AS rows, min(seq) AS first, max(seq) AS last FROM {_E} GROUP BY 1"),
    "complete_chunks": (complete_chunks, f"SELECT seq // {CHUNK_ODD} AS chunk_seq, seq FROM {_E} WHERE seq < (SELECT count(*) FROM events) // {CHUNK_ODD} * {CHUNK_ODD}"),
    "commit_progress": (commit_progress, f"SELECT count(*) // {CHUNK_ODD} * {CHUNK_ODD} - 1 AS last_committed, count(*) % {CHUNK_ODD} AS backlog FROM {_E}"),
    "sorted_chunk": (sorted_chunk, f"SELECT id, seq // {CHUNK} AS chunk_seq, row_number() OVER (PARTITION BY seq // {CHUNK} ORDER BY t, seq) AS pos FROM {_A}"),
    "pivot_columns": (pivot_columns, f"SELECT seq // {CHUNK} AS chunk_seq, CAST(count(*) AS INTEGER) AS rows, list(t ORDER BY t, seq) AS t, list(v ORDER BY t, seq) AS v, list(u ORDER BY t, seq) AS u FROM {_A} GROUP BY 1 HAVING count(*) = {CHUNK}"),
    "chunk_table": (chunk_table, f"SELECT seq // {CHUNK_ODD} AS chunk_seq, seq, t, v, u FROM {_E} WHERE seq < (SELECT count(*) FROM events) // {CHUNK_ODD} * {CHUNK_ODD}"),
    "sql_view": (sql_view, f"SELECT u, round(avg(CAST(v AS DOUBLE)), 6) AS average, count(*) AS rows FROM {_E} WHERE seq < (SELECT count(*) FROM events) // {CHUNK} * {CHUNK} GROUP BY u"),
    "dod_bits_per_chunk": (dod_bits_per_chunk, _DOD_BITS),
    "dod_roundtrip": (dod_roundtrip, f"SELECT seq, t FROM {_E}"),
    "rle_runs": (rle_runs, f"SELECT chunk_seq, start, value, length FROM {_RUNS}"),
    "rle_bits": (rle_bits, _RLE_BITS),
    "rle_roundtrip": (rle_roundtrip, f"SELECT seq, u FROM {_E}"),
    "codec_roundtrip": (codec_roundtrip, f"SELECT seq // {CHUNK} AS chunk_seq, row_number() OVER (PARTITION BY seq // {CHUNK} ORDER BY t, seq) AS pos, t, v, u FROM {_E}"),
    "codec_sizes": (codec_sizes, f"SELECT d.chunk_seq, CAST(d.rows AS INTEGER) AS rows, CAST((d.bits + 7) // 8 AS INTEGER) AS t_bytes, CAST((r.bits + 7) // 8 AS INTEGER) AS u_bytes FROM ({_DOD_BITS}) d JOIN ({_RLE_BITS}) r USING (chunk_seq)"),
    "binary_average": (binary_average, _AVG),
    "streamed_chunks": (streamed_chunks, f"SELECT seq // {CHUNK_ODD} AS chunk_seq, count(*) AS rows, min(seq) AS first, max(seq) AS last FROM {_E} WHERE seq < (SELECT count(*) FROM events) // {CHUNK_ODD} * {CHUNK_ODD} GROUP BY 1"),
}

QUERIES = {name: run for name, (run, _) in CATALOGUE.items()}
ORACLES = {name: sql for name, (_, sql) in CATALOGUE.items()}
