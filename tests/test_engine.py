import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import codecs, relational
from tessera.operators import compaction, ingest, query
from tessera.schema import TELEMETRY, TableSpec
from tessera.sources import chunk_format
from tessera.streaming import ingest as streaming

DEMO = TableSpec("demo", "time", ("cpu_temp", "fan_speed"), ("server_id",))
SPEC = TableSpec("s", "t", ("v",), ("u",))


@pytest.fixture(scope="module")
def demo(spark):
    """Four writers of 2500 rows each, one second apart from a fixed midnight; arrival takes turns."""
    i = F.col("id").cast("long")
    k, server = F.floor(i / 4), (i % 4).cast("int")
    sine = F.sin(0.05 * k).cast("float").cast("double")
    cosine = F.cos(0.02 * k).cast("float").cast("double")
    rows = spark.range(10_000).select(i.alias("seq"), (F.lit(639_000_000_000_000_000) + k * 10_000_000).cast("long").alias("time"), (50 + 10 * sine).cast("float").alias("cpu_temp"), (2000 + 500 * cosine).cast("float").alias("fan_speed"), server.alias("server_id"))
    return DEMO.project(rows)


def test_spec_rules():
    with pytest.raises(ValueError):
        TableSpec("x", "")
    with pytest.raises(ValueError):
        TableSpec("x", "t", ("t",))
    with pytest.raises(ValueError):
        TableSpec("x", "t", ("v",), (), ("w",))
    two = T.StructType([T.StructField(c, T.LongType(), False, {"role": "timestamp"}) for c in "ab"])
    with pytest.raises(ValueError):
        TableSpec.from_schema("x", two)
    assert TableSpec.from_schema("telemetry", TELEMETRY.schema) == TELEMETRY
    assert [f.dataType for f in TELEMETRY.schema] == [T.LongType(), T.FloatType(), T.FloatType(), T.IntegerType()]
    assert list(query.generated(TableSpec("x", "t", ("a", "b"), ("c",)))) == ["average_a_for_c", "average_b_for_c"]
    assert query.generated(TableSpec("x", "t", ("a",))) == {}


def test_nulls_are_rejected(spark):
    rows = spark.createDataFrame([(1, 1.0, None)], "t long, v float, u int")
    with pytest.raises(Exception, match="null in column u"):
        SPEC.project(rows).collect()


def test_demo_answer(spark, demo, tmp_path):
    compaction.write(demo, DEMO, str(tmp_path / "c"))
    got = query.generated(DEMO)["average_cpu_temp_for_server_id"](spark.read.parquet(str(tmp_path / "c")), 2).first()[0]
    assert abs(got - 50.0182114074707) < 1e-3
    rows = chunk_format.from_chunks(chunk_format.to_chunks(codecs.encoded(compaction.assign(demo), DEMO), DEMO), DEMO, ["cpu_temp", "server_id"])
    assert query.average(rows, "cpu_temp", "server_id", 2).first()[0] == pytest.approx(got, abs=1e-12)


def test_benchmark_answer(spark):
    i = F.col("id").cast("long")
    v = (45 + 5 * F.sin(0.05 * i).cast("float").cast("double")).cast("float")
    rows = spark.range(10_000).select(v.alias("v"), (i % 4).cast("int").alias("u"))
    assert abs(query.average(rows, "v", "u", 1).first()[0] - 45.01908050384522) < 1e-3


def test_average_edges(spark):
    rows = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (3.0, 1)], "v float, u int")
    assert query.average(rows, "v", "u", 1).first()[0] == 2.0
    assert query.average(rows, "v", "u", 9).first()[0] == 0.0
    assert math.isnan(query.average(rows, "v", "u", 2).first()[0])
    assert query.average(rows.limit(0), "v", "u", 1).first()[0] == 0.0
    assert {r.target: r.average for r in query.masked_totals(rows, "v", "u", [1, 5]).collect()} == {1: 2.0, 5: 0.0}


def test_scan_reads_two_columns_and_pushes_the_filter(spark, demo, tmp_path):
    compaction.write(demo, DEMO, str(tmp_path / "c"))
    plan = query.average(spark.read.parquet(str(tmp_path / "c")), "cpu_temp", "server_id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(server_id,2)" in plan
    assert "ReadSchema: struct<cpu_temp:float,server_id:int>" in plan


def test_batches(spark):
    rows = spark.range(10).select(F.col("id").alias("seq"))
    assert [r.seq for r in ingest.batch(rows, 2, 3).orderBy("seq").collect()] == [2, 3, 4]
    assert ingest.batch(rows, 8, 3).count() == 0
    assert ingest.batch(rows, 8, 0).count() == 0
    with pytest.raises(ValueError):
        ingest.batch(rows, -1, 1)
    with pytest.raises(ValueError):
        compaction.assign(rows, 0)
    assert ingest.progress(rows, 4).first() == (7, 2)
    assert ingest.progress(rows.limit(0), 4).first() == (-1, 0)


def test_sequence_is_dense_and_ordered(spark):
    rows = spark.range(5000).select((F.hash("id") % 100).alias("k"), F.col("id").alias("i"))
    got = ingest.with_sequence(rows, "k", "i", start=7).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(7, 5007))
    assert [(r.k, r.i) for r in got] == sorted((r.k, r.i) for r in got)


def test_tail_is_withheld_and_rewrites_agree(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("seq"), (2500 - F.col("id")).alias("t"), F.lit(1.0).cast("float").alias("v"), F.lit(1).alias("u"))
    for _ in range(2):
        compaction.write(rows, SPEC, str(tmp_path / "c"), 1000)
    got = spark.read.parquet(str(tmp_path / "c"))
    assert got.count() == 2000 and got.agg(F.max("chunk_seq")).first()[0] == 1
    compaction.write(rows, SPEC, str(tmp_path / "p"), 1000, include_partial=True)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2500


def test_pivot_sorts_by_time_then_arrival(spark):
    rows = spark.createDataFrame([(0, 5, 1.0, 1), (1, 3, 2.0, 2), (2, 5, 3.0, 3), (3, 1, 4.0, 4)], "seq long, t long, v float, u int")
    got = compaction.pivot(compaction.assign(rows, 4), SPEC).first()
    assert got.t == [1, 3, 5, 5] and got.u == [4, 2, 1, 3]


def test_relational_forms_match_the_codecs(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(0, 4000, 500)).tolist()
    rows = spark.createDataFrame([(i, 0, int(t[i]), 1.0, int(x)) for i, x in enumerate(rng.integers(0, 3, 500))], "seq long, chunk_seq long, t long, v float, u int")
    block = codecs.encoded(rows, SPEC).first()
    bits = relational.dod_bits(rows, "chunk_seq", "t", "seq").first().bits
    assert len(block.t) == (bits + 7) // 8
    runs = relational.runs(rows, "seq", "u", "chunk_seq")
    assert len(block.u) == (relational.rle_bits(runs, "chunk_seq").first().bits + 7) // 8


def test_bad_chunks():
    good = chunk_format.pack_chunk(2, [b"ab", b"c", b""])
    assert chunk_format.unpack_chunk(good, 3) == (2, [b"ab", b"c", b""])
    for bad in (b"xx", b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[:-2]):
        with pytest.raises(ValueError):
            chunk_format.unpack_chunk(bad, 3)
    with pytest.raises(ValueError):
        chunk_format.check(TableSpec("x", "t", ("a", "b", "c"), ("d",)))


def test_chunk_files(spark, demo, tmp_path):
    chunks = chunk_format.to_chunks(codecs.encoded(compaction.assign(demo), DEMO), DEMO).collect()
    for r in chunks:
        (tmp_path / f"chunk_{r.chunk_seq}.bin").write_bytes(bytes(r.chunk))
    got = chunk_format.read_files(spark, str(tmp_path), DEMO, ["time", "server_id"])
    want = demo.select("time", "server_id")
    assert got.count() == 10_000 and got.select("time", "server_id").exceptAll(want).count() == 0


def test_stream_gives_the_batch_chunks_and_survives_a_repeat(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("t"), F.col("id").cast("float").alias("v"), (F.col("id") % 3).cast("int").alias("u"))
    source, hot, chunks, check = (str(tmp_path / d) for d in ("source", "hot", "chunks", "check"))
    rows.repartitionByRange(6, "t").write.parquet(source)
    read = lambda: spark.readStream.schema("t long, v float, u int").option("maxFilesPerTrigger", 1).parquet(source)
    streaming.compact_stream(read(), SPEC, hot, chunks, check, 300).awaitTermination()
    got = streaming.read_chunks(spark, chunks)
    first = sorted(map(tuple, got.collect()))
    assert [r[0] for r in first] == sorted(i // 300 for i in range(900))
    assert len({r[1] for r in first}) == 900 and streaming.backlog(spark, hot).first() == (899, 100)
    last = max(int(d.name.split("=")[1]) for d in Path(hot).iterdir())
    assert len(list(Path(hot).iterdir())) == 2 and last > 3  # rows whose chunk is written have been released
    before = spark.read.parquet(f"{hot}/batch={last - 1}/end").first().end
    held = got.select("seq", "t", "v", "u").unionByName(spark.read.parquet(f"{hot}/batch={last}/rows"))
    again = spark.createDataFrame(held.where(F.col("seq") >= before).drop("seq").collect(), "t long, v float, u int")
    streaming.compact_batch(again, last, SPEC, 300, hot, chunks)
    assert sorted(map(tuple, streaming.read_chunks(spark, chunks).collect())) == first
    rows.limit(0).write.mode("append").parquet(source)
    streaming.compact_stream(read(), SPEC, hot, chunks, check, 300).awaitTermination()
    assert sorted(map(tuple, streaming.read_chunks(spark, chunks).collect())) == first


def test_spilled_writer_order_is_time_order(spark, demo, tmp_path):
    compaction.write(demo, DEMO, str(tmp_path / "c"), 1000)
    files = [f for f in spark.read.parquet(str(tmp_path / "c")).inputFiles()]
    for f in files:
        part = [(r.chunk_seq, r.time, r.seq) for r in spark.read.parquet(f).select("chunk_seq", "time", "seq").collect()]
        assert part == sorted(part)


def test_sequence_counts_and_numbers_one_exchange(spark):
    rows = spark.range(20_000).select((F.hash("id") % 1000).alias("k"), F.col("id").alias("i"), F.repeat(F.lit("v"), 50).alias("v"))
    out = ingest.with_sequence(rows, "k")
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()  # no range exchange is left to be made twice
    got = [(r.seq, r.k) for r in out.select("seq", "k").collect()]
    assert sorted(s for s, _ in got) == list(range(20_000)) and [k for _, k in sorted(got)] == sorted(k for _, k in got)


@pytest.mark.parametrize("n", [100_000, 3_000_000])
def test_sequence_with_columns_that_are_no_key(spark, n):
    rows = spark.range(n).select((F.hash("id") % 50_000).alias("k"), F.col("id").alias("i"), (F.col("id") * 3).alias("v"), F.repeat(F.lit("x"), 5).alias("w"))
    out = ingest.with_sequence(rows, "k", "i")
    got = out.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq"), F.sum("i"), F.sum("v"), F.count("w")).first()
    assert tuple(got) == (n, n, 0, n - 1, n * (n - 1) // 2, 3 * n * (n - 1) // 2, n)


def test_complete_means_every_sequence(spark):
    rows = spark.createDataFrame([(0,), (0,), (2,), (3,), (4,), (5,), (5,), (6,)], "seq long")
    assert sorted(r.seq for r in compaction.complete(rows, 3).collect()) == [3, 4, 5, 5]


def test_a_batch_of_some_chunks_keeps_the_others(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("seq"), F.col("id").alias("t"), F.lit(1.0).cast("float").alias("v"), F.lit(1).alias("u"))
    path = str(tmp_path / "c")
    for part in (rows.where("seq < 1000"), rows.where("seq >= 1000"), rows.where("seq between 300 and 599").withColumn("u", F.lit(2))):
        compaction.write(part, SPEC, path, 100)
    got = spark.read.parquet(path)
    assert got.count() == 2000 and got.agg(F.count_distinct("seq")).first()[0] == 2000 and got.where("u = 2").count() == 300


def test_built_in_telemetry_table(spark):
    raw = spark.createDataFrame([(i, 45.0 + i, 80.0, i % 4, "extra") for i in range(8)], "timestamp long, cpu_usage double, mem_usage double, entity_id int, other string")
    rows = TELEMETRY.project(raw)
    assert rows.columns == ["timestamp", "cpu_usage", "mem_usage", "entity_id"] and [t for _, t in rows.dtypes] == ["bigint", "float", "float", "int"]
    assert TableSpec.from_schema("telemetry", rows.schema).columns == TELEMETRY.columns
    averages = query.generated(TELEMETRY)
    assert sorted(averages) == ["average_cpu_usage_for_entity_id", "average_mem_usage_for_entity_id"]
    assert averages["average_cpu_usage_for_entity_id"](rows, 1).first()[0] == 48.0
