from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

NAMES = tuple(f"s{i}" for i in range(7))


def slow_fill(shards, size):
    """Whole permutations first, then turns."""
    order = [[(sharding._digest(f"{s}/offset") % size + j * (sharding._digest(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    taken, out = set(), [None] * size
    while len(taken) < size:
        for i, row in enumerate(order):
            free = [x for x in row if x not in taken]
            if free:
                taken.add(free[0])
                out[free[0]] = i
    return out


def test_table_by_definition():
    assert sharding.fill_table(NAMES, 211) == slow_fill(NAMES, 211)
    counts = Counter(sharding.fill_table(NAMES, 65537))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_goes():
    before = sharding.fill_table(NAMES, 65537)
    after = sharding.fill_table(NAMES[:-1], 65537)
    moved = sum(a != b for a, b in zip(before, after) if b != 6 and a != 6)
    assert moved < 0.1 * 65537


def test_bad_tables():
    for names, size in ((NAMES, 100), ((), 101), (("a", "a"), 101), (NAMES, 5), (NAMES, (1 << 20) + 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(names, size)


def test_placement(spark, edge_docs):
    got = sharding.place(edge_docs.withColumn("slot", F.lit("x")), "doc_id")
    assert got.count() == edge_docs.count() and got.where("shard is null").count() == 0
    assert got.where("doc_id = 7").select("shard").distinct().count() == 1
    assert sharding.place(edge_docs.limit(0), "doc_id").count() == 0
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_names_of_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([("a", 1, 2, 3)], "k string, _slot int, _shard int, _key_slot int")
    got = sharding.place(df, "k").first()
    assert (got._slot, got._shard, got._key_slot) == (1, 2, 3) and got.slot == sharding.place(df.select("k"), "k").first().slot
