"""Shard placement by a permutation-filled lookup table.

Every shard derives a permutation of the slots of a prime-sized table from two
hashes of its name. Shards take turns: each claims the next slot of its
permutation that is still free, until no slot is free. A key's shard is then the
entry at hash(key) mod size: constant time, near-equal shares, and few keys move
when a shard comes or goes.

The table has a fixed size (a parameter, at most MAX_TABLE slots), so it is
broadcast; rows are never shuffled and a hot key costs nothing extra.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, table

MAX_TABLE = 1 << 20
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str] | tuple[str, ...], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard. Needs a prime size (so that every skip visits all slots) and distinct shard names."""
    if not _is_prime(size) or size > MAX_TABLE:
        raise ValueError(f"table size must be a prime of at most {MAX_TABLE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shard names must be distinct, at least one and at most one for each slot")
    at = [_digest(f"{s}/offset") % size for s in shards]
    skip = [_digest(f"{s}/skip") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            slots[at[i]] = i
            free -= 1
            if not free:
                break
    return slots


def slot_of(key: Column, size: int) -> Column:
    """A null key has the slot of the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards=SHARDS, size: int = TABLE_SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the key's slot and shard. Existing columns of those two names are replaced; an empty df gives no rows; equal keys share a shard."""
    filled = fill_table(shards, size)
    own, entry, name = named(df, "_key_slot", "_slot", "_shard")
    lookup = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(filled)], f"{entry} int, {name} string")
    placed = df.withColumn(own, slot_of(F.col(f"`{key}`"), size)).join(F.broadcast(lookup), F.col(own) == F.col(entry))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (slot, shard)]
    return placed.select(*keep, F.col(own).alias(slot), F.col(name).alias(shard))


def op6_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _oracle() -> str:
    entries = ",".join(map(str, fill_table(SHARDS)))
    return f"""
    WITH filled AS (SELECT unnest([{entries}]) AS s, generate_subscripts([{entries}], 1) - 1 AS slot),
    placed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents)
    SELECT p.doc_id, p.slot, 'shard-' || lpad(CAST(f.s AS VARCHAR), 3, '0') AS shard FROM placed p JOIN filled f ON p.slot = f.slot
    """


QUERIES = {"op6_shard_placement": op6_shard_placement}
ORACLES = {"op6_shard_placement": _oracle()}
