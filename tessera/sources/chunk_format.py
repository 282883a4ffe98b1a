"""The binary chunk layout as an exchange format: one chunk's header and blocks as bytes.

Tables live in Parquet; this is for chunks that come from or go to elsewhere.
Files are read with Spark's binaryFile source, and only the blocks asked for are
decoded. All numbers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.codecs import CODECS
from ..schema import TableSpec

# Fixed values of the layout.
MAGIC = 0x48434C47
VERSION = 1
HEADER_BYTES = 64
SLOTS = 3  # metrics first, then categories; a slot is an int64 offset and an int32 length
_SLOT = struct.Struct("<qi")


def check(spec: TableSpec) -> None:
    if len(spec.columns) - 1 > SLOTS:
        raise ValueError(f"the header has room for {SLOTS} metrics and categories")


def pack_chunk(rows: int, blocks: list[bytes]) -> bytes:
    """blocks: the timestamps', then the metrics' and the categories'."""
    head, at = bytearray(HEADER_BYTES), HEADER_BYTES
    struct.pack_into("<IIi", head, 0, MAGIC, VERSION, rows)
    for k, block in enumerate(blocks):
        _SLOT.pack_into(head, 12 + 12 * k, at, len(block))
        at += len(block)
    return bytes(head) + b"".join(blocks)


def unpack_chunk(data: bytes, columns: int) -> tuple[int, list[bytes]]:
    """Row count and blocks; a bad magic number, version or range is an error."""
    if len(data) < HEADER_BYTES:
        raise ValueError("not a chunk: too short")
    magic, version, rows = struct.unpack_from("<IIi", data, 0)
    if magic != MAGIC:
        raise ValueError("not a chunk: bad magic number")
    if version != VERSION:
        raise ValueError(f"unknown chunk version {version}")
    blocks = []
    for k in range(columns):
        at, size = _SLOT.unpack_from(data, 12 + 12 * k)
        if size < 0 or at < HEADER_BYTES or at + size > len(data):
            raise ValueError("a block lies outside the chunk")
        blocks.append(data[at : at + size])
    return max(0, rows), blocks


def to_chunks(blocks: DataFrame, spec: TableSpec) -> DataFrame:
    """chunk_seq, chunk (bytes) of encoded chunks (see functions.codecs.encoded)."""
    check(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chunks = [pack_chunk(int(r["rows"]), [bytes(r[c]) for c in spec.columns]) for r in b.to_dict("records")]
            yield pd.DataFrame({"chunk_seq": b["chunk_seq"], "chunk": chunks})

    return blocks.select("chunk_seq", "rows", *spec.columns).mapInPandas(run, "chunk_seq long, chunk binary")


def from_chunks(chunks: DataFrame, spec: TableSpec, columns: list[str] | None = None) -> DataFrame:
    """Rows of chunk bytes (column chunk): pos (from 1) and the columns asked for. A chunk of no rows gives none."""
    check(spec)
    wanted = list(columns or spec.columns)
    slots = {c: k for k, c in enumerate(spec.columns)}
    names = {"timestamp": "long", "metric": "float", "category": "int"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["chunk"]:
                n, blocks = unpack_chunk(bytes(data), len(slots))
                yield pd.DataFrame({"pos": range(1, n + 1), **{c: CODECS[spec.role(c)][1](blocks[slots[c]], n) for c in wanted}})

    return chunks.select("chunk").mapInPandas(run, "pos long, " + ", ".join(f"`{c}` {names[spec.role(c)]}" for c in wanted))


def read_files(spark: SparkSession, path: str, spec: TableSpec, columns: list[str] | None = None) -> DataFrame:
    """Rows of all chunk files under a path."""
    return from_chunks(spark.read.format("binaryFile").load(path).withColumnRenamed("content", "chunk"), spec, columns)
