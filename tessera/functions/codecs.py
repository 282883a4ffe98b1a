"""Byte-exact column codecs for one chunk: delta-of-delta (int64), XOR (float32), run-length (int32).

Each is a pair of small helpers over NumPy arrays; encoded() and decoded() run
them where Spark has put a chunk's rows together. Streams carry most significant
bits first and are zero-padded to a byte; the row count travels beside the block,
since a padded stream does not hold it. Arithmetic wraps, so any int64 comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TableSpec

# A class's prefix, its bits, the payload's bits and the least delta of deltas it holds.
DOD_CLASSES = ((0b10, 2, 7, -63), (0b110, 3, 9, -255), (0b1110, 4, 12, -2047))
DOD_RAW = (0b1111, 4)


def pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Each value's lowest bits, as many as its width (0 to 64), one after the other."""
    widths = np.asarray(widths, dtype=np.int64)
    total = int(widths.sum())
    if not total:
        return b""
    place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    shift = (np.repeat(widths, widths) - 1 - place).astype(np.uint64)
    return np.packbits((np.repeat(np.asarray(values, dtype=np.uint64), widths) >> shift) & np.uint64(1)).tobytes()


class Bits:
    """Reads numbers off a stream; reading past its end is an error."""

    def __init__(self, data: bytes):
        self.number, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise ValueError("the stream ends too early")
        self.left -= n
        out = self.number >> self.left
        self.number &= (1 << self.left) - 1
        return out


def _in_pieces(data: bytes):
    """A reader over a long stream that keeps its numbers short."""
    bits, at = Bits(b""), 0

    def take(n: int) -> int:
        nonlocal bits, at
        if n > bits.left and at < len(data):
            more = data[at : at + 512]
            at += len(more)
            bits.number, bits.left = (bits.number << 8 * len(more)) | int.from_bytes(more, "big"), bits.left + 8 * len(more)
        return bits.take(n)

    return take


def dod_encode(values: np.ndarray) -> bytes:
    raw = np.asarray(values, dtype=np.int64).view(np.uint64)
    if not len(raw):
        return b""
    delta = raw[1:] - raw[:-1]
    dod = (delta[1:] - delta[:-1]).view(np.int64)
    head, head_bits = np.full(len(dod), DOD_RAW[0]), np.full(len(dod), DOD_RAW[1])
    body, body_bits = dod.view(np.uint64).copy(), np.full(len(dod), 64)
    for prefix, bits, width, least in reversed(DOD_CLASSES):
        fits = (dod >= least) & (dod < least + (1 << width))
        head[fits], head_bits[fits], body[fits], body_bits[fits] = prefix, bits, (dod[fits] - least).view(np.uint64), width
    same = dod == 0
    head[same], head_bits[same], body_bits[same] = 0, 1, 0
    values_ = np.concatenate([raw[:1], delta[:1], np.column_stack([head.astype(np.uint64), body]).ravel()])
    return pack(values_, np.concatenate([np.full(min(2, len(raw)), 64), np.column_stack([head_bits, body_bits]).ravel()]))


def dod_decode(data: bytes, count: int) -> np.ndarray:
    take, mask, out = _in_pieces(data), (1 << 64) - 1, np.zeros(count, dtype=np.uint64)
    value = delta = 0
    for i in range(count):
        if i == 0:
            value = take(64)
        else:
            if i == 1:
                delta = take(64)
            elif take(1):
                for prefix, _, width, least in DOD_CLASSES:
                    if not take(1):
                        delta = (delta + take(width) + least) & mask
                        break
                else:
                    delta = (delta + take(64)) & mask
            value = (value + delta) & mask
        out[i] = value
    return out.view(np.int64)


def xor_encode(values: np.ndarray) -> bytes:
    raw = np.asarray(values, dtype=np.float32).view(np.uint32)
    if not len(raw):
        return b""
    out, widths, window = [int(raw[0])], [32], None
    for x in (raw[1:] ^ raw[:-1]).tolist():
        if not x:
            out.append(0)
            widths.append(1)
            continue
        lead, trail = 32 - x.bit_length(), (x & -x).bit_length() - 1
        if window and lead >= window[0] and trail >= window[1]:
            size = 32 - window[0] - window[1]
            out += [0b10, x >> window[1]]
            widths += [2, size]
        else:
            window, size = (lead, trail), 32 - lead - trail
            out += [0b11 << 11 | lead << 6 | size, x >> trail]
            widths += [13, size]
    return pack(np.array(out, dtype=np.uint64), np.array(widths))


def xor_decode(data: bytes, count: int) -> np.ndarray:
    take, out = _in_pieces(data), np.zeros(count, dtype=np.uint32)
    value = trail = size = 0
    for i in range(count):
        if i == 0:
            value = take(32)
        elif take(1):
            if take(1):
                lead, size = take(5), take(6)
                trail = 32 - lead - size
                if trail < 0:
                    raise ValueError("the stream is corrupt")
            value ^= take(size) << trail
        out[i] = value
    return out.view(np.float32)


def rle_encode(values: np.ndarray) -> bytes:
    raw = np.asarray(values, dtype=np.int32)
    if not len(raw):
        return b""
    start = np.flatnonzero(np.append(True, raw[1:] != raw[:-1]))
    length = np.diff(np.append(start, len(raw)))
    single, value = length == 1, raw[start].view(np.uint32).astype(np.uint64)
    # the flag and the value are one number of 33 bits
    flagged = value | (np.where(single, 0, 1).astype(np.uint64) << np.uint64(32))
    body = np.column_stack([flagged, length.astype(np.uint64)]).ravel()
    widths = np.column_stack([np.full(len(start), 33), np.where(single, 0, 32)]).ravel()
    return pack(np.append(np.uint64(len(raw)), body), np.append(32, widths))


def rle_decode(data: bytes, count: int) -> np.ndarray:
    out = np.zeros(count, dtype=np.uint32)
    if not data and not count:
        return out.view(np.int32)
    take = _in_pieces(data)
    total, at = take(32), 0
    if total > count:
        raise ValueError("the block holds more rows than its place")
    while at < total:
        long, value = take(1), take(32)
        length = take(32) if long else 1
        if not 0 < length <= total - at:
            raise ValueError("a run overshoots the block")
        out[at : at + length] = value
        at += length
    return out[:total].view(np.int32)


CODECS = {"timestamp": (dod_encode, dod_decode, np.int64), "metric": (xor_encode, xor_decode, np.float32), "category": (rle_encode, rle_decode, np.int32)}


def encoded(df: DataFrame, spec: TableSpec) -> DataFrame:
    """chunk_seq, rows and a binary block for each column of each chunk, rows in table order. One chunk is one group: its size bounds the task."""

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        ordered = chunk.sort_values([*spec.sort_keys, "seq"], kind="stable")
        out = {"chunk_seq": [int(ordered["chunk_seq"].iloc[0])], "rows": [len(ordered)]}
        for c in spec.columns:
            encode, _, kind = CODECS[spec.role(c)]
            out[c] = [encode(ordered[c].to_numpy(dtype=kind))]
        return pd.DataFrame(out)

    schema = "chunk_seq long, rows int, " + ", ".join(f"`{c}` binary" for c in spec.columns)
    return df.select("chunk_seq", "seq", *spec.columns).groupBy("chunk_seq").applyInPandas(run, schema)


def decoded(blocks: DataFrame, spec: TableSpec, columns: list[str] | None = None) -> DataFrame:
    """Rows of encoded chunks: chunk_seq, pos (from 1) and the columns asked for; the others' blocks are not read."""
    wanted = list(columns or spec.columns)
    names = {"timestamp": "long", "metric": "float", "category": "int"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                n = int(row["rows"])
                out = {c: CODECS[spec.role(c)][1](bytes(row[c]), n) for c in wanted}
                yield pd.DataFrame({"chunk_seq": np.full(n, row["chunk_seq"], np.int64), "pos": np.arange(1, n + 1), **out})

    schema = "chunk_seq long, pos long, " + ", ".join(f"`{c}` {names[spec.role(c)]}" for c in wanted)
    return blocks.select("chunk_seq", "rows", *wanted).mapInPandas(run, schema)


def sizes(blocks: DataFrame, spec: TableSpec) -> DataFrame:
    """chunk_seq, rows and each block's bytes."""
    return blocks.select("chunk_seq", "rows", *(F.octet_length(c).alias(f"{c}_bytes") for c in spec.columns))
