import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import codecs as c

DOD = [
    ([1000, 2000, 3000, 4000], "00000000000003e800000000000003e800"),
    ([0, 10, 20, 31, 300], "0000000000000000000000000000000a503a4040"),
    ([0, 100, 50, 5000, 0], "00000000000000000000000000000064c69f0000000000001388fffffffffffffd9220"),
    ([-5], "fffffffffffffffb"),
    ([], ""),
]
XOR = [([45, 45, 45], "4234000000"), ([45, 45.5, 45.25, 45.25, -1], "42340000dc0f705b021fb6a0"), ([0.0, -0.0, np.inf], "00000000c00f013ff0"), ([1.5], "3fc00000"), ([], "")]
RLE = [([1, 1, 1, 2, 3, 3], "00000006800000008000000180000000a00000006000000040"), ([-1], "000000017fffffff80"), ([0, 1, 2, 3], "000000040000000000000000400000004000000030"), ([], "")]


@pytest.mark.parametrize("values, want", DOD)
def test_dod_vectors(values, want):
    assert c.dod_encode(np.array(values, dtype=np.int64)).hex() == want
    assert c.dod_decode(bytes.fromhex(want), len(values)).tolist() == values


@pytest.mark.parametrize("values, want", XOR)
def test_xor_vectors(values, want):
    values = np.array(values, dtype=np.float32)
    assert c.xor_encode(values).hex() == want
    assert c.xor_decode(bytes.fromhex(want), len(values)).tobytes() == values.tobytes()


@pytest.mark.parametrize("values, want", RLE)
def test_rle_vectors(values, want):
    assert c.rle_encode(np.array(values, dtype=np.int32)).hex() == want
    assert c.rle_decode(bytes.fromhex(want), len(values)).tolist() == values


@pytest.mark.parametrize("dod, bits", [(0, 1), (-63, 9), (64, 9), (-64, 12), (65, 12), (-255, 12), (256, 12), (-256, 16), (257, 16), (-2047, 16), (2048, 16), (-2048, 68), (2049, 68)])
def test_dod_class_borders(dod, bits):
    values = np.array([0, 10, 20 + dod], dtype=np.int64)
    data = c.dod_encode(values)
    assert len(data) == (128 + bits + 7) // 8 and c.dod_decode(data, 3).tolist() == values.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1) | st.integers(-300, 300), max_size=60))
def test_dod_round_trip(values):
    values = np.array(values, dtype=np.int64)
    assert c.dod_decode(c.dod_encode(values), len(values)).tolist() == values.tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0x7FC00001, 0x80000000, 0x7F800000, 0xFF800000, 0]), max_size=60))
def test_xor_keeps_every_bit(raw):
    values = np.array(raw, dtype=np.uint32).view(np.float32)
    assert c.xor_decode(c.xor_encode(values), len(values)).view(np.uint32).tolist() == raw


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3) | st.integers(-(2**31), 2**31 - 1), max_size=80))
def test_rle_round_trip(values):
    values = np.array(values, dtype=np.int32)
    assert c.rle_decode(c.rle_encode(values), len(values)).tolist() == values.tolist()


def test_long_chunk_round_trip():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.integers(0, 5000, 10_000))
    assert (c.dod_decode(c.dod_encode(t), 10_000) == t).all()
    v = (45 + 5 * np.sin(0.05 * np.arange(10_000)).astype(np.float32)).astype(np.float32)
    assert (c.xor_decode(c.xor_encode(v), 10_000) == v).all()


def test_malformed_streams():
    with pytest.raises(ValueError):
        c.dod_decode(b"\0" * 7, 1)
    with pytest.raises(ValueError):
        c.xor_decode(bytes.fromhex("4234000000"), 10)  # padding holds at most seven phantom values
    data = c.rle_encode(np.array([1, 1, 2], dtype=np.int32))
    with pytest.raises(ValueError):
        c.rle_decode(data, 2)
    with pytest.raises(ValueError):
        c.rle_decode(b"\0\0\0\2" + c.pack(np.array([(1 << 32) | 7, 5], dtype=np.uint64), np.array([33, 32])), 2)
    with pytest.raises(ValueError):
        c.rle_decode(data[:-5], 3)
