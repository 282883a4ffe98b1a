import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash


def brute(points, radius=4):
    p, q = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    label = np.arange(len(points))
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        if (new == label).all():
            return label
        label = new


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, n // 4 + 1, dtype=np.uint64)
    out = centres[rng.integers(0, len(centres), n)]
    for _ in range(5):
        out = out ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(out)


def test_fingerprint_by_definition():
    text = "The Quick\x0bbrown fox  jumps\tover THE lazy dog É"
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def test_tree_finds_exactly_the_near_pairs():
    points = clustered(3000)
    i, j = simhash.tree_pairs(points)
    got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())}
    p, q = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert got == {(a, b) for a, b in zip(p.tolist(), q.tolist()) if a < b} and len(i) == len(got)


@pytest.mark.parametrize("limit", [8192, 40])
def test_components_match_brute_force(spark, limit):
    points = clustered(1500, seed=limit)
    if limit == 40:  # a dense ball, larger than a shard may be
        rng = np.random.default_rng(5)
        points = np.unique(np.concatenate([points, points[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))]))
    label = brute(points)
    df = spark.createDataFrame([(int(np.int64(p)), i) for i, p in enumerate(points.view(np.int64))], "fp long, rep long")
    got = {r.node: r.component for r in simhash.components(simhash.links(df, limit=limit)).collect()}
    assert {i: got.get(i, i) for i in range(len(points))} == dict(enumerate(label.tolist()))


def test_more_blocks_for_more_points():
    assert len(simhash.projections(10_000)) == 5
    assert len(simhash.projections(100_000_000)) == 15
    assert all(sum(bin(m).count("1") for m in simhash.projections(n)) == 64 * len(simhash.projections(n)) // k * (k - 4) for n, k in ((10, 5),) if k)


def test_edge_rows(spark):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "a b c d e", "x"), (5, None, None), (4, "", None), (None, "", None), (9, "word " * 50_000, "y"), (7, "quite other words stand here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 4), (1, 1), (1, 1), (3, 1), (4, 4), (5, 4), (7, 7), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chain_is_one_component(spark):
    random.seed(2)
    pairs = [(i + 1, i) for i in range(200)]
    random.shuffle(pairs)
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r.node, r.component) for r in got.collect()} == {(i, 0) for i in range(1, 201)}


def test_tree_has_depth_and_prunes():
    rng = np.random.default_rng(3)
    balls = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([balls ^ (np.uint64(1) << np.uint64(b)) for b in range(12)]))
    nodes = []
    i, j = simhash.tree_pairs(points, 4, nodes)
    assert max(d for d, _, _ in nodes) >= 4 and sum(n for _, n, _ in nodes) > sum(c for _, _, c in nodes)
    p, q = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(p.tolist(), q.tolist()) if a < b}


def test_shards_overlap_at_their_borders(spark):
    points = clustered(2000, seed=9)
    df = spark.createDataFrame([(int(p), int(p)) for p in points.view(np.int64)], "fp long, rep long")
    rows = simhash.shards(df).toPandas()
    together = set()
    for _, g in rows.groupby(["band", "key"]):
        fp = np.sort(g["fp"].to_numpy()).view(np.uint64)
        p, q = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        together |= {(int(fp[a]), int(fp[b])) for a, b in zip(p, q) if fp[a] < fp[b]}
    p, q = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    assert together == {(int(points[a]), int(points[b])) for a, b in zip(p, q) if points[a] < points[b]}
    assert 5 * len(points) < len(rows) < 9 * len(points)


def test_rows_without_id_link_others(spark, monkeypatch):
    prints = {"a": 0, "b": 0b1111, "c": 0b11111111, "d": (1 << 62) - 1, "e": ((1 << 62) - 1) ^ 1}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: docs.select("doc_id", simhash.F.create_map(*[x for k, v in prints.items() for x in (simhash.F.lit(k), simhash.F.lit(v).cast("long"))])[docs.text].alias("fp")))
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "d"), (None, "e")], "doc_id long, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[(1, 0)] == got[(None, 0b1111)] == got[(2, 0b11111111)] == 1
    assert got[(None, prints["d"])] is None and got[(None, prints["e"])] is None
