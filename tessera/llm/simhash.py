"""Near-duplicate texts by SimHash fingerprints and vantage-point trees: all pairs within RADIUS bits, as components.

The bits are cut into blocks. Two fingerprints at most RADIUS bits apart agree on all
but RADIUS of the blocks (pigeonhole), so they lie at distance zero in one of the
projections to the other blocks; no pair is lost. In each projection the fingerprints are
partitioned by Hamming distance:

* Each projection has a vantage point that all tasks share. Fingerprints that agree in
  the projection are cut into shells of SHELL bits of distance to it; by the triangle
  inequality two within RADIUS differ in that distance by RADIUS at most. So a shard is
  one shell together with the rows of the next shell that lie within RADIUS of the
  border: pairs across a border are found in the shard that overlaps it.
* Within a shard a vantage-point tree finds the exact pairs: points split at the median
  distance to a vantage point, down to LEAF points, and a pair across a split is looked
  for only among points within RADIUS of the border; other branches are pruned.

Why not trees alone: random 64-bit fingerprints lie 32 +- 4 bits from any vantage
point, so at radius 4 a tree over all of them sends most fingerprints down both
branches; ten levels copy the table about a hundredfold. The projections are what
makes shards small, the shells halve them again for half of the rows copied.

A shard that outgrows SHARD_ROWS is cut in turn by distance to a vantage point of its own,
one bit a shell; two shells are searched together only if their distances differ by
RADIUS at most, and shells too large for a task are cut into blocks searched pair
by pair. So every task holds at most SHARD_ROWS fingerprints, whatever the data.

Equal fingerprints are one point. What leaves a task is a star for each group it
has found, not its pairs; stars are joined to components by alternating large-star
and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

WORDS = 4
RADIUS = 4
SHARD_ROWS = 8192
SHARD_MEAN = 1024  # more blocks are taken when shards would be larger than this on average
SHELL = 8  # bits of distance to the shared vantage point; more than RADIUS
LEAF = 16
_EDGES = "kind int, band int, key long, fp long, a long, b long"


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash over XXH64 of word shingles, A-Z in lower case; a bit is set where over half of the shingles set it. No words: zero."""
    import xxhash

    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist())], dtype=">u8")
    bytes_ = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(bytes_), 1 << 16):
        votes += np.unpackbits(bytes_[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)


def tree_pairs(points: np.ndarray, radius: int = RADIUS, nodes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct 64-bit points at most radius apart: a vantage-point tree joined with itself, each pair once. nodes is given a row for each split: its depth, points, and points compared across the border."""
    left, right = [], []

    def cross(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), LEAF):
            p, q = _near(points[i[k : k + LEAF]], points[j], radius)
            left.append(i[k + p])
            right.append(j[q])

    work = [(np.arange(len(points)), 0)]
    while work:
        i, depth = work.pop()
        if len(i) <= LEAF:
            p, q = _near(points[i], points[i], radius)
            left.append(i[p[p < q]])
            right.append(i[q[p < q]])
            continue
        d = np.bitwise_count(points[i] ^ points[i[0]]).astype(np.int64)
        mid = int(np.median(d))
        inner = d <= mid
        if inner.all():
            mid -= 1
            inner = d <= mid
        if not inner.any():  # all equally far from the vantage point: no bound prunes here, so halves are compared
            half = len(i) // 2
            cross(i[:half], i[half:])
            work += [(i[:half], depth + 1), (i[half:], depth + 1)]
            continue
        near, far = i[inner & (d > mid - radius)], i[~inner & (d <= mid + radius)]
        if nodes is not None:
            nodes.append((depth, len(i), len(near) + len(far)))
        cross(near, far)
        work += [(i[inner], depth + 1), (i[~inner], depth + 1)]
    return np.concatenate(left), np.concatenate(right)


def _stars(points: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest id of its group) for the members of all groups of linked points but those smallest ones."""
    i, j = tree_pairs(points, radius)
    if not len(i):
        return ids[:0], ids[:0]
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    i, j, label = rank[i], rank[j], np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[order[moved]], ids[order[label[moved]]]


def _search(radius: int, limit: int):
    """A map over rows sorted by (band, key): kind 0 rows are star edges a > b; kind 1 rows are those of shards over the limit, passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, band, key, fp, a, b):
            n = max(len(fp), len(a))
            cols = [np.full(n, kind, np.int32), np.broadcast_to(np.int32(band), n), np.broadcast_to(np.int64(key), n)] + [v if len(v) else np.zeros(n, np.int64) for v in (fp, a, b)]
            return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], ["kind", "band", "key", "fp", "a", "b"])

        none = np.zeros(0, np.int64)
        current, held, spilling = None, [], False
        found_a, found_b, waiting = [], [], 0

        def close():
            nonlocal held
            if held and not spilling:
                fp, ids = (np.concatenate(c) for c in zip(*held))
                if len(fp) > 1:
                    a, b = _stars(fp.view(np.uint64), ids, radius)
                    found_a.append(a)
                    found_b.append(b)
            held = []

        for batch in batches:
            band, key, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "fp", "rep"))
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (key[1:] != key[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                if e == s:
                    continue
                if current != (band[s], key[s]):
                    close()
                    current, spilling = (band[s], key[s]), False
                held.append((fp[s:e], rep[s:e]))
                if spilling or sum(len(h[0]) for h in held) > limit:
                    spilling = True
                    for x, y in held:
                        yield out(1, *current, x, y, none)
                    held = []
            waiting = sum(map(len, found_a))
            if waiting > 10_000:
                yield out(0, 0, 0, none, np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [], []
        close()
        if found_a:
            yield out(0, 0, 0, none, np.concatenate(found_a), np.concatenate(found_b))

    return run


def projections(points: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits kept by each projection: all but radius of the blocks, with enough blocks for shards of SHARD_MEAN points."""
    blocks = radius + 1
    while blocks < 9 and points >> (64 * (blocks - radius) // blocks) > SHARD_MEAN:
        blocks += 1
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (e - s)) - 1) << s for s, e in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "key").sortWithinPartitions("band", "key")


def vantage_points(masks: list[int], seed: int = 17) -> list[int]:
    """One for each projection, the same for every task: random in the bits that the projection leaves out, zero elsewhere."""
    rng = np.random.default_rng(seed)
    return [int(rng.integers(0, 1 << 64, dtype=np.uint64)) & ~m & ((1 << 64) - 1) for m in masks]


def shards(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """band, key, fp, rep: a row for each projection and shell, and one more where the fingerprint lies within radius of the lower border of its shell."""
    masks = projections(points.count(), radius)
    width = max(SHELL, radius + 1)
    plan = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(v)).alias("vantage")) for m, v in zip(masks, vantage_points(masks))))
    each = points.select("fp", "rep", F.posexplode(plan).alias("band", "p"))
    distance = F.bit_count(F.col("fp").bitwiseAND(F.bitwise_not("p.mask")).bitwiseXOR(F.col("p.vantage")))
    each = each.select("band", F.col("fp").bitwiseAND(F.col("p.mask")).alias("kept"), "fp", "rep", distance.alias("d"))
    shell = F.floor(F.col("d") / width).cast("int")
    own_and_below = F.when((F.col("d") % width < radius) & (F.col("d") >= width), F.array(shell, shell - 1)).otherwise(F.array(shell))
    # a key names a projected ball and a shell; should two meet in one long, they only share a shard
    return each.select("band", "kept", "fp", "rep", F.explode(own_and_below).alias("shell")).select("band", F.xxhash64("kept", "shell").alias("key"), "fp", "rep")


def links(points: DataFrame, radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """Star edges a > b between the reps of linked points (fp distinct long, rep long), enough to join all that are linked."""
    found = written(_in_order(shards(points, radius)).mapInArrow(_search(radius, limit), _EDGES), "simhash-search")
    edges = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select("band", "key", "fp", F.col("a").alias("rep"))
    if large.isEmpty():
        return edges
    return edges.unionByName(_shells(large, radius, limit))


def _shells(large: DataFrame, radius: int, limit: int) -> DataFrame:
    """The exact way for shards over the limit. Blocks hold half the limit on average at most, a pair of blocks makes one task's group."""
    shard = ["band", "key"]
    vantage = large.groupBy(*shard).agg(F.min("fp").alias("vantage"))
    shelled = large.join(vantage, shard).withColumn("shell", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
    sizes = shelled.groupBy(*shard, "shell").agg(F.ceil(F.count("*") / F.lit(limit / 4)).cast("int").alias("cuts"))
    rows = shelled.join(sizes, [*shard, "shell"]).select(*shard, "fp", "rep", "shell", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut"))
    blocks = sizes.select(*shard, "shell", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = blocks.select(*shard, F.col("shell").alias("shell2"), F.col("cut").alias("cut2"))
    # triangle bound: shells further apart than the radius hold no pair
    pairs = blocks.join(other, shard).where(F.col("shell2").between(F.col("shell"), F.col("shell") + radius) & (F.struct("shell", "cut") <= F.struct("shell2", "cut2")))
    pairs = pairs.withColumn("pair", F.xxhash64(*shard, "shell", "cut", "shell2", "cut2"))
    sides = pairs.select(*shard, "shell", "cut", "pair").unionByName(pairs.where("shell <> shell2 or cut <> cut2").select(*shard, F.col("shell2").alias("shell"), F.col("cut2").alias("cut"), "pair"))
    grouped = rows.join(sides, [*shard, "shell", "cut"]).select(F.col("band"), F.col("pair").alias("key"), "fp", "rep")
    return _in_order(grouped).mapInArrow(_search(radius, 1 << 40), _EDGES).where("kind = 0").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with an edge a > b, by alternating large-star and small-star rounds."""
    now, before = written(edges.where("a <> b").distinct(), "components"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = now.join(least, now.b == least.u).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(small, large.a == small.u).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = written(moved.unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "components")
        drop_written(now)
        now = new
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, limit: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp, component_id of every row. Texts with no words share fingerprint zero; repeated rows stay repeated.

    Fingerprints are linked whether or not a row that holds them has a doc_id, so a row without one joins others; component_id
    is the smallest doc_id reachable, null only where no row of the component has any.
    """
    prints = written(fingerprints(docs, words), "simhash-prints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    joined = components(links(points.select("fp", F.col("fp").alias("rep")), radius, limit))
    placed = points.join(joined, points.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("fp", "component").join(names, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
