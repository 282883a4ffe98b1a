"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

Unit vectors are hashed in TABLES tables by Gaussian projections cut
into cells of one width (for unit vectors the Euclidean order is the cosine order); the number of
projections grows with the logarithm of the rows, so buckets stay small. A
query visits its own bucket and those reached by moving single projections one
cell, in the order of their estimated success: the least sum of squared distances
to the cells' borders first, up to a sum that is the same for all queries. That and the width are fitted on SAMPLE_QUERIES
vectors and their true neighbours in the whole table (one pass without a shuffle), so that TARGET of these are reached; every vector is indexed.

Equal vectors are one class with its smallest K + 1 ids, all that can ever be
among K nearest, so a vector repeated a million times is one row of a bucket.
The first projections of a table name a group of neighbouring buckets, so many of them that a group holds about BLOCK classes (a
larger group is cut into several pieces). Probes are made for these projections only: their sum is a part of
each bucket's, so no bucket to visit lies in a group that they leave out. A query goes to such a group once; there
the buckets that exist are compared with the sum, and the query with the vectors of those within it. Buckets that
hold nothing are never named. A query that finds fewer than K + 1 rows is run against all vectors of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K = 5
TABLES = 4
HASHES_PER_BIT = 0.5  # projections of a table for each binary digit of the number of rows
SAMPLE_QUERIES, TARGET = 300, 0.94  # vectors whose neighbours among all are sought to fit by
BLOCK = 2048
MERGE = 100_000
QUERIES_AT_ONCE = 64  # whose buckets are told in one step


def probes(place: np.ndarray, most: float) -> np.ndarray:
    """Perturbations (rows of -1, 0, 1) in the order of their estimated success, the query's own cell first: those whose squared distances to borders add up to most or less. place is the position within the cell, 0 to 1."""
    k = len(place)
    if not k:
        return np.zeros((1, 0), np.int64)
    gap = np.concatenate([place, 1 - place]) ** 2
    order = np.argsort(gap, kind="stable")
    z, dim, step = gap[order].tolist(), (order % k).tolist(), np.where(order < k, -1, 1).tolist()
    moves, heap = [()], [(z[0], (0,))]
    while heap and heap[0][0] <= most:
        score, chosen = heapq.heappop(heap)
        if len({dim[i] for i in chosen}) == len(chosen):
            moves.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + z[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(moves), k), np.int64)
    for row, chosen in enumerate(moves):
        for i in chosen:
            out[row, dim[i]] = step[i]
    return out


def _steps(inside: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The squared distance to the border that a move of one cell crosses; moves of more than one are not made."""
    return np.where(np.abs(move) <= 1, np.where(move < 0, inside, 1 - inside) ** 2 * (move != 0), np.inf)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Hasher:
    def __init__(self, dims: int, width: float, hashes: int, tables: int = TABLES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.axes = rng.normal(size=(tables, dims, hashes)) / width
        self.shift = rng.random((tables, hashes))
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1
        self.most = 1.0
        self.lead = 0  # projections that name a group

    def places(self, unit: np.ndarray, part: int) -> np.ndarray:
        return unit @ self.axes[part] + self.shift[part]

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One long for each row of cells; sums wrap. Two cells that meet in one long only share a bucket."""
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mix).sum(axis=-1)

    def group(self, cells: np.ndarray) -> np.ndarray:
        """The same for the projections that name a group."""
        with np.errstate(over="ignore"):
            return (cells[..., : self.lead].astype(np.int64) * self.mix[: self.lead]).sum(axis=-1)

    def visits(self, place: np.ndarray) -> np.ndarray:
        """The groups that may hold a bucket to visit."""
        place = place[: self.lead]
        cell = np.floor(place)
        return np.unique(self.group(cell.astype(np.int64) + probes(place - cell, self.most + 1e-9)))


def fitted(queries: np.ndarray, near: np.ndarray, rows: int) -> Hasher:
    """Cell width from the neighbours' distances, and the least sum of squared distances up to which probes reach TARGET of them. near[i] is a neighbour of queries[i]."""
    hashes = max(4, round(HASHES_PER_BIT * np.log2(max(2, rows))))
    if not len(near):
        return Hasher(queries.shape[1], 1.0, hashes)
    x, y = _unit(queries), _unit(near)
    gap = float(np.median(np.linalg.norm(x - y, axis=1)))
    hasher = Hasher(x.shape[1], 1.4 * max(gap, 1e-3), hashes)
    cost = np.full(len(x), np.inf)  # the least sum at which a table's probes reach each neighbour
    shares = []  # of a cell that a vector is in, on average
    for part in range(TABLES):
        place = hasher.places(x, part)
        cell = np.floor(place)
        cost = np.minimum(cost, _steps(place - cell, np.floor(hasher.places(y, part)) - cell).sum(axis=1))
        shares += [((np.unique(c, return_counts=True)[1] / len(c)) ** 2).sum() for c in cell.T]
    finite = cost[np.isfinite(cost)]
    hasher.most = float(min(np.quantile(cost, TARGET, method="higher"), finite.max(initial=0))) + 1e-9
    share = min(float(np.mean(shares)), 0.9)
    hasher.lead = min(hashes, max(0, int(np.log(rows / BLOCK) / -np.log(share))))
    return hasher


def sampled(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLE_QUERIES vectors, the first by a hash of their class, each as often as it has neighbours among the K nearest of all classes, and these neighbours."""
    some = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_QUERIES).select("cid", "v").toPandas()
    own, queries = some["cid"].to_numpy(), np.array(some["v"].tolist(), dtype=np.float64)
    shared = classes.sparkSession.sparkContext.broadcast((own, _unit(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        best: tuple = (np.zeros(0, np.int64), np.zeros(0), [])
        for b in batches:
            if not b.num_rows:
                continue
            cid, matrix = b.column("cid").to_numpy(), _matrix(b.column("v"))
            score = unit @ _unit(matrix).T
            score[cid[None, :] == ids[:, None]] = -2
            k = min(K, len(cid))
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            q = np.concatenate([best[0], np.repeat(np.arange(len(ids)), k)])
            s = np.concatenate([best[1], np.take_along_axis(score, top, 1).ravel()])
            v = [*best[2], *matrix[top.ravel()]]
            order = np.lexsort((-s, q))
            start = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1]))
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            order = order[rank < K]
            best = (q[order], s[order], [v[i] for i in order])
        if len(best[0]):
            yield pa.record_batch([pa.array(best[0]), pa.array(best[1]), pa.array([x.tolist() for x in best[2]], pa.list_(pa.float64()))], ["q", "s", "v"])

    found = classes.select("cid", "v").mapInArrow(run, "q long, s double, v array<double>").where("s > -2")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    near = found.withColumn("place", place).where(F.col("place") <= K).select("q", "v").toPandas()
    return queries[near["q"].to_numpy()] if len(near) else queries, np.array(near["v"].tolist(), dtype=np.float64)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _hashed(classes: DataFrame, hasher: Hasher, queries: bool) -> DataFrame:
    """part, grp, cid: a row for each table, with the bucket's cells (queries: for each group that may hold a bucket to visit)."""
    shared = classes.sparkSession.sparkContext.broadcast(hasher)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_matrix(b.column("v")))
            for part in range(len(h.axes)):
                places = h.places(unit, part)
                if queries:
                    each = [h.visits(p) for p in places]
                    owner, grp = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each)
                else:
                    cells = np.floor(places).astype(np.int32)
                    owner, grp = np.arange(len(places)), h.group(cells)
                columns = [pa.array(np.full(len(owner), part, np.int32)), pa.array(grp), b.column("cid").take(pa.array(owner))]
                if queries:
                    yield pa.record_batch(columns, ["part", "grp", "cid"])
                else:
                    ends = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
                    yield pa.record_batch([*columns, pa.ListArray.from_arrays(ends, pa.array(cells.ravel()))], ["part", "grp", "cid", "cell"])

    return classes.select("cid", "v").mapInArrow(run, "part int, grp long, cid long" + ("" if queries else ", cell array<int>"))


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best distinct classes, ties to the smaller."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    once = np.lexsort((np.arange(len(q)), c, q))
    first = np.append(True, (q[once][1:] != q[once][:-1]) | (c[once][1:] != c[once][:-1]))
    keep = np.sort(once[first])
    q, c, s = q[keep], c[keep], s[keep]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return q[rank < k], c[rank < k], s[rank < k]


def _exact(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines, each worked out in one fixed order of its own, so equal directions give equal numbers wherever they are met."""
    return (matrix * v).sum(axis=1) / (np.sqrt((matrix * matrix).sum(axis=1)) * np.sqrt((v * v).sum()))


class _Group:
    """The vectors of a group, by bucket."""

    def __init__(self, ids: list[np.ndarray], cells: list[np.ndarray], vectors: list[np.ndarray]):
        names, bucket = np.unique(np.concatenate(cells), axis=0, return_inverse=True)
        bucket = bucket.ravel()
        order = np.argsort(bucket, kind="stable")
        self.ids, self.matrix = np.concatenate(ids)[order], np.concatenate(vectors)[order]
        self.unit, self.sizes = _unit(self.matrix), np.bincount(bucket)
        self.cells = [np.unique(c, return_inverse=True) for c in names.T]

    def visited(self, places: np.ndarray, most: float) -> np.ndarray:
        """For each query and bucket, whether a probe of it is within the sum."""
        cost = np.zeros((len(places), len(self.sizes)))
        for place, (cell, at) in zip(places.T, self.cells):
            own = np.floor(place)
            cost += _steps((place - own)[:, None], cell[None, :] - own[:, None])[:, at]
        return cost <= most

    def best(self, v: np.ndarray, visited: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the K + 1 nearest in the buckets visited (None: in all), and of all that may tie with the last."""
        rows = np.arange(len(self.ids)) if visited is None else np.flatnonzero(np.repeat(visited, self.sizes))
        if len(rows) > K + 1:
            score = self.unit[rows] @ (v / np.linalg.norm(v))
            rows = rows[score >= np.partition(score, len(rows) - K - 1)[len(rows) - K - 1] - 1e-9]
        return self.ids[rows], _exact(self.matrix[rows], v)


def _search(hasher):
    """A map over rows sorted by part, group and piece, queries last: a piece's vectors are held, queries stream past. hasher is broadcast; in parts below 0 all vectors are visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, cells, vectors, group = None, [], [], [], None
        held, size = [], 0

        def merged():
            return _best(*(np.concatenate(x) for x in zip(*held)), K + 1)

        def batch(q, c, s):
            return pa.record_batch([pa.array(q), pa.array(c), pa.array(s)], ["qid", "cid", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            part, grp, piece, query, cid = (b.column(n).to_numpy(zero_copy_only=False) for n in ("part", "grp", "piece", "query", "cid"))
            v, cell = b.column("v"), b.column("cell")
            new = (part[1:] != part[:-1]) | (grp[1:] != grp[:-1]) | (piece[1:] != piece[:-1]) | (query[1:] != query[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(part)]
            for i, j in zip(cuts, cuts[1:]):
                name = (part[i], grp[i], piece[i])
                if name != current:
                    current, ids, cells, vectors, group = name, [], [], [], None
                matrix = _matrix(v.slice(i, j - i))
                if not query[i]:
                    ids.append(cid[i:j])
                    cells.append(_matrix(cell.slice(i, j - i)))
                    vectors.append(matrix)
                    continue
                if not ids:
                    continue
                group = group or _Group(ids, cells, vectors)
                for k in range(i, j, QUERIES_AT_ONCE):
                    some = matrix[k - i : k - i + QUERIES_AT_ONCE]
                    visited = [None] * len(some) if part[i] < 0 else group.visited(hasher.value.places(_unit(some), part[i]), hasher.value.most)
                    for own, x, seen in zip(cid[k:].tolist(), some, visited):
                        found, score = group.best(x, seen)
                        held.append((np.full(len(found), own), found, score))
                        size += len(found)
                        if size > MERGE:
                            held = [merged()]
                            size = len(held[0][0])
                            if size > MERGE // 2:  # many queries: what is merged goes out, so memory stays bounded
                                yield batch(*held[0])
                                held, size = [], 0
        if held:
            yield batch(*merged())

    return run


def _run(data: DataFrame, queries: DataFrame, hasher) -> DataFrame:
    """part, grp, piece, cid, v of both; data has its cells too."""
    both = data.withColumn("query", F.lit(False)).unionByName(queries.withColumn("cell", F.lit(None).cast("array<int>")).withColumn("query", F.lit(True)))
    dealt = both.select("part", "grp", "piece", "query", "cid", "cell", "v").repartition("part", "grp", "piece").sortWithinPartitions("part", "grp", "piece", "query")
    return dealt.mapInArrow(_search(hasher), "qid long, cid long, score double")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: rows with an id and a vector with no null or non-finite component and not all zeros; floats stay floats until they are compared, in double precision."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return vectors.where("vec_id is not null and embedding is not null").where(good).select(F.col("vec_id").cast("long"), v.alias("v"))


def nearest(vectors: DataFrame, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest rows by cosine of each row whose vec_id is divisible by every, ties to the smaller id.

    Unusable vectors take no part (see usable); no usable vector gives no rows; repeated ids are separate rows with equal vectors.
    A cosine is between vectors of one length: those of the commonest length are hashed, any others compared with all of their own length.
    """
    rows = usable(vectors)
    # the smallest ids of equal vectors; the limit is applied before the shuffle too
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = written(rows.withColumn("place", place).where(F.col("place") <= K + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "ids", "v"), "ann-classes")
    # of an id that several rows share, each row's own vector: classes are told apart by a number of their own
    if not _distinct(classes):
        classes = written(classes.orderBy("cid").withColumn("cid", F.monotonically_increasing_id()), "ann-numbered")
    asked = written(rows.where(F.col("vec_id") % every == 0).join(classes.select("v", "cid"), "v").select("vec_id", "cid"), "ann-queries")
    lengths = classes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = classes.where(F.size("v") == lengths.n)
    hasher = fitted(*sampled(common), lengths.c)
    hashed = written(_hashed(common, hasher, False), "ann-buckets")
    # all groups with their number of pieces; a probe of an empty group ends here
    sizes = hashed.groupBy("part", "grp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("pieces"))
    dealt = hashed.join(sizes, ["part", "grp"]).withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    data = dealt.select("part", "grp", "piece", "cid", "cell").join(common.select("cid", "v"), "cid")
    wanted = common.join(asked.select("cid").distinct(), "cid").select("cid", "v")
    sent = _hashed(wanted, hasher, True).join(sizes, ["part", "grp"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    sent = sent.select("part", "grp", "piece", "cid").join(wanted, "cid")
    shared = rows.sparkSession.sparkContext.broadcast(hasher)
    found = written(_ranked(_run(data, sent, shared), classes), "ann-found")
    short = asked.select("cid").distinct().join(found.groupBy("qid").agg(F.count("*").alias("c")).where(F.col("c") > K), F.col("cid") == F.col("qid"), "left_anti")
    short = written(classes.join(short, "cid").select("cid", "v"), "ann-short")
    if not short.isEmpty():
        blocks = -(-classes.count() // BLOCK)
        part, grp = (-F.size("v")).alias("part"), F.lit(0).cast("long").alias("grp")
        whole = classes.select(part, grp, F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("piece"), "cid", F.array(F.lit(0)).alias("cell"), "v")
        ask = short.select(part, grp, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("piece"), "cid", "v")
        found = found.join(short.select(F.col("cid").alias("qid")), "qid", "left_anti").unionByName(_ranked(_run(whole, ask, shared), classes))
    # a query row leaves out itself: once, should its id be repeated
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid"), F.monotonically_increasing_id().alias("row")).join(found, "qid")
    own = F.row_number().over(Window.partitionBy("row", "vec_id").orderBy(F.desc("score")))
    others = pairs.withColumn("copy", own).where(~((F.col("vec_id") == F.col("query_id")) & (F.col("copy") == 1)))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def _distinct(classes: DataFrame) -> bool:
    rows, ids = classes.agg(F.count("*"), F.count_distinct("cid")).first()
    return rows == ids


def _ranked(found: DataFrame, classes: DataFrame) -> DataFrame:
    """qid, vec_id, score: each query class's K + 1 best rows."""
    once = found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))
    once = once.withColumn("place", best).where(F.col("place") <= K + 1).drop("place")
    rows = once.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= K + 1).select("qid", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_nearest_neighbours": op7_nearest_neighbours}
