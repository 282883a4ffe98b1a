"""Merkle fixity audit of two replicas of a record archive.

Each replica has a tree of its own. Leaves are record ids: a leaf's hash covers all records that carry the id,
by their number and the sums of all digits of their SHA-256 digests (in five pieces), so repeated ids need no
ordering and a hot id is pre-aggregated before the shuffle. Records lie in files of FILE_IDS consecutive ids, each in
the replica's own order; a record's offset is the sum of the bytes before it in its file.

Inner nodes are ordered offset ranges: that of FANOUT consecutive ids of a file, then the file, each hashed as the list
of its children's offsets (from the range's first byte), lengths and hashes in the order of their
offsets. So a changed, lost, added or moved record changes its range and what is above it; ranges behind it keep
their hashes, since they count offsets from their own first byte. Above the files nodes cover FANOUT children each, up to one root for each
replica. The roots are compared first, and a branch is descended only while the two replicas' hashes of it differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written

FAN_BITS = 6
FILE_LEVEL = 2  # a file holds 2 ** (FAN_BITS * FILE_LEVEL) ids
PIECES = 5  # of a digest, 13 hexadecimal digits each
_NODE = ("h", "g", "start", "length", "lo_id", "hi_id")


def _leaves(records: DataFrame, key: str, fields: list[str], order: str | None, none: int) -> DataFrame:
    """One row an id. Nulls hash unlike empty strings; records without an id form the leaf of id none."""
    body = F.concat_ws("\n", *(F.coalesce(F.concat(F.lit("+"), F.col(f"`{f}`").cast("string")), F.lit("-")) for f in fields))
    at = F.col(f"`{order or key}`").alias("at")
    each = records.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(none)).alias("id"), at, F.sha2(body, 256).alias("d"), F.octet_length(body).cast("long").alias("n"))
    sums = [F.sum(F.conv(F.substring("d", 13 * i + 1, 13), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(PIECES)]
    per_id = each.groupBy("id").agg(F.count("*").alias("c"), F.sum("n").alias("length"), F.min("at").alias("at"), *sums)
    in_file = Window.partitionBy(F.shiftright("id", FAN_BITS * FILE_LEVEL)).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = F.sha2(F.concat_ws(":", F.col("c").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(PIECES))), 256)
    own = F.when(F.col("id") != none, F.col("id"))
    return per_id.select(F.col("id").alias("node"), h.alias("h"), h.alias("g"), (F.sum("length").over(in_file) - F.col("length")).alias("start"), "length", own.alias("lo_id"), own.alias("hi_id"))


def _parents(nodes: DataFrame, parent: Column, in_file: bool) -> DataFrame:
    """The next level: h covers the children's offsets (above the files: their places), lengths and hashes; g only their hashes, by id."""
    group = nodes.withColumn("parent", parent).groupBy("parent").agg(
        F.collect_list(F.struct("start", "node", "length", "h")).alias("c"), F.collect_list(F.struct("node", "g")).alias("k"),
        F.min("start").alias("start"), F.sum("length").alias("length"), F.min("lo_id").alias("lo_id"), F.max("hi_id").alias("hi_id"),
    )
    if in_file:
        ordered, place = F.array_sort("c"), lambda x: x.start - F.col("start")
    else:
        ordered, place = F.array_sort(F.transform("c", lambda x: F.struct(x.node.alias("node"), x.length.alias("length"), x.h.alias("h")))), lambda x: x.node
    h = F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", place(x).cast("string"), x.length.cast("string"), x.h)), "|"), 256)
    g = F.sha2(F.array_join(F.transform(F.array_sort("k"), lambda x: x.g), ""), 256)
    start = F.col("start") if in_file else F.lit(None).cast("long").alias("start")
    return group.select(F.col("parent").alias("node"), h.alias("h"), g.alias("g"), start, "length", "lo_id", "hi_id")


def height(replicas: list[DataFrame], key: str) -> tuple[int, int]:
    """Levels over the leaves up to the root, and the id that stands for none."""
    ends = [r.agg(F.min(F.col(f"`{key}`").cast("long")), F.max(F.col(f"`{key}`").cast("long"))).first() for r in replicas]
    found = [x for e in ends for x in e if x is not None]
    least, most = min(found, default=0), max(found, default=0)
    none = most + 1 if most < 1 << 62 else least - 1
    bits = max(abs(x).bit_length() for x in (least, most, none))
    return max(FILE_LEVEL, -(-bits // FAN_BITS)) + 1, none


def build(replica: DataFrame, key: str, fields: list[str], levels: int, none: int, order: str | None = None) -> list[DataFrame]:
    """The tree's levels, leaves first, the root last: node, h, g, start, length, lo_id, hi_id. A node's children share all but the last FAN_BITS bits; the root's are what is left of either sign."""
    out = [written(_leaves(replica, key, fields, order, none), "fixity-0")]
    for level in range(1, levels + 1):
        parent = F.shiftright("node", FAN_BITS) if level < levels else F.lit(0).cast("long")
        out.append(written(_parents(out[-1], parent, level <= FILE_LEVEL), f"fixity-{level}"))
    return out


def audit(primary: DataFrame, replica: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """Every mismatching node, from the roots down to single ids: level (0: one id), node, lo_id, hi_id, start, length (offsets in the primary's file, in the
    replica's for what only that has; null above files), primary_hash, replica_hash, status (corrupt, missing or extra in the replica; moved: the same records at other offsets).

    order names the column that orders a file's records in both replicas (by default, the id; several records of one id lie together, at the first one's place).
    Equal replicas, or two empty ones, give no rows. Records without an id are one leaf, with null lo_id and hi_id.
    """
    levels, none = height([primary, replica], key)
    trees = [build(r, key, fields, levels, none, order) for r in (primary, replica)]

    def both(level: int) -> DataFrame:
        a, b = (t[level].select("node", *(F.col(c).alias(f"{c}_{tag}") for c in _NODE)) for t, tag in zip(trees, "ab"))
        return a.join(b, "node", "full_outer").where(~F.col("h_a").eqNullSafe(F.col("h_b"))).withColumn("level", F.lit(level))

    found = [written(both(levels), "fixity-differs")]
    for level in range(levels - 1, -1, -1):
        above = found[-1].select(F.col("node").alias("above"))
        parent = F.shiftright("node", FAN_BITS) if level + 1 < levels else F.lit(0).cast("long")
        # only children of nodes that differ are compared
        for t in trees:
            t[level] = t[level].withColumn("above", parent).join(above, "above", "left_semi").drop("above")
        found.append(written(both(level), "fixity-differs"))
    status = F.when(F.col("h_b").isNull(), "missing").when(F.col("h_a").isNull(), "extra").when(F.col("g_a") == F.col("g_b"), "moved").otherwise("corrupt")
    one = [F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("start", "length")]
    ids = [F.least("lo_id_a", "lo_id_b").alias("lo_id"), F.greatest("hi_id_a", "hi_id_b").alias("hi_id")]
    out = written(reduce(DataFrame.unionByName, found).select("level", "node", *ids, *one, F.col("h_a").alias("primary_hash"), F.col("h_b").alias("replica_hash"), status.alias("status")), "fixity-report")
    drop_written(*found, *(level for t in trees for level in t))
    return out


def rotten_replica(pages: DataFrame) -> DataFrame:
    """A second replica with planted faults, since the tables hold but one: every 101st page has one character changed, every 211th is lost, every 307th is there under a new id as well."""
    flipped = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(F.col("page_id") % 211 != 5, F.lit(True))).select("page_id", "url", flipped.alias("html"))
    extra = pages.where(F.col("page_id") % 307 == 3).select((F.col("page_id") + 10_000_000).alias("page_id"), "url", "html")
    return kept.unionByName(extra)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, rotten_replica(pages), "page_id", ["url", "html"])


def _oracle(levels: int = 5) -> str:
    """levels: as many as the added ids, of up to 24 bits, take."""
    pieces = ["CAST(sum(CAST(CAST('0x' || substr(d, {}, 13) AS BIGINT) AS HUGEINT)) AS VARCHAR)".format(13 * i + 1) for i in range(PIECES)]
    hashed = " || ':' || ".join(["CAST(count(*) AS VARCHAR)", *pieces])
    file = FAN_BITS * FILE_LEVEL
    sql = """WITH replica AS (
        SELECT page_id, url, CASE WHEN page_id % 101 = 7 THEN '?' || substr(html, 2) ELSE html END AS html FROM pages WHERE page_id % 211 <> 5
        UNION ALL SELECT page_id + 10000000, url, html FROM pages WHERE page_id % 307 = 3)"""
    for tag, src in (("a", "pages"), ("b", "replica")):
        sql += f""", {tag}x AS (SELECT id AS node, sha256({hashed}) AS h, CAST(sum(n) AS BIGINT) AS length FROM (
            SELECT page_id AS id, sha256(b) AS d, octet_length(encode(b)) AS n FROM (SELECT page_id, '+' || url || chr(10) || '+' || html AS b FROM {src})) GROUP BY id),
          {tag}0 AS (SELECT node, h, h AS g, CAST(sum(length) OVER (PARTITION BY node >> {file} ORDER BY node) - length AS BIGINT) AS start, length, node AS lo_id, node AS hi_id FROM {tag}x)"""
        for k in range(1, levels + 1):
            parent = f"node >> {FAN_BITS}" if k < levels else "0::BIGINT"
            place, by, start = ("start - least_start", "start, node", "min(start)") if k <= FILE_LEVEL else ("node", "node", "CAST(NULL AS BIGINT)")
            sql += f""", {tag}{k} AS (SELECT parent AS node, sha256(string_agg(CAST({place} AS VARCHAR) || ':' || CAST(length AS VARCHAR) || ':' || h, '|' ORDER BY {by})) AS h,
              sha256(string_agg(g, '' ORDER BY node)) AS g, {start} AS start, CAST(sum(length) AS BIGINT) AS length, min(lo_id) AS lo_id, max(hi_id) AS hi_id
              FROM (SELECT *, {parent} AS parent, min(start) OVER (PARTITION BY {parent}) AS least_start FROM {tag}{k - 1}) GROUP BY parent)"""
    every = " UNION ALL ".join(
        f"""SELECT {k} AS level, coalesce(a.node, b.node) AS node, least(a.lo_id, b.lo_id) AS lo_id, greatest(a.hi_id, b.hi_id) AS hi_id, coalesce(a.start, b.start) AS start,
        coalesce(a.length, b.length) AS length, a.h AS primary_hash, b.h AS replica_hash, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.g = b.g THEN 'moved' ELSE 'corrupt' END AS status
        FROM a{k} a FULL JOIN b{k} b ON a.node = b.node WHERE a.h IS DISTINCT FROM b.h""" for k in range(levels + 1)
    )
    return f"{sql} {every}"


QUERIES = {"op4_warc_fixity": op4_warc_fixity}
ORACLES = {"op4_warc_fixity": _oracle()}
