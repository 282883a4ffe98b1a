"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-case words (what spaces separate). Lines whose word sets have a Jaccard
similarity of 4/5 or more match; a line goes if any earlier line (by document id,
then line number; rows that share an id or have none by their keys, see common.keyed) matches it, whether that one stays or not. Lines without words
always stay.

* Words are ordered by rarity: by the lines of all documents that have them, counted in a fixed
  number of hash buckets so that what every task needs has a fixed size, then by
  hash. Any order gives the same result; a rarer-first one gives fewer candidates.
* Equal word sets are one class; its first line stands for it. Only classes are
  joined, so a line repeated a million times costs one row.
* Two matching classes share a word in their prefixes (the n - ceil(4n/5) + 1
  rarest of n words). The join on those words keeps pairs that pass the length and
  positional filters and the parity filter: each word flips one of 64 bits, so
  two sets' parities differ in no more bits than the sets in words. Lines of WIDE
  words or more carry 128 such bits, as 64 are soon even between long lines.
* Lines are dealt by word and size band, so a frequent word's lines meet only those of
  their size, and no filter sees what the length excludes anyway.
* First, a class that passes these filters against the first class of a word's
  group is paired with that one only. Of a thousand variants of a line, each is
  thus paired with the first, not with a thousand others. All classes for which
  no such pair is verified are then searched in full, against all.
* What is dealt by word is narrow (word, line, size and place, parity); the
  second half of long lines' parities is asked for by the pairs that are left.
* Candidates are verified on the words themselves.
* Tables are deleted as soon as nothing reads them any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, keyed, named, release_shuffles, table, written

BUCKETS, SLICES = 1 << 19, 128
NUM, DEN = 4, 5  # the least similarity, as a fraction
BROADCAST_PAIRS = 1_000_000  # candidate pairs up to so many (16 bytes each) are broadcast to the lines, more are joined by shuffles
WIDE = 64
BAND = 3.0  # lines are dealt by word and by size, in bands of this ratio
PLACES = 8  # ranks in a long
_HASH = (1 << 56) - 1
_DONE, _SHORT = 1 << 31, 1 << 30


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(line), " ")), "")


def _bits(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask))


def hashed(docs: DataFrame) -> DataFrame:
    """_row, line_no, hashes of each line with words: its distinct words, each split off and hashed once."""
    hashes = F.transform(F.split(F.lower("line"), " "), lambda w: F.xxhash64(w))
    return _each(docs).where(F.trim("line") != "").select("_row", "line_no", F.array_except(hashes, F.array(F.xxhash64(F.lit("")))).alias("hashes"))


def rarity(docs: DataFrame) -> str:
    """The logarithm of each hash bucket's count over all documents, as a list of BUCKETS numbers. A word counts once for each line. docs has texts, or is a table of hashed()."""
    each = docs if "hashes" in docs.columns else hashed(docs.select(F.lit(0).alias("_row"), "text"))
    counts = each.select(F.explode("hashes").alias("h")).groupBy(_bits(F.col("h"), BUCKETS - 1).cast("int").alias("b")).agg(F.count("*").alias("c"))
    # a bucket and its number in one integer, and few rows of many: the driver's Python never holds an object for each bucket
    each = counts.select("b", (F.col("b") * 128 + F.least(F.floor(3 * F.log2(F.col("c") + 1)), F.lit(126)).cast("int")).cast("string").alias("q"))
    ranks = bytearray(BUCKETS)
    for r in each.groupBy((F.col("b") % SLICES).alias("slice")).agg(F.array_join(F.collect_list("q"), ",").alias("q")).toLocalIterator():
        for q in map(int, r.q.split(",")):
            ranks[q >> 7] = q & 127
    names = [str(q) for q in range(128)]
    return ",".join(map(names.__getitem__, ranks))


def _packed_ranks(counts: str) -> str:
    """What rarity() returns as longs of PLACES bytes: bucket b is byte b // (BUCKETS // PLACES) of long b % (BUCKETS // PLACES)."""
    ranks = list(map(int, counts.split(",")))
    size = BUCKETS // PLACES
    return ",".join(str(int.from_bytes(bytes(ranks[b::size]), "little", signed=True)) for b in range(size))


def _each(docs: DataFrame) -> DataFrame:
    return docs.select("_row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def lines(docs: DataFrame, counts: str) -> DataFrame:
    """A row for each line with words, from docs with texts or a table of hashed(): _row, line_no, n, its class (h1, h2), parity, half, prefix. Words are known by hashes here, those of the prefix by 31 bits; a collision only makes a candidate."""
    # the folded literal is a constant of each task; Spark keeps one object for each small long, so a look-up touches the array only
    ranks = F.split(F.lit(counts), ",").cast("array<bigint>")

    def ordered(h: Column) -> Column:
        # never null, so that Spark sorts the keys as primitive longs
        rank = F.get(ranks, _bits(h, BUCKETS - 1).cast("int"))
        return F.coalesce(F.call_function("shiftleft", rank, F.lit(56)).bitwiseOR(_bits(h, _HASH)), F.lit(0).cast("long"))

    # what a lambda does for each word of all lines is interpreted by Spark, and so is what its array is made by: there is little of it, the rest is compiled
    each = docs if "hashes" in docs.columns else hashed(docs)

    def parity(bit) -> Column:
        # a shift takes the low six bits of its second number
        return F.aggregate("hashes", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", bit(h), F.hash(h))))

    half = F.when(F.size("hashes") >= WIDE, parity(lambda h: _bits(h, 1)))
    each = each.select("_row", "line_no", F.size("hashes").alias("n"), F.transform("hashes", ordered).alias("keys"), parity(lambda h: F.lit(1).cast("long")).alias("parity"), half.alias("half"))
    each = each.withColumn("keys", F.sort_array("keys"))
    return each.select(
        "_row", "line_no", "n", F.xxhash64("keys").alias("h1"), F.hash("keys").alias("h2"), "parity", "half",
        F.transform(F.slice("keys", F.lit(1), F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN} + 1")), lambda k: F.hash(k)).alias("prefix"),
    )


def _passes(a: str, b: str) -> str:
    """Parity, length and positional filter between the prefix entries a and b of one word, the one that excludes most first."""
    most = f"({a}n + {b}n) * {DEN - NUM}"  # over NUM + DEN: the words in which two matching sets differ at most
    wide = f"bit_count({a}half ^ {b}half) + bit_count({a}parity ^ {b}parity ^ {a}half ^ {b}half)"
    return (
        f"bit_count({a}parity ^ {b}parity) * {NUM + DEN} <= {most} AND {a}n * {DEN} >= {b}n * {NUM} AND {b}n * {DEN} >= {a}n * {NUM} "
        f"AND (1 + least({a}n - {a}i, {b}n - {b}i)) * {NUM + DEN} >= {NUM} * ({a}n + {b}n) AND coalesce(({wide}) * {NUM + DEN} <= {most}, true)"
    )


def packed(found: DataFrame) -> tuple[DataFrame, int]:
    """found with pos, a long that holds _row and, in so many low bits, line_no: it orders lines as the two do and names them."""
    longest, least, most = found.agg(F.max("line_no"), F.min("_row"), F.max("_row")).first()
    bits = max(1, (longest or 0).bit_length())
    if max(abs(least or 0), abs(most or 0)).bit_length() + bits > 62:
        raise OverflowError("rows times lines of the longest text go beyond 2**62")
    return found.withColumn("pos", F.shiftleft("_row", bits).bitwiseOR(F.col("line_no").cast("long"))), bits


def repeats(found: DataFrame) -> DataFrame:
    """h1, h2 and first (the first line's pos) of each word set that several lines have."""
    return found.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h1", "h2", "first")


def classes(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """A row for each word set: its first line's."""
    return found.join(repeated, ["h1", "h2"], "left").where("first IS NULL OR pos = first").select("pos", "n", "parity", "half", "prefix")


def _band(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(BAND)) + 1e-9).cast("long")


#: Two matching sets share one of the first so many words of the one that has no more words than the other.
_LEAST = f"n - (2 * {NUM} * n + {NUM + DEN - 1}) div {NUM + DEN} + 1"


def _entries(kinds: DataFrame) -> DataFrame:
    """A narrow row for each word of a prefix, by word and size band, dealt by both: at holds n, whether the class is done, whether the entry is
    short (one of the _LEAST first words, in the class's own band) and the word's place (from 1) in the prefix.

    kinds has the bands that a class is dealt to.
    """
    each = kinds.select("pos", "n", "parity", "half", "done", "prefix", _band(F.col("n")).alias("own"), F.explode("bands").alias("band"))
    each = each.select("pos", "n", "parity", "half", "done", "own", "band", F.posexplode("prefix").alias("i", "word"))
    marks = F.when(F.col("done"), F.lit(_DONE)).otherwise(F.lit(0)).bitwiseOR(F.when(F.expr(f"band = own AND i < {_LEAST}"), F.lit(_SHORT)).otherwise(F.lit(0)))
    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(marks.cast("long")).bitwiseOR(F.col("i") + F.lit(1).cast("long"))
    each = each.select(F.shiftleft(F.col("word").cast("long"), 8).bitwiseOR(F.col("band")).alias("key"), "pos", at.alias("at"), "parity", "half")
    # with these conditions on both sides of the join no more are inferred for one of them, and both read one exchange
    each = each.where("key IS NOT NULL AND pos IS NOT NULL AND CAST(shiftright(at, 32) AS INT) IS NOT NULL AND parity IS NOT NULL").repartition("key")
    at = F.col("at")
    return each.select("key", "pos", F.shiftright(at, 32).cast("int").alias("n"), _bits(at, _SHORT - 1).cast("int").alias("i"), (_bits(at, _DONE) != 0).alias("done"), (_bits(at, _SHORT) != 0).alias("short"), "parity", "half")


def leaders(kinds: DataFrame) -> DataFrame:
    """pos, other: each class with a word's first class, where that passes. A shortcut only: the words are those that two matching sets of one size share one of, the band is the class's own."""
    short = F.slice("prefix", F.lit(1), F.expr(_LEAST))
    entries = _entries(kinds.withColumn("prefix", short).withColumn("bands", F.array(_band(F.col("n")))).withColumn("done", F.lit(False)))
    # no order within a group: one sort column lets Spark sort by radix
    led = entries.withColumn("l", F.min(F.struct("pos", "n", "i", "parity", "half")).over(Window.partitionBy("key")))
    return led.where(f"l.pos < pos AND {_passes('l.', '')}").select("pos", F.col("l.pos").alias("other")).distinct()


def candidates(kinds: DataFrame, matched: DataFrame, few: bool = False) -> DataFrame:
    """pos, other: each class that is not among the matched ones with all earlier classes that pass. few: whether the matched ones are few.

    A line is in its own band and in the one below if a line that matches it may be there, so the length filter is part of the key. Of two
    that match, the one of fewer words (of as many, the earlier one) has a short entry for a word that both share, so only short entries are joined with all.
    """
    bands = F.sequence(_band(F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}")), _band(F.col("n")))
    known = kinds.join(matched.withColumn("done", F.lit(True)), "pos", "left")
    # the task's number keeps conditions above the exchange, so that all sides of the joins read the same one
    entries = _entries(known.withColumn("done", F.coalesce("done", F.lit(False))).withColumn("bands", bands)).withColumn("task", F.spark_partition_id())

    def met(a: DataFrame, b: DataFrame, later: str) -> DataFrame:
        # what excludes nearly all comes first
        both = b.alias("b").join(a.alias("a"), F.col("a.key") == F.col("b.key"))
        both = both.where(f"{_passes('a.', 'b.')} AND (a.n < b.n OR a.n = b.n AND a.pos < b.pos) AND {later}")
        return both.select(F.greatest("a.pos", "b.pos").alias("pos"), F.least("a.pos", "b.pos").alias("other"))

    # two classes that are both done never meet: thousands of variants of a line would be compared with each other
    done = entries.where("short AND done AND task >= 0")
    found = met(entries.where("short AND NOT done AND task >= 0"), entries, "(a.pos > b.pos OR NOT b.done)")
    return found.unionByName(met(done.hint("shuffle_hash") if few else done, entries.where("NOT done AND task >= 0"), "a.pos < b.pos")).distinct()


def _few(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST_PAIRS else rows


def _place(pos: str, bits: int) -> list[Column]:
    return [F.shiftright(pos, bits).alias("_row"), _bits(F.col(pos), (1 << bits) - 1).cast("int").alias("line_no")]


def _verified(pairs: DataFrame, bits: int, docs: DataFrame) -> DataFrame:
    """pos, other, same: whether the words of the two lines match. Only the lines named are split into words again, each once."""
    pairs = written(pairs, "line-dedup-pairs")
    release_shuffles(docs.sparkSession)
    wanted = pairs.select("pos").unionByName(pairs.select(F.col("other").alias("pos"))).distinct()
    owners = wanted.select("pos", *_place("pos", bits)).groupBy("_row").agg(F.collect_list(F.struct("line_no", "pos")).alias("l"))
    found = docs.join(_few(owners, 2 * pairs.count()), "_row").select("l", F.split("text", "\n").alias("t"))
    found = found.select(F.explode(F.transform("l", lambda x: F.struct(x.pos.alias("pos"), F.get("t", x.line_no).alias("line")))).alias("x"))
    text = written(found.select("x.pos", _words(F.col("x.line")).alias("words")), "line-dedup-words")
    # both with new names, so that both joins read one exchange
    both = pairs.join(text.toDF("pos1", "words1"), F.col("pos") == F.col("pos1")).join(text.toDF("pos2", "words2"), F.col("other") == F.col("pos2"))
    same = F.size(F.array_intersect("words1", "words2")) * (NUM + DEN) >= NUM * (F.size("words1") + F.size("words2"))
    checked = written(both.select("pos", "other", same.alias("same")), "line-dedup-checked")
    drop_written(pairs, text)
    release_shuffles(docs.sparkSession)
    return checked


def _gone(rows: DataFrame) -> DataFrame:
    """_row, line_no of every line that goes, from rows with _row (see common.keyed) and text."""
    docs = rows.select("_row", "text").where("text is not null")
    words = written(hashed(docs), "line-dedup-hashes")
    each = written(lines(words, rarity(words)), "line-dedup-lines")
    drop_written(words)
    found, bits = packed(each)
    repeated = written(repeats(found), "line-dedup-repeated")
    repeated = _few(repeated, repeated.count())
    kinds = classes(found, repeated)
    release_shuffles(rows.sparkSession)
    led = _verified(leaders(kinds), bits, docs)
    matched = written(led.where("same").select("pos").distinct(), "line-dedup-matched")
    # only what was paired with a word's first class and matches it has been searched in full
    count = matched.count()
    checked = _verified(candidates(kinds, _few(matched, count), count <= BROADCAST_PAIRS), bits, docs)
    firsts = matched.unionByName(checked.where("same").select("pos").distinct()).select(*_place("pos", bits))
    copies = found.join(repeated, ["h1", "h2"]).where("pos > first").select("_row", "line_no")
    gone = written(firsts.unionByName(copies), "line-dedup-gone")
    drop_written(each, repeated, led, matched, checked)
    return gone


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, line_no of every line that goes.

    Null and empty texts have no lines. Lines of rows without doc_id come first. Rows that share a doc_id (or have none) are rows of their
    own all the same: each one's lines are compared with the others', and named under that doc_id.
    """
    rows, by_id = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    gone = _gone(rows)
    if by_id:
        return gone.withColumnRenamed("_row", "doc_id")
    return gone.join(rows.select("_row", "doc_id"), "_row").select("doc_id", "line_no")


def deduplicated(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """docs with the lines that go taken out of text; all other columns stay. A text with no lines left is empty, a null one null.

    emptied=False leaves out the rows whose text is empty because of the lines taken out.
    """
    row, gone = named(docs, "_row", "_gone")
    rows, _ = keyed(docs, row)
    lost = _gone(rows.select(F.col(row).alias("_row"), "text")).groupBy(F.col("_row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cleaned = rows.join(lost, row, "left").withColumn("text", text)
    if not emptied:
        cleaned = cleaned.where(f"{gone} IS NULL OR text <> ''")
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH each AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
sets AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split(lower(line), ' '), lambda w: w <> ''))) AS s FROM each),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS pos FROM sets WHERE len(s) > 0),
classes AS (SELECT s, min(pos) AS pos, len(s) AS n FROM ranked GROUP BY s),
near AS (SELECT DISTINCT b.pos FROM classes b JOIN classes a ON a.pos < b.pos AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
         WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n))
SELECT r.doc_id, CAST(r.line_no AS INTEGER) AS line_no FROM ranked r JOIN classes c ON r.s = c.s WHERE r.pos > c.pos OR r.pos IN (SELECT pos FROM near)
"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {"op8_line_dedup": ORACLE}
