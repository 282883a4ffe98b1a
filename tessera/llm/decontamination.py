"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

The test items are the indexed documents, a training passage is the query: the
set of its words. Passages are windows of the text's words, overlapping by half; each
item is looked for in windows of the least power of two that is twice its own length or more (64
at least), so every run of its length lies within one, and no other item changes what is found.
A passage's score for an item is its BM25 sum as a share of the item's own
(what a passage with all of its words would get); all items with THRESHOLD or more are
retrieved, exactly. Document frequencies and the mean length are those of all items.

Postings carry the largest share of each word and, for blocks of BLOCK items, of each word in
the block. A window is searched by block-max WAND: cursors stand in its words' lists, sorted by
item; the pivot is the first item at which the lists' bounds add up to the threshold; where the block maxima
cannot reach it, all cursors skip to the next block that can, else those before the pivot move up to it, and it is
scored once they meet there. A run of windows is asked as one larger query first: its words hold those of
every window in it, so if no item reaches the threshold none of its windows can.

A hit counts if the passage has OVERLAP or more of the five-word shingles of the item's
question (all but its last sentence) and answer (the last one) together, and OVERLAP
or more of the words of each. A part of fewer than five words is one shorter shingle.

An index holds INDEX_ITEMS items and INDEX_CHARS characters on average at most and is broadcast; more items make more
indexes over the same statistics, each with its own pass.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 16
INDEX_ITEMS, INDEX_CHARS = 20_000, 20_000_000
LEAST_WINDOW = 64
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SCHEMA = "doc_id long, item_id long, passages int, first_word int, score double, overlap double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """All five-word shingles; of fewer words the one whole sequence."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    """All runs of n neighbouring words."""
    return set(zip(*(words[i:] for i in range(n))))


class Part:
    """An item's question or answer: its words and its shingles, all of one length."""

    def __init__(self, words: list[str]):
        self.words, self.shingles = set(words), shingles(words)
        self.length = min(SHINGLE, len(words))


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; one sentence is both."""
    parts = [w for w in map(words_of, _SENTENCE.split(text.strip())) if w]
    if len(parts) < 2:
        return (parts[0], parts[0]) if parts else ([], [])
    return [w for p in parts[:-1] for w in p], parts[-1]


class Postings:
    """Postings by word (item, share of the item's own score), sorted by item, with the maxima of words and of their blocks."""

    def __init__(self, found: list[tuple[int, int, float]], words: int, items: int):
        found = sorted(found)
        word, self.item, self.share = (np.array(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.items = items
        self.start = np.searchsorted(word, np.arange(words + 1))
        self.bound = np.zeros(words)
        np.maximum.at(self.bound, word, self.share)
        key = word * (items // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if found else np.zeros(0, int)
        self.block, self.block_max = self.item[first] // BLOCK, np.maximum.reduceat(self.share, first) if found else np.zeros(0)
        self.block_start = np.searchsorted(word[first], np.arange(words + 1))
        self.blocks = items // BLOCK + 1
        self.item_list, self.share_list = self.item.tolist(), self.share.tolist()

    def _open(self, words: np.ndarray, threshold: float) -> np.ndarray:
        """Which blocks' maxima of these words add up to the threshold."""
        at, _ = _ranges(self.block_start, words)
        return np.bincount(self.block[at], weights=self.block_max[at], minlength=self.blocks) >= threshold - 1e-9

    def reached(self, words: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
        """Items that reach the threshold for these distinct words, all at once: what prunes a run of windows."""
        none = np.zeros(0, int)
        if self.bound[words].sum() < threshold - 1e-9:
            return none
        opened = self._open(words, threshold)
        if not opened.any():
            return none
        at, _ = _ranges(self.start, words)
        at = at[opened[self.item[at] // BLOCK]]
        return np.flatnonzero(np.bincount(self.item[at], weights=self.share[at], minlength=self.items) >= threshold - 1e-9)

    def search(self, words: np.ndarray, threshold: float = THRESHOLD, trace: list | None = None) -> list[tuple[int, float]]:
        """(item, share) of the items that reach the threshold for these distinct words, by block-max WAND. trace is given each item scored."""
        least = threshold - 1e-9
        opened = np.flatnonzero(self._open(words, threshold)).tolist()
        item, share = self.item_list, self.share_list
        at, end, bound = [], [], []
        for s, e, b in zip(self.start[words].tolist(), self.start[words + 1].tolist(), self.bound[words].tolist()):
            if s < e:
                at.append(s)
                end.append(e)
                bound.append(b)
        here = [item[s] for s in at]  # where the cursors stand
        live, out = list(range(len(at))), []

        def move(lists: list[int], target: int) -> None:
            nonlocal live
            over = False
            for x in lists:
                p = at[x] = bisect_left(item, target, at[x], end[x])
                if p < end[x]:
                    here[x] = item[p]
                else:
                    here[x], over = self.items, True
            if over:
                live = [x for x in live if here[x] < self.items]

        while live and opened:
            live.sort(key=here.__getitem__)
            total, pivot = 0.0, None
            for x in live:
                total += bound[x]
                if total >= least:
                    pivot = here[x]
                    break
            if pivot is None:
                break
            block = pivot // BLOCK
            k = bisect_left(opened, block)
            if k == len(opened):
                break
            if opened[k] > block:
                pivot = opened[k] * BLOCK
                move([x for x in live if here[x] < pivot], pivot)
            elif here[live[0]] == pivot:
                met = [x for x in live if here[x] == pivot]
                score = sum(share[at[x]] for x in met)
                if trace is not None:
                    trace.append(pivot)
                if score >= least:
                    out.append((pivot, score))
                move(met, pivot + 1)
            else:
                move([x for x in live if here[x] < pivot], pivot)
        return out


class Index:
    """The items' parts and postings: of all items, and of those that share a window's length. count, mean and df describe all items there are (by default, these)."""

    def __init__(self, items: list[tuple[int, str]], count: int | None = None, mean: float | None = None, df: dict[str, int] | None = None):
        split = [(i, t, words_of(t)) for i, t in items]
        split = [x for x in split if x[2]]
        self.ids = [i for i, _, _ in split]
        self.parts = [tuple(map(Part, question_and_answer(t))) for _, t, _ in split]
        counts, sizes = [Counter(w) for _, _, w in split], [len(w) for _, _, w in split]
        n = count or len(split)
        mean = mean or sum(sizes) / max(1, len(sizes))
        df = df if df is not None else Counter(w for c in counts for w in c)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for c in counts for w in c}))}
        self.windows = [max(LEAST_WINDOW, 1 << (2 * size - 1).bit_length()) for size in sizes]
        found: list[tuple[int, int, float]] = []
        for item, (c, size) in enumerate(zip(counts, sizes)):
            norm = K1 * (1 - B + B * size / mean)
            each = [(self.vocabulary[w], np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)) for w, tf in sorted(c.items())]
            own = sum(x for _, x in each)
            found += [(w, item, x / own) for w, x in each]
        self.all = Postings(found, len(self.vocabulary), len(split))
        self.groups = {}
        for window in sorted(set(self.windows)):
            members = [i for i, w in enumerate(self.windows) if w == window]
            place = {i: k for k, i in enumerate(members)}
            self.groups[window] = (members, Postings([(w, place[i], x) for w, i, x in found if i in place], len(self.vocabulary), len(members)))

    def passages(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """(first word, end, [(item, share)]) of every passage with hits; ids are a text's words, -1 those in no item."""
        words = np.unique(ids)
        for window in sorted({self.windows[i] for i in self.all.reached(words[words >= 0]).tolist()}):
            members, postings = self.groups[window]
            stride = window // 2
            work = [(0, max(0, -(-(len(ids) - window) // stride)) + 1)]
            while work:
                a, b = work.pop()
                s, e = a * stride, min(len(ids), (b - 1) * stride + window)
                words = np.unique(ids[s:e])
                words = words[words >= 0]
                if b - a == 1:
                    hits = postings.search(words)
                    if hits:
                        yield s, e, [(members[i], x) for i, x in hits]
                elif len(postings.reached(words)):
                    work += [(a, (a + b) // 2), ((a + b) // 2, b)]

    def leaks(self, text: str | None) -> list[tuple[int, int, int, float, float, float, float]]:
        """(item id, passages, first word of the first one, best score, best overlaps: of shingles, of question and of answer words) of each item found in a text."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        found: dict[int, list] = {}
        for s, e, hits in self.passages(ids):
            have = {n: runs(words[s:e], n) for n in {p.length for i, _ in hits for p in self.parts[i]} | {1}}
            for item, score in hits:
                parts = self.parts[item]
                both = sum(len(p.shingles & have[p.length]) for p in parts) / sum(len(p.shingles) for p in parts)
                q, a = (sum((w,) in have[1] for w in p.words) / len(p.words) for p in parts)
                if min(both, q, a) >= OVERLAP:
                    x = found.setdefault(item, [0, s, 0.0, 0.0, 0.0, 0.0])
                    x[:] = [x[0] + 1, min(x[1], s), *map(max, x[2:], (score, both, q, a))]
        return [(self.ids[i], *x) for i, x in sorted(found.items())]


def _ranges(start: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions start[w] .. start[w + 1] of all words, and which word each belongs to."""
    first, size = start[words], start[words + 1] - start[words]
    owner = np.repeat(np.arange(len(words)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner], owner


def _words_of_items(items: DataFrame) -> DataFrame:
    """part, item (a number), size, word: a row for each distinct word of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text in zip(b.column("part").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                if words:
                    own = sorted(set(words))
                    yield pa.record_batch([pa.array([part] * len(own), pa.int32()), pa.array([len(words)] + [0] * (len(own) - 1), pa.int64()), pa.array(own, pa.string())], ["part", "size", "word"])

    return items.select("part", "text").mapInArrow(run, "part int, size long, word string")


def indexes(items: DataFrame, limit: int = INDEX_ITEMS, chars: int = INDEX_CHARS) -> Iterator[Index]:
    """One index, or as many as hold at most so many items and characters each (on average, by a hash of the item). Items without words are left out.

    All indexes score by the statistics of all items, which Spark counts; only the words of an index's own items reach the driver.
    """
    items = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-rows // limit), -(-size // chars))
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))

    def collected(part: int) -> list[tuple[int, str]]:
        return sorted((r.item_id if r.item_id is not None else -1, r.text) for r in items.where(F.col("part") == part).collect())

    if parts == 1:
        yield Index(collected(0))
        return
    words = written(_words_of_items(items), "item-words")
    count, total = words.where("size > 0").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counts = written(words.groupBy("word").agg(F.count("*").alias("df")), "item-counts")
    for part in range(parts):
        own = words.where(F.col("part") == part).select("word").distinct()
        yield Index(collected(part), count, total / max(1, count), {r.word: r.df for r in counts.join(own, "word").toLocalIterator()})
    drop_written(words, counts)


def leaks(docs: DataFrame, items: DataFrame, limit: int = INDEX_ITEMS) -> DataFrame:
    """A row for each text and item that it holds. Texts or items without words give none; repeated rows give repeated rows."""

    def search(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(d.as_py(), *x) for d, t in zip(b.column("doc_id"), b.column("text")) for x in shared.value.leaks(t.as_py())]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in SCHEMA.split(", ")])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, [search(i) for i in indexes(items, limit)])


def decontaminated(docs: DataFrame, items: DataFrame, limit: int = INDEX_ITEMS) -> DataFrame:
    """docs without the rows whose text holds an item, all columns as they are."""
    schema = docs.schema
    for index in indexes(items, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t.as_py()) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
