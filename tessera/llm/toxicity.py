"""Toxicity by a gappy-subsequence string-kernel support vector machine with Nyström landmarks.

Kernel of two words: the sum, over all 3-character subsequences they share that
span at most SPAN characters, of DECAY to the number of skipped characters in
either word, divided by both words' norms (a subsequence that a word holds several
times counts with the sum of its weights). Skipped characters only lower a
subsequence's weight, so "idXiot" or "i-d-i-o-t" stay close to the word they
hide; single letters set apart by spaces are joined to one word first, and such a
word counts as the worst of itself and itself without its first or its last letter,
as these may be words of their own ("a", "I", "y"). A word carries a mark at either end.

Training (on the driver, over a bounded sample of labelled texts): words that
speak most for either label are the landmarks; a word's features are its kernels
with them, whitened by the landmarks' own kernel matrix (Nyström). A text is
labelled, not its words, so the machine is trained by multiple instances: a toxic
text gives its best word so far, a clean text its worst ones, and this is
repeated. Linear weights over Nyström features of a finite subsequence kernel fold
into one weight for each 3-character subsequence, a fixed table of ALPHABET**3
numbers: that is all the executors get.

A text's score is a logistic function of its highest word margin and of how much
positive margin its words have, in all and each, with the cut between the labels at 0.7.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import labelled, table

ALPHABET = 32
SPAN, DECAY = 7, 0.6
TRAIN_ROWS = 2500  # labelled texts of each class at most, the first by a hash of their id
TRAIN_CHARS = 20_000_000  # characters of each class at most, in the same order
TRAIN_TEXT = 1_000_000  # a longer text is no training text
LANDMARKS = 256
ROUNDS = 6
CHUNK = 1_000_000  # characters worked on at once
KNOWN_WORDS = 1_000_000  # margins of so many words are kept by a task
CUT = 0.7
_PAIRS = [(j, k) for k in range(2, SPAN + 1) for j in range(1, k)]
_MARK, _SPACE = ALPHABET - 1, 255
IGNORANT = {"weights": np.zeros(ALPHABET**3, dtype=np.float32), "bias": -1.0, "combine": np.zeros(4), "cut": 1.0}


def _codes() -> np.ndarray:
    """Code point -> letter code; white space is 255, other signs share five codes, accented letters have their base letter's."""
    import unicodedata

    out = np.array([26 + c % 5 for c in range(0x3000)], dtype=np.uint8)
    for c in range(0x3000):
        base = unicodedata.normalize("NFD", chr(c).lower())[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - ord("a")
        elif chr(c).isspace():
            out[c] = _SPACE
    return out


CODES = _codes()


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts as one array of letter codes with a mark before and after each, the words' starts, each word's text, and whether it was joined from single letters."""
    points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = CODES[np.minimum(points, 0x2FFF)]
    lengths = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    space = codes == _SPACE
    # a space between two single letters goes: the letters are one word
    glue = np.zeros(len(codes), bool)
    if len(codes) > 4:
        glue[2:-2] = space[2:-2] & space[:-4] & space[4:] & ~space[1:-3] & ~space[3:-1]
    glued = np.zeros(len(codes), bool)
    glued[1:] = glue[:-1]  # the letter after a space that goes
    codes, owner, space, glued = codes[~glue], owner[~glue], space[~glue], glued[~glue]
    first = ~space[1:] & space[:-1]
    # of each run of spaces the last one is kept, as the mark before the next word; its fellow after the word is put in
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    sizes = ends - starts  # mark and letters
    total = int(sizes.sum()) + len(sizes)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    out = np.full(total, _MARK, dtype=np.int32)
    at = np.arange(total) - np.repeat(begin, sizes + 1) + np.repeat(starts, sizes + 1)
    inner = np.ones(total, bool)
    inner[begin] = False
    inner[begin + sizes] = False
    out[inner] = codes[at[inner]]
    # the second letter of a joined word follows a space that went
    joined = glued[np.minimum(starts + 2, len(glued) - 1)] & (sizes > 2) if len(starts) else np.zeros(0, bool)
    return out, begin.astype(np.int64), owner[starts + 1] if len(starts) else np.zeros(0, np.int32), joined


def _sizes(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.diff(np.append(begin, len(codes)))


def _subsequences(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every subsequence of every word: the word's number, the subsequence, its weight; one that occurs several times has several rows."""
    sizes = _sizes(codes, begin)
    word = np.repeat(np.arange(len(begin)), sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(codes))  # codes from here to the word's end
    words, found, weights = [], [], []
    for j, k in _PAIRS:
        at = np.flatnonzero(left > k)
        words.append(word[at])
        found.append((codes[at].astype(np.int64) << 10) | (codes[at + j] << 5) | codes[at + k])
        weights.append(np.full(len(at), DECAY ** (k - 2)))
    return np.concatenate(words), np.concatenate(found), np.concatenate(weights)


def _norms(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The norm of each word's subsequence features; 1 at least, for words too short to have any."""
    if not len(begin):
        return np.zeros(0)
    word, found, weight = _subsequences(codes, begin)
    key = (word << 15) | found
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    return np.sqrt(np.maximum(np.bincount(key[first] >> 15, weights=sums**2, minlength=len(begin)), 1.0))


def word_margins(codes: np.ndarray, begin: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each word, the folded weights of its subsequences, over its norm."""
    if not len(begin):
        return np.zeros(0)
    sizes = _sizes(codes, begin)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(codes))
    total = np.zeros(len(codes), dtype=np.float64)
    for j, k in _PAIRS:
        n = len(codes) - k
        if n > 0:
            index = (codes[:n] << 10) | (codes[j : j + n] << 5) | codes[k : k + n]
            total[:n] += np.where(left[:n] > k, weights[index], 0.0) * DECAY ** (k - 2)
    return np.add.reduceat(total, begin) / _norms(codes, begin)


def _chosen(codes: np.ndarray, begin: np.ndarray, rows: np.ndarray, skip: int = 0, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The words of the given numbers, without so many letters at the front and at the end."""
    sizes = _sizes(codes, begin)[rows] - skip - cut
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(start, sizes) + np.repeat(begin[rows] + skip, sizes)
    out = codes[at]
    if len(rows):
        out[start] = _MARK
        out[start + sizes - 1] = _MARK
    return out, start


_STEPS = np.random.default_rng(31).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _names(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    sizes = _sizes(codes, begin)
    place = np.arange(len(codes)) - np.repeat(begin, sizes)
    turn = (place >> 6).astype(np.uint64) + np.uint64(1)
    h = (codes.astype(np.uint64) + np.uint64(1)) * _STEPS[place & 63] * (turn * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    h = np.add.reduceat(h ^ (h >> np.uint64(29)), begin) + sizes.astype(np.uint64)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Margins:
    """Word margins under one model. Each distinct word is worked out once; a task keeps those of KNOWN_WORDS."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.names, self.values = weights, np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        names, first, back = np.unique(_names(codes, begin), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        held = at < len(self.names)
        held[held] = self.names[at[held]] == names[held]
        out = np.zeros(len(names))
        out[held] = self.values[at[held]]
        if not held.all():
            out[~held] = word_margins(*_chosen(codes, begin, first[~held]), self.weights)
            if len(self.names) > KNOWN_WORDS:
                self.names, self.values, at = np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(at), np.int64)
            self.names = np.insert(self.names, at[~held], names[~held])
            self.values = np.insert(self.values, at[~held], out[~held])
        return out[back]


def evidence(texts: list[str], margins: Margins, bias: float) -> np.ndarray:
    """A row for each text: its highest word margin, the log of its words' summed positive margins, and that sum's share of all words; -1, 0, 0 without words. In chunks, so memory does not grow with the batch."""
    out, i = np.tile([-1.0, 0.0, 0.0], (len(texts), 1)), 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
            n += len(texts[j])
            j += 1
        codes, begin, owner, joined = _stream(texts[i:j])
        if len(begin):
            values = margins(codes, begin)
            rows = np.flatnonzero(joined)
            if len(rows):
                for skip, cut in ((1, 0), (0, 1)):
                    values[rows] = np.maximum(values[rows], margins(*_chosen(codes, begin, rows, skip, cut)))
            values = np.clip(values + bias, -1.0, 1.0)
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            has, total = owner[first] + i, np.add.reduceat(np.maximum(values, 0), first)
            words = np.diff(np.append(first, len(owner)))
            out[has] = np.column_stack([np.maximum.reduceat(values, first), np.log1p(total), np.minimum(10 * total / words, 1)])
        i = j
    return out


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(w) for w in words]
    return np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _mapped(words: list[bytes], to: np.ndarray) -> np.ndarray:
    """Each word's normed subsequence features times the matrix to, without ever holding the features."""
    out = np.zeros((len(words), to.shape[1]))
    for i in range(0, len(words), 1000):
        codes, begin = _joined(words[i : i + 1000])
        sizes = _sizes(codes, begin)
        left = np.repeat(begin + sizes, sizes) - np.arange(len(codes))
        total = np.zeros((len(codes), to.shape[1]), dtype=np.float32)
        for j, k in _PAIRS:
            at = np.flatnonzero(left > k)
            total[at] += to[(codes[at] << 10) | (codes[at + j] << 5) | codes[at + k]] * np.float32(DECAY ** (k - 2))
        out[i : i + 1000] = np.add.reduceat(total, begin) / _norms(codes, begin)[:, None]
    return out


def _features(words: list[bytes]) -> np.ndarray:
    """Explicit subsequence features of a few words, normed: a row each."""
    out = np.zeros((len(words), ALPHABET**3), dtype=np.float32)
    codes, begin = _joined(words)
    word, found, weight = _subsequences(codes, begin)
    np.add.at(out, (word, found), weight.astype(np.float32))
    return out / _norms(codes, begin)[:, None].astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(penalty), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def fit(texts: list[str], labels: list[int]) -> dict:
    """Train on labelled texts. Without both labels the model knows nothing and scores every text below the cut."""
    y = np.array(labels, dtype=int)
    if len(set(labels)) < 2:
        return dict(IGNORANT)
    words, seen = [], [Counter(), Counter()]
    for t, label in zip(texts, labels):
        codes, begin, _, _ = _stream([t])
        raw, ends = codes.astype(np.uint8).tobytes(), [*begin[1:].tolist(), len(codes)]
        own = {raw[b:e] for b, e in zip(begin.tolist(), ends) if e - b > 3}
        words.append(own)
        seen[label].update(own)
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    rank = {w: (seen[1][w] / n1 - seen[0][w] / n0) / np.sqrt((seen[1][w] + seen[0][w] + 2) / (n1 + n0)) for w in seen[1]}
    best = sorted(rank, key=lambda w: (-rank[w], w))
    rng = np.random.default_rng(7)
    clean = sorted(seen[0])
    marks = best[: LANDMARKS // 2] + [clean[i] for i in rng.choice(len(clean), min(LANDMARKS // 2, len(clean)), replace=False)]
    marks = list(dict.fromkeys(marks))
    if not marks:  # texts without words
        return dict(IGNORANT)
    phi = _features(marks)
    value, vector = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    keep = value > 1e-4 * value[-1]
    to_features = (phi.T @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32)  # subsequences -> Nyström features
    known: dict[bytes, np.ndarray] = {}

    def nystrom(some: list[bytes]) -> np.ndarray:
        new = [w for w in some if w not in known]
        known.update(zip(new, _mapped(new, to_features)))
        return np.array([known[w] for w in some])

    order = {w: i for i, w in enumerate(best)}
    words = [sorted(own) for own in words]
    joined = [_joined(own) if own else None for own in words]
    witness = [sorted(own, key=lambda w: order.get(w, len(order)))[:2] for own in words]
    negatives = {clean[i] for i in rng.choice(len(clean), min(4000, len(clean)), replace=False)}
    weights, bias = None, 0.0
    for _ in range(ROUNDS):
        if weights is not None:
            witness = [[own[i] for i in np.argsort(-word_margins(*at, weights), kind="stable")[:2]] if own else [] for own, at in zip(words, joined)]
        positive = Counter(w for two, label in zip(witness, labels) for w in two if label)
        negatives |= {w for two, label in zip(witness, labels) for w in two if not label}
        # a word that clean texts hold as often is no witness
        p = [w for w in sorted(positive) if seen[1][w] / n1 > 2 * seen[0][w] / n0]
        n = sorted(negatives - set(p))
        if not p or not n:
            break
        cost = np.sqrt(np.concatenate([[positive[w] for w in p], [1 + seen[0][w] for w in n]]).astype(float))
        cost[: len(p)] *= 5 / cost[: len(p)].sum()
        cost[len(p) :] *= 5 / cost[len(p) :].sum()
        w = _svm(nystrom(p + n), np.array([1.0] * len(p) + [-1.0] * len(n)), cost, 1e-2)
        weights, bias = (to_features @ w[:-1]).astype(np.float32), float(w[-1])
    if weights is None:
        return dict(IGNORANT)
    x = evidence(texts, Margins(weights), bias)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = _logistic((x - mean) / spread, y)
    combine = np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())
    m = x @ combine[:-1] + combine[-1]
    by = np.argsort(m, kind="stable")
    hit = np.cumsum((y[by] == 1)[::-1])[::-1]
    f1 = 2 * hit / (np.arange(len(m), 0, -1) + n1)
    top = int(np.argmax(f1))
    cut = float((m[by[top]] + m[by[max(top - 1, 0)]]) / 2)
    return {"weights": weights, "bias": bias, "combine": combine, "cut": cut}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> list[tuple[str, int]]:
    """Texts and labels to learn from: of each class at most so many rows and TRAIN_CHARS characters, the first by a hash of their id. Spark applies both bounds, so no more reaches the driver."""
    found = labelled(docs, labels, label, allowed, rows).where(F.length("text") <= TRAIN_TEXT)
    order = F.xxhash64(F.col("doc_id"))
    # a class has at most so many rows here, so the window is bounded
    so_far = F.sum(F.length("text")).over(Window.partitionBy("y").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = found.withColumn("so_far", so_far).where(F.col("so_far") <= TRAIN_CHARS).select("text", "y", order.alias("o"), "doc_id").toLocalIterator()
    return [(r.text, r.y) for r in sorted(got, key=lambda r: (r.o, r.doc_id))]


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text. A null text counts as an empty one, which has the lowest margin."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 128 kB

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        margins = Margins(m["weights"])
        for b in batches:
            texts = [t or "" for t in b["text"]]
            z = evidence(texts, margins, m["bias"]) @ m["combine"][:-1] + m["combine"][-1] - m["cut"] + np.log(CUT / (1 - CUT))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")


def held_out(remainder: int, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = training_rows(docs, labels, "toxic", ~held_out(1, 3), TRAIN_ROWS)
    scored = scores(docs, fit([t for t, _ in rows], [y for _, y in rows]))
    return scored.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
