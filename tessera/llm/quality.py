"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Preference pairs
are drawn between training texts of either label (the better one wins), and the
weights minimise the logistic loss of the pairs' feature differences. The cut is
a quantile of the training strengths: that of the rejected labels' share, or any
other given. No label is looked at to place it. The score is a logistic function
of the distance to it, 0.7 at the cut.

Training runs on the driver over the features (not the texts) of a bounded
sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, table
from .toxicity import held_out

TRAIN_ROWS = 8000  # labelled rows of each label at most, the first by a hash of their id
PAIRS, BLOCK = 200_000, 10_000
CUT = 0.7

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "\n", "\"'", "-_", "/\\:", "<>{}[]()=;", "|", "#$%&*@^~+`")


def _byte_groups() -> np.ndarray:
    out = np.zeros((256, len(_GROUPS) + 1))
    out[128:, -1] = 1
    for g, chars in enumerate(_GROUPS):
        out[np.frombuffer(chars.encode(), np.uint8), g] = 1
    return out


BYTE_GROUPS = _byte_groups()
FEATURES = 2 * (len(_GROUPS) + 1) + 14


def features(text: str) -> np.ndarray:
    """Shares of byte groups and their roots; sizes; repetition of words, lines and neighbouring words. An empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros(FEATURES)
    n, size = len(words), len(raw)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ BYTE_GROUPS / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    upper = sum(map(bytes.isupper, words)) / n
    alpha = sum(map(bytes.isalnum, words)) / n
    longest = max(map(len, words))
    rest = [
        np.log1p(size), np.log1p(n), min(n, 20) / 20, min(n, 100) / 100, size / n / 10, np.log1p(longest), distinct / n, distinct / n**0.75, pairs,
        same, upper, alpha, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
    ]
    return np.concatenate([shares, np.sqrt(shares), rest])


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "x": [features(t or "").tolist() for t in b["text"]]})


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11, quantile: float | None = None) -> dict:
    """Weights over standardised features. With one label only nothing can be ranked: the model keeps every text. quantile: the share of training rows under the cut, by default that of label 0."""
    x, y = np.asarray(x, dtype=float).reshape(-1, FEATURES), np.asarray(y)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"weights": np.zeros(FEATURES), "cut": -1.0, "scale": 1.0}
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.clip((x - mean) / spread, -8, 8)
    pairs = min(PAIRS, 40 * len(z))
    winner, loser = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, ridge = np.zeros(FEATURES), 1e-3
    for _ in range(30):
        gradient, curve = ridge * w, ridge * np.eye(FEATURES)
        for i in range(0, pairs, BLOCK):  # all differences at once would be 200 MB of the driver's memory
            diff = z[winner[i : i + BLOCK]] - z[loser[i : i + BLOCK]]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            gradient += diff.T @ (p - 1) / pairs
            curve += (diff * (p * (1 - p))[:, None]).T @ diff / pairs
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float(np.quantile(s, len(bad) / len(s) if quantile is None else quantile, method="midpoint"))
    return {"weights": w, "mean": mean, "spread": spread, "cut": cut, "scale": float(np.std(s) or 1.0)}


def strength(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["spread"], -8, 8) if "mean" in model else np.zeros_like(x)
    return (z @ model["weights"] - model["cut"]) / model["scale"]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS) -> dict:
    """Fit on the labelled rows allowed. Only their features reach the driver, of so many rows of each label at most."""
    texts = labelled(docs, labels, "quality", allowed, rows)

    def with_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [features(t or "").tolist() for t in b["text"]]})

    got = texts.mapInPandas(with_label, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit(np.array(got["x"].tolist()).reshape(-1, FEATURES), got["y"].to_numpy())


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """docs' doc_id and score (0 to 1). A null text counts as an empty one; repeated rows are scored alike; no row is lost."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t or "") for t in b["text"]]).reshape(-1, FEATURES)
            z = 2 * strength(x, shared.value) + np.log(CUT / (1 - CUT))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows whose score is under the cut, all columns as they are."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def kept(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([features(t or "") for t in b.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield b.filter(pa.array(strength(x, shared.value) >= 0))

    return docs.mapInArrow(kept, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = scores(docs, train(docs, labels, ~held_out(2, 4)))
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
