"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text, each counted once: its words and the n-grams that begin them, pairs of
neighbours, and pairs with one or two words between (skip-grams), hashed to 2**BITS places. FTRL-proximal keeps a learning
rate for each coordinate and its L1 term leaves most weights at exactly zero; the rest
(place, weight) are the whole model, at most 2**BITS pairs, a few kilobytes in practice.

The fit uses at most `common.SAMPLE_PER_CLASS` labelled rows of each class (a documented
bound); scoring reads every word of every text. Null or empty text: the score of the bias.
Repeated rows get the same score. No labelled rows: every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality

BITS = 20
ALPHA, BETA, L2, EPOCHS = 0.3, 1.0, 0.5, 6
#: L1 and the least number of training rows of a feature: this share of the rows, within these bounds.
SHARE, L1_RANGE, ROWS_RANGE = 0.0025, (1.0, 10.0), (2, 10)
WORD = re.compile(r"\w+")
CACHE = 500_000
GAPS = (1, 2, 3)
#: Characters of the word n-grams that begin a word.
PREFIXES = (4, 5, 6, 7, 8)


def spread(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Ids(dict):
    """Hash of a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace"))
        return h


def inside(word: str) -> list[int]:
    """Places of a word and of the word n-grams that begin it."""
    crc, out = zlib.crc32, [zlib.crc32(word.encode("utf-8", "replace"))]
    for k in PREFIXES:
        if len(word) <= k:
            break
        out.append(crc((word[:k] + "~").encode("utf-8", "replace")))
    return [(h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - BITS for h in out]


def pairs(words: list[str], ids: Ids) -> np.ndarray:
    """Places of neighbours and skip-grams, with repeats."""
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    out = [spread(w[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + w[gap:] * np.uint64(0x165667B19E3779F9) + np.uint64(gap)) for gap in GAPS if len(w) > gap]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def features(text: str | None, ids: Ids) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    own = [p for w in set(words) for p in inside(w)]
    return np.unique(np.concatenate([np.array(own, np.int64), pairs(words, ids)]))


def fit(rows: list[tuple[int, str, int]], alpha: float = ALPHA, beta: float = BETA, l1: float | None = None, l2: float = L2, epochs: int = EPOCHS) -> dict:
    """Sparse weights from (id, text, 0/1), in the given order of rows, each class weighed alike."""
    labels = np.array([y for *_, y in rows], float)
    if not len(labels) or labels.min() == labels.max():
        return {"at": np.zeros(0, np.int64), "w": np.zeros(0), "bias": 0.0 if not len(labels) else (4.0 if labels[0] else -4.0)}
    ids = Ids()
    xs = [features(t, ids) for _, t, _ in rows]
    size = 1 << BITS
    l1 = l1 or float(np.clip(SHARE * len(rows), *L1_RANGE))
    seen = np.bincount(np.concatenate(xs), minlength=size)
    xs = [x[seen[x] >= np.clip(SHARE * len(rows), *ROWS_RANGE)] for x in xs]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(epochs):
        for x, y in zip(xs, labels, strict=True):
            at = np.append(x, size)  # the last place is the bias
            zi, ni = z[at], n[at]
            shrunk = np.abs(zi) - l1
            shrunk[-1] = abs(zi[-1])
            w = np.where(shrunk > 0, -np.sign(zi) * shrunk / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    shrunk = np.abs(z) - l1
    shrunk[-1] = abs(z[-1])
    w = np.where(shrunk > 0, -np.sign(z) * shrunk / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    at = np.flatnonzero(w[:-1])
    return {"at": at, "w": w[at], "bias": float(w[-1])}


class Hits(dict):
    """Places of a word that carry a weight: for most words, none."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        self[word] = hit = tuple(p for p in inside(word) if self.table[p])
        return hit


def scorer(model: dict):
    table = np.zeros(1 << BITS, np.float32)
    table[model["at"]] = model["w"]
    ids, hits = Ids(), Hits(table)

    def one(text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        two = pairs(words, ids)
        found = {p for w in set(words) for p in hits[w]}
        found.update(two[table[two] != 0].tolist())
        return float(table[sorted(found)].sum(dtype=np.float64)) + model["bias"]

    return lambda texts: 1 / (1 + np.exp(-np.clip(np.fromiter(map(one, texts), float, len(texts)), -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, per_class: int = common.SAMPLE_PER_CLASS, mod: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; the weights are broadcast."""
    model = fit(common.labelled_sample(docs, labels, "toxic", common.fold("doc_id", mod) != held, per_class))
    scored = quality.with_score(docs.select("doc_id", "text"), scorer, model)
    return scored.select("doc_id", (common.fold("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
