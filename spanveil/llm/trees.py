"""Quality rules by gradient-boosted trees over document statistics.

Counts of a whole text (words, symbols, repeated lines, words in repeated 3-word windows,
case, punctuation, digits) become ratios; logistic gradient boosting on histograms of them
is fitted on labelled rows, with monotone constraints: more symbols, repeated lines or
repeated words never raise a score. The trees are flattened into numpy arrays of nodes and
all documents of a batch go down each tree together.

The fit uses at most `common.SAMPLE_PER_CLASS` labelled rows of each class (a documented
bound); statistics and scores cover whole texts. Null or empty text: no words, base_failed.
Labelled rows of one class: every score says that class. No labelled rows: base_failed alone decides. Repeated
rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "dup_lines", "repeats", "same_as_before", "commonest", "distinct", "upper", "marks", "digits", "word_length", "log_words", "line_words"]
#: -1: a higher value never raises the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "same_as_before": -1}
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST = 60, 3, 48, 0.2, 1.0, 8
KEEP_AT = 0.5


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the counts in BASE, the ratios in FEATURES) of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, WHITE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    dup_lines = len(lines) - len(set(lines))
    repeat = same = commonest = 0
    distinct = 1.0
    if n:
        index: dict[bytes, int] = {}
        at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        counts = np.bincount(at)
        commonest, distinct, same = int(counts.max()), len(counts) / n, int((at[1:] == at[:-1]).sum())
        if n > 3 and len(index) < n:
            first = at[:-2] * len(index) + at[1:-1]
            if len(index) >= 1 << 20:
                first = np.unique(first, return_inverse=True)[1]
            order = np.argsort(key := first * len(index) + at[2:], kind="stable")
            twin = key[order[1:]] == key[order[:-1]]
            windows = np.zeros(n - 2, bool)
            windows[order[1:][twin]] = windows[order[:-1][twin]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= windows
            repeat = int(covered.sum())
    size, d = max(1, len(data)), max(1, n)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b"!?\"'()[]{}=_\\/~^@"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    ratios = [symbols / size, dup_lines / max(1, len(lines)), repeat / d, same / d, commonest / d, distinct, upper / size, marks / size, digits / size, chars / d, float(np.log1p(n)), n / max(1, len(lines))]
    return [n, chars, symbols, dup_lines, repeat], ratios


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def fit(rows: list[tuple[int, str, int]], trees: int = TREES, depth: int = DEPTH) -> dict:
    """Flattened trees (feature, threshold, left, right, value, roots) and the prior, from (id, text, 0/1)."""
    y = np.array([r[2] for r in rows], float)
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "roots")}
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0  # one class: its label for all; no labels: base_failed alone decides
        return {"prior": float(np.log((share + 1e-3) / (1 - share + 1e-3))), **{k: np.array(v, float if k in ("threshold", "value") else int) for k, v in flat.items()}}
    x = np.array([statistics(t)[1] for _, t, _ in rows])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin <= k means x <= cuts[k]
    sign = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), prior)

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        node = len(flat["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", node), ("right", node)):
            flat[k].append(v)
        flat["value"].append(float(np.clip(-g[at].sum() / (h[at].sum() + LAMBDA), low, high)) * RATE)
        best = (1e-6, None)
        if level < depth and len(at) >= 2 * LEAST:
            for j in range(x.shape[1]):
                n_bins = len(cuts[j]) + 1
                b = binned[at, j]
                gs, hs, ns = (np.bincount(b, w, n_bins).cumsum()[:-1] for w in (g[at], h[at], np.ones(len(at))))
                gr, hr, nr = g[at].sum() - gs, h[at].sum() - hs, len(at) - ns
                left, right = np.clip(-gs / (hs + LAMBDA), low, high), np.clip(-gr / (hr + LAMBDA), low, high)
                gain = -(gs * left + 0.5 * (hs + LAMBDA) * left**2 + gr * right + 0.5 * (hr + LAMBDA) * right**2)
                gain += 0.0 + (g[at].sum() * (v := flat["value"][node] / RATE) + 0.5 * (h[at].sum() + LAMBDA) * v**2)
                gain[(ns < LEAST) | (nr < LEAST) | (sign[j] * (right - left) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, left[k], right[k]))
        if best[1] is not None:
            j, k, lv, rv = best[1]
            middle = (lv + rv) / 2
            bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[int(sign[j])]
            flat["feature"][node], flat["threshold"][node] = j, float(cuts[j][k])
            goes = binned[at, j] <= k
            flat["left"][node] = grow(at[goes], g, h, level + 1, *bounds[0])
            flat["right"][node] = grow(at[~goes], g, h, level + 1, *bounds[1])
        return node

    model: dict = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        flat["roots"].append(root := grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        model = {k: np.array(v, float if k in ("threshold", "value") else int) for k, v in flat.items()}
        score = score + down(model, root, x, depth)
    return model | {"prior": prior, "depth": depth}


def down(model: dict, root: int, x: np.ndarray, depth: int) -> np.ndarray:
    at = np.full(len(x), root)
    rows = np.arange(len(x))
    for _ in range(depth):
        f = model["feature"][at]
        at = np.where((f >= 0) & (x[rows, np.maximum(f, 0)] > model["threshold"][at]), model["right"][at], model["left"][at])
    return model["value"][at]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    score = np.full(len(x), model["prior"])
    for root in model["roots"]:
        score += down(model, root, x, model["depth"])
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def rules(docs: DataFrame, model: dict, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """doc_id (of its own type), the counts in BASE, base_failed, kept and score."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(b, T.LongType()) for b in BASE), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t.as_py()) for t in batch.column(1)]
            counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(BASE))
            score = predict(model, np.array([r for _, r in got], float).reshape(-1, len(FEATURES)))
            failed = np.array([base_failed(c[0], c[4]) for c in counts.tolist()], bool)
            cols = [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= keep_at)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "kept", "score"])

    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, T.StructType(fields))
