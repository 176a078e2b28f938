"""Compression classifier of document quality.

Two zstandard dictionaries are built from good and from bad labelled text. A document is
compressed with each in blocks; the difference of the two sizes over its length is the
evidence. A logistic model, fitted on labelled rows that the dictionaries haven't seen, makes
a calibrated score from it. It has a weight for each size, as a byte of one dictionary isn't
worth a byte of the other, and nothing else: a text's length alone moves no score.

The fit uses at most `common.SAMPLE_PER_CLASS` labelled rows and `common.SAMPLE_BYTES` bytes
of each class (documented bounds). A dictionary takes pieces of LEAST_PIECE to PIECE bytes,
the shorter the more texts there are, up to DICT_BYTES. Scoring reads every byte of every text. Null or empty text: the score of a text of
no bytes. No labelled rows of a class: every score is the share of label 1 (0.5 without
labels). Repeated rows get the same score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DICT_BYTES = 256 << 10
BLOCK = 1024
LEVEL = 3
PIECE, LEAST_PIECE = 4096, 512
FRAME = dict(write_content_size=False, write_checksum=False, write_dict_id=False)


def raw_dictionary(texts: list[str], size: int = DICT_BYTES, piece: int = PIECE, least: int = LEAST_PIECE) -> bytes:
    """Pieces of the texts, one of each at a place that its hash gives, up to `size` bytes; of many texts, each gives a shorter one."""
    piece = min(piece, max(least, size // max(1, len(texts))))
    out, total = [], 0
    for text in texts:
        data = text.encode("utf-8", "replace")
        at = zlib.crc32(data) % (len(data) - piece) if len(data) > piece else 0
        out.append(data[at : at + piece])
        total += len(out[-1]) + 1
        if total >= size:
            break
    return b"\n".join(out)[-size:]


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, **FRAME)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, **FRAME)


def sizes(text: str | None, coders: list[zstandard.ZstdCompressor], block: int = BLOCK) -> tuple[int, list[int]]:
    """Bytes of the whole text, and compressed in blocks by each coder."""
    data = memoryview((text or "").encode("utf-8", "replace"))
    got = [0] * len(coders)
    for i in range(0, len(data), block):
        part = data[i : i + block]
        for k, coder in enumerate(coders):
            got[k] += len(coder.compress(part))
    return len(data), got


#: Bytes that smooth the sizes of short texts.
SMOOTH = (20, 2)


def evidence(n: int, good: int, bad: int) -> list[float]:
    """The two compressed sizes over the length: what the weighted difference is made of."""
    return [(bad + SMOOTH[1]) / (n + SMOOTH[0]), (good + SMOOTH[1]) / (n + SMOOTH[0])]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 40) -> dict:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + l2 * w)
    return {"mean": mean, "scale": scale, "w": w}


def fit(rows: list[tuple[int, str, int]]) -> dict:
    """A model from (id, text, 0/1): every other row of a class fills its dictionary, the rest calibrate."""
    by = {y: [t for _, t, label in rows if label == y] for y in (0, 1)}
    if min(map(len, by.values())) < 4:
        return {"constant": len(by[1]) / max(1, len(rows)) if rows else 0.5}
    model: dict = {"good": raw_dictionary(by[1][::2]), "bad": raw_dictionary(by[0][::2])}
    coders = [compressor(model["good"]), compressor(model["bad"])]
    x, y = [], []
    for label in (0, 1):
        for text in by[label][1::2]:
            n, (g, b) = sizes(text, coders)
            x.append(evidence(n, g, b))
            y.append(label)
    return model | logistic(np.array(x), np.array(y))


def scorer(model: dict):
    if "constant" in model:
        return lambda texts: np.full(len(texts), model["constant"])
    coders = [compressor(model["good"]), compressor(model["bad"])]

    def score(texts: list[str | None]) -> np.ndarray:
        x = np.array([evidence(n, *got) for n, got in (sizes(t, coders) for t in texts)]).reshape(-1, 2)
        a = np.c_[np.ones(len(x)), (x - model["mean"]) / model["scale"]]
        return 1 / (1 + np.exp(-np.clip(a @ model["w"], -30, 30)))

    return score


def with_score(docs: DataFrame, make, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out` (replaced if there is one) by make(model), which scores lists of whole texts. The model is broadcast."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out])
    names = docs.columns
    at = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make(shared.value)
        for batch in batches:
            got = [score(batch.column(at).slice(lo, 512).to_pylist()) for lo in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], names=[*inner, out])

    # Names with a dot don't pass through mapInArrow: columns have plain names inside.
    inner = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(inner, docs.schema.fields, strict=True)]
    return docs.toDF(*inner).mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())])).toDF(*names, out)


#: Inner column of accepted().
SCORE = "_spanveil_score"


def model_of(docs: DataFrame, labels: DataFrame, per_class: int = common.SAMPLE_PER_CLASS, mod: int = 4, held: int = 2) -> dict:
    return fit(common.labelled_sample(docs, labels, "quality", common.fold("doc_id", mod) != held, per_class))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = common.SAMPLE_PER_CLASS, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = with_score(docs.select("doc_id", "text"), scorer, model_of(docs, labels, per_class, mod, held))
    return scored.select("doc_id", (common.fold("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **more) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with the columns of docs as they are."""
    scored = with_score(docs, scorer, model_of(docs, labels, **more), out=SCORE)
    return scored.where(F.col(SCORE) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
