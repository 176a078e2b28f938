"""Language identification by compression.

One zstandard raw-content dictionary is made for each language of the labelled rows. A text
is reduced to its lower-case words and compressed in blocks with each; the smallest total names the language.
The score is the share of that language in a softmax of the saved bytes, so narrow margins
score near 1 / languages; `rejected` marks margins under `margin` bits of the smallest
size, and identify(reject=True) answers `und` for them.

The dictionaries come from pieces of at most PER_LANGUAGE rows of each language and hold at
most DICT_BYTES each and TOTAL_BYTES in all (documented bounds); every language that occurs in
the labelled rows has one. Identification reads whole texts: all their letters, in words, a word that repeats the
one before it counted once. Null text or one without a letter: `und`, score 0. Ties: the
language with the most rows. No labelled rows: `und` for all. Repeated rows get the same
answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import compressor, raw_dictionary, sizes

PER_LANGUAGE = 2000
DICT_BYTES, TOTAL_BYTES, LEAST_BYTES = 512 << 10, 64 << 20, 1 << 10
#: Characters of the piece of a text, and the fewest.
PIECE, LEAST_PIECE = 4096, 512
#: Rows beyond PER_LANGUAGE that are read so that enough are left, as a factor and a number.
SPARE = (1.2, 100)
BLOCK = 512
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
WORDS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    words = WORDS.findall(text.lower())
    return " " + " ".join([a for a, b in zip(words, [None, *words], strict=False) if a != b]) + " "


def sample(docs: DataFrame, usable, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """Pieces of texts by language, the language with the most rows first.

    Two passes over the labelled rows: counts of the languages, then the rows with the smallest
    hashes. How small a hash must be follows from the count, so a language with a third of all
    rows sends about as many as any other, and only pieces of texts are collected.
    """
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit("lid"), F.col("doc_id").cast("string"), F.col(text)).alias("rank"))
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    least = F.lit(-(2.0**63)) + 2.0**64 * F.least(F.lit(1.0), (per_language * SPARE[0] + SPARE[1]) / F.col("n"))
    # One row a language: as many as the model has dictionaries, which is broadcast itself. Without it, whole texts would be shuffled by language.
    chosen = rows.join(F.broadcast(counts), "l").where(F.col("rank").cast("double") <= least)
    size = F.greatest(F.lit(LEAST_PIECE), F.least(F.lit(PIECE), F.floor(F.lit(DICT_BYTES) / F.col("n")))).cast("int")
    at = F.when(F.length("t") > size, F.crc32(F.col("t").cast("binary")) % (F.length("t") - size)).otherwise(0).cast("int")
    best = Window.partitionBy("l").orderBy("rank", "piece")
    pieces = chosen.select("l", "n", "rank", F.substring(F.col("t"), at + 1, size).alias("piece")).withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_language)
    by: dict[str, list[str]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (-r["n"], r["l"], r["k"])):
        by.setdefault(r["l"], []).append(letters(r["piece"]))
    return by


def fit(by: dict[str, list[str]]) -> dict[str, bytes]:
    size = max(LEAST_BYTES, min(DICT_BYTES, TOTAL_BYTES // max(1, len(by))))
    return {name: raw_dictionary(texts, size) for name, texts in by.items()}


def identifier(model: dict[str, bytes], margin: float = MARGIN):
    names = list(model)
    coders = [compressor(model[n]) for n in names]

    def one(text: str | None) -> tuple[str, float, bool]:
        if not names or not text or not LETTER.search(text):
            return "und", 0.0, True
        n, got = sizes(letters(text), coders, BLOCK)
        size = np.array(got, float)
        best = int(size.argmin())
        odds = np.exp(-np.minimum((size - size[best]) / max(1.0, n**0.5) * 4, 50))
        rest = np.delete(size, best)
        return names[best], float(1 / odds.sum()), bool(len(rest) and rest.min() - size[best] < margin * size[best])

    return one


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", margin: float = MARGIN, reject: bool = False) -> DataFrame:
    """doc_id (of its own type), lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = identifier(shared.value, margin)
        for batch in batches:
            got = [one(t.as_py()) for t in batch.column(1)]
            if reject:
                got = [("und" if r else n, s, r) for n, s, r in got]
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", F.col(f"`{text}`")).mapInArrow(run, schema)
