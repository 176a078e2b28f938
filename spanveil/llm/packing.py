"""Packing by concatenate and cut.

Pass one tokenizes every document once (whole text, then the end id) and writes the ids,
two bytes each, with the running total inside its partition. The totals of the partitions
(one row each) are summed up in a second pass to global offsets. The concatenated ids are
then cut at every multiple of the sequence length; a document that crosses a cut leaves
one boundary record on each side. Only the last sequence can be short.

Null text: empty. Empty text: the end id alone. Null or repeated ids: each row is a
document of its own. Empty table: empty result. A very long text spans many sequences;
nothing else depends on its length. Ids are those of the `tokenizers` file: texts of
common scripts run through the same vocabulary in tiktoken, one cached word at a time;
a text with other characters, or with the text of a special token, runs through
`tokenizers` itself, whole.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 2048
END_ID = 1
CACHE = 600_000
#: Partition totals are broadcast up to this many rows (24 bytes each); beyond, a plain join.
BROADCAST_PARTS = 200_000

#: A space between two characters that aren't white space; no word of the pattern crosses it.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space that would join a cut, at the ends or in runs.
RUNS = re.compile(r"\s\s|^\s|\s\Z")
#: Above these, the two libraries' tables of letters may differ.
RARE = re.compile("[^\t\n\r -~\xa1-ɏ‐-‧€]")


class Words(dict):
    """Bytes of the ids (two bytes an id) of a word with the space before it."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = array("H", self.encode(word)).tobytes()
        return ids


class Encoder:
    """Ids of byte_bpe_50k as bytes, two for each id."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words, self.json_path, self.whole = Words(own._core_bpe.encode_ordinary), json_path, None

    @classmethod
    def of(cls, json_path: str, ranks_path: str) -> Encoder:
        if (json_path, ranks_path) not in cls._made:
            cls._made[json_path, ranks_path] = cls(json_path, ranks_path)
        return cls._made[json_path, ranks_path]

    def encode(self, text: str) -> bytes:
        if RARE.search(text) or "<|" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if not text:
            return b""
        parts = CUT.split(text) if RUNS.search(text) else text.split(" ")
        of = self.words.__getitem__
        return of(parts[0]) + b"".join(map(of, map(" ".__add__, parts[1:])))


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenize(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id (of its own type), ids (binary, two bytes each), n, part, at: its first id's place in the partition."""
    end = array("H", [end_id]).tobytes()
    names = ["doc_id", "ids", "n", "part", "at"]
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *T.DataType.fromDDL("ids binary, n long, part int, at long").fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = Encoder.of(*paths).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            step = 512
            for lo in range(0, batch.num_rows, step):
                piece = batch.slice(lo, step)
                ids = [encode(t or "") + end for t in piece.column(1).to_pylist()]
                n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)], names=names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(run, T.StructType(fields))


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of a written table of tokenize(): second pass of the prefix sums, then windows."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    few = totals.count() <= BROADCAST_PARTS
    placed = tokens.join(F.broadcast(offsets) if few else offsets, "part").select("doc_id", "ids", (F.col("base") + F.col("at")).alias("first"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, (ids, first) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                wide = np.frombuffer(ids.as_buffer(), np.uint16).astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    end = min(n, start + length - offset)
                    out.append((row, start, end - start, zlib.crc32(wide[start:end]), n, sequence, offset))
                    start = end
            row, *cols = (pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *cols], names=["doc_id", *names])

    return placed.mapInArrow(run, T.StructType([tokens.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names)]))


def pack(docs: DataFrame, length: int = LENGTH, paths: tuple[str, str] | None = None, **names: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    return cut(common.materialize(tokenize(docs, paths or default_paths(), **names)), length)
