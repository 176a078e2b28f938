"""Suffix-array deduplication: bytes covered by a long string that also starts earlier.

A byte goes if a string of MIN bytes over it also starts earlier (smaller id, or the same
document and an earlier start). Strings are judged on the input, within documents.

1. Each window of MIN bytes is served by its smallest hashed k-mer (an anchor). The choice
   depends on the window's bytes alone, so equal windows have equal anchors at equal places.
   Windows in a row with one anchor form one context: the bytes that they cover. For each
   anchor the hash of the k-mer, a 128-bit digest of the context (BLAKE2b) and the place are
   shuffled. Equal contexts of one task are combined before: the first stands for them.
2. Places of an anchor meet. An anchor with one place is done. Of equal contexts the first
   place is the representative, the others are its further places.
3. Representatives fetch their bytes. In each bucket an enhanced suffix array over their
   windows is built (suffixes sorted, common prefixes of neighbours), and a stack scan walks
   its common-prefix interval tree. Each interval of MIN bytes or more with more than one left
   extension is a maximal repeat group with all its places; intervals with one left extension
   are parts of a longer group. A representative with further places is a leaf of several
   places, a group of its own. All places of a group but the first are covered. Where an
   anchor has a single context, all its places extend to the left alike but at the context's
   start, so only that suffix enters the array; such contexts are dealt by document, where
   neighbours share their bytes.
4. Spans are merged for each document and its bytes cut.

Hot anchors: a passage in a third of all documents has, at its ends, anchors with another
context in each document. A hash subset of the documents finds such anchors beforehand
(this steers the dealing only; results don't depend on it). They are dealt by document in
step 2 and by context in step 3, each share has its own suffix array, and the windows that
no share has settled meet by a 128-bit fingerprint (step 3b). Long texts are read in overlapping
segments. Nothing is collected but the list of hot anchors, at most HOT_MOST.

Null text: no bytes. Texts under MIN bytes lose nothing. Ids that are null or repeat: rows
are put in order (null last, then by text digest) and each counts as a document of its own.
Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Inner columns: the id of a row, and its text.
ID, TEXT = "_spanveil_id", "_spanveil_text"

MIN = 100
KMER = 24
SEGMENT = 1 << 17
#: A hot anchor has this many contexts or more in the hash subset of one document in HOT_ONE_IN.
HOT_ONE_IN, HOT_AT, HOT_MOST, HOT_SHARES = 64, 32, 100_000, 64

ONE = np.uint64(1)
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Two independent hashes of a byte.
BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + ONE for seed in (1, 2)]
PLACE = [("h", "<u8"), ("c", "<u8"), ("d", "<u8"), ("doc", "<i8"), ("s", "<u4"), ("w", "u1")]
KINDS = {"anchor": PLACE, "place": PLACE, "also": PLACE, "lone": PLACE, "part": [*PLACE, ("o", "<u4")], "mark": [("doc", "<i8"), ("s", "<u4"), ("n", "<u4")], "window": [("f", "<u8"), ("g", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("s", "<u4")]}
SHIFTS = (5, 11, 23)
#: Anchors that one task combines and hands on at a time.
FLUSH = 400_000
#: Windows that one suffix array holds, if no anchor alone has more: contexts of different anchors have no window in common.
WINDOWS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of the `length` bytes at each place, by doubling."""
    h, have, got, out = BYTES[which][data], 1, 0, None
    while True:
        if length & have:
            part = h[got : got + len(data) - length + 1]
            out = part.copy() if out is None else out[: len(part)] * M3 + part
            got += have
        if have * 2 > length:
            return mixed(out)
        h = mixed(h[:-have] * M1 + h[have:])
        have *= 2


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, whatever pattern the ids follow; the same as bucket_column()."""
    x = doc.astype(np.uint64)
    for k in SHIFTS:
        x = x ^ (x >> np.uint64(k))
    return (x % np.uint64(buckets)).astype(np.int64)


def bucket_column(buckets: int) -> Column:
    x = F.col(ID)
    for k in SHIFTS:
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return F.pmod(x, F.lit(buckets)).cast("int")


def anchors(data: np.ndarray, minimum: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Of a text of at least `minimum` bytes: anchors' hashes, contexts' digests in two parts, their starts, windows served."""
    out = []
    for lo in range(0, len(data) - minimum + 1, SEGMENT):
        seg = data[lo : lo + SEGMENT + minimum - 1]
        h = hashes(seg, kmer)
        low = np.uint64((1 << 20) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, have, m = minimum - kmer + 1, 1, key
        while have * 2 <= span:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        m = np.minimum(m[: len(m) - (span - have)], m[span - have :]) if span > have else m
        at = (m & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        raw = memoryview(seg)
        digests = [hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (last + minimum).tolist(), strict=True)]
        c = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        out.append((h[at[first]], c[:, 0], c[:, 1], first + lo, last - first + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pack(cols: dict[str, np.ndarray], kind: str, keep=slice(None)) -> bytes:
    return b"".join(np.ascontiguousarray(cols[n][keep].astype(t)).tobytes() for n, t in KINDS[kind])


def unpack(blobs, kind: str) -> dict[str, np.ndarray]:
    fields, got = KINDS[kind], {n: [] for n, _ in KINDS[kind]}
    width = sum(np.dtype(t).itemsize for _, t in fields)
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, t in fields:
            got[name].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(v) if v else np.zeros(0, t) for (n, t), v in zip(fields, got.values(), strict=True)}


def dealt(cols: dict[str, np.ndarray], kind: str, to: np.ndarray) -> list[tuple[int, bytes]]:
    """(bucket, blob) for each bucket that gets rows."""
    if not len(to):
        return []
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
    ends = np.append(cuts[1:], len(to))
    return [(int(to[order[a]]), pack(cols, kind, order[a:b])) for a, b in zip(cuts, ends, strict=True)]


def table_of(rows: list[tuple[str, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "blob"])


def in_order(p: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(places by anchor, context and place, where an anchor begins, where a context begins)."""
    order = np.lexsort((p["s"], p["doc"], p["d"], p["c"], p["h"]))
    p = {n: v[order] for n, v in p.items()}
    new_h = np.append(True, p["h"][1:] != p["h"][:-1])[: len(order)]
    return p, new_h, new_h | np.append(True, (p["c"][1:] != p["c"][:-1]) | (p["d"][1:] != p["d"][:-1]))[: len(order)]


def whole_marks(p: dict[str, np.ndarray], minimum: int) -> dict[str, np.ndarray]:
    return {"doc": p["doc"], "s": p["s"], "n": p["w"].astype(np.uint32) + minimum - 1}


OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
OUT = "kind string, bucket int, blob binary"


def hot_anchors(docs: DataFrame, minimum: int, kmer: int, one_in: int, at_least: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, cs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for text in batch.column(0):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else b""
                if len(data) >= minimum:
                    h, c, *_ = anchors(data, minimum, kmer)
                    hs.append(h)
                    cs.append(c)
            pairs = np.unique(np.stack([np.concatenate(hs), np.concatenate(cs)]), axis=1)
            h, n = np.unique(pairs[0], return_counts=True)
            h, n = h[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    some = docs.where(F.pmod(F.xxhash64(ID), F.lit(one_in)) == 0).select(TEXT).mapInArrow(run, "h long, n long")
    top = some.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least).orderBy(F.desc("n"), "h").limit(HOT_MOST)
    return np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def to_buckets(h: np.ndarray, salt: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    key = np.where(hot, mixed(h + (salt % np.uint64(HOT_SHARES) + ONE) * M1), mixed(h))
    return (key % np.uint64(buckets)).astype(np.int64)


def map_anchors(docs: DataFrame, hot: np.ndarray, buckets: int, doc_buckets: int, minimum: int, kmer: int) -> DataFrame:
    """Rows (bucket, kind, to, blob): places for step 2, and marks of contexts that begin earlier in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            p, _, new = in_order({n: np.concatenate(v) for n, v in zip(("h", "c", "d", "doc", "s", "w"), zip(*parts, strict=True), strict=True)})
            marks = joined(whole_marks({n: v[~new] for n, v in p.items()}, minimum))
            p = {n: v[new] for n, v in p.items()}
            rows = [(b, "anchor", b, x) for b, x in dealt(p, "anchor", to_buckets(p["h"], mixed(p["doc"].astype(np.uint64)), is_in(p["h"], hot), buckets))]
            rows += [(b % buckets, "mark", b, x) for b, x in dealt(marks, "mark", bucket_of(marks["doc"], doc_buckets))]
            cols = zip(*rows, strict=True) if rows else ([],) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "to", "blob"])

        parts, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else b""
                if len(data) >= minimum:
                    h, c, d, s, w = anchors(data, minimum, kmer)
                    parts.append((h, c, d, np.full(len(h), doc, np.int64), s, w))
                    held += len(h)
                if held >= FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return docs.select(ID, TEXT).mapInArrow(run, "bucket int, kind string, to int, blob binary")


def settle(hot: np.ndarray, buckets: int, doc_buckets: int):
    """Step 2, for a bucket of anchors: representatives go to their text, further places straight to step 3; marks are handed on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_mark = pdf["kind"] == "mark"
        rows = [("mark", b, x) for b, x in zip(pdf["to"][is_mark].tolist(), pdf["blob"][is_mark], strict=True)]
        p, new_h, new = in_order(unpack(pdf["blob"][~is_mark], "anchor"))
        if not len(new):
            return table_of(rows)
        group, leaf = np.cumsum(new_h) - 1, np.cumsum(new) - 1
        busy = is_in(p["h"], hot)
        several = np.bincount(group, new)[group] > 1  # contexts of the anchor
        lone = ~several & ~busy & (np.bincount(leaf)[leaf] > 1)
        to = np.where(lone, bucket_of(p["doc"][new][leaf], buckets), to_buckets(p["h"], p["c"], busy, buckets))
        for kind, some in (("place", new & (several | busy)), ("lone", new & lone)):
            reps = {n: v[some] for n, v in p.items()}
            rows += [(kind, b, x) for b, x in dealt(reps, kind, bucket_of(reps["doc"], doc_buckets))]
        rows += [("also", b, x) for b, x in dealt({n: v[~new] for n, v in p.items()}, "also", to[~new])]
        return table_of(rows)

    return run


def fetch(hot: np.ndarray, buckets: int, minimum: int):
    """Bytes of the contexts, for a bucket of documents: rows (kind, bucket, records, bytes). Lone contexts that overlap share their bytes."""

    def run(texts: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        text = {d: t.encode() for d, t in zip(texts[ID], texts[TEXT], strict=True) if t} if len(blobs) else {}
        rows = []
        for kind in ("place", "lone"):
            p = unpack(blobs["blob"][blobs["kind"] == kind], kind)
            if not len(p["h"]):
                continue
            to = bucket_of(p["doc"], buckets) if kind == "lone" else to_buckets(p["h"], p["c"], is_in(p["h"], hot), buckets)
            order = np.lexsort((p["s"], p["doc"], to))
            p, to = {n: v[order] for n, v in p.items()}, to[order]
            ends = p["s"].astype(np.int64) + p["w"] + minimum - 1
            cuts = np.flatnonzero(np.append(True, np.diff(to) != 0))
            for a, b in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
                pieces, offsets, at, last = [], [], 0, (-1, 0, 0)  # last: document, end of its piece, and where the piece would begin if it began at 0
                for d, s, e in zip(p["doc"][a:b].tolist(), p["s"][a:b].tolist(), ends[a:b].tolist(), strict=True):
                    if kind == "lone" and last[0] == d and s <= last[1]:
                        if e > last[1]:
                            pieces.append(text[d][last[1] : e])
                            at += e - last[1]
                            last = (d, e, last[2])
                    else:
                        pieces.append(text[d][s:e])
                        last = (d, e, at - s)
                        at += e - s
                    offsets.append(last[2] + s)
                cols = {n: v[a:b] for n, v in p.items()} | {"o": np.array(offsets)}
                rows.append((kind, int(to[a]), pack(cols, "part"), b"".join(pieces)))
        return pd.DataFrame(rows, columns=["kind", "bucket", "blob", "bytes"])

    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Enhanced suffix array of the given suffixes: their order, and the common prefix of each with the one before."""
    width = int(lengths.max())
    padded = np.zeros((len(starts), width), np.uint8)
    step = max(1, (1 << 22) // width)
    for lo in range(0, len(starts), step):
        at = starts[lo : lo + step, None] + np.arange(width)[None, :]
        inside = np.arange(width)[None, :] < lengths[lo : lo + step, None]
        padded[lo : lo + step] = np.where(inside, data[np.minimum(at, len(data) - 1)] + 1, 0)  # UTF-8 has no byte 255
    order = np.argsort(padded.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(starts), np.int64)
    for lo in range(1, len(order), step):
        hi = min(len(order), lo + step)
        a, b = padded[order[lo - 1 : hi - 1]], padded[order[lo:hi]]
        differ = a != b
        found = differ.argmax(1)
        same = np.where(differ[np.arange(hi - lo), found], found, width)
        lcp[lo:hi] = np.minimum(same, np.minimum(lengths[order[lo - 1 : hi - 1]], lengths[order[lo:hi]]))
    return order, lcp


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, minimum: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) in suffix order of each left-diverse interval of the common-prefix interval tree.

    left: the left extension of each suffix in suffix order, a value of its own where there is none.
    """
    changes = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    joined = np.flatnonzero(lcp >= minimum)
    if not len(joined):
        return
    breaks = np.flatnonzero(np.diff(joined) > 1)
    firsts, lasts = np.append(joined[0], joined[breaks + 1]), np.append(joined[breaks], joined[-1])
    for lo, hi in zip(firsts.tolist(), lasts.tolist(), strict=True):
        if changes[hi] == changes[lo - 1]:
            continue  # every suffix of the run extends to the left alike
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate([*lcp[lo : hi + 1].tolist(), 0], lo):
            begin = i - 1
            while stack and stack[-1][0] > depth:
                length, begin = stack.pop()
                if changes[i - 1] != changes[begin]:
                    yield length, begin, i - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, begin))


def repeat_marks(p: dict[str, np.ndarray], begins: np.ndarray, lone: np.ndarray, more: dict[str, np.ndarray], data: np.ndarray, minimum: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Marks of all places of maximal repeat groups but the first; and each window in the array: its record in p, its place in data, whether a mark covers it.

    p: contexts whose bytes begin at `begins` in `data`, and whether they are alone in their
    anchor; more: further places of the same contexts. Contexts of p that are equal (from
    several shares of a hot anchor) are one leaf, too.
    """
    sizes = p["w"].astype(np.int64) + minimum - 1
    n = len(sizes)
    both, _, new = in_order({k: np.concatenate([p[k], more[k]]) for k in more} | {"at": np.arange(n + len(more["h"]))})
    firsts = both["at"][new]  # the first place of each context is one that has its bytes
    assert (firsts < n).all()
    leaves = whole_marks({k: v[~new] for k, v in both.items()}, minimum)
    keep = np.sort(firsts)
    windows = np.where(lone[keep], 1, p["w"][keep]).astype(np.int64)
    record = np.repeat(keep, windows)
    within = np.arange(len(record)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = begins[record] + within
    by, lcp = suffix_order(data, starts, sizes[record] - within)
    left = np.where(within > 0, data[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))[by]
    doc, s = p["doc"][record], p["s"][record].astype(np.int64) + within
    rank = np.empty(len(by), np.int64)
    rank[np.lexsort((s, doc))] = np.arange(len(by))
    rank = rank[by]
    settled = np.zeros(len(record), bool)
    docs, at, lengths = [leaves["doc"]], [leaves["s"].astype(np.int64)], [leaves["n"].astype(np.int64)]
    for length, lo, hi in maximal_repeats(lcp, left, minimum):
        places = by[lo : hi + 1]
        others = np.delete(places, int(rank[lo : hi + 1].argmin()))
        docs.append(doc[others])
        at.append(s[others])
        lengths.append(np.full(len(others), length))
        for k in range(length - minimum + 1):
            settled[others + k] = True
    return {"doc": np.concatenate(docs), "s": np.concatenate(at), "n": np.concatenate(lengths)}, record, starts, settled


def joined(marks: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The same cover in fewer marks: those of a document that overlap or touch are one."""
    order = np.lexsort((marks["s"], marks["doc"]))
    doc, s = marks["doc"][order], marks["s"][order].astype(np.int64)
    if not len(doc):
        return marks
    group = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << np.int64(33)  # a text is shorter than 2**32 bytes
    reach = np.maximum.accumulate(group + s + marks["n"][order].astype(np.int64))
    new = np.append(True, (group + s)[1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return {"doc": doc[new], "s": s[new], "n": reach[ends] - (group + s)[new]}


def fingerprints(data: np.ndarray, starts: np.ndarray, length: int, step: int = 1 << 20) -> np.ndarray:
    """Two hashes of the `length` bytes at each start; only parts of the data that hold a start are read."""
    out = np.zeros((2, len(starts)), np.uint64)
    part = starts // step
    for k in np.unique(part).tolist():
        some, seg = np.flatnonzero(part == k), data[k * step : (k + 1) * step + length - 1]
        for which in (0, 1):
            out[which, some] = hashes(seg, length, which)[starts[some] - k * step]
    return out


def groups_of(h: np.ndarray, windows: np.ndarray, most: int = WINDOWS) -> Iterator[np.ndarray]:
    """Records in groups of whole anchors, of about `most` windows each."""
    order = np.argsort(h, kind="stable")
    ends = np.cumsum(windows[order])
    begins = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))  # of the anchors
    lo = 0
    while lo < len(order):
        at = np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")
        cut = begins[np.searchsorted(begins, at, "right") - 1] if at < len(order) else len(order)
        if cut <= lo:  # an anchor that has more windows alone
            later = begins[begins > lo]
            cut = later[0] if len(later) else len(order)
        yield order[lo:cut]
        lo = cut


def by_array(hot: np.ndarray, doc_buckets: int, buckets: int, minimum: int):
    """Step 3, for a bucket of contexts; windows of hot anchors that are not settled go on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        with_bytes = pdf[pdf["bytes"].notna()]
        further = unpack(pdf["blob"][pdf["bytes"].isna()], "also")
        parts = [unpack([blob], "part") for blob in with_bytes["blob"]]
        if not parts:
            return table_of([])
        every = {n: np.concatenate([x[n] for x in parts]) for n in parts[0]}
        counts = [len(x["h"]) for x in parts]
        alone = np.repeat((with_bytes["kind"] == "lone").to_numpy(), counts)
        sizes = np.array([len(x) for x in with_bytes["bytes"]], np.int64)
        places = np.repeat(np.cumsum(sizes) - sizes, counts) + every["o"]
        data = np.frombuffer(b"".join(with_bytes["bytes"]), np.uint8)
        del pdf, with_bytes, parts
        by_h = np.argsort(further["h"], kind="stable")
        further = {n: v[by_h] for n, v in further.items()}
        found, on = [], []  # marks; windows of hot anchors that are left: record, place in data
        for some in groups_of(every["h"], np.where(alone, 1, every["w"])):
            p, begins, lone = {n: v[some] for n, v in every.items()}, places[some], alone[some]
            lo, hi = np.searchsorted(further["h"], p["h"].min(), "left"), np.searchsorted(further["h"], p["h"].max(), "right")
            marks, record, starts, settled = repeat_marks(p, begins, lone, {n: v[lo:hi] for n, v in further.items()}, data, minimum)
            found.append(marks)
            left = np.flatnonzero(is_in(p["h"], hot)[record] & ~settled)
            on.append(np.stack([some[record[left]], starts[left]]))
        record, starts = np.concatenate(on, axis=1)
        f, g = fingerprints(data, starts, minimum)
        windows = {"f": f, "g": g, "h": every["h"][record], "doc": every["doc"][record], "s": every["s"][record].astype(np.int64) + starts - places[record]}
        rows = [("window", b, x) for b, x in dealt(windows, "window", (windows["f"] % np.uint64(buckets)).astype(np.int64))]
        marks = joined({n: np.concatenate([m[n] for m in found]) for n in found[0]})
        return table_of(rows + [("mark", b, x) for b, x in dealt(marks, "mark", bucket_of(marks["doc"], doc_buckets))])

    return run


def by_window(doc_buckets: int, minimum: int):
    """Step 3b: among equal windows from several shares of a hot anchor, the first place stays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = unpack(pdf["blob"], "window")
        order = np.lexsort((w["s"], w["doc"], w["g"], w["f"], w["h"]))
        w = {n: v[order] for n, v in w.items()}
        later = np.append(False, np.all([w[k][1:] == w[k][:-1] for k in ("f", "g", "h")], axis=0))
        marks = {"doc": w["doc"][later], "s": w["s"][later], "n": np.full(int(later.sum()), minimum)}
        return table_of([("mark", b, x) for b, x in dealt(marks, "mark", bucket_of(marks["doc"], doc_buckets))])

    return run


def spans_of(s: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that the marks cover; runs that touch are one."""
    order = np.argsort(s, kind="stable")
    s, e = s[order].astype(np.int64), (s[order].astype(np.int64) + n[order])
    reach = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > reach[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return list(zip(s[new].tolist(), reach[ends].tolist(), strict=True))


def cutter(with_text: bool):
    def run(texts: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        m = unpack(blobs["blob"], "mark")
        order = np.argsort(m["doc"], kind="stable")
        m = {n: v[order] for n, v in m.items()}
        rows = []
        for doc, text in zip(texts[ID].tolist(), texts[TEXT], strict=True):
            data = (text or "").encode()
            lo, hi = np.searchsorted(m["doc"], [doc, doc + 1])
            spans = spans_of(m["s"][lo:hi], m["n"][lo:hi]) if hi > lo else []
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            rest = b"".join(kept) + data[at:]
            row = (doc, len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
            rows.append((*row, rest.decode("utf-8", "ignore")) if with_text else row)
        return pd.DataFrame(rows, columns=[ID, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return run


def identified(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, bool]:
    """(docs with ID and TEXT, whether ID is the id). Ids that aren't whole numbers from 0 on, are null or repeat are replaced by an order."""
    own = F.col(f"`{id_col}`")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        ids = docs.select(own.alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
        if ids.where("i is null or n > 1 or i < 0").isEmpty():
            return docs.withColumns({ID: own.cast("long"), TEXT: F.col(f"`{text}`")}), True
    is_text = isinstance(docs.schema[text].dataType, T.StringType)
    content = F.col(f"`{text}`") if is_text else F.to_json(F.struct(F.col(f"`{text}`")))
    order = [own.asc_nulls_last(), F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)]
    parts = common.scan_parts(docs)
    sorted_docs = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.materialize(sorted_docs.withColumns({ID: F.monotonically_increasing_id(), TEXT: F.col(f"`{text}`")})), False


def cut(docs: DataFrame, minimum: int = MIN, kmer: int = KMER, with_text: bool = False, hot: tuple[int, int] = (HOT_ONE_IN, HOT_AT)) -> DataFrame:
    """ID, n_bytes, n_removed, n_spans, kept_sha256 (and kept) of identified documents."""
    spark = docs.sparkSession
    parts = common.scan_parts(docs)
    doc_buckets, buckets = max(8, 2 * parts), max(8, 2 * parts)
    busy = hot_anchors(docs, minimum, kmer, *hot)
    found = map_anchors(docs, busy, buckets, doc_buckets, minimum, kmer).groupBy("bucket").applyInPandas(settle(busy, buckets, doc_buckets), OUT)
    settled = common.materialize(found)
    common.release(spark)
    texts = docs.select(ID, TEXT, bucket_column(doc_buckets).alias("bucket"))
    contexts = (
        texts.groupBy("bucket")
        .cogroup(settled.where("kind in ('place', 'lone')").groupBy("bucket"))
        .applyInPandas(fetch(busy, buckets, minimum), "kind string, bucket int, blob binary, bytes binary")
        .unionByName(settled.where("kind = 'also'").select("kind", "bucket", "blob", F.lit(None).cast("binary").alias("bytes")))
    )
    grouped = common.materialize(contexts.groupBy("bucket").applyInPandas(by_array(busy, doc_buckets, buckets, minimum), OUT))
    common.release(spark)
    marks = settled.where("kind = 'mark'").unionByName(grouped.where("kind = 'mark'"))
    if len(busy):
        marks = marks.unionByName(grouped.where("kind = 'window'").groupBy("bucket").applyInPandas(by_window(doc_buckets, minimum), OUT))
    schema = f"{ID} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(cutter(with_text), schema)


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs without their text, with n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text that is left, if with_text).

    Columns of docs that are named like these are replaced.
    """
    docs, same_ids = identified(docs, id_col, text)
    out = cut(docs, **more)
    others = [c for c in docs.columns if c not in (text, TEXT, *OUTPUTS)]
    if others == [id_col, ID] and same_ids:
        return out.select(F.col(ID).cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c != ID])
    return docs.select(*[F.col(f"`{c}`") for c in others]).join(out, ID).drop(ID)


def stripped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **more) -> DataFrame:
    """docs with the text that is left and its length in `n_chars` (if docs have it), and all other columns as they are.

    A character that is cut in part goes as a whole.
    """
    names = docs.columns
    docs, _ = identified(docs, id_col, text)
    left = f"{ID}_left"
    out = cut(docs, with_text=True, **more).select(ID, F.col("kept").alias(left))
    made = {text: F.col(left), n_chars: F.length(left).cast("long")}
    return docs.drop(TEXT).drop(F.col(f"`{text}`")).join(out, ID).select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in names])
