"""Embedding near-duplicates by product quantisation with coarse inverted lists.

Unit vectors go to the nearest of the coarse centres, whose number grows like the root of the
number of vectors; what is left (the residual) is coded by SUBSPACES codebooks of CODES
entries. Each vector visits the lists of its nearest centres, as many as a measurement
asks for (below). In a list, visitors and members are compared by table-lookup (asymmetric)
distances, a matrix of tables for all of them at once, and only pairs that pass are compared
exactly, in double precision. The distance to a code less its stored coding error never
exceeds the true distance, so the lookup itself loses nothing.

Probes: the fitting sample is searched exactly for linked pairs, and the probes are
2 more than the deepest place at which one of a pair finds the list of the other (LEAST_PROBES
at least). A pair counts for both of its vectors if either visits the other's list: a member
knows its own visits, so a pair that is met twice counts once for each side.

Centres and codebooks are fitted on at most SAMPLE vectors (chosen by a hash of the row);
every vector is indexed and every vector is a query. Vectors of different lengths never
link; each length that is frequent in the sample has its own model, the vectors of another
length are one list that is compared exactly.

Vectors that are equal (and have equal labels) are one class with a count. Work is dealt by
label, list and pairs of blocks of BLOCK vectors, so a hot label or list is shared by many
tasks; tasks hand on counts and spanning links, never pairs.

Null, empty and zero vectors, vectors with null or non-finite components, and rows with a null
label link with nothing. Ids that repeat or are null: see `repeats.identified`, each row counts
as a vector. Labels and ids may be of any type. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import classes, with_classes
from .repeats import ID, TEXT, identified

COSINE = 0.93
SUBSPACES, CODES, SAMPLE = 8, 64, 20_000
#: Lists for each root of the number of vectors, and the sampled vectors that a list has at least.
LISTS_A_ROOT, LEAST_A_LIST = 2.0, 8
#: Sampled vectors that are searched exactly to choose the probes, and the fewest probes.
QUERIES, LEAST_PROBES = 2000, 6
BLOCK = 2048
#: Rows of the index that one task takes, about.
TASK_ROWS = 50_000
STEPS = 12
SLACK = 1e-6


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T)


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1, step: int = 2048) -> np.ndarray:
    """The k nearest centres of each row, the nearest first."""
    out = np.zeros((len(x), k), np.int32)
    for lo in range(0, len(x), step):
        d = distances(x[lo : lo + step], centres)
        some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        by = np.take_along_axis(d, some, 1).argsort(1, kind="stable")
        out[lo : lo + step] = np.take_along_axis(some, by, 1)
    return out


def kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(steps):
        at = nearest(x, centres)[:, 0]
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=k)
        starts = np.cumsum(n) - n
        total = np.add.reduceat(x[order], starts[n > 0], axis=0)
        centres[n > 0] = total / n[n > 0, None]
    return centres


def fit(x: np.ndarray, labels: np.ndarray, n: int, cosine: float = COSINE, lists: int | None = None, subspaces: int = SUBSPACES, codes: int = CODES) -> dict:
    """Centres, codebooks and probes from a sample of unit vectors and their labels, for n vectors in all."""
    want = lists or math.ceil(LISTS_A_ROOT * math.sqrt(n))
    centres = kmeans(x, max(1, min(want, len(x) // LEAST_A_LIST)))
    at = nearest(x, centres)[:, 0]
    cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
    rest = x - centres[at]
    books = [kmeans(rest[:, a:b], codes) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    deepest = 0
    for lo in range(0, min(QUERIES, len(x)), 256):
        q = np.arange(lo, min(lo + 256, QUERIES, len(x)))
        i, j = np.nonzero((x[q] @ x.T >= cosine) & (labels[q][:, None] == labels[None]) & (q[:, None] != np.arange(len(x))[None]))
        if len(i):
            d = distances(x[q], centres)
            there = (d[i] < d[i, at[j]][:, None]).sum(1)  # place of j's list for i
            back = np.concatenate([(distances(x[j[k : k + 4096]], centres) < distances(x[j[k : k + 4096]], centres)[np.arange(len(j[k : k + 4096])), at[q[i[k : k + 4096]]]][:, None]).sum(1) for k in range(0, len(j), 4096)])
            deepest = max(deepest, int(np.minimum(there, back).max()))
    return {"centres": centres, "cuts": cuts, "books": books, "probes": min(len(centres), max(LEAST_PROBES, deepest + 3))}


def encode(x: np.ndarray, at: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(codes, coding errors) of vectors in their lists."""
    rest = x - model["centres"][at]
    codes = np.zeros((len(x), len(model["books"])), np.uint8)
    back = np.zeros_like(rest)
    for k, (book, a, b) in enumerate(zip(model["books"], model["cuts"][:-1], model["cuts"][1:], strict=True)):
        codes[:, k] = nearest(rest[:, a:b], book)[:, 0]
        back[:, a:b] = book[codes[:, k]]
    return codes, np.sqrt(((rest - back) ** 2).sum(1))


def units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; rows without a direction become NaN."""
    x = raw.astype(np.float64)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(1, initial=0)[:, None]
        return x / np.sqrt((x * x).sum(1))[:, None]


def keyed(rows: DataFrame, single: bool) -> DataFrame:
    """Usable vectors of rows (ID, label, TEXT: the vector): doc, label, dim, key (a digest of the vector) and vec (its components)."""
    kind, names = np.dtype("<f4" if single else "<f8"), ["doc", "label", "dim", "key", "vec"]
    types = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (batch.column(i) for i in range(3))
            size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # null is NaN; -0.0 is 0.0
            starts, known = np.cumsum(size) - size, np.asarray(labels.is_valid())
            out: list[list] = [[] for _ in names]
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero((size == dim) & known)
                for lo in range(0, len(at), max(1, (1 << 22) // dim)):
                    some = at[lo : lo + max(1, (1 << 22) // dim)]
                    raw = flat[starts[some][:, None] + np.arange(dim)[None]]
                    ok = np.isfinite(raw).all(1) & (raw != 0).any(1)
                    blobs = [r.tobytes() for r in raw[ok]]
                    keys = [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
                    for c, v in zip(out, (ids.take(pa.array(some[ok])).to_pylist(), labels.take(pa.array(some[ok])).to_pylist(), [dim] * len(blobs), keys, blobs), strict=True):
                        c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc long, label string, dim int, key binary, vec binary")


def matrix(blobs, dim: int, kind: np.dtype) -> np.ndarray:
    return units(np.frombuffer(b"".join(blobs), kind).reshape(-1, dim))


def indexed(reps: DataFrame, models: dict[int, dict], kind: np.dtype) -> DataFrame:
    """Each vector as a member of its list (with codes, coding error and the lists that it visits) and once for each visit."""
    names = ["doc", "label", "dim", "vec", "copies", "list", "home", "codes", "error", "visits"]
    types = (None, None, None, None, None, pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                dims = np.asarray(part.column(2))
                for dim in np.unique(dims).tolist():
                    some = part.take(pa.array(np.flatnonzero(dims == dim)))
                    n, model = some.num_rows, models.get(dim)
                    lists, codes, error = np.zeros((n, 1), np.int32), [b""] * n, np.zeros(n)
                    if model:
                        x = matrix(some.column(3).to_pylist(), dim, kind)
                        lists = nearest(x, model["centres"], model["probes"])
                        code, error = encode(x, lists[:, 0], model)
                        codes = [c.tobytes() for c in code]
                    rows, home = np.repeat(np.arange(n), lists.shape[1]), np.repeat(lists[:, 0], lists.shape[1])
                    member = np.tile(np.arange(lists.shape[1]) == 0, n).tolist()
                    own = [
                        lists.ravel(), home, [codes[r] if m else None for r, m in zip(rows.tolist(), member, strict=True)], error[rows],
                        [lists[r, 1:].tolist() if m else None for r, m in zip(rows.tolist(), member, strict=True)],
                    ]
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([*(some.column(k).take(take) for k in range(5)), *(pa.array(v, t) for v, t in zip(own, types[5:], strict=True))], names=names)

    return reps.select(*names[:5]).mapInArrow(run, "doc long, label string, dim int, vec binary, copies long, list int, home int, codes binary, error double, visits array<int>")


def compare(q: dict, b: dict, model: dict | None, place: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of the queries, links that members owe to visitors that they don't visit, (query, member) rows of links that span)."""
    n_q, n_b = np.zeros(len(q["doc"]), np.int64), np.zeros(len(b["doc"]), np.int64)
    names = np.unique(np.concatenate([b["doc"], q["doc"]]))
    root = np.arange(len(names))
    b_at, q_at = np.searchsorted(names, b["doc"]), np.searchsorted(names, q["doc"])

    x, y = q["x"], b["x"]
    homes, at_home = np.unique(q["home"], return_inverse=True)
    seen = np.zeros((len(homes), len(y)), bool)  # whether a member comes to the home of a query
    for k, h in enumerate(homes.tolist()):
        seen[k] = (h == place) | (b["visits"] == h).any(1)
    if model:
        reach = float(np.sqrt(2 - 2 * cosine))
        limit = (reach + b["error"] + SLACK) ** 2
        codes = b["codes"]
    step = max(1, (1 << 21) // max(1, len(y)))
    for lo in range(0, len(x), step):
        part = x[lo : lo + step]
        if model:
            far = np.zeros((len(part), len(y)))
            for k, (book, c0, c1) in enumerate(zip(model["books"], model["cuts"][:-1], model["cuts"][1:], strict=True)):
                table = distances(part[:, c0:c1] - model["centres"][place][c0:c1], book)
                far += table[:, codes[:, k]]
            i, j = np.nonzero(far <= limit[None])
        else:
            i, j = (v.ravel() for v in np.indices((len(part), len(y))))
        for k in range(0, len(i), 1 << 16):
            a, c = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            linked = (np.einsum("ij,ij->i", part[a], y[c]) >= cosine) & (q_at[lo + a] != b_at[c])
            a, c = a[linked] + lo, c[linked]
            np.add.at(n_q, a, b["copies"][c])
            owed = ~seen[at_home[a], c]
            np.add.at(n_b, c[owed], q["copies"][a[owed]])
            u, v = q_at[a], b_at[c]
            while (apart := root[u] != root[v]).any():
                u, v = u[apart], v[apart]
                np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
    moved = np.flatnonzero(root != np.arange(len(names)))
    return n_q, n_b, np.stack([names[moved], names[root[moved]]]) if len(moved) else np.zeros((2, 0), np.int64)


def link(models: dict[int, dict], cosine: float, kind: np.dtype):
    """Several pairs of a block of queries and a block of members: counts of links and spanning links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, top, n = [], [], []
        for (_, dim, place, _, _), at in pdf.groupby(["label", "dim", "list", "i", "j"], sort=False).indices.items():
            some = pdf.iloc[at]
            role = some["role"].to_numpy()
            is_q, is_b = (role & 2) > 0, (role & 1) > 0
            if not is_q.any() or not is_b.any():
                continue
            x, ids, copies, home = matrix(some["vec"], dim, kind), some["doc"].to_numpy(), some["copies"].to_numpy(), some["home"].to_numpy()
            member = some[is_b]
            b = {
                "doc": ids[is_b], "x": x[is_b], "copies": copies[is_b], "error": member["error"].to_numpy(),
                "visits": np.array(member["visits"].tolist(), np.int32).reshape(len(member), -1), "codes": np.frombuffer(b"".join(member["codes"]), np.uint8).reshape(len(member), -1),
            }
            q = {"doc": ids[is_q], "x": x[is_q], "copies": copies[is_q], "home": home[is_q]}
            n_q, n_b, spans = compare(q, b, models.get(dim), place, cosine)
            for ids_, count in ((q["doc"], n_q), (b["doc"], n_b)):
                doc.append(ids_[count > 0])
                top.append(ids_[count > 0])
                n.append(count[count > 0])
            doc.append(spans[0])
            top.append(spans[1])
            n.append(np.zeros(spans.shape[1], np.int64))
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in (("doc", doc), ("n", n), ("top", top))})

    return run


def near_links(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", lists: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").alias("embedding"))
    single = isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType)
    rows = rows if single else rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = np.dtype("<f4" if single else "<f8")
    rows, same_ids = identified(rows, "vec_id", "embedding")
    usable = common.materialize(keyed(rows.select(ID, "label", TEXT), single))
    equal = common.materialize(usable.groupBy("label", "key").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copied = common.materialize(usable.select("doc", "label", "key").join(equal, ["label", "key"]).select("doc", "rep", "copies"))
    reps = usable.join(copied.where("doc != rep").select("doc"), "doc", "left_anti").join(copied.where("doc = rep").select("doc", "copies"), "doc", "left")
    reps = common.materialize(reps.select("doc", "label", "dim", "vec", F.coalesce("copies", F.lit(1)).alias("copies")))
    fitted = reps.orderBy(F.xxhash64(F.lit("pq"), "doc"), "doc").limit(sample).select("label", "dim", "vec").toPandas()
    often = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * LEAST_A_LIST)
    n_of = {r["dim"]: r["n"] for r in often.orderBy(F.desc("n"), "dim").limit(sample).collect()}
    models = {}
    for dim, part in fitted.groupby("dim"):
        if dim in n_of and len(part) >= 2 * LEAST_A_LIST:
            models[int(dim)] = fit(matrix(part["vec"], int(dim), kind), pd.factorize(part["label"])[0], n_of[dim], cosine, lists)
    index = common.materialize(indexed(reps, models, kind))
    # Blocks of the members and of the visitors (members, too) of each list; each meets all blocks of the other side.
    of = ["label", "dim", "list"]
    counts = index.groupBy(*of).agg(F.count(F.when(F.col("codes").isNotNull(), 1)).alias("members"), F.count(F.lit(1)).alias("n")).where("members > 0 and n > 1")
    placed = index.join(counts.select(*of, F.ceil(F.col("members") / block).cast("int").alias("bs"), F.ceil(F.col("n") / block).cast("int").alias("qs")), of)
    member, spot = F.col("codes").isNotNull(), F.xxhash64("doc")
    own_q, own_b = F.pmod(spot, F.col("qs")).cast("int"), F.pmod(spot, F.col("bs")).cast("int")

    def cell(i, j, role):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))

    asks = F.transform(F.sequence(F.lit(0), F.col("bs") - 1), lambda j: cell(own_q, j, 2))
    serves = F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda i: cell(i, own_b, 1))
    cells = F.when(~member, asks).when((F.col("bs") == 1) & (F.col("qs") == 1), F.array(cell(F.lit(0), F.lit(0), 3))).otherwise(F.concat(asks, serves))
    tasks = placed.withColumn("cell", F.explode(cells)).select(*of, "cell.i", "cell.j", "cell.role", "doc", "vec", "copies", "home", "codes", "error", "visits")
    parts = max(8, math.ceil(index.count() / TASK_ROWS))
    dealt = tasks.withColumn("part", F.pmod(F.xxhash64(*of, "i", "j"), F.lit(parts)).cast("int"))
    found = common.materialize(dealt.groupBy("part").applyInPandas(link(models, cosine, kind), "doc long, n long, top long"))
    done = with_classes(rows.select(ID, "vec_id"), classes(found, copied), ID, "vec_id", same_ids)
    return done.select("vec_id", F.col("_links").alias("n_links"), F.col("_class").alias("component_id"), F.col("_kept").alias("kept"))
