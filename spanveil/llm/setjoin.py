"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles. Every run of the join chooses, at each node of
a tree of paths, the tokens of a set whose hash (seeded by run and path) is under
1 / (LAMBDA * size); sets that choose the same token move on to the same child. Two sets of
similarity LAMBDA share one child a node on average, so they survive to the bottom of some
run with the recall that `runs_for` aims at. A node with few sets is solved by brute force
where it stands; only larger nodes are split further, down to DEPTH tokens.

1. Signatures, one row a document: a digest of the set, a bin sketch, the paths of all runs.
   Sets that are equal become one class with a count; one document of each class goes on.
2. Nodes: classes on the same path. Nodes with one class are dropped, large nodes are split
   into their children. In a small node all pairs of sketches are compared; a pair that
   `least_same` lets through is a tie. Ties only say what must be checked together: a node
   hands on a spanning forest of them, never pairs. A node that is still large at the bottom
   is led in shares: leaders are compared with all others, then the leaders of the shares.
3. Groups (components of step 2) read their texts again and are solved exactly, as products
   of set matrices in blocks of BLOCK: each class counts its links (Jaccard >= LAMBDA, by
   integers) and hands on links of a spanning forest. Large groups are dealt as pairs of
   blocks, so that no task holds more than two blocks.
4. Components of the exact links are the classes of the result.

Only ids, paths and sketches are shuffled before step 3, and there only the sets of grouped
documents: a fixed-size bit filter of their ids (`common.maybe`) is broadcast to the scan.
Signatures are held on the executors' disks until step 3; the other tables that are written are
small and get few files (`common.gather`).

The result has one row a document: class_id (smallest id that its links reach), n_links
(documents linked directly, copies included) and kept (doc_id = class_id).

Words are runs of characters other than ASCII white space; fewer than five make one
shingle. Null, empty or white texts link with nothing. Ids that repeat or are null: see
`repeats.identified`, rows count as documents of their own. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import classes, components, with_classes
from .repeats import ID, TEXT, identified, mixed

LAMBDA = (4, 5)
WORDS = 5
DEPTH = 3
BINS = 64
RECALL = 0.999
#: A node with more classes than this is split further.
NODE = 512
#: Large nodes that are broadcast, 8 bytes each, so that the children of others aren't shuffled; more are joined by a shuffle.
SENT = 1 << 20
BLOCK = 2048
#: Rows of a node that are led in one place.
SHARE = 4096
#: Sketch similarity: under LEAD a member leads, too; over TIE it is tied to the leader.
LEAD, TIE = 0.45, 0.25
#: Share of pairs of similarity LAMBDA that the comparison of their sketches may miss.
MISS = 1e-6
CACHE = 150_000
#: Hashes of tokens by nodes that are held at once, 8 bytes each.
CELLS = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
PRIME = np.uint64(0xC2B2AE3D27D4EB4F)


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair of similarity LAMBDA is found with this probability, even at full depth."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, ids: WordIds, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    split = (text or "").encode("utf-8", "replace").split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(ids.__getitem__, split), np.uint64, len(split))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * GOLD
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def sketch(s: np.ndarray, bins: int = BINS) -> bytes:
    """One byte a bin of the hash space: of its smallest hash, 0 if it is empty."""
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(64 - int(math.log2(bins)))
    at = np.searchsorted(s, edges)
    ends = np.append(at[1:], len(s))
    low = s[np.minimum(at, len(s) - 1)]
    return np.where(ends > at, (mixed(low) % np.uint64(255) + np.uint64(1)), np.uint64(0)).astype(np.uint8).tobytes()


def children(s: np.ndarray, parents: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(place of the parent, child) for each token that a node chooses: all nodes of a level at once, CELLS hashes at a time."""
    width, found = max(1, CELLS // len(parents)), []
    for lo in range(0, len(s), width):
        at, token = np.nonzero((s[None, lo : lo + width] ^ parents[:, None]) * (parents[:, None] | np.uint64(1)) * PRIME < limit)
        found.append((at, token + lo))
    at, token = (np.concatenate(x) for x in zip(*found, strict=True))
    return at.astype(np.uint64), mixed((s[token] * GOLD) ^ parents[at])


def paths_of(s: np.ndarray, roots: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, (places of the parents, nodes) of the set's chosen paths in all runs."""
    limit = np.uint64(min(2**64 - 1, int(2**64 * LAMBDA[1] / (LAMBDA[0] * len(s)))))
    out, level = [], roots
    for _ in range(depth):
        parent, node = children(s, level, limit) if len(level) else (level, level)
        out.append((parent, node))
        level = node
    return out


def signatures(docs: DataFrame, runs: int) -> DataFrame:
    """doc, digest, sketch, and the nodes of each level (l1, l2, l3) with the places of their parents in the level above (p2, p3)."""
    names = ["doc", "digest", "sketch", "l1"] + [f"{c}{k}" for k in range(2, DEPTH + 1) for c in ("p", "l")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots = WordIds(), mixed(np.arange(1, runs + 1, dtype=np.uint64) * GOLD)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                heads: list[tuple] = []
                levels: list[list[tuple[np.ndarray, np.ndarray]]] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingles(text, ids)
                    if len(s):
                        heads.append((doc, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s)))
                        levels.append(paths_of(s, roots))
                cols = [pa.array([h[i] for h in heads], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
                for k in range(DEPTH):
                    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[k][1]) for x in levels])]).astype(np.int32))
                    for side, kind in ((0, np.int32), (1, np.int64)):
                        if k or side:
                            flat = np.concatenate([x[k][side] for x in levels]) if levels else np.zeros(0, np.uint64)
                            cols.append(pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64).astype(kind))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    arrays = ", ".join(f"{n} array<{'int' if n[0] == 'p' else 'long'}>" for n in names[3:])
    return docs.select(ID, TEXT).mapInArrow(run, f"doc long, digest binary, sketch binary, {arrays}")


@lru_cache
def least_same(miss: float = MISS, bins: int = BINS) -> np.ndarray:
    """For each number of bins that either set fills: equal ones that a pair of similarity LAMBDA has but for `miss` of such pairs."""
    p, out = LAMBDA[0] / LAMBDA[1], [0]
    for k in range(1, bins + 1):
        below, s = 0.0, 0
        while (below := below + math.comb(k, s) * p**s * (1 - p) ** (k - s)) <= miss:
            s += 1
        out.append(s)
    return np.array(out)


def brute(sketches: np.ndarray) -> np.ndarray:
    """For each member of a small node the first member that its ties reach: all pairs of sketches are compared."""
    n, least = len(sketches), least_same()
    filled = sketches != 0
    tied_to = np.arange(n)
    for i in range(1, n):
        same = ((sketches[:i] == sketches[i]) & filled[i]).sum(1)
        meet = np.unique(tied_to[:i][same >= least[(filled[:i] | filled[i]).sum(1)]])
        if len(meet):
            tied_to[i] = meet[0]
            if len(meet) > 1:
                tied_to[: i + 1][np.isin(tied_to[: i + 1], meet)] = meet[0]
    return tied_to


def lead(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each member of a node the first member that it is tied to, over any number of leaders; the leaders).

    Work is members times leaders, not pairs, and each member yields one tie.
    """
    n = len(sketches)
    open_, tied_to, leaders = np.ones(n, bool), np.arange(n), []
    filled = sketches != 0
    while True:
        at = int(open_.argmax())
        if not open_[at]:
            break
        either = (filled | filled[at]).sum(1)
        same = ((sketches == sketches[at]) & filled).sum(1) / np.maximum(either, 1)
        loose = np.minimum(1.0, either / BINS)  # fewer filled bins tell less
        tied = same >= TIE * loose
        tied[at] = True
        open_ &= same < LEAD + (1 - loose) * 0.3
        open_[at] = False
        meet = np.unique(tied_to[tied])
        if len(meet) > 1:
            tied_to[np.isin(tied_to, meet)] = meet[0]
        leaders.append(at)
    return tied_to, np.array(leaders)


def ties(nodes: DataFrame, parts: int, limit: int = NODE) -> DataFrame:
    """(node, a, b) from nodes (node, doc, sketch, shares): ties (a != b; node is 0), and the leaders (a = b) of nodes in several shares."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, node, share = (pdf[c].to_numpy() for c in ("doc", "node", "share"))
        sk = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(doc), -1)
        order = np.lexsort((doc, share, node))
        doc, sk, node, share, many = doc[order], sk[order], node[order], share[order], pdf["shares"].to_numpy()[order] > 1
        cuts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (share[1:] != share[:-1])))
        at, a, b = [], [], []
        for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(node)).tolist(), strict=True):
            tied_to, leaders = lead(sk[lo:hi]) if many[lo] or hi - lo > limit else (brute(sk[lo:hi]), None)
            m = np.flatnonzero(tied_to != np.arange(hi - lo))
            a.append(doc[lo:hi][m])
            b.append(doc[lo:hi][tied_to[m]])
            at.append(np.zeros(len(m), np.int64))
            if many[lo]:
                a.append(doc[lo:hi][leaders])
                b.append(doc[lo:hi][leaders])
                at.append(node[lo:hi][leaders])
        cols = {k: np.concatenate(v) if v else [] for k, v in (("node", at), ("a", a), ("b", b))}
        return pd.DataFrame(cols, dtype="int64").drop_duplicates()

    dealt = nodes.withColumn("share", F.pmod(F.xxhash64("doc"), F.col("shares")).cast("int"))
    return dealt.withColumn("part", F.pmod(F.xxhash64("node", "share"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(run, "node long, a long, b long")


def sketched(nodes: DataFrame, sig: DataFrame) -> DataFrame:
    """nodes with the sketches of their documents, by a merge join at every size: both sides grow with the corpus."""
    return nodes.join(sig.select("doc", "sketch").hint("merge"), "doc")


def all_ties(nodes: DataFrame, sig: DataFrame, parts: int, limit: int = NODE) -> DataFrame:
    """(a, b) of all nodes. Shares of a large node are led apart, then their leaders meet."""
    first = common.gather(ties(sketched(nodes, sig), parts, limit))
    heads = first.where("a = b").select("node", F.col("a").alias("doc")).withColumn("shares", F.lit(1))
    if heads.isEmpty():
        return first.select("a", "b")
    again = common.gather(ties(sketched(heads, sig), parts, limit))
    return first.select("a", "b").unionByName(again.select("a", "b")).where("a != b")


def nodes_of(reps: DataFrame, limit: int = NODE, depth: int = DEPTH) -> DataFrame:
    """(node, doc, shares): the nodes to solve. A large node is split into its children, down to `depth`.

    Nodes with one class, most of all nodes, are dropped before anything is joined.
    """
    rows = reps.select("doc", F.explode("l1").alias("node"))
    solve = None
    for level in range(1, depth + 1):
        counts = common.gather(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        last = level == depth
        now = counts if last else counts.where(F.col("n") <= limit)
        here = rows.join(now.select("node", F.ceil(F.col("n") / SHARE).cast("int").alias("shares")), "node")
        solve = here if solve is None else solve.unionByName(here)
        if last:
            break
        large = counts.where(F.col("n") > limit).select(F.col("node").alias("parent"))
        many = large.count()
        if not many:
            break
        above, below = F.col(f"l{level}"), F.arrays_zip(F.col(f"p{level + 1}").alias("p"), F.col(f"l{level + 1}").alias("node"))
        down = reps.select("doc", F.explode(F.transform(below, lambda x: F.struct(F.get(above, x["p"]).alias("parent"), x["node"].alias("node")))).alias("x"))
        rows = common.gather(down.select("doc", "x.parent", "x.node").join(F.broadcast(large) if many <= SENT else large, "parent").select("doc", "node"))
    return solve


def block_links(sets: list[np.ndarray], rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, positions linked with i) for the first `rows` sets against all sets, by exact intersections."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[token] > 1
    owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
    common_ = np.zeros((rows, len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    width = max(256, (8 << 20) // max(1, len(sets)))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(token[-1]) + 1 - lo)), np.float32)
        m[owner[a:b], token[a:b] - lo] = 1
        common_ += m[:rows] @ m.T
    p, q = LAMBDA
    for i in range(rows):
        both = common_[i].astype(np.int64)
        yield i, np.flatnonzero((both * q >= p * (sizes[i] + sizes - both)) & (np.arange(len(sets)) != i))


def solve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks (or one block) of a group: link counts weighed by copies, and spanning links."""
    left = pdf["side"].to_numpy() == 0
    pdf = pd.concat([pdf[left], pdf[~left]])
    rows, doc, copies = int(left.sum()), pdf["doc"].to_numpy(), pdf["copies"].to_numpy()
    alone = rows == len(pdf)
    sets = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
    n = np.zeros(len(doc), np.int64)
    root = np.arange(len(doc))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    for i, linked in block_links(sets, rows):
        linked = linked if alone else linked[linked >= rows]
        n[i] += copies[linked].sum()
        if not alone:
            n[linked] += copies[i]
        for j in linked.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
    top = np.array([find(i) for i in range(len(doc))], np.int64)
    return pd.DataFrame({"doc": doc, "n": n, "top": doc[top] if len(doc) else doc})


def tokens_of(docs: DataFrame) -> DataFrame:
    """(doc, set) of docs: the shingles, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingles(t, ids).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc", "set"])

    return docs.select(ID, TEXT).mapInArrow(run, "doc long, set binary")


def links(docs: DataFrame, recall: float = RECALL, node: int = NODE, block: int = BLOCK) -> DataFrame:
    """(doc, class_id, n) of the documents with a link, from identified docs; class_id is an inner id."""
    parts = max(8, 2 * common.scan_parts(docs))
    sig = common.hold(signatures(docs, runs_for(recall)))
    # Equal sets. The table of them is written, so that the join is free to split a hot digest.
    equal = common.gather(sig.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copied = common.gather(sig.select("doc", "digest").join(equal, "digest").select("doc", "rep", "copies"))
    followers = copied.where("doc != rep")
    reps = sig.join(followers.select("doc"), "doc", "left_anti")
    found = all_ties(nodes_of(reps, node), sig, parts, node)
    groups = components(found).withColumnRenamed("v", "doc").withColumnRenamed("component", "grp")
    sig.unpersist()
    common.release(docs.sparkSession)
    blocks = F.ceil(F.col("m") / block).cast("int")
    sized = groups.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp").withColumn("blocks", blocks)
    copies = sized.join(copied.where("doc = rep").select("doc", "copies"), "doc", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    placed = common.gather(copies.select("doc", "copies", "grp", "blocks", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("own")))
    near = common.maybe(docs.select(ID, TEXT), ID, placed.select("doc")).where("_maybe").drop("_maybe")
    with_sets = placed.join(tokens_of(near), "doc")
    pairs = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = pairs.select("doc", "copies", "set", "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    solved = common.gather(task.groupBy("grp", "i", "j").applyInPandas(solve, "doc long, n long, top long"))
    common.release(docs.sparkSession)
    return classes(solved, copied)


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """docs with class_id, n_links and kept; columns of docs that are named like these are replaced."""
    docs, same_ids = identified(docs.drop("class_id", "n_links", "kept"), id_col, text)
    keep = [f"`{c}`" for c in docs.columns if c not in (ID, TEXT)]
    done = with_classes(docs.drop(TEXT), links(docs, **more), ID, id_col, same_ids)
    return done.select(*keep, F.col("_class").alias("class_id"), F.col("_links").alias("n_links"), F.col("_kept").alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The rows of docs that linked() keeps, with the columns of docs as they are.

    Rows that the bit filter of dropped ids lets through stay where they are; only the others are joined.
    """
    names = [f"`{c}`" for c in docs.columns]
    docs, _ = identified(docs, id_col, text)
    gone = common.materialize(links(docs, **more).where("doc != class_id").select("doc"))
    seen = common.maybe(docs, ID, gone)
    sure = seen.where("not _maybe").select(*names)
    rest = seen.where("_maybe").join(gone.select(F.col("doc").alias(ID)), ID, "left_anti").select(*names)
    return sure.unionAll(rest)
