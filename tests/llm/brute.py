"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np


def removed(docs, minimum=100):
    """doc_id to (n_bytes, n_removed, n_spans, sha256 of what is kept)."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - minimum + 1):
            w = data[i : i + minimum]
            if w in seen:
                gone[i : i + minimum] = True
            seen.add(w)
        rest = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = Counter()
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: (find(x), n[x]) for x in nodes}


def shingles(text, words=5):
    w = (text or "").encode().split()
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def jaccard_pairs(docs):
    sets = {d: shingles(t) for d, t in docs}
    inverted, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    for ds in inverted.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[min(a, b), max(a, b)] += 1
    return [p for p, c in common.items() if 5 * c >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
