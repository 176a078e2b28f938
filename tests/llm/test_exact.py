"""Operators whose results are exact, against plain versions, and their edge cases."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanveil.llm import annlink, chat, common, mixing, packing, repeats, setjoin

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, _id int, bucket int"


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def fixture_docs():
    passage, base = words(60, 1), words(120, 2)
    docs = [(i, words(random.Random(i).randrange(1, 150), i + 10)) for i in range(60)]
    docs += [(100 + i, words(20, i + 500) + " " + passage + " " + words(20, i + 700)) for i in range(12)]
    docs += [(200 + i, base.replace(f"{base.split()[i * 7]} ", f"edit{i} ", 1)) for i in range(12)]
    docs += [(300 + i, base) for i in range(3)] + [(310, ""), (311, None), (312, " \n "), (313, "a" * 500), (314, "ab" * 300), (315, "one two"), (316, "one two"), (317, "é" * 120)]
    return docs


@pytest.mark.parametrize("hot", [(64, 32), (1, 3)])
def test_repeats(spark, fixture_docs, hot):
    got = repeats.removed(spark.createDataFrame(fixture_docs, DOCS), hot=hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.removed(fixture_docs)


def test_anchors_over_segments(monkeypatch):
    text = np.frombuffer(words(800, 3).encode(), np.uint8)
    whole = {(int(h), int(c), int(d)) for h, c, d, *_ in zip(*repeats.anchors(text, 100, 24))}
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    h, c, d, s, w = repeats.anchors(text, 100, 24)
    assert sum(w) == len(text) - 99 and s[0] == 0 and all(a + b == e for a, b, e in zip(s, w, s[1:]))
    assert {int(x) for x in h} == {x for x, *_ in whole}  # the same anchors, with contexts cut at segments only
    assert len({x for x in zip(h.tolist(), c.tolist(), d.tolist())} - whole) <= 2 * (len(text) // 256 + 1)


def test_repeats_in_very_long_texts(spark):
    long = words(60_000, 4, 20_000)
    assert len(long) > 2 * repeats.SEGMENT
    docs = [(1, long), (2, "y" + long[1000:200_000] + "z" + long[-150_000:]), (3, long[:99]), (4, "é" + long[50_000:50_150] + "é")]
    got = repeats.removed(spark.createDataFrame(docs, DOCS).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.removed(docs)


def test_repeats_whatever_the_ids_and_partitions(spark, fixture_docs):
    docs = [(i * 64, t) for i, t in fixture_docs]  # ids in steps of a number of buckets
    for parts in (1, 7):
        got = repeats.removed(spark.createDataFrame(docs, DOCS).repartition(parts)).collect()
        assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute.removed(docs)
    names = spark.createDataFrame([(f"d{i:04}", t) for i, t in fixture_docs], "doc_id string, text string")
    assert sum(r["n_removed"] for r in repeats.removed(names).collect()) == sum(x[1] for x in brute.removed(fixture_docs).values())


def test_leaves_of_several_places_are_groups():
    context = np.frombuffer(b"a" * 7 + b"bcdefghij" * 12, np.uint8)
    place = {"h": np.uint64([1]), "c": np.uint64([2]), "d": np.uint64([3]), "doc": np.int64([5]), "s": np.uint32([9]), "w": np.uint8([len(context) - 99])}
    more = {k: v.copy() for k, v in place.items()}
    more["doc"], more["s"] = np.int64([8]), np.uint32([0])
    for lone in (False, True):
        marks, *_ = repeats.repeat_marks(place, np.zeros(1, np.int64), np.array([lone]), more, context, 100)
        assert (marks["doc"].tolist(), marks["s"].tolist(), marks["n"].tolist()) == ([8], [0], [len(context)])


def test_groups_of_whole_anchors():
    r = np.random.default_rng(3)
    for most in (1, 7, 50, 10_000):
        h, w = r.integers(0, 40, 300).astype(np.uint64), r.integers(1, 9, 300)
        groups = list(repeats.groups_of(h, w, most))
        assert sorted(np.concatenate(groups).tolist()) == list(range(300))
        keys = [set(h[g].tolist()) for g in groups]
        assert sum(map(len, keys)) == len(set(h.tolist())) and all(len(k) == 1 or w[g].sum() <= most for k, g in zip(keys, groups))
    data = r.integers(97, 110, 5000).astype(np.uint8)
    starts = np.array([0, 17, 2047, 2048, 2049, 4899])
    assert (repeats.fingerprints(data, starts, 100, 1024) == np.stack([repeats.hashes(data, 100, k)[starts] for k in (0, 1)])).all()


def test_marks_are_joined():
    marks = {"doc": np.int64([7, 3, 7, 3, 3]), "s": np.uint32([5, 0, 0, 10, 21]), "n": np.uint32([5, 10, 5, 10, 4])}
    got = repeats.joined(marks)
    assert (got["doc"].tolist(), got["s"].tolist(), got["n"].tolist()) == ([3, 3, 7], [0, 21, 0], [20, 4, 10])


def test_maximal_repeats():
    data = np.frombuffer(b"xabcyabczabcq", np.uint8)
    starts = np.arange(len(data))
    order, lcp = repeats.suffix_order(data, starts, len(data) - starts)
    assert [bytes(data[i:]) for i in order] == sorted(bytes(data[i:]) for i in range(len(data)))
    left = np.array([data[i - 1] if i else -1 for i in order], np.int64)
    groups = [(n, sorted(order[a : b + 1].tolist())) for n, a, b in repeats.maximal_repeats(lcp, left, 2)]
    assert groups == [(3, [1, 5, 9])]  # "bc" always follows "a", so it isn't maximal


def test_repeats_null_and_repeated_ids(spark):
    text = words(60, 4)
    rows = [(None, text, "x"), (5, text, "y"), (5, text, "z"), (7, None, None)]
    got = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string, kept string"), with_text=True).orderBy("doc_id").collect()
    assert len(got) == 4 and sorted(r["n_removed"] for r in got) == [0, 0, len(text), len(text)]


def test_setjoin(spark, fixture_docs):
    got = setjoin.linked(spark.createDataFrame(fixture_docs, DOCS)).collect()
    want = brute.classes([d for d, _ in fixture_docs], brute.jaccard_pairs(fixture_docs))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == {d for d, (c, _) in want.items() if d == c}


def test_setjoin_splits_large_nodes_and_groups(spark, fixture_docs, monkeypatch):
    monkeypatch.setattr(setjoin, "SHARE", 4)
    got = setjoin.linked(spark.createDataFrame(fixture_docs, DOCS), node=3, block=4).collect()
    want = brute.classes([d for d, _ in fixture_docs], brute.jaccard_pairs(fixture_docs))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want


def test_setjoin_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    got = setjoin.linked(common.table(spark, SF, "documents").select("doc_id", "text")).collect()
    want = brute.classes([d for d, _ in docs], brute.jaccard_pairs(docs))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want


def test_setjoin_writes_few_files(spark, fixture_docs, monkeypatch, tmp_path):
    # Each file that an executor writes to a local folder starts processes, which count as second JVMs.
    places = (f"file://{tmp_path}/{k}" for k in range(1000))
    monkeypatch.setattr(common, "shared_dir", lambda spark: next(places))
    monkeypatch.setattr(setjoin, "SENT", 0)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    found = setjoin.links(spark.createDataFrame(fixture_docs, DOCS).repartition(12).withColumnsRenamed({"doc_id": repeats.ID, "text": repeats.TEXT}), node=3, block=4)
    want = brute.classes([d for d, _ in fixture_docs], brute.jaccard_pairs(fixture_docs))
    assert {r["doc"]: (r["class_id"], r["n"]) for r in found.collect()} == {d: (c, n) for d, (c, n) in want.items() if n}
    files = [len(list(table.glob("part-*"))) for table in tmp_path.iterdir()]
    assert len(files) > 5 and max(files) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_chosen_paths_of_a_long_text(monkeypatch):
    r = np.random.default_rng(3)
    s, parents = np.unique(r.integers(0, 2**63, 1_000_000).astype(np.uint64)), r.integers(0, 2**63, 16).astype(np.uint64)
    tracemalloc.start()
    at, node = setjoin.children(s, parents, np.uint64(2**64 // 1000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    monkeypatch.setattr(setjoin, "CELLS", 1 << 40)
    whole = setjoin.children(s, parents, np.uint64(2**64 // 1000))
    assert len(at) > 10_000 and sorted(zip(at.tolist(), node.tolist())) == sorted(zip(*(x.tolist() for x in whole)))


def test_packing(spark, fixture_docs):
    from tokenizers import Tokenizer

    odd = [(400, "a  b\n\n c \n d "), (401, "<|endoftext|> x"), (402, "naïve — 中文  emoji 😀 \x85 \xa0x"), (403, " lead"), (404, "it's 12345  \t\tx"), (405, "\x1c\x1d a"), (406, "don't\r\n\r\nstop")]
    docs = fixture_docs + odd
    tok = Tokenizer.from_file(packing.default_paths()[0])
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    pieces = packing.pack(spark.createDataFrame(docs, DOCS), length=64).collect()
    for p in pieces:
        own = np.array(ids[p["doc_id"]], "<u4")
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]])
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))
    by = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == by.get(p["sequence_id"], 0)
        by[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(by) == list(range(len(by))) and sorted(by.values())[1:] == [64] * (len(by) - 1)


def test_chat_round_trip():
    for text in ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\|im_end|>", "<<SYS>>x<</SYS>>", "<|im_start|>user\n", "", "\\", "a\nb"]:
        for role in ("user", "assistant", "", "two words\n", "<s>"):
            formatted, mask = chat.render([(role, text), ("assistant", text)])
            assert chat.parse(formatted) == [(role, text), ("assistant", text)]
            assert chat.unescape(formatted[slice(*mask[-1])]) == text
            assert not any(c in chat.escape(text) for c in chat.CONTROL)


def test_chat_trees(spark):
    nodes = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "good", 0.9), ("t", "c", "a", "assistant", "bad", 0.1), ("t", "d", "b", "user", "more", 0.9), ("t", "e", "d", "assistant", None, 0.9), ("u", "x", "gone", "user", "alone", 0.5), ("v", "p", "q", "user", "cycle", 0.5), ("v", "q", "p", "user", "cycle", 0.5)]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, role string, text string, score double")
    got = {(r["tree"], r["place"]): chat.parse(r["formatted"]) for r in chat.conversations(df).collect()}
    assert got == {("t", 1): [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "")], ("t", 2): [("user", "q"), ("assistant", "bad")], ("u", 1): [("user", "alone")]}
    assert [r["leaf"] for r in chat.conversations(df, keep=1).where("tree = 't'").collect()] == ["e"]


def test_chat_chains(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, None, None), (2, None, "user", "x")]
    out = chat.digests(chat.conversations(chat.chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    assert {r["tree"]: (r["n_turns"], r["loss_chars"]) for r in out} == {"1": (3, 2), "null": (1, 0), "2": (1, 0)}


def test_class_ids_are_document_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(70, text["a"]), (50, text["a"]), (50, text["b"]), (None, text["b"]), (90, text["c"]), (-4, text["c"]), (None, text["d"]), (60, "alone")]
    out = setjoin.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"][0], r["class_id"], r["n_links"], r["kept"]) for r in out)
    assert got == [
        (False, -4, "c", -4, 1, True), (False, 50, "a", 50, 1, True), (False, 50, "b", 50, 1, True), (False, 60, "a", 60, 0, True), (False, 70, "a", 50, 1, False), (False, 90, "c", -4, 1, False),
        (True, 0, "b", 50, 1, False), (True, 0, "d", None, 0, True),
    ]


def mixture(rows, cap=3):
    """Targets by repeated sharing out."""
    size = {}
    for _, s, n in rows:
        size[s] = size.get(s, 0) + n
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, target = sum(size.values()), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left > cap * size[s] * w}
        if not over:
            return size, target | {s: weight[s] * left / w for s in free}
        for s in over:
            target[s] = cap * size[s]
        left, free = left - sum(cap * size[s] for s in over), free - over
    return size, target


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "c", "é", None, "big", "big", "big"]), r.randrange(0, 60)) for i in range(300)] + [(900, "tiny", 1), (901, "none", 0)]
    df = spark.createDataFrame([(i, " ".join(["x"] * n) if n else None, s) for i, s, n in rows], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size, target = mixture(rows)
    source = {i: s for i, s, _ in rows}
    taken = {}
    for g in got:
        s = source[g["doc_id"]]
        assert (g["source_size"], pytest.approx(g["target"])) == (size[s], target[s]) and 0 <= g["taken"] <= 3 * g["size"]
        taken[s] = taken.get(s, 0) + g["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 20 for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))


@pytest.mark.parametrize("blocks", [16, 1024])
def test_mixing_of_tiny_sources(spark, blocks):
    r = random.Random(3)
    sizes = [("hot", 1000)] * 400 + [(f"t{k}", r.randrange(1, 20)) for k in range(100) for _ in range(r.randrange(1, 60))] + [("mid", 50)] * 300
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes)]
    df = spark.createDataFrame([(i, " ".join(["x"] * n), s) for i, s, n in rows], "doc_id long, text string, source string")
    size, target = mixture(rows)
    source, taken = {i: s for i, s, _ in rows}, dict.fromkeys(size, 0)
    for g in mixing.mix(df, blocks=blocks).collect():
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[source[g["doc_id"]]] += g["taken"]
    assert all(abs(taken[s] - target[s]) <= max(1, 0.005 * target[s]) for s in size)
    assert abs(sum(taken.values()) - sum(size.values())) <= max(len(size), sum(size.values()) // blocks)


def test_sainte_lague(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0}
    df = spark.createDataFrame([(1, k, v, 17) for k, v in votes.items()], "g int, k string, v double, seats long")
    got = {r["k"]: r["won"] for r in mixing.apportion(df, ["g"], ["k"], "v", "seats", "won").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(17):
        want[max(votes, key=lambda k: (votes[k] / (2 * want[k] + 1), -ord(k)))] += 1
    assert got == want


def test_embeddings(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(20, 16))
    rows, n = [], 0
    for k in range(20):
        for _ in range(12):
            rows.append((n, (base[k] + r.normal(scale=0.12, size=16)).astype(np.float32).tolist(), k % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, rows[0][1], None), (n + 6, [1.0], 0), (n + 7, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float)), y) for i, v, y in rows if v and y is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a[0], b[0]) for i, a in enumerate(ok) for b in ok[:i] if a[2] == b[2] and a[1] @ b[1] >= 0.93]
    want = brute.classes([i for i, *_ in rows], pairs)
    for lists, block in ((64, 2048), (4, 8)):
        got = annlink.near_links(df, lists=lists, block=block).collect()
        assert {g["vec_id"]: (g["component_id"], g["n_links"]) for g in got} == want
    assert len(pairs) > 100


def test_empty_tables(spark):
    docs = spark.createDataFrame([], FULL)
    assert repeats.removed(docs).count() == setjoin.linked(docs).count() == packing.pack(docs).count() == mixing.mix(docs).count() == mixing.resampled(docs).count() == 0
    assert annlink.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.digests(chat.conversations(chat.chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_clashing_columns(spark):
    text = words(40, 9)
    docs = spark.createDataFrame([(1, text, "en", "s", 1, 0.5, "k", 3, 4), (2, text, None, None, None, None, None, None, None)], FULL)
    assert repeats.removed(docs).select("kept_sha256", "score").count() == 2
    assert setjoin.linked(docs).where("kept").count() == 1
    assert mixing.resampled(docs).select("score", "kept").count() >= 1
    assert packing.pack(docs.withColumn("n", F.lit(1))).count() == 2
