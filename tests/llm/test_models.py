"""Classifiers: held-out accuracy on the tables, and edge cases."""

import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spanveil.llm import common, language, mixing, packing, quality, queries, repeats, setjoin, toxicity, trees

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "1234 5678"), (5, "word " * 30000), (5, "word " * 30000), (None, "x")]


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in common.table(spark, SF, "labels").collect()}


def test_quality(spark, labels):
    got = [(r, labels[r["doc_id"]]["quality"]) for r in queries.op4_quality(spark, SF).collect() if r["doc_id"] in labels]
    held = [(r["predicted"], y) for r, y in got if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.93 and all(0 <= r["score"] <= 1 for r, _ in got)


def test_toxicity(spark, labels):
    got = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in queries.op2_toxicity(spark, SF).collect() if r["doc_id"] in labels and r["held_out"]]
    assert np.mean([p == y for p, y in got]) > 0.9


def test_language(spark):
    want = {r["doc_id"]: r["lang"] for r in common.table(spark, SF, "documents").collect()}
    got = [(r["lang_pred"], want[r["doc_id"]]) for r in queries.op5_language(spark, SF).collect() if r["held_out"]]
    assert np.mean([p == y for p, y in got]) > 0.97


def counts(text):
    """The base counts, one by one."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else None
    covered = {j for i, w in enumerate(windows) if w in twice for j in (i, i + 1, i + 2)} if twice is not None else set()
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_rules(spark, labels):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for text in [*docs.values(), None, "", "a b c a b c", "x\nx\n \n \nx", "é é é é", "a\x1cb c\x85d", "a " * 50]:
        if text is None or len(text) < 12000:
            assert trees.statistics(text)[0] == counts(text)
    got = {r["doc_id"]: r for r in queries.op10_rules(spark, SF).collect()}
    held = [(got[d]["kept"], r["quality"] == 1) for d, r in labels.items() if d % 5 == 0 and not got[d]["base_failed"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got.values())


def test_rules_are_monotone(spark):
    docs, lab = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = trees.fit(common.labelled_sample(docs, lab, "quality", F.lit(True)))
    x = np.array([trees.statistics(t)[1] for _, t, _ in common.labelled_sample(docs, lab, "quality", F.lit(True), 50)])
    for j, name in enumerate(trees.FEATURES):
        if trees.MONOTONE.get(name) == -1:
            rows = [trees.predict(model, np.where(np.arange(x.shape[1]) == j, v, x)) for v in np.linspace(0, 1, 12)]
            assert all((b <= a + 1e-12).all() for a, b in zip(rows, rows[1:]))


def test_edge_cases(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("x"), "lang": F.lit(None).cast("string")})
    lab = common.table(spark, SF, "labels")
    none = spark.createDataFrame([], lab.schema)
    for labels_ in (lab, none, spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], lab.schema)):
        rows = quality.classify(docs, labels_).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert quality.accepted(docs, labels_, 0.0).schema == docs.schema and quality.accepted(docs, labels_, 0.0).count() == len(ODD)
        assert len(toxicity.classify(docs, labels_).collect()) == len(ODD)
        model = toxicity.fit(common.labelled_sample(docs, labels_, "toxic", F.lit(True)))
        assert ((s := toxicity.scorer(model)([t for _, t in ODD])) >= 0).all() and (s <= 1).all()
        assert len(trees.rules(docs, trees.fit(common.labelled_sample(docs, labels_, "quality", F.lit(True)))).collect()) == len(ODD)
    out = language.identify(docs, language.fit(language.sample(docs, F.lit(True)))).collect()
    assert {r["lang_pred"] for r in out} == {"und"}
    train = common.table(spark, SF, "documents")
    out = {r["doc_id"]: r for r in language.identify(docs.where("doc_id < 5"), language.fit(language.sample(train, F.lit(True)))).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 4))
    empty = docs.limit(0)
    assert quality.classify(empty, lab).count() == language.identify(empty, {}).count() == toxicity.classify(empty, lab).count() == trees.rules(empty, trees.fit([])).count() == 0


def test_labelled_sample_is_bounded(spark):
    docs, lab = (common.table(spark, SF, t) for t in ("documents", "labels"))
    rows = common.labelled_sample(docs, lab, "quality", F.lit(True), 20)
    assert len(rows) == 40 and rows == common.labelled_sample(docs, lab, "quality", F.lit(True), 20)


def test_ftrl_is_the_textbook_one(spark):
    docs, lab = (common.table(spark, SF, t) for t in ("documents", "labels"))
    rows = common.labelled_sample(docs, lab, "toxic", F.lit(True), 25)
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.7, 0.5, 3
    model = toxicity.fit(rows, alpha, beta, l1, l2, epochs)
    places = [set(toxicity.features(t, toxicity.Ids()).tolist()) for _, t, _ in rows]
    often = {p for p in set().union(*places) if sum(p in x for x in places) >= toxicity.ROWS_RANGE[0]}
    z, n = {}, {}

    def weight(p):
        shrink = 0 if p == "bias" else l1
        zp = z.get(p, 0.0)
        return 0.0 if abs(zp) <= shrink else -math.copysign(abs(zp) - shrink, zp) / ((beta + math.sqrt(n.get(p, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for x, (_, _, y) in zip(places, rows):
            active = [*(x & often), "bias"]
            w = {p: weight(p) for p in active}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for p in active:
                sigma = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / alpha
                z[p] = z.get(p, 0.0) + g - sigma * w[p]
                n[p] = n.get(p, 0.0) + g * g
    want = {p: weight(p) for p in often if weight(p)}
    assert dict(zip(model["at"].tolist(), model["w"].tolist())) == pytest.approx(want) and model["bias"] == pytest.approx(weight("bias"))
    score = toxicity.scorer(model)([t for _, t, _ in rows[:8]])
    assert score == pytest.approx([1 / (1 + math.exp(-weight("bias") - sum(want.get(p, 0.0) for p in x))) for x in places[:8]], abs=1e-5)


def test_toxicity_features():
    ids, text = toxicity.Ids(), "one two Three four"
    crc = lambda w: zlib.crc32(w.encode())
    spread = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> 64 - toxicity.BITS
    want = {spread(crc(w)) for w in ("one", "two", "three", "four")} | {spread(crc("thre~"))}
    words = [crc(w) for w in ("one", "two", "three", "four")]
    for gap in (1, 2, 3):
        want |= {spread((a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9 + gap) % 2**64) for a, b in zip(words, words[gap:])}
    assert set(toxicity.features(text, ids).tolist()) == want and toxicity.features(None, ids).tolist() == []


def plain_size(text, content, block):
    """Bytes of the text compressed block by block, each by a compressor of its own."""
    d, data, total = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), text.encode(), 0
    for i in range(0, len(data), block):
        total += len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + block]))
    return len(data), total


def test_quality_scores_one_by_one(spark):
    docs, lab = (common.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    model = quality.model_of(docs, lab, 20)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, lab, per_class=20).collect()}
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()]:
        n, good = plain_size(text or "", model["good"], quality.BLOCK)
        _, bad = plain_size(text or "", model["bad"], quality.BLOCK)
        x = ((np.array([(bad + 2) / (n + 20), (good + 2) / (n + 20)]) - model["mean"]) / model["scale"]) @ model["w"][1:] + model["w"][0]
        assert got[doc] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-6)
    # the weights are those of a difference: smaller with the good dictionary speaks for a text, smaller with the bad one against it
    full = quality.model_of(*(common.table(spark, SF, t) for t in ("documents", "labels")))
    assert full["w"][1] > 0 > full["w"][2]


def test_language_one_by_one(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(language.sample(docs, F.lit(True)))
    for r, text in [(r, r["text"]) for r in language.identify(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(40).collect()]:
        if text and any(c.isalpha() for c in text):
            sizes = {name: plain_size(language.letters(text), content, language.BLOCK)[1] for name, content in model.items()}
            assert sizes[r["lang_pred"]] == min(sizes.values())
            second = sorted(sizes.values())[1]
            assert r["rejected"] == (second - min(sizes.values()) < language.MARGIN * min(sizes.values()))
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_three_hundred_languages_and_ties(spark):
    rows = [(k * 10 + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(20)), f"l{k:03}") for k in range(300) for i in range(2)]
    rows += [(9000 + i, "same words in both", lang) for i, lang in enumerate(("x2", "x1", "x1"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(language.sample(docs, F.lit(True)))
    assert len(model) == 302
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert all(got[d] == lang for d, _, lang in rows if d < 9000) and {got[9000], got[9001]} == {"x1"}  # a tie: the one with more rows


def test_language_sample_is_bounded_and_spread(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    by = language.sample(docs, F.lit(True), 50)
    assert {k: len(v) for k, v in by.items()} == {"a": 50, "b": 50} and list(by) == ["a", "b"] and by == language.sample(docs.repartition(3), F.lit(True), 50)


def test_trees_are_walked_and_split_right(spark):
    docs, lab = (common.table(spark, SF, t) for t in ("documents", "labels"))
    rows = common.labelled_sample(docs, lab, "quality", F.lit(True), 150)
    x, y = np.array([trees.statistics(t)[1] for _, t, _ in rows]), np.array([r[2] for r in rows], float)
    model = trees.fit(rows, trees=4)

    def walk(node, row):
        while model["feature"][node] >= 0:
            node = model["right" if row[model["feature"][node]] > model["threshold"][node] else "left"][node]
        return model["value"][node]

    plain = [1 / (1 + math.exp(-model["prior"] - sum(walk(r, row) for r in model["roots"]))) for row in x]
    assert trees.predict(model, x) == pytest.approx(plain)
    # the first split: the best of all features and cuts
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0, None)
    for j, name in enumerate(trees.FEATURES):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, trees.BINS + 1)[1:-1])):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < trees.LEAST:
                continue
            values = [-g[s].sum() / (h[s].sum() + trees.LAMBDA) for s in (left, ~left)]
            if trees.MONOTONE.get(name) == -1 and values[1] > values[0]:
                continue
            gain = sum(0.5 * g[s].sum() ** 2 / (h[s].sum() + trees.LAMBDA) for s in (left, ~left)) - 0.5 * g.sum() ** 2 / (h.sum() + trees.LAMBDA)
            best = max(best, (gain, (j, float(cut))))
    root = model["roots"][0]
    assert (model["feature"][root], model["threshold"][root]) == best[1]


def test_rules_labels_of_one_class():
    text = "good words " * 60
    assert trees.predict(trees.fit([(1, text, 0)] * 5), np.array([trees.statistics(text)[1]]))[0] < 0.5
    assert trees.predict(trees.fit([(1, text, 1)] * 5), np.array([trees.statistics(text)[1]]))[0] > 0.5


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    lab = common.table(spark, SF, "labels").withColumn("doc_id", F.col("doc_id").cast(kind))
    for out in (trees.rules(docs, trees.fit([])), language.identify(docs, {}), packing.pack(docs), quality.classify(docs, lab), toxicity.classify(docs, lab), repeats.removed(docs), setjoin.linked(docs), mixing.mix(docs.withColumn("source", F.lit("s")))):
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and out.count() == 2
