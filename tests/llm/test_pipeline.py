"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import pytest

from spanveil.llm import common, packing, queries

from . import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, tables = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
        tables.append(docs.collect())
    start, good, single, cut, mixed, packed = tables
    assert all(set(t[0].asDict()) == set(columns) for t in tables[:5])
    accepted = {r["doc_id"] for r in queries.op4_quality(spark, SF).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in good} == accepted
    rows = [(r["doc_id"], r["text"]) for r in good]
    want = brute.classes([d for d, _ in rows], brute.jaccard_pairs(rows))
    assert {r["doc_id"] for r in single} == {d for d, (c, _) in want.items() if c == d}
    gone = brute.removed([(r["doc_id"], r["text"]) for r in single])
    size = {r["doc_id"]: len(r["text"].encode()) for r in cut}
    assert set(size) == set(gone) and all(gone[d][0] - gone[d][1] - 6 * gone[d][2] <= n <= gone[d][0] - gone[d][1] for d, n in size.items())
    texts = {r["doc_id"]: r["text"] for r in cut}
    times = {}
    for r in mixed:
        assert texts[r["doc_id"]] == r["text"]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3 and len(times) > len(texts) / 3
    encode = packing.Encoder.of(*packing.default_paths()).encode
    tokens = sum(len(encode(r["text"])) // 2 + 1 for r in mixed)
    assert sum(p["length"] for p in packed) == tokens and max(p["sequence_id"] for p in packed) == (tokens - 1) // packing.LENGTH


def odd(spark, rows):
    """documents with the names of all outputs of the operators as columns of their own."""
    clash = {"kept": "string", "n_removed": "string", "n_bytes": "string", "n_spans": "string", "kept_sha256": "string", "score": "string", "score_": "string", "held_out": "string", "predicted": "string", "n_links": "string", "class_id": "string", "_id": "string", "_text": "string", "size": "string", "taken": "string", "shard": "string", "bucket": "string", "rep": "string", "a.b": "string"}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {t}" for c, t in clash.items())
    return spark.createDataFrame([(*r, None, "s" if i % 2 else None, None, *[f"{c}{i}" for c in clash]) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_clashing_columns_and_survive_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = " ".join(f"word{i}" for i in range(120))
    rows = [(1, prose), (2, prose), (3, None), (4, ""), (5, " \n\t "), (6, "long " * 60_000), (7, "one two three"), (7, "one two three"), (None, "no id"), (8, prose + " end")]
    docs = odd(spark, rows)
    out = stage(spark, docs, SF)
    assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    known = {r["score"]: r for r in docs.collect()}
    got = out.collect()
    for r in got:
        before = known[r["score"]].asDict() | {"text": r["text"], "n_chars": r["n_chars"]}
        assert r.asDict() == before  # all other columns are the row's own
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "near_duplicates":
        assert sorted(r["score"] for r in got) == ["score0", "score2", "score3", "score4", "score5", "score6", "score8"]
    if name == "repeated_passages":
        left = {r["score"]: r["text"] for r in got}
        assert len(got) == len(rows) and left["score0"] == prose and not left["score1"] and left["score9"] == " end" and left["score6"] == left["score7"] == "one two three"


def test_packing_survives_odd_rows(spark):
    docs = odd(spark, [(1, "a b"), (None, None), (2, ""), (2, "x " * 5000)])
    out = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0} >= {(None, 1), (2, 1)} and corpus_pipeline.packed(spark, docs.limit(0), SF).count() == 0


def test_run_is_its_stages(spark):
    docs = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
    pieces = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in df.collect())
    whole = lambda rows: sorted({(d, n) for d, _, _, _, n in rows})
    got, want = pieces(corpus_pipeline.run(spark, SF)), pieces(docs)
    assert whole(got) == whole(want) and sum(r[2] for r in got) == sum(r[2] for r in want) and len(got) > 0
