"""Sub-operators of the sequential detectors and of the resolution, on literal texts."""

import pytest
from pyspark.sql import functions as F

from spanveil.functions import vocab as V
from spanveil.operators import curated, filters, lookup, redact, scanner
from spanveil.operators.dictionary import countries, custom_deny_list, deny_list
from spanveil.operators.rules import detect_arrays
from spanveil.plans.pipeline import PipelineConfig, Tables, analyse, resolved, stages


def found(entities):
    return [(e.label, e.text) for e in entities]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("by Acme (UK) LLP today", ["Acme (UK) LLP"]),
        ("between Alpha Ltd, Beta GmbH and Gamma s.r.o. as parties", ["Alpha Ltd", "Beta GmbH", "Gamma s.r.o."]),
        ("die Muster GmbH & Co. KG haftet", ["Muster GmbH & Co. KG"]),
        ("see Chapter IV SA below", []),
        ("see Section A LLC below", []),
        ("With Delta Works Inc. we agree", ["Delta Works Inc."]),
        ("made by Omega Trading\nLimited here", ["Omega Trading\nLimited"]),
        ("Title\nLimited liability", []),
        ("the Ministry of Public Works said", ["Ministry of Public Works"]),
    ],
)
def test_legal_forms(text, want):
    assert [e.text for e in scanner.legal_forms(text)] == want


def test_outermost_and_covered():
    assert scanner.outermost([(3, 5), (0, 4), (1, 2), (0, 4), (4, 9), (6, 7)]) == [(0, 4), (3, 5), (4, 9)]
    cover = scanner.Covered([(5, 9), (0, 2), (1, 8)])
    assert [cover.touches(a, b) for a, b in ((2, 3), (8, 9), (9, 10), (0, 1), (10, 12))] == [True, True, False, True, False]


def test_merge_is_the_pairwise_one():
    import random

    r = random.Random(5)
    for _ in range(200):
        spans = [(a := r.randrange(60), a + r.randrange(1, 15)) for _ in range(12)]
        es = [scanner.Entity(a, b, r.choice(["person", "address", "organization"]), "x" * (b - a), r.choice([0.5, 0.9, 1.0]), r.choice(["regex", "trigger", "deny-list"])) for a, b in spans]
        kept = []
        for e in sorted(es, key=lambda x: x.start):
            over = [k for k in kept if k.start < e.end and e.start < k.end]
            if all(scanner.outranks(e, k) for k in over):
                kept = [k for k in kept if k not in over] + [e]
        assert scanner.merge(es) == sorted(kept, key=lambda x: (x.start, x.end))


def test_triggers():
    rules = scanner.expand_triggers([(["case ref"], "case number", "line", {"most": 20}, ["digit", "min-length:4"]), (["case ref:", "file"], "case number", "line", {"most": 20}, ["matches:^F-"])])
    assert rules[0][0] == ["case ref", "case ref:", "case ref"] and rules[1][0] == ["case ref::", "case\u00a0ref:", "file", "file:"]
    assert [e.text for e in scanner.triggers("case ref A 12/3\nfile F-7\nfile G-8\ncase ref 1", rules)] == ["A 12/3", "F-7"]
    assert scanner.valid("AB 12", ["valid-id", "max-length:5"]) and not scanner.valid("AB 12", ["max-length:4"])
    assert [e.text for e in scanner.triggers("represented by John Doe, Ph.D., director")] == ["John Doe"]
    assert [e.text for e in scanner.triggers("represented by Dr. Jana Nováková, and others")][0].startswith("Dr")


def test_normalise_and_wrapped_cities():
    text = "Seller: 5 Main Street, hereinafter the site"
    assert [e.text for e in scanner.normalise(text, [scanner.entity(text, 0, len(text), "address", 0.9, "trigger")])] == ["5 Main Street"]
    text = "Merritt\nIsland, FL 32953 and more"
    assert found(scanner.wrapped_cities(text, [scanner.entity(text, 0, 7, "person", 0.5, "deny-list")])) == [("address", "Merritt\nIsland, FL 32953")]
    text = "Prague Agreement"
    assert scanner.false_positive(text, scanner.entity(text, 0, 16, "address", 0.9, "deny-list")) == "address-noun"


def test_orphan_street_lines():
    text = "ACME\n12 Long Meadow Road\nPrague 11000\n" + "body text here. " * 60
    known = [scanner.entity(text, 25, 37, "address", 0.9, "regex")]
    assert ("address", "12 Long Meadow Road") in found(scanner.address_context(text, known))


def test_last_filter_keeps_labels_and_threshold():
    text = "call Anna Brown now"
    got = scanner.resolve(text, [scanner.entity(text, 5, 15, "person", 0.9, "deny-list"), scanner.entity(text, 0, 4, "misc", 0.1, "regex")], 0.3, {"person"})
    assert found(got) == [("person", "Anna Brown")]


def deny(text, *hits):
    return [scanner.entity(text, text.index(t), text.index(t) + len(t), label, 0.9, "deny-list") for t, label in hits]


def test_curated_hits():
    text = "Dr Petra Veselá and Ota Kos Malý"
    assert found(curated.curated(text, deny(text, ("Petra", "person"), ("Veselá", "person"), ("Ota", "person"), ("Kos", "person")))) == [("person", "Dr Petra Veselá"), ("person", "Ota Kos Malý")]
    text = "alone Ota went"
    assert curated.curated(text, deny(text, ("Ota", "person"))) == []
    text = 'the company (the "Nice") in Nice is nice'
    assert curated.curated(text, deny(text, ("Nice", "address"))) == []
    text = "lives at Rue du Port, 06000 Nice, France"
    assert found(curated.curated(text, deny(text, ("Nice", "address")))) == [("address", "06000 Nice")]
    text = "office 110 00 Praha 4 and Brno-město"
    assert found(curated.curated(text, deny(text, ("Praha", "address"), ("Brno", "address")))) == [("address", "110 00 Praha 4"), ("address", "Brno-město")]
    text = "Anna-Marie came"
    assert curated.curated(text, deny(text, ("Anna", "person"))) == []


def test_declensions():
    assert {"Nováka", "Novákovi", "Novákem"} <= curated.declensions("Novák") and {"Nováková", "Novákové", "Novákovou"} == curated.declensions("Nováková")
    assert {"Svobody", "Svobodu", "Svobodou"} <= curated.declensions("Svoboda") and {"Černého", "Černému"} <= curated.declensions("Černý") and {"Havla", "Havlem"} <= curated.declensions("Havel")


def test_names_from_a_table(spark):
    names = spark.createDataFrame([("Zorka", "first", False), ("Dvořáček", "last", True)], "name string, kind string, declined boolean")
    docs = spark.createDataFrame([(1, "met Zorka Dvořáčka there")], "doc_id long, text string")
    got = resolved(docs, PipelineConfig(), tables=Tables(names=names)).select("label", "text").collect()
    assert [tuple(r) for r in got] == [("person", "Zorka Dvořáčka")]


def test_small_dictionaries_find_what_joins_find(spark):
    texts = ["From United  Kingdom to the port, not united kingdom. New-York", "St. Kitts Group and ACME\nLtd: Acme Ltd.", "Peru's Peru, Perú", "", None, "The Long Name Of Seven Words Here Now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([("united kingdom", ["country"]), ("st. kitts group", ["organization"]), ("acme ltd", ["organization", "misc"]), ("peru", ["country"]), ("long name of seven words here now", ["organization"]), ("name of", ["misc"])], "term string, labels array<string>")
    stop = spark.createDataFrame([("peru",)], "word string")
    want = sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in deny_list(docs, terms, stop, joined=True).collect())
    assert sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in deny_list(docs, terms, stop).collect()) == want
    lexicon = lookup.Lexicon((r["term"], r["labels"]) for r in terms.collect())
    got = sorted((i, *hit) for i, t in enumerate(texts) if t for hit in lookup.deny_list(t.translate(lookup.FOLD), lexicon, {"peru"}))
    assert got == want and len(want) >= 4
    custom = spark.createDataFrame([("Peru", "x"), ("new-york", "y"), ("ltd", "z")], "value string, label string")
    want = sorted((r["doc_id"], r["start"], r["end"], r["label"]) for r in custom_deny_list(docs, custom).collect())
    lexicon = lookup.Lexicon((lookup.folded(r["value"]), r["label"]) for r in custom.collect())
    assert sorted((i, a, b, label) for i, t in enumerate(texts) if t for a, b, _, labels in lexicon.hits(t.translate(lookup.FOLD)) for label in labels) == want
    surfaces = spark.createDataFrame([("United Kingdom", "UK"), ("Peru", "PE"), ("Ltd", "LT")], "surface string, code string")
    want = sorted((r["doc_id"], r["start"], r["end"]) for r in countries(docs, surfaces).collect())
    small = [(r.doc_id, r.start, r.end) for r in resolved(docs.where("text is not null"), PipelineConfig(detectors=("countries",), zones=False, hotwords=False), tables=Tables(countries=surfaces)).collect()]
    assert sorted(small) == want


def test_large_dictionaries_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "From Peru to Chile")], "doc_id long, text string")
    tables = Tables(countries=spark.createDataFrame([("Peru", "PE"), ("Chile", "CL")], "surface string, code string"))
    config = PipelineConfig(detectors=("countries",))
    want = sorted(map(tuple, resolved(docs, config, tables=tables).collect()))
    monkeypatch.setattr(lookup, "SMALL_TERMS", 1)
    assert sorted(map(tuple, resolved(docs, config, tables=tables).collect())) == want and len(want) == 2


def test_hotwords_by_rows_and_by_arrays(spark):
    text = "call me: dial 12345 or the code 67890, dial again " + "x" * 300 + " 11111"
    docs = spark.createDataFrame([(1, text), (2, "no 5555")], "doc_id long, text string")
    from spanveil.operators.rules import Rule

    es = detect_arrays(docs, [Rule("digits", "number", r"\b[0-9]{4,19}\b", 0.35)])
    hit = lambda w, k, change, new: [(m.start(), m.end(), k, "number", change, 40, 20, new) for m in __import__("re").finditer(w, text)]
    hits = spark.createDataFrame([(1, hit("dial", 0, 0.3, "phone") + hit("code", 1, -0.2, None))], "doc_id long, hits array<struct<hit_start:int,hit_end:int,rule:int,target_label:string,adjustment:double,before:int,after:int,reclassify:string>>")
    both = es.join(hits, "doc_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(hits.schema["hits"].dataType)))
    by_array = filters.hotword_arrays(both).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    by_row = filters.hotword_adjust(es.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*"), hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*"), cell=30)
    key = lambda df: sorted((r["doc_id"], r["start"], r["label"], round(r["score"], 9)) for r in df.collect())
    assert key(by_array) == key(by_row) and {r[2] for r in key(by_row)} == {"phone", "number"}


def test_redaction_of_arrays_and_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.example [EMAIL_ADDRESS_1] c@d.example a@b.example"), (2, None), (3, "none")], "doc_id long, text string")
    es = detect_arrays(docs)
    rows = es.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    a, b = ({r["doc_id"]: (r["redacted_text"], r["redaction_map"], r["entity_count"]) for r in out.collect()} for out in (redact.redact_arrays(es), redact.redact(docs, rows)))
    assert a == b and a[1][0] == "[EMAIL_ADDRESS_2] [EMAIL_ADDRESS_1] [EMAIL_ADDRESS_3] [EMAIL_ADDRESS_2]" and a[2] == (None, [], 0) and len(a[1][1]) == 2


def test_stages(spark):
    docs = spark.createDataFrame([(1, "Signed by Anna Brown of Acme Ltd on 3 May 2021, mail a@b.example")], "doc_id long, text string")
    out = stages(docs)
    labels = {r["label"] for r in out["detected"].collect()}
    assert {"person", "organization", "date", "email address"} <= labels
    assert out["redacted"].first()["entity_count"] == out["resolved"].count() <= out["detected"].count()


def test_labels_that_hotwords_make(spark):
    text = "Her birthday is 2001-02-03, more"
    entities = analyse(text, [{"start": 16, "end": 26, "label": "date", "score": 0.9, "custom": False}], PipelineConfig(labels=("date of birth",)))
    assert [(e.label, e.text) for e in entities] == [("date of birth", "2001-02-03")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["label"], r["text"]) for r in resolved(docs, PipelineConfig(labels=("date of birth",))).collect()] == [("date of birth", "2001-02-03")]


def test_word_tables_are_disjoint_in_case():
    assert len(set(V.ROLES)) == len(V.ROLES) and all(w == w.lower() for w in [*V.ROLES, *V.PERSON_STOP])


def test_batches_of_sessions(spark, tmp_path):
    from spanveil.operators import session

    text = {1: "a@x.example and b@x.example", 2: "a@x.example", 3: "see [EMAIL_ADDRESS_s1_1]", 4: "c@x.example"}
    docs = spark.createDataFrame([("s1", d, t) for d, t in text.items()] + [("bad id", 5, "a@x.example"), ("s2", 6, "a@x.example b@x.example c@x.example"), ("s3", 7, "a@x.example")], "session_id string, doc_id long, text string")
    es = detect_arrays(docs).select("session_id", "doc_id", F.col("doc_id").alias("doc_seq"), F.explode("entities").alias("e")).select("session_id", "doc_id", "doc_seq", "e.*")
    life = spark.createDataFrame([("s1", "active"), ("s2", "active"), ("bad id", "active"), ("s3", "expired")], "session_id string, status string")
    empty = session.current(spark, str(tmp_path), 0)
    planned, after, errors = session.plan_batch(docs, es, empty, life, most=2)
    assert {(r["doc_id"], r["error_code"]) for r in errors.collect()} == {(1, "too-many-mappings"), (2, "too-many-mappings"), (4, "too-many-mappings"), (3, "session-token-collision"), (5, "bad-session-id"), (6, "too-many-mappings"), (7, "session-not-active")} and planned.count() == 0
    planned, after, errors = session.plan_batch(docs, es, empty, life, most=3)
    assert {r["doc_id"] for r in errors.collect()} == {3, 5, 7} and {r["doc_id"] for r in planned.collect()} == {1, 2, 4, 6}
    session.commit(after, str(tmp_path), 1)
    with pytest.raises(Exception, match="exist"):
        session.commit(after, str(tmp_path), 1)
    again, more, _ = session.plan_batch(docs.where("doc_id = 4"), es.where("doc_id = 4"), session.current(spark, str(tmp_path), 1), life)
    assert [r["placeholder"] for r in again.collect()] == [r["placeholder"] for r in planned.where("doc_id = 4").collect()] and more.count() == after.count() == 6


def test_states_are_validated(spark):
    from spanveil.operators import session

    entry = '{"key":"K","number":1,"ident":"i","placeholder":"[K_s_1]","original":"o"}'
    states = [f'{{"version":2,"session_id":"s","entries":[{entry}]}}', f'{{"version":1,"session_id":"s","entries":[{entry}]}}', f'{{"version":2,"session_id":"s s","entries":[{entry}]}}', f'{{"version":2,"session_id":"s","entries":[{entry},{entry}]}}', "{", '{"version":2,"session_id":"s","entries":[{"key":"K","number":0,"ident":"i","placeholder":"p","original":"o"}]}']
    df = spark.createDataFrame([(s,) for s in states], "state string")
    assert {r["state"]: r["error_code"] for r in session.invalid_states(df).collect()} == dict(zip(states[1:], ["unknown-version", "bad-session-id", "repeated-entry", "not-a-state", "bad-entry"]))
    assert session.from_json(df).count() == 1


def test_mandatory_and_contextual(spark):
    from spanveil.operators import evaluate

    docs = spark.createDataFrame([(1, "abcdefghij klmnop")], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 0, 4, "mandatory"), (1, 6, 8, "mandatory"), (1, 11, 14, "contextual")], "doc_id long, start int, end int, kind string")
    masks = spark.createDataFrame([(1, 0, 5), (1, 7, 8), (1, 11, 13)], "doc_id long, start int, end int")
    r = evaluate.mandatory_contextual(gold, masks, docs).first()
    assert (r["span_recall"], r["char_recall"], r["accepted_precision"]) == (0.5, 5 / 6, 7 / 8)
    rows = spark.createDataFrame([("Jan Novák, 12/3",), (None,)], "text string")
    assert [x["text"] for x in evaluate.shareable(rows).collect()] == ["Xxx Xxxxx, 00/0", None]


def test_sessions_of_a_stream_expire(spark, tmp_path):
    import json
    import time

    from spanveil.streaming import streams

    def put(n, row):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(row))

    schema = "session_id string, doc_seq long, start int, label string, text string"
    put(1, {"session_id": "s", "doc_seq": 1, "start": 0, "label": "person", "text": "A"})
    source = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    out = streams.session_placeholders(source, idle_ms=1).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    seen = set()

    def wait(n):  # batches without data go on, as time passes; so the result is polled
        nonlocal seen
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            time.sleep(0.5)
            seen = {(r["text"], r["number"]) for r in spark.sql("select * from expiring").collect()}

    wait(1)
    time.sleep(3)
    put(2, {"session_id": "s", "doc_seq": 2, "start": 0, "label": "person", "text": "B"})
    wait(2)
    out.stop()
    assert seen == {("A", 1), ("B", 1)}  # numbers begin again


@pytest.mark.parametrize("pattern", [r"[0-9]+", r"(?i)\bAB?\b", r"'[^'\\]*'", r"\p{Lu}\p{Ll}+", r"a|\n"])
def test_spans_as_sql_and_as_columns(spark, pattern):
    import regex

    from spanveil.functions import spans as S

    texts = ["", None, "12 ab A aB 'q' 'x' Éa\n😀7", "ab 1'2' " * 300, "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.spans("t", pattern).alias("a"), S.spans(F.col("t"), pattern).alias("b")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group()) for m in regex.finditer(pattern, r["t"] or "")]
        assert [tuple(x) for x in r["a"]] == [tuple(x) for x in r["b"]] == want


def test_large_deny_lists_look_up_capitalised_words_only(spark):
    from spanveil.operators import dictionary, lookup

    texts = ["the Orbi-tex’s bank\nÉlan Vital a 4 Ab.", "kein Wort hier", "", None, "x “Ab Cd”"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = ("doc_id", "start", "end", "surface")
    every = [tuple(r[c] for c in key) for r in dictionary.ngrams(docs, 3).collect()]
    got = [tuple(r[c] for c in key) for r in dictionary.begun(docs, 3, lookup.UPPER_OR_DIGIT).collect()]
    assert sorted(got) == sorted(x for x in every if x[3][0].isupper() or x[3][0].isdigit()) and len(got) < len(every)
    terms = spark.createDataFrame([("ab cd", ["a"]), ("élan", ["b"])], "term string, labels array<string>")
    plan = dictionary.deny_list(docs, terms, joined=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
