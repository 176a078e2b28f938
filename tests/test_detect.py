"""Detectors, resolution and redaction on literal texts."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.functions import spans as S
from spanveil.functions import validators as V
from spanveil.operators import blocks, dictionary, filters, redact, scanner, session
from spanveil.operators.rules import BY_ID, detect
from spanveil.plans.pipeline import PipelineConfig, redacted, resolved
from spanveil.sources import external, office, text as text_source

ACCEPT = [
    ("email", "write to legal!notices@example.test now", "legal!notices@example.test"), ("email-idn", "an counsel@büro.example.", "counsel@büro.example"), ("email-written", "legal.notices at example dot test", "legal.notices at example dot test"),
    ("ipv4", "host 10.0.0.255 up", "10.0.0.255"), ("ipv6", "at 2001:db8:0:0:0:0:0:1.", None), ("mac", "if 00:1A:2b:3c:4d:5e x", "00:1A:2b:3c:4d:5e"), ("url", "see https://example.test/a?b=1.", "https://example.test/a?b=1"),
    ("card", "pay 4111 1111 1111 1111 now", "4111 1111 1111 1111"), ("iban", "IBAN DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 00"), ("phone-international", "call +420 777 123 456.", "+420 777 123 456"),
    ("phone-nanp", "call (212) 555-0123 today", "(212) 555-0123"), ("phone-german", "Tel 030 12345678", "030 12345678"), ("ssn", "no 123-45-6789 x", "123-45-6789"), ("nino", "NI AB123456C.", "AB123456C"),
    ("date-iso", "on 2024-02-29.", "2024-02-29"), ("date-numeric", "am 5. 3. 2024 in", "5. 3. 2024"), ("percent", "at 3.875% a year", "3.875%"), ("eth", "0x" + "aB" * 20, "0x" + "aB" * 20),
    ("passport", "US passport number X12345678", "US passport number X12345678"), ("nhs", "NHS number 943 476 5919", "NHS number 943 476 5919"), ("cn-ric", "id 11010519491231002X ok", "11010519491231002X"), ("cz-birth", "r.č. 900101/0008 x", None),
    ("es-dni", "DNI 12345678Z", "12345678Z"), ("br-cpf", "CPF 529.982.247-25", "529.982.247-25"), ("ch-uid", "CHE-116.281.710 MWST", None), ("au-abn", "ABN 51 824 753 556", "51 824 753 556"),
    ("us-ein", "EIN 12-3456789", "12-3456789"), ("us-zip", "Austin, TX 78701-1234", "TX 78701-1234"), ("ecli", "see ECLI:EU:C:2019:123 ok", "ECLI:EU:C:2019:123"), ("neutral-citation", "[2024] UKSC 1", "[2024] UKSC 1"),
    ("us-docket", "No. 1:23-cv-04567", "1:23-cv-04567"), ("de-aktenzeichen", "Az. 1 BvR 123/24", "Az. 1 BvR 123/24"), ("pl-sygnatura", "sygn. akt III CZP 10/23", "sygn. akt III CZP 10/23"),
]
REJECT = [("ipv4", "1.2.3.256"), ("card", "4111 1111 1111 1112"), ("iban", "DE89 3704 0044 0532 0130 01"), ("phone-german", "030 1234"), ("phone-nanp", "(112) 555-0123"), ("ssn", "666-12-3456"), ("nhs", "NHS number 943 476 5918"), ("date-iso", "2024-13-01"), ("es-dni", "12345678A"), ("br-cpf", "529.982.247-26"), ("cn-ric", "11010519491331002X"), ("au-abn", "ABN 51 824 753 557")]


def test_rules(spark):
    rows = [(i, t) for i, (_, t, _) in enumerate(ACCEPT)] + [(1000 + i, t) for i, (_, t) in enumerate(REJECT)]
    found = {}
    for r in detect(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault((r["doc_id"], r["rule_id"]), []).append(r["text"])
        assert dict(rows)[r["doc_id"]][r["start"] : r["end"]] == r["text"]
    for i, (rule, _, want) in enumerate(ACCEPT):
        if want is not None:
            assert found.get((i, rule)) == [want], (rule, found.get((i, rule)))
    for i, (rule, _) in enumerate(REJECT):
        assert (1000 + i, rule) not in found


def test_validators(spark):
    good = {"de.idnr": "86095742719", "uk.nhs": "9434765919", "au.abn": "51824753556", "us.rtn": "021000021", "pl.pesel": "44051401359", "pl.nip": "1060000062", "fr.siren": "732829320", "nl.bsn": "111222333", "br.cnpj": "11222333000181", "ro.cnp": "1800101221144", "cz.ico": "25596641", "no.orgnr": "974760673", "uk.utr": "1955839661", "be.nn": "85073003328"}
    row = spark.range(1).select(*[F.coalesce(V.VALIDATORS[k](F.lit(v)), F.lit(False)).alias(k.replace(".", "_")) for k, v in good.items()]).first()
    assert [k for k, ok in row.asDict().items() if not ok] == []
    row = spark.range(1).select(*[F.coalesce(V.VALIDATORS[k](F.lit(v[:-1] + str((int(v[-1]) + 1) % 10))), F.lit(False)).alias(k.replace(".", "_")) for k, v in good.items()]).first()
    assert [k for k, ok in row.asDict().items() if ok] == []


def test_normalize_keeps_length(spark):
    t = "a b—“c” 😀"
    r = spark.range(1).select(S.normalize_search(F.lit(t)).alias("x")).first()["x"]
    assert len(r) == len(t) and r == 'a b-"c" 😀'


def test_offsets(spark):
    r = spark.createDataFrame([("é😀x",)], "t string").select(S.utf8_offset("t", F.lit(2)).alias("b"), S.utf16_offset("t", F.lit(2)).alias("u"), S.from_utf16("t", F.lit(3)).alias("c"), S.from_utf16("t", F.lit(2)).alias("n")).first()
    assert tuple(r) == (6, 3, 2, None)


AGREEMENT = """This Agreement is made on 5 March 2024 between Acme Holdings Ltd. (the "Seller") and Novák Trading s.r.o., represented by Jan Novák, residing at 12 Main Street, London, and Dr. Emma Weber.
The fee is USD 1,250,000.00 (in words: one million) and Acme Holdings agrees. Tax id: CZ12345678. phone: +420 777 123 456
IN WITNESS WHEREOF
/s/ John Smith
By: Mary Jones   Title: CEO
"""


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, AGREEMENT), (2, None), (3, "")], "doc_id long, text string")
    rows = resolved(docs).orderBy("start").collect()
    got = {(r["label"], r["text"]) for r in rows}
    assert {("date", "5 March 2024"), ("organization", "Acme Holdings Ltd."), ("organization", "Novák Trading s.r.o."), ("person", "Jan Novák"), ("person", "John Smith"), ("person", "Mary Jones"), ("tax identification number", "CZ12345678"), ("organization", "Acme Holdings")} <= got
    assert all(a["end"] <= b["start"] for a, b in zip(rows, rows[1:])) and all(AGREEMENT[r["start"] : r["end"]] == r["text"] for r in rows)
    out = {r["doc_id"]: r for r in redacted(docs).collect()}
    assert "John Smith" not in out[1]["redacted_text"] and "[ORGANIZATION_1]" in out[1]["redacted_text"] and out[2]["redacted_text"] is None and out[3]["redacted_text"] == ""
    # the alias has the number of its source
    assert out[1]["redacted_text"].count("[ORGANIZATION_1]") == 2
    assert resolved(docs, PipelineConfig(labels=("date",))).select("label").distinct().collect()[0][0] == "date"
    with pytest.raises(ValueError):
        PipelineConfig(threshold=2)


def test_structured_documents():
    td3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    assert [e.label for e in scanner.structured(td3)] == ["passport number"]
    assert scanner.structured(td3.replace("L898902C36", "L898902C37")) == []
    assert [e.label for e in scanner.structured("%B4111111111111111^DOE/JOHN^2912101000000?")] == ["credit card number"]


def test_merge_has_no_overlaps():
    r = random.Random(5)
    text = "x" * 200
    for _ in range(200):
        found = [scanner.entity(text, a := r.randrange(190), min(200, a + r.randrange(1, 20)), r.choice(["person", "address", "country", "organization"]), r.random(), r.choice(list(filters.PRIORITY))) for _ in range(12)]
        kept = scanner.merge(found)
        assert all(a.end <= b.start for a, b in zip(kept, kept[1:])) and set(kept) <= set(found)
        assert all(0 <= e.start < e.end <= 200 for e in scanner.sanitise("ab, " * 50, kept))


def test_detectors():
    get = lambda f, t: [e.text for e in f(t)]
    assert get(scanner.dates, "on 3rd of May 2021 at 10:30 and märz, may be") == ["3rd of May 2021 at 10:30"]
    assert get(scanner.money, "pay € 1.200,50 or 5 million dollars, not 100 shares") == ["€ 1.200,50", "5 million dollars"]
    assert get(scanner.legal_forms, "by Alpha & Beta GmbH and the Ministry of Foreign Affairs today") == ["Alpha & Beta GmbH", "Ministry of Foreign Affairs"]
    assert get(scanner.names, "met Dr. Weber and Anna Smith, 王小明") == ["Dr. Weber", "Anna Smith", "王小明"]
    assert get(lambda t: scanner.addresses(t, []), "at 5 Baker Street, London today") == ["5 Baker Street, London"]


def test_redaction(spark):
    text = "a@b.cz, A@B.cz and c@d.cz [EMAIL_ADDRESS_2] call 123456"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = detect(docs, [BY_ID["email"]]).drop("rule_id")
    num = spark.createDataFrame([(1, len(text) - 6, len(text), "number", "123456", 1.0, "regex", 99)], "doc_id long, start int, end int, label string, text string, score double, source string, seq long")
    out = redact.redact(docs, e.unionByName(num), {"number": {"type": "mask", "char": "#", "n": 4, "from": "start"}}).first()
    assert out["redacted_text"] == "[EMAIL_ADDRESS_1], [EMAIL_ADDRESS_1] and [EMAIL_ADDRESS_3] [EMAIL_ADDRESS_2] call ####56"
    assert [(m["placeholder"], m["original"]) for m in out["redaction_map"]] == [("[EMAIL_ADDRESS_1]", "a@b.cz"), ("[EMAIL_ADDRESS_3]", "c@d.cz")]
    with pytest.raises(ValueError):
        redact.with_operators(e, {"x": {"type": "mask", "char": "ab"}})


def test_sessions(spark):
    e = spark.createDataFrame([("s_1", 1, 0, "person", "Ann"), ("s_1", 2, 0, "person", "ann"), ("s_1", 2, 5, "person", "Bob")], "session_id string, doc_seq int, start int, label string, text string")
    _, first = session.plan(e.where("doc_seq = 1"), spark.createDataFrame([], session.MAPPING))
    rows, mapping = session.plan(e.where("doc_seq = 2"), first)
    assert {r["text"]: r["placeholder"] for r in rows.collect()} == {"ann": "[PERSON_s%5F1_1]", "Bob": "[PERSON_s%5F1_2]"}
    docs = spark.createDataFrame([("s_1", 1, "hi [PERSON_s%5F1_2] and [PERSON_s%5F1_1] [OTHER_1]"), ("s_1", 2, "[PERSON_s%5F1_9]")], "session_id string, doc_id long, text string")
    back = {r["doc_id"]: r for r in session.restore(docs, mapping).collect()}
    assert back[1]["restored"] == "hi Bob and Ann [OTHER_1]" and back[2]["restored"] is None
    assert session.collisions(docs).count() == 2
    states = session.to_json(mapping)
    again = session.from_json(session.unseal(session.seal(states, b"0" * 16), b"0" * 16))
    assert sorted(map(tuple, again.select(mapping.columns).collect())) == sorted(map(tuple, mapping.collect()))


def test_external_detections(spark):
    docs = spark.createDataFrame([(1, "é John")], "doc_id long, text string")
    batch = '{"version":1,"document":{"sha256":"%s"},"offsetUnit":"%s","provider":{"id":"p1","name":"n","version":"1"},"labelMap":[{"providerLabel":"PER","entityLabel":"person"}],"detections":[{"id":"d1","start":%d,"end":%d,"label":"%s","score":0.8}]}'
    sha = docs.select(F.sha2("text", 256)).first()[0]
    lines = [batch % (sha, "utf-8", 3, 7, "PER"), batch % (sha, "utf-16", 2, 6, "PER"), batch % (sha, "code-point", 2, 60, "PER"), batch % ("0" * 64, "utf-8", 0, 1, "PER"), batch % (sha, "utf-8", 3, 7, "LOC")]
    rows = spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", external.BATCH).alias("b")).select("b.*")
    entities, errors = external.detections(rows, docs)
    assert [r["text"] for r in entities.collect()] == ["John", "John"]
    assert sorted(r["error_code"] for r in errors.collect()) == ["bad-span", "unknown-document", "unmapped-label"]


def test_dictionaries(spark):
    docs = spark.createDataFrame([(1, "Visit Novotny Bank in Prague, near Novotni Bnk. prague!")], "doc_id long, text string")
    terms = dictionary.gazetteer_terms(spark.createDataFrame([("Novotny Bank", "organization", None)], "canonical string, label string, variants array<string>"))
    assert {(r["text"], r["score"]) for r in dictionary.gazetteer(docs, terms).collect()} == {("Novotny Bank", 0.9), ("Novotni Bnk", 0.85)}
    d = dictionary.assemble(spark.createDataFrame([("Prague", "address", "deny-list"), ("Novotny", "person", "names"), ("Novotny Bank", "organization", "banks")], "value string, label string, source string"))
    assert {r["text"] for r in dictionary.deny_list(docs, d).collect()} == {"Novotny Bank", "Prague"}


def test_long_terms(spark):
    term = "The Royal Society of Old and New Friends of the Northern Sea"
    wide = " ".join(["Wissenschaftsgesellschaft"] * 7)
    near = term.replace("Friends", "Fri ends")
    docs = spark.createDataFrame([(1, f"By {term} in May"), (2, f"by {wide} now"), (3, f"x {wide[:-1]}y z"), (4, f"by {near} now")], "doc_id long, text string")
    frame = lambda label: spark.createDataFrame([(term, label), (wide, label)], "value string, label string")
    found = lambda rows: {(r["doc_id"], r["text"]) for r in rows.collect()}
    whole = {(1, term), (2, wide)}
    assert found(dictionary.deny_list(docs, dictionary.assemble(frame("organization").withColumn("source", F.lit("s"))))) == whole
    assert found(dictionary.custom_deny_list(docs, frame("x"))) == whole
    assert found(dictionary.countries(docs, frame("x").selectExpr("value as surface", "label as code"))) == whole
    terms = dictionary.gazetteer_terms(frame("x").selectExpr("value as canonical", "label", "cast(null as array<string>) as variants"))
    assert found(dictionary.gazetteer(docs, terms, fuzzy=False)) == whole
    assert whole | {(3, wide[:-1] + "y"), (4, near)} <= found(dictionary.gazetteer(docs, terms))


def test_literal_passages(spark):
    long = "the quick\nbrown fox jumps over the lazy dog"
    passages = {1: long, 2: "two words", 3: "x", 4: "eins zwei drei vier fünf sechs", 5: "漢字漢字漢字", 6: "  a  b \n c d e f", 7: "", 8: None, 9: "😀é", 10: "a b c d e f g"}
    around = ["%s", 'say "%s" now', "(%s)", "tab\t%s\tend", "line\n%s\nend", "glued%sglued", "before %s after"]
    texts = [a % (p or "none") for a in around for p in passages.values()] + [long.replace("\n", " "), "", None, "twowords", "漢字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = dictionary.literal_scan(docs, spark.createDataFrame(list(passages.items()), "item_id long, text string"))
    want = {(d, i) for d, t in enumerate(texts) for i, p in passages.items() if t and p and p in t}
    assert sorted(map(tuple, rows.collect())) == sorted(want)
    few = dictionary.literal_scan(docs, spark.createDataFrame([(1, long)], "item_id long, text string"))
    assert sorted(map(tuple, few.collect())) == sorted(x for x in want if x[1] == 1)


def test_pipeline_with_tables(spark):
    from spanveil.plans.pipeline import DEFAULT, Tables

    texts = [(1, "We saw Orbitex and zorb near Freedonia, said quux."), (1, "plain words"), (None, "Nothing but Freedonia here"), (2, None), (3, "hello wibble there")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = Tables(
        deny_list=dictionary.assemble(frame([("Orbitex", "organization", "deny-list")], "value string, label string, source string")),
        custom_deny_list=frame([("zorb", "project")], "value string, label string"),
        gazetteer=frame([("quux", "codename", None)], "canonical string, label string, variants array<string>"),
        countries=frame([("Freedonia", "FD")], "surface string, code string"),
        caller=frame([(3, 6, 12, "thing", 0.8), (3, 90, 99, "thing", 0.8)], "doc_id long, start int, end int, label string, score double"),
    )
    found = lambda c, t=tables: {(r["doc_id"], r["text"], r["label"], r["source"]) for r in resolved(docs, c, tables=t).collect()}
    on = {(1, "Orbitex", "organization", "deny-list"), (1, "zorb", "project", "deny-list"), (1, "Freedonia", "country", "country"), (None, "Freedonia", "country", "country"), (3, "wibble", "thing", "caller")}
    assert on <= found(PipelineConfig())
    assert on | {(1, "quux", "codename", "gazetteer")} <= found(PipelineConfig(detectors=(*DEFAULT, "gazetteer")))
    assert not {x[3] for x in found(PipelineConfig(detectors=("regex",)))} & {"deny-list", "country", "caller", "gazetteer"}
    out = {r["doc_id"]: r["redacted_text"] for r in redacted(docs.where("doc_id = 3"), tables=tables).collect()}
    assert out == {3: "hello [THING_1] there"}


def test_files_and_office(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "a.txt").write_text("hello", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"a\x00b")
    assert [r["text"] for r in text_source.text_files(spark, str(tmp_path)).collect()] == ["hello"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Jan </w:t></w:r><w:r><w:t>Novák</w:t></w:r></w:p></w:body></w:document>')
    assert office.docx_blocks(buf.getvalue()) == [("word/document.xml", 0, "word/document.xml#0", "Jan Novák")]
    new = office.rewrite_docx(buf.getvalue(), {"word/document.xml#0": ("Jan Novák", "[PERSON_1]")})
    assert office.docx_blocks(new)[0][3] == "[PERSON_1]"
    with pytest.raises(ValueError):
        office.rewrite_docx(buf.getvalue(), {"word/document.xml#0": ("stale", "x")})
    assert office.pdf_facts(b"%PDF-1.7 /Type /Page /Subtype /Image")["coverage"] == "partial"


def test_blocks(spark):
    b = spark.createDataFrame([(1, 0, "a", "one two", None), (1, 1, "b", "three", None)], "doc_id long, pos int, block_id string, text string, meta map<string,string>")
    found = blocks.run_rules(b, {"r": lambda x: blocks.block_rule(x, "r", "t[a-z]+", "t word", "replace", "T")})
    assert [r["text"] for r in blocks.apply_actions(b, found).orderBy("pos").collect()] == ["one T", "T"]
    assert blocks.invalid(found.withColumn("end", F.lit(99)), b).count() == 2
    p = spark.createDataFrame([(1, 7, "insert_after", "a", "n", "new", None), (1, 7, "remove", "b", None, None, None)], "doc_id long, revision int, op string, block_id string, new_id string, text string, meta map<string,string>")
    done, rejected = blocks.apply_patches(b, p, 7)
    assert [r["text"] for r in done.orderBy("pos").collect()] == ["one two", "new"] and rejected.count() == 0
    assert blocks.apply_patches(b, p, 8)[1].count() == 2


def test_streams(spark, tmp_path):
    from spanveil.streaming import streams

    spark.createDataFrame([("s", 1, 0, "person", "Ann"), ("s", 2, 3, "person", "Bob"), ("s", 3, 1, "person", "ann")], "session_id string, doc_seq int, start int, label string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("session_id string, doc_seq int, start int, label string, text string").parquet(str(tmp_path / "in"))
    q = streams.session_placeholders(source).writeStream.format("memory").queryName("placed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["text"]: r["placeholder"] for r in spark.sql("select * from placed").collect()} == {"Ann": "[PERSON_s_1]", "Bob": "[PERSON_s_2]", "ann": "[PERSON_s_1]"}


#: Published examples of valid numbers.
NUMBERS = {
    "au.acn": ["004 085 616"], "at.businessid": ["FN 122119m"], "at.tin": ["59-119/9013"], "at.uid": ["AT U13585627"], "be.vat": ["BE403019261"], "bg.vat": ["BG 175 074 752"], "cy.vat": ["CY-10259033P"],
    "cz.dic": ["CZ 25123891", "7103192745", "640903926"], "de.svnr": ["15 070649 C 10 3"], "de.vat": ["DE 136695976"], "dk.vat": ["DK 13585628"], "ee.ik": ["36805280109"], "ee.vat": ["EE 100 931 558"],
    "es.cif": ["J99216582", "A13 585 625"], "es.dni": ["54362315-K"], "es.nie": ["X-2482300W"], "es.vat": ["ES54362315K"], "fi.hetu": ["131052-308T"], "fi.vat": ["FI 20774740"], "fi.ytunnus": ["2077474-0"],
    "fr.tva": ["FR 40 303 265 045"], "gb.vat": ["GB 980 7806 84"], "gr.vat": ["EL 094259216", "GR 94259216"], "hr.vat": ["HR 33392005961"], "hu.vat": ["HU-12892312"], "ie.pps": ["6433435F", "6433435FT"], "ie.vat": ["IE 6433435F", "IE 8D79739I"],
    "it.codiceFiscale": ["RCCMNL83S18D969H"], "lt.asmens": ["33309240064"], "lt.vat": ["119511515", "100001919017"], "lu.vat": ["LU 150 274 42"], "lv.vat": ["LV 4000 3521 600", "161175-19997"], "mt.vat": ["MT-1167-9112"],
    "nl.vat": ["NL004495445B01", "NL002455799B11"], "no.mva": ["NO 995 525 828 MVA"], "pt.cc": ["00000000 0 ZZ4"], "pt.vat": ["PT 501 964 843"], "ro.vat": ["RO 185 472 90"], "se.personnummer": ["880320-0016"],
    "si.vat": ["SI 5022 3054"], "sk.dic": ["SK 202 274 96 19"], "us.rtn": ["111000025"], "dk.cpr": ["211062-5629"], "de.stnr": ["181/815/08155"], "eu.vat": ["DE136695976", "ATU13585627"],
}
#: No checksum, or none over the last digit.
UNCHECKED = {"at.businessid", "dk.cpr", "de.stnr", "NL004495445B01"}


def test_numbers_of_all_countries(spark):
    from spanveil.functions.idnumbers import ALL

    rows = [(name, v, True) for name, values in NUMBERS.items() for v in values]
    for name, values in NUMBERS.items():
        for v in values:
            at = max(i for i, c in enumerate(v) if c.isdigit())
            rows += [(name, v[:at] + str((int(v[at]) + 1) % 10) + v[at + 1 :], False)] if not {name, v} & UNCHECKED else []
            rows += [(name, v + "77777", False), (name, "", False)]
    for name in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == name]
        got = {r["v"]: r["ok"] for r in spark.createDataFrame(mine, "name string, v string, want boolean").select("v", F.coalesce(ALL[name](F.col("v")), F.lit(False)).alias("ok")).collect()}
        assert got == {v: want for _, v, want in mine}, name


def test_contextual_identifiers(spark):
    lines = [
        ("ETH wallet 0x742d35Cc6634C0532925a3b844Bc454e4438f44e.", "crypto", "0x742d35Cc6634C0532925a3b844Bc454e4438f44e"), ("BTC wallet 1BoatSLRHtKNngkdXEeobR76b53LETtpyT.", "crypto", "BTC wallet 1BoatSLRHtKNngkdXEeobR76b53LETtpyT"),
        ("Bitcoin address BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4.", "crypto", "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4"), ("US passport number X12345678 was inspected.", "passport number", "US passport number X12345678"),
        ("UK passport no 123456789 was copied.", "passport number", "UK passport no 123456789"), ("Passport No. A1234567 was listed.", "passport number", "Passport No. A1234567"), ("French passport number 12AB34567 was checked.", "passport number", "French passport number 12AB34567"),
        ("NHS No. 401 023 2137 was present.", "national identification number", "NHS No. 401 023 2137"), ("National Health Service # 401 023 2137 again.", "national identification number", "National Health Service # 401 023 2137"),
        ("CNI nº 12AB34567 was attached.", "identity card number", "CNI nº 12AB34567"), ("Carte Nationale D’Identité n° 12AB34567 was attached.", "identity card number", "Carte Nationale D’Identité n° 12AB34567"),
        ("Cyprus TIC: 12345678X was recorded.", "tax identification number", "Cyprus TIC: 12345678X"), ("Cypriot ID card no 123456 was copied.", "identity card number", "Cypriot ID card no 123456"),
        ("UK driving licence MORGA657054SM9IJ was verified.", "identity card number", "UK driving licence MORGA657054SM9IJ"), ("UK driving licence LEE99706030J99AB was verified.", "identity card number", "UK driving licence LEE99706030J99AB"),
        ("CA driver’s license no D1234567 was scanned.", "identity card number", "CA driver’s license no D1234567"), ("GMC number: 1234567 was checked.", "registration number", "GMC number: 1234567"), ("NMC PIN 12A3456B was checked.", "registration number", "NMC PIN 12A3456B"),
        ("(Companies House: 09876543) is the parent.", "registration number", "09876543"), ("Self Assessment UTR: 1234567890 was filed.", "tax identification number", "1234567890"), ("ABN 83 914 571 673", "tax identification number", "83 914 571 673"),
        ("Norwegian orgnr 923 609 016", "registration number", "923 609 016"), ("Norwegian VAT NO 995 525 828 MVA", "tax identification number", "NO 995 525 828 MVA"), ("EIN 04-2103594", "tax identification number", "04-2103594"),
        ("The company UID is CHE-101.374.515.", "registration number", "CHE-101.374.515"), ("Signed at Cork on 3 May", "address", "Cork"), ("V Praze dne 3. 5.", "address", "Praze"), ("Wien, den 3. Mai", "address", "Wien"), ("VAT DE136695976", "tax identification number", "DE136695976"),
    ]
    wrong = ["NHS number 401 023 2138 was a typo.", "The company UID is CHE-101.374.516.", "VAT DE136695977"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([x[0] for x in lines] + wrong)], "doc_id long, text string")
    got = {}
    for r in detect(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["label"], r["text"]))
    for i, (_, label, value) in enumerate(lines):
        assert (label, value) in got.get(i, set()), (lines[i], got.get(i))
    kinds = {"national identification number", "registration number", "tax identification number"}
    assert not any(label in kinds for i in range(len(lines), len(lines) + len(wrong)) for label, _ in got.get(i, set()))


def test_html(spark):
    pages = {
        "<p>a&#233;b&#x1F600;&#x110000;&#xD800;&amp;lt; &LDQUO;q&rdquo; &copy;</p><p></p><p></p><br/><div>x&nbsp;&nbsp;y</div>": "aéb😀&#x110000;&#xD800;&lt; “q” &copy;\n\nx y",
        "<script>no</script>one<!-- no\n-->two<STYLE a=b>no</STYLE >": "one two no",
        "a<b>c": "a c", "": "", "&;&#;&#abc;": "&;&#;&#abc;", "  \n\n z \u3000w ": "z w",
    }
    rows = spark.createDataFrame([(k,) for k in pages] + [(None,)], "html string").select("html", text_source.html_to_text("html").alias("t")).collect()
    assert {r["html"]: r["t"] for r in rows} == pages | {None: None}


def test_clues_of_rules_lose_no_match(spark):
    """Far from a digit, a text isn't scanned for digit rules; what stands next to long prose, at seams and in one run is still found."""
    from dataclasses import replace

    from spanveil.operators import rules as R

    prose = "Lorem ipsum dolor sit amet consectetur " * 12
    held = ["bc1" + "q" * 71, "Sozialversicherungsnummer: 65 170839 J 003", "bitcoin wallet address: 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "My US passport number: 123456789", "Fait à Paris, le 3", "V Praze dne 4", "Berlin, den 3",
            "write joe at example dot org", "fe80::1", "00:1b:44:11:3a:b7", "www.example.org/x", "api_key = abcdefabcdef0123", "a!b@c.example.d@e.example", "x.y@z@q.example", "4111 1111 1111 1111", "10.0.0.1"]
    texts = [t for h in held for t in (h, prose + h, h + " " + prose, prose + h + "é " + prose + "7 " + prose + h)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    bare = lambda r: replace(r, needs=None, clue=None, near=False, digit=False, pattern=r.pattern.replace(R.RUN, ""))
    chosen = [R.BY_ID[k] for k in ("email", "email-written", "ipv4", "ipv6", "mac", "url", "card", "bech32", "base58", "passport", "signing-place", "de-svnr", "secret")]
    got, want = (sorted(map(tuple, R.detect(docs, rules).select("doc_id", "start", "end", "rule_id", "seq").collect())) for rules in (chosen, [bare(r) for r in chosen]))
    assert got == want and {g[3] for g in got} == {r.rule_id for r in chosen}
    short = spark.createDataFrame([(prose + "12" + prose,)], "t string").select(R.near_digits(F.col("t"))).first()[0]
    assert len(short) == 4 * R.NEAR + 4 and short[2 * R.NEAR + 1 : 2 * R.NEAR + 3] == "12"
