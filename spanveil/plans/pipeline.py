"""The whole detection and redaction of documents, from a configuration.

`resolved` runs regex rules as column expressions and the sequential detectors with
mapInArrow, in one pass over the documents without a shuffle: rule matches travel as an
array beside the text, so even the resolution of a document is narrow, and the redaction
after it is array expressions on the same row. Detectors that the configuration switches off
are not in the plan.

The terms of the dictionary detectors (deny lists, gazetteer, countries) and the detections of
a caller are tables, given as `Tables`. A deny list, custom deny list or list of countries of at
most `lookup.SMALL_TERMS` terms travels with the tasks; larger ones, the gazetteer (its fuzzy
hits need a join) and the caller's spans are joined to the documents before the resolution.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from ..functions.vocab import HOTWORDS
from ..operators import dictionary as D
from ..operators import lookup as L
from ..operators import redact as R
from ..operators import rules as rule_catalogue
from ..operators.curated import declensions
from ..operators.filters import BAND, BONUS, ANCHOR, NEAR, ZONE_BOOST, HEADING, SIGNING

#: Detectors in the fixed order in which their results are concatenated.
ORDER = ("regex", "deny_list", "custom_deny_list", "gazetteer", "countries", "dates", "money", "triggers", "signatures", "legal_forms", "names", "addresses", "structured", "caller")
#: All are on by default but the gazetteer.
DEFAULT = tuple(name for name in ORDER if name != "gazetteer")
RULES_PER_PROJECTION = 8


@dataclass(frozen=True)
class PipelineConfig:
    """What to detect. An empty list of labels wants all."""

    threshold: float = 0.3
    labels: tuple[str, ...] = ()
    language: str | None = None
    detectors: tuple[str, ...] = DEFAULT
    zones: bool = True
    hotwords: bool = True
    confidence_boost: bool = True
    coreference: bool = True
    standalone_streets: bool = False
    name_mode: str = "full"
    custom_regex: tuple[tuple[str, str, float], ...] = ()  # pattern, label, score
    operators: dict[str, dict] = field(default_factory=dict)
    resolve: bool = True  # False: what the detectors find, overlaps and all

    def __post_init__(self):
        unknown = set(self.detectors) - set(ORDER)
        if unknown or not 0 <= self.threshold <= 1 or self.name_mode not in ("full", "supplemental"):
            raise ValueError(f"bad configuration: {unknown or self.threshold}")


@dataclass(frozen=True)
class Tables:
    """What the dictionary detectors look up, and a caller's spans; a missing table finds nothing."""

    deny_list: DataFrame | None = None  # term, labels: of dictionary.assemble()
    stopwords: DataFrame | None = None  # word
    custom_deny_list: DataFrame | None = None  # value, label
    gazetteer: DataFrame | None = None  # canonical, label, variants
    countries: DataFrame | None = None  # surface, code
    ambiguous: DataFrame | None = None  # surface
    names: DataFrame | None = None  # name, kind (first or last), declined (whether case forms count, too)
    caller: DataFrame | None = None  # doc_id, start, end, label, score: of external.detections()


LITERAL = "array<struct<rank:int,start:int,end:int,label:string,score:double,source:string,source_detail:string>>"


def literal_hits(docs: DataFrame, config: PipelineConfig, tables: Tables) -> DataFrame:
    """docs (doc_id, text, found) with `literal`: hits of the dictionaries and the caller, in the order of detectors.

    Hits of terms belong to a text and are joined by its digest, whatever the ids are.
    """

    def shaped(hits: DataFrame, name: str) -> DataFrame:
        detail = F.col("source_detail") if "source_detail" in hits.columns else F.lit(None)
        hits = hits.where(F.col("label").isin(*config.labels)) if config.labels else hits
        return hits.select("doc_id", F.struct(F.lit(ORDER.index(name)).alias("rank"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", F.col("score").cast("double").alias("score"), "source", detail.cast("string").alias("source_detail")).alias("hit"))

    texts = docs.where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("doc_id"), "text")
    runs = {
        "deny_list": lambda t: D.deny_list(texts, t, tables.stopwords, joined=True),
        "custom_deny_list": lambda t: D.custom_deny_list(texts, t),
        "gazetteer": lambda t: D.gazetteer(texts, D.gazetteer_terms(t)),
        "countries": lambda t: D.countries(texts, t, tables.ambiguous),
    }
    hits = [shaped(run(getattr(tables, name)), name) for name, run in runs.items() if name in config.detectors and getattr(tables, name) is not None]
    out = docs.withColumn("literal", F.array().cast(LITERAL))
    more = [c for c in docs.columns if c not in ("doc_id", "text", "found")]
    if hits:
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        by_text = every.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_set("hit").cast(LITERAL).alias("_hits"))
        out = out.withColumn("_key", F.sha2("text", 256)).join(by_text, "_key", "left").withColumn("literal", F.coalesce("_hits", "literal")).drop("_key", "_hits")
    if "caller" in config.detectors and tables.caller is not None:
        spans = shaped(tables.caller.withColumn("source", F.lit("caller")), "caller")
        by_id = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("hit").cast(LITERAL).alias("_spans"))
        out = out.join(by_id, F.col("doc_id") == F.col("_id"), "left").withColumn("literal", F.concat("literal", F.coalesce("_spans", F.array().cast(LITERAL)))).drop("_id", "_spans")
    return out.select("doc_id", "text", "found", F.array_sort("literal").alias("literal"), *more)


def searched(config: PipelineConfig) -> set[str]:
    """The labels to look for: the wanted ones, and those that a hotword can turn into a wanted one. Empty: all."""
    wanted = set(config.labels)
    if wanted and config.hotwords:
        wanted |= {label for _, labels, _, _, _, new in HOTWORDS if new in wanted for label in labels}
    return wanted


def tagged(found: Column, rule: rule_catalogue.Rule) -> Column:
    custom = F.lit(rule.rule_id.startswith("custom-")).alias("custom")
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rule.label).alias("label"), F.lit(rule.score).alias("score"), custom))


def rule_matches(docs: DataFrame, config: PipelineConfig, id_col: str, text: str) -> DataFrame:
    """docs (doc_id, text, and its other columns) with `found`: matches of the wanted regex rules, array of structs."""
    wanted = searched(config)
    chosen = [r for r in rule_catalogue.RULES if not wanted or r.label in wanted] if "regex" in config.detectors else []
    chosen += [rule_catalogue.Rule(f"custom-{i}", label, pattern, score, digit=False) for i, (pattern, label, score) in enumerate(config.custom_regex)]
    kind = "array<struct<start:int,end:int,label:string,score:double,custom:boolean>>"
    more = [c for c in docs.columns if c not in (id_col, text)]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), S.normalize_search(text).alias("_t"), F.array().cast(kind).alias("found"), *more).withColumn("_d", rule_catalogue.near_digits(F.col("_t")))
    for lo in range(0, len(chosen), RULES_PER_PROJECTION):
        parts = [tagged(rule_catalogue.found_by(r), r) for r in chosen[lo : lo + RULES_PER_PROJECTION]]
        out = out.withColumn("found", F.concat("found", *parts).cast(kind))
    return out.drop("_t", "_d")


def carried(config: PipelineConfig, tables: Tables) -> tuple[dict, Tables]:
    """(dictionaries that travel with the tasks, the tables that are left for joins)."""
    out, left = {}, tables
    if "deny_list" in config.detectors and (rows := L.small(tables.deny_list, "term")) is not None and (tables.stopwords is None or (stop := L.small(tables.stopwords, "word")) is not None):
        words = {L.folded(r["word"]) for r in stop if r["word"]} if tables.stopwords is not None else set()
        out["deny_list"] = (L.Lexicon((r["term"], r["labels"]) for r in rows), words)
        left = replace(left, deny_list=None)
    if "custom_deny_list" in config.detectors and (rows := L.small(tables.custom_deny_list, "value")) is not None:
        out["custom_deny_list"] = L.Lexicon(sorted({(L.folded(r["value"]), r["label"]) for r in rows if r["value"]}))
        left = replace(left, custom_deny_list=None)
    if "countries" in config.detectors and (rows := L.small(tables.countries, "surface")) is not None and (tables.ambiguous is None or (odd := L.small(tables.ambiguous, "surface")) is not None):
        no = {L.folded(r["surface"]) for r in odd if r["surface"]} if tables.ambiguous is not None else set()
        terms = {L.folded(r["surface"]) for r in rows if r["surface"]}
        out["countries"] = L.Lexicon((t, "country") for t in sorted(terms - no) if len(t) > 3)
        left = replace(left, countries=None)
    if "names" in config.detectors and tables.names is not None:
        if (rows := L.small(tables.names, "name")) is None:
            raise ValueError(f"names are looked up word by word: at most {L.SMALL_TERMS} of them")
        forms = lambda r: declensions(r["name"]) if r["declined"] else {r["name"]}
        out["names"] = {kind: {f for r in rows if r["name"] and r["kind"] == kind for f in forms(r)} for kind in ("first", "last")}
    return out, left


def lexical(text: str, lexicons: dict, config: PipelineConfig) -> list[dict]:
    """Hits of the dictionaries that travel with the tasks, like those of literal_hits()."""
    out = []

    def add(name: str, a: int, b: int, label: str, score: float, source: str, detail: str | None = None) -> None:
        if not config.labels or label in config.labels:
            out.append({"rank": ORDER.index(name), "start": a, "end": b, "label": label, "score": score, "source": source, "source_detail": detail})

    if "deny_list" in lexicons:
        for a, b, label in L.deny_list(text, *lexicons["deny_list"]):
            add("deny_list", a, b, label, 0.9, "deny-list")
    if "custom_deny_list" in lexicons:
        for a, b, _, labels in lexicons["custom_deny_list"].hits(text):
            for label in labels:
                add("custom_deny_list", a, b, label, 0.9, "deny-list", "custom-deny-list")
    if "countries" in lexicons:
        for a, b, surface, _ in lexicons["countries"].hits(text):
            if L.UPPER.match(surface):
                add("countries", a, b, "country", 0.95, "country")
    return out


def analyse(text: str, found: list[dict], config: PipelineConfig, literal: list[dict] = (), more_names: dict[str, set[str]] | None = None):
    """Resolved entities of one text, from its rule matches, literal hits and the other detectors."""
    import regex

    from ..functions import vocab as V
    from ..operators import scanner as C
    from ..operators.curated import curated

    entities = [C.entity(text, f["start"], f["end"], f["label"], f["score"], "regex", source_detail="custom-regex" if f["custom"] else None) for f in found]
    given = {c: [C.entity(text, h["start"], h["end"], h["label"], h["score"], h["source"], source_detail=h["source_detail"]) for h in literal if (h["source"] == "caller") == c and 0 <= h["start"] < h["end"] <= len(text)] for c in (False, True)}
    dealt = [e for e in given[False] if e.source == "deny-list" and e.source_detail is None]
    entities += [e for e in given[False] if e not in dealt] + curated(text, dealt) if dealt else given[False]
    search, on = text.translate(C.FOLD), config.detectors
    known = (C.FIRST | more_names["first"], C.LAST | more_names["last"]) if more_names else (None, None)
    languages = (config.language,) if config.language in V.MONTHS else tuple(V.MONTHS)
    for name, run in (("dates", lambda t: C.dates(t, languages)), ("money", C.money), ("triggers", C.triggers), ("signatures", C.signatures), ("legal_forms", C.legal_forms), ("names", lambda t: C.names(t, *known, mode=config.name_mode))):
        if name in on:
            entities += run(search)
    if "addresses" in on:
        entities += C.addresses(search, entities, config.standalone_streets)
    if "structured" in on:
        entities += C.structured(search)
    entities += given[True]
    entities = [replace(e, text=text[e.start : e.end]) for e in entities]
    if not config.resolve:
        return sorted((e for e in entities if not config.labels or e.label in config.labels), key=lambda e: (e.start, e.end, e.label))
    if config.zones and entities:
        at, rows = 0, []
        for line in search.split("\n"):
            rows.append((at, at + len(line), line))
            at += len(line) + 1
        head = next((a for a, _, x in rows if regex.search(HEADING, x)), 0)
        sign = next((a for a, _, x in reversed(rows) if regex.search(SIGNING, x)), None)
        head = head if sign is None or sign >= head else 0

        starts = [a for a, _, _ in rows]

        def boosted(e):
            middle = (e.start + e.end) // 2
            line = rows[bisect_right(starts, middle) - 1][2]
            zone = "header" if middle < head else "signature" if sign is not None and middle >= sign else "table" if line.count("\t") >= 2 else "body"
            return replace(e, score=min(1.0, e.score + ZONE_BOOST[zone]))

        entities = [boosted(e) for e in entities]
    if config.hotwords and entities:
        low = search.lower()
        hits = sorted((m.start(), m.end(), k) for k, (words, *_) in enumerate(V.HOTWORDS) if C.holds(low, words) for m in C.compiled(rf"(?<!\w)(?:{C.any_of(words)})(?!\w)", regex.I).finditer(search))
        begins = [a for a, _, _ in hits]
        widest, longest = max(max(h[3], h[4]) for h in V.HOTWORDS), max((b - a for a, b, _ in hits), default=0)

        def adjusted(e):
            best, label = 0.0, None
            for a, b, k in hits[bisect_left(begins, e.start - widest - longest) : bisect_right(begins, e.end + widest)]:
                _, labels, change, before, after, new = V.HOTWORDS[k]
                gap, reach = (e.start - b, before) if b <= e.start else (max(0, a - e.end), after)
                if e.label in labels and gap <= reach and abs(change * (1 - gap / reach)) > abs(best):
                    best, label = change * (1 - gap / reach), new
            return replace(e, score=max(0.0, min(1.0, e.score + best)), label=label if label and best > 0 else e.label)

        entities = [adjusted(e) for e in entities]
    if config.confidence_boost:
        strong = sorted((e.start + e.end) / 2 for e in entities if e.score >= ANCHOR)

        def lifted(e):
            if config.threshold - BAND <= e.score < config.threshold:
                middle = (e.start + e.end) / 2
                near = bisect_right(strong, middle + NEAR) - bisect_left(strong, middle - NEAR)
                return replace(e, score=min(1.0, e.score + BONUS * near))
            return e

        entities = [lifted(e) for e in entities]
    if "addresses" in on:
        entities += C.address_context(search, [e for e in entities if e.score >= config.threshold])
    return C.resolve(text, entities, config.threshold, set(config.labels) or None, config.coreference)


#: An entity, without its document.
FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("source", pa.string()), ("source_detail", pa.string()), ("kind", pa.string()), ("source_text", pa.string()), ("seq", pa.int64())]
ENTITIES = "array<struct<start:int,end:int,label:string,text:string,score:double,source:string,source_detail:string,kind:string,source_text:string,seq:bigint>>"
ROWS = 200


def resolved_arrays(docs: DataFrame, config: PipelineConfig | None = None, id_col: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """docs (doc_id, text and its other columns) with `entities`: no overlaps, in order. Null texts have none."""
    config, tables = config or PipelineConfig(), tables or Tables()
    lexicons, tables = carried(config, tables)
    more = [c for c in docs.columns if c not in (id_col, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import scanner as C

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                cols: list[list] = [[] for _ in FIELDS]
                ends = [0]
                for body, found, literal in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if body:
                        if lexicons:
                            literal = sorted([*literal, *lexical(body.translate(C.FOLD), lexicons, config)], key=lambda h: (h["rank"], h["start"], h["end"], h["label"]))
                        for k, e in enumerate(analyse(body, found, config, literal, lexicons.get("names"))):
                            for c, v in zip(cols, (e.start, e.end, e.label, e.text, e.score, e.source, e.source_detail, e.kind, e.source_text, k), strict=True):
                                c.append(v)
                    ends.append(len(cols[0]))
                entities = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[n for n, _ in FIELDS])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entities), *part.columns[4:]], names=["doc_id", "text", "entities", *more])

    matched = rule_matches(rule_catalogue.spread(docs), config, id_col, text)
    joined = literal_hits(matched, config, tables)
    schema = T.StructType([joined.schema["doc_id"], joined.schema["text"], T.StructField("entities", T.DataType.fromDDL(ENTITIES)), *(joined.schema[c] for c in more)])
    return joined.mapInArrow(run, schema)


def resolved(docs: DataFrame, config: PipelineConfig | None = None, id_col: str = "doc_id", text: str = "text", tables: Tables | None = None) -> DataFrame:
    """Entity rows of all documents: no overlaps, ordered by seq in a document. Null texts have none."""
    return resolved_arrays(docs.select(id_col, text), config, id_col, text, tables).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")


def redacted(docs: DataFrame, config: PipelineConfig | None = None, tables: Tables | None = None) -> DataFrame:
    """The resolved documents redacted with the operators of the configuration, row by row."""
    config = config or PipelineConfig()
    return R.redact_arrays(resolved_arrays(docs, config, tables=tables), config.operators)


def stages(docs: DataFrame, config: PipelineConfig | None = None, tables: Tables | None = None) -> dict[str, DataFrame]:
    """The three results of a run, as DataFrames: detected (what all detectors find, before the resolution), resolved, redacted."""
    config = config or PipelineConfig()
    every = replace(config, resolve=False)
    return {"detected": resolved(docs, every, tables=tables), "resolved": resolved(docs, config, tables=tables), "redacted": redacted(docs, config, tables)}


def diagnostics(entities: DataFrame) -> DataFrame:
    """Counts by source and label, without any matched text."""
    return entities.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
