"""Filters and score operators on entity rows, all relational.

Entities are rows: doc_id, start, end, label, text, score, source, seq and what else they carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S

LINE = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("l", T.StringType())])

#: Sources by priority, the higher the stronger. Fixed values.
PRIORITY = {"gazetteer": 5, "trigger": 4, "legal-form": 3, "regex": 3, "country": 3, "deny-list": 2, "coreference": 2, "caller": 1, "ner": 1}

# Default threshold, near-miss band, its bonus, anchors' score and distance.
THRESHOLD, BAND, BONUS, ANCHOR, NEAR = 0.3, 0.15, 0.05, 0.9, 150
# Score added in a zone.
ZONE_BOOST = {"header": 0.10, "signature": 0.15, "table": 0.05, "body": 0.0}

HEADING = r"^\s*(?:(?:I\.|1\.)\s|(?i:article|art\.|section|clause|artikel|abschnitt|článek|čl\.|articolo|artículo)\s*[0-9IVX]|§\s*[0-9])"
SIGNING = r"(?i)(?:in witness whereof|/s/|signature|signed by|unterschrift|ort, datum|podpis|fait à|firma)"


def priority(source="source"):
    return F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col(source)], F.lit(0))


def label_filter(entities: DataFrame, labels: list[str] | None) -> DataFrame:
    """Entities of the wanted labels; an empty list wants all."""
    return entities.where(F.col("label").isin(labels)) if labels else entities


def threshold_filter(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    keep = F.col("score") >= threshold
    if "source_detail" in entities.columns:
        keep |= F.coalesce(F.col("source_detail") == "address-context", F.lit(False))
    return entities.where(keep)


def near_miss_boost(entities: DataFrame, threshold: float = THRESHOLD, near: int = NEAR) -> DataFrame:
    """Scores just under the threshold gain BONUS for each strong entity near by; those still under go.

    The strong ones are counted in a window over the middles of a document's entities, so the
    entities are made once and nothing is joined. Middles are doubled: they are whole then.
    """
    around = Window.partitionBy("doc_id").orderBy("_mid").rangeBetween(-2 * near, 2 * near)
    marked = entities.where(F.col("score") >= F.least(F.lit(threshold - BAND), F.lit(ANCHOR))).withColumn("_mid", F.col("start").cast("long") + F.col("end"))
    counted = marked.withColumn("_n", F.count(F.when(F.col("score") >= ANCHOR, 1)).over(around))
    boosted = F.when(F.col("score") >= threshold, F.col("score")).when(F.col("score") >= threshold - BAND, F.least(F.lit(1.0), F.col("score") + BONUS * F.col("_n")))
    return counted.withColumn("score", boosted).where(F.col("score") >= threshold).drop("_mid", "_n")


def zoned_lines(text: Column) -> Column:
    """Array of the lines of a text: a (start), b (end), zone.

    The header ends before the first section heading; the signature zone begins at the last
    signing clause; lines with two tabs or more are tables; the rest is body. A signing clause
    before the heading cancels the header.
    """
    lines = F.split(text, "\n", -1)
    at = S.running(lines, S.empty_of(LINE), lambda p, x: p + F.length(x) + 1, lambda p, x: F.struct(p.alias("a"), (p + F.length(x)).alias("b"), x.alias("l")), lambda *_: F.lit(True))
    start = lambda pattern, ls, k: F.try_element_at(F.transform(F.filter(ls, lambda x: x["l"].rlike(pattern)), lambda x: x["a"]), F.lit(k))

    def zoned(ls: Column, edges: Column) -> Column:
        header = lambda x: (x["a"] < edges["head"]) & (edges["sign"].isNull() | (edges["sign"] >= edges["head"]))
        zone = lambda x: F.when(header(x), "header").when(x["a"] >= edges["sign"], "signature").when(F.length(F.regexp_replace(x["l"], r"[^\t]", "")) >= 2, "table").otherwise("body")
        return F.transform(ls, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), zone(x).alias("zone")))

    edges = lambda ls: F.struct(F.coalesce(start(HEADING, ls, 1), F.lit(0)).alias("head"), start(SIGNING, ls, -1).alias("sign"))
    return S.bound(at, lambda ls: S.bound(edges(ls), lambda e: zoned(ls, e)))


def zones(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: doc_id, line_start, line_end, zone, see zoned_lines()."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(zoned_lines(F.col(text))).alias("x"))
    return rows.select("doc_id", F.col("x.a").alias("line_start"), F.col("x.b").alias("line_end"), F.col("x.zone").alias("zone"))


def zone_arrays(docs: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """docs (text and an array of entities) whose entities have their zone and the boosted score; a row at a time.

    The line of a span is found by the number of line breaks before its middle.
    """
    boost = F.create_map(*[F.lit(x) for kv in ZONE_BOOST.items() for x in kv])

    def placed(e: Column, ls: Column) -> Column:
        line = F.regexp_count(F.substring(F.col(text), F.lit(1), F.floor((e["start"] + e["end"]) / 2).cast("int")), F.lit("\n"))
        return S.bound(F.coalesce(F.get(ls, line)["zone"], F.lit("body")), lambda z: e.withField("zone", z).withField("score", F.least(F.lit(1.0), e["score"] + F.coalesce(boost[z], F.lit(0.0)))))

    lines = F.when(F.size(entities) > 0, zoned_lines(F.col(text)))
    return S.computed(docs, **{entities: S.bound(lines, lambda ls: F.transform(F.col(entities), lambda e: placed(e, ls)))})


def zone_boost(entities: DataFrame, zoned: DataFrame) -> DataFrame:
    """entities with zone and the boosted score: the zone of the line that holds the middle of the span."""
    middle = F.floor((F.col("e.start") + F.col("e.end")) / 2)
    on = (F.col("e.doc_id") == F.col("z.doc_id")) & (middle >= F.col("z.line_start")) & (middle <= F.col("z.line_end"))
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in ZONE_BOOST.items() for x in kv])[F.col("zone")], F.lit(0.0))
    joined = entities.alias("e").join(zoned.alias("z"), on, "left").select("e.*", F.coalesce("z.zone", F.lit("body")).alias("zone"))
    return joined.withColumn("score", F.least(F.lit(1.0), F.col("score") + boost))


def hotword_adjust(entities: DataFrame, hits: DataFrame, cell: int = 200) -> DataFrame:
    """Apply the strongest hotword near each entity.

    hits: doc_id, hit_start, hit_end, rule, target_label, adjustment, before, after, reclassify.
    The effect fades linearly with distance; the largest magnitude wins, the first on ties;
    scores stay in [0, 1]; a label changes only if the effect is positive. A hit meets the
    spans of its label in the cells of `cell` code points that it reaches, and a span counts in
    the cells that it covers, so the join is an equality. The effect depends on a span and its
    label alone, which are the key.
    """
    place = ["doc_id", "start", "end", "label"]
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(b / cell)))
    spans = entities.select(*place).distinct().withColumn("_cell", cells(F.col("start"), F.col("end")))
    reached = hits.select(F.col("doc_id"), F.col("target_label").alias("label"), "hit_start", "hit_end", "rule", "adjustment", "before", "after", "reclassify", cells(F.col("hit_start") - F.col("after"), F.col("hit_end") + F.col("before")).alias("_cell"))
    gap = F.when(F.col("hit_end") <= F.col("start"), F.col("start") - F.col("hit_end")).when(F.col("hit_start") >= F.col("end"), F.col("hit_start") - F.col("end")).otherwise(F.lit(0))
    reach = F.when(F.col("hit_end") <= F.col("start"), F.col("before")).otherwise(F.col("after"))
    near = spans.join(reached, ["doc_id", "label", "_cell"]).withColumn("_gap", gap).withColumn("_reach", reach).where(F.col("_gap") <= F.col("_reach"))
    near = near.withColumn("_effect", F.col("adjustment") * (1 - F.col("_gap") / F.col("_reach")))
    best = F.min(F.struct((-F.abs("_effect")).alias("w"), "hit_start", "rule", "_effect", "reclassify")).alias("_best")
    top = near.groupBy(*place).agg(best).select(*place, "_best._effect", "_best.reclassify")
    out = entities.join(top, place, "left").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.coalesce("_effect", F.lit(0.0)))))
    return out.withColumn("label", F.when((F.col("_effect") > 0) & F.col("reclassify").isNotNull(), F.col("reclassify")).otherwise(F.col("label"))).select(*entities.columns)


def hotword_arrays(docs: DataFrame, entities: str = "entities", hits: str = "hits") -> DataFrame:
    """hotword_adjust() of documents whose entities and hits are arrays beside each other: a row at a time, nothing is joined.

    hits: array of hit_start, hit_end, rule, target_label, adjustment, before, after, reclassify.
    """

    def adjusted(e: Column, hs: Column) -> Column:
        def effect(h: Column) -> Column:
            first = h["hit_end"] <= e["start"]
            gap = F.when(first, e["start"] - h["hit_end"]).when(h["hit_start"] >= e["end"], h["hit_start"] - e["end"]).otherwise(F.lit(0))
            reach = F.when(first, h["before"]).otherwise(h["after"])
            return F.struct((-F.abs(h["adjustment"] * (1 - gap / reach))).alias("w"), h["hit_start"].alias("at"), h["rule"].alias("rule"), (h["adjustment"] * (1 - gap / reach)).alias("effect"), h["reclassify"].alias("label"), (gap <= reach).alias("near"))

        near = F.filter(F.transform(F.filter(hs, lambda h: h["target_label"] == e["label"]), effect), lambda x: x["near"])

        def applied(best: Column) -> Column:
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["score"] + F.coalesce(best["effect"], F.lit(0.0))))
            label = F.when((best["effect"] > 0) & best["label"].isNotNull(), best["label"]).otherwise(e["label"])
            return e.withField("score", score).withField("label", label)

        return S.bound(F.array_min(near), applied)

    return docs.withColumn(entities, S.bound(F.col(hits), lambda hs: F.transform(F.col(entities), lambda e: adjusted(e, hs))))


def drop_nested_same_label(entities: DataFrame) -> DataFrame:
    """Without entities that lie inside an earlier or longer one of their label: a running maximum of ends."""
    order = Window.partitionBy("doc_id", "label").orderBy("start", F.desc("end"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    return entities.withColumn("_reach", F.max("end").over(order)).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def dedup_spans(entities: DataFrame) -> DataFrame:
    """One entity a span: the best by score, source priority and order."""
    best = F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("score"), priority().desc(), "seq"))
    return entities.withColumn("_k", best).where("_k = 1").drop("_k")


def same_span_conflicts(entities: DataFrame) -> DataFrame:
    """Of entities with equal spans: persons beat addresses and countries, then the top source priority stays, and precise labels beat addresses."""
    span = Window.partitionBy("doc_id", "start", "end")
    marked = entities.withColumn("_person", F.max((F.col("label") == "person").cast("int")).over(span)).withColumn("_top", F.max(priority()).over(span))
    kept = marked.where(~((F.col("_person") == 1) & F.col("label").isin("address", "country", "land parcel"))).where(priority() == F.col("_top"))
    precise = F.max((F.col("label") != "address").cast("int")).over(span)
    return kept.withColumn("_precise", precise).where((F.col("_precise") == 0) | (F.col("label") != "address")).drop("_person", "_top", "_precise")


def islands(spans: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Union of spans of each key: spans that overlap, touch or lie at most `gap` apart become one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("start") > reach + gap)).cast("int")
    return spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def merge_adjacent(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities of one label with nothing or up to three of space, tab, comma and hyphen between become one; not countries."""
    order = Window.partitionBy("doc_id", "label").orderBy("start", "end", "seq")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A text meets the entities of its document once, as an array, and hands on their pieces only.
    listed = entities.withColumn("_last", last).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "score", "source", "seq", "_last")).alias("_all"))
    near = lambda e: e["start"].between(e["_last"], e["_last"] + 3)
    cut = lambda at, n: F.substring(F.col("_t"), at + 1, n)
    pieces = F.transform("_all", lambda e: F.struct(e.alias("e"), F.when(near(e), cut(e["_last"], e["start"] - e["_last"])).alias("_gap"), cut(e["start"], e["end"] - e["start"]).alias("_piece")))
    rows = listed.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").select("doc_id", F.explode(pieces).alias("p")).select("doc_id", "p.e.*", "p._gap", "p._piece")
    joined = (F.col("label") != "country") & F.col("_gap").rlike(r"^[ \t,\-]*\z")
    grouped = rows.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    part = F.struct("start", "end", "seq", F.concat(F.when(F.col("_new") == 0, F.col("_gap")).otherwise(""), "_piece").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")
    out = grouped.groupBy("doc_id", "label", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.min_by("source", "seq").alias("source"), F.min("seq").alias("seq"), text.alias("text"))
    return out.select("doc_id", "start", "end", "label", "text", "score", "source", "seq")


def counts_by(entities: DataFrame, keys: list[str]) -> DataFrame:
    return entities.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entities"))


def rollup_by(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Counts at all levels, null for the levels that are summed over."""
    return entities.rollup(*keys).agg(F.count(F.lit(1)).alias("n_entities"))
