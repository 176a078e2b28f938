"""Quality metrics of detected spans against gold spans, and differences of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import islands

IOU = 0.5


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of [a, b) and [c, d) over their union."""
    shared = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))
    union = (b - a) + (d - c) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def map_labels(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Native labels to common ones (native, common; null drops); a label without an entry stays only if it is common."""
    known = mapping.select(F.col("common").alias("label")).where("label is not null").distinct().withColumn("_is_common", F.lit(True))
    rows = entities.join(mapping.withColumnRenamed("native", "label").withColumn("_has", F.lit(True)), "label", "left").join(known, "label", "left")
    out = F.when(F.col("_has"), F.col("common")).when(F.col("_is_common"), F.col("label"))
    return rows.withColumn("label", out).where("label is not null").drop("common", "_has", "_is_common")


def exact_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """kind (tp, fp, fn) of each span, equal [start, end) and label."""
    keys = ["doc_id", "start", "end", "label"]
    p = predicted.select(*keys).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")))
    g = gold.select(*keys).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id")))
    both = p.withColumn("p", F.lit(True)).join(g.withColumn("g", F.lit(True)), [*keys, "k"], "full")
    return both.select(*keys, F.when(F.col("p") & F.col("g"), "tp").when(F.col("p"), "fp").otherwise("fn").alias("kind"))


def greedy_matches(predicted: DataFrame, gold: DataFrame, least: float = IOU) -> DataFrame:
    """kind of each span by greedy one-to-one assignment, best overlap first (ties by place).

    Only pairs of one document that overlap enough are sorted, in an array of the document.
    """
    p = predicted.select("doc_id", F.col("start").alias("a"), F.col("end").alias("b"), "label")
    g = gold.select("doc_id", F.col("start").alias("c"), F.col("end").alias("d"), "label")
    score = iou(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    pairs = p.join(g, ["doc_id", "label"]).withColumn("s", score).where(F.col("s") >= least)
    line = F.struct((-F.col("s")).alias("s"), "label", "a", "b", "c", "d")
    taken = F.aggregate(
        F.array_sort(F.collect_list(line)),
        F.array().cast("array<struct<s:double,label:string,a:int,b:int,c:int,d:int>>"),
        lambda acc, x: F.when(
            F.exists(acc, lambda y: (y["label"] == x["label"]) & (((y["a"] == x["a"]) & (y["b"] == x["b"])) | ((y["c"] == x["c"]) & (y["d"] == x["d"])))), acc
        ).otherwise(F.concat(acc, F.array(x))),
    )
    won = pairs.groupBy("doc_id").agg(taken.alias("w")).select("doc_id", F.explode("w").alias("w")).select("doc_id", "w.*")
    tp = won.select("doc_id", F.col("a").alias("start"), F.col("b").alias("end"), "label", F.lit("tp").alias("kind"))
    fp = predicted.select("doc_id", "start", "end", "label").join(tp.drop("kind"), ["doc_id", "start", "end", "label"], "left_anti").withColumn("kind", F.lit("fp"))
    hit = won.select("doc_id", F.col("c").alias("start"), F.col("d").alias("end"), "label")
    fn = gold.select("doc_id", "start", "end", "label").join(hit, ["doc_id", "start", "end", "label"], "left_anti").withColumn("kind", F.lit("fn"))
    return tp.unionByName(fp).unionByName(fn)


def prf(scored: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 by key; 0 where a denominator is 0."""
    n = {k: F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("tp", "fp", "fn")}
    c = scored.groupBy(*keys).agg(*n.values())
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    c = c.withColumns({"precision": p, "recall": r})
    return c.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def covered(mentions: DataFrame, masks: DataFrame) -> DataFrame:
    """mentions with covered: whether one merged mask holds the mention."""
    merged = islands(masks.select("doc_id", "start", "end"), ["doc_id"]).select(F.col("doc_id").alias("_d"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    on = (F.col("doc_id") == F.col("_d")) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b"))
    return mentions.join(merged, on, "left").withColumn("covered", F.col("_d").isNotNull()).drop("_d", "_a", "_b")


def entity_recall(mentions: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Recall of mentions and of entities (an entity is covered if all its mentions are), of direct and quasi identifiers.

    mentions: doc_id, annotator, entity_id, start, end, identifier_type; NO_MASK rows don't count.
    """
    m = covered(mentions.where("identifier_type <> 'NO_MASK'"), masks)
    entities = m.groupBy(*keys, "doc_id", "annotator", "entity_id").agg(F.min("covered").alias("all_covered"))
    by_mention = m.groupBy(*keys).agg(
        F.avg(F.when(F.col("identifier_type") == "DIRECT", F.col("covered").cast("double"))).alias("direct_recall"),
        F.avg(F.when(F.col("identifier_type") == "QUASI", F.col("covered").cast("double"))).alias("quasi_recall"),
        F.avg(F.col("covered").cast("double")).alias("mention_recall"),
    )
    by_entity = entities.groupBy(*keys).agg(F.avg(F.col("all_covered").cast("double")).alias("entity_recall"))
    return by_mention.join(by_entity, keys) if keys else by_mention.crossJoin(by_entity)  # one row each


def char_counts(predicted: DataFrame, gold: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, hidden, gold, both: code points that aren't white space under each mask, by interval arithmetic on merged masks."""
    p = islands(predicted.select("doc_id", "start", "end"), ["doc_id"]).select("doc_id", "start", "end")
    g = islands(gold.select("doc_id", "start", "end"), ["doc_id"]).select("doc_id", "start", "end")
    cut = p.alias("p").join(g.alias("g"), (F.col("p.doc_id") == F.col("g.doc_id")) & (F.col("p.start") < F.col("g.end")) & (F.col("g.start") < F.col("p.end")))
    both = cut.select("p.doc_id", F.greatest("p.start", "g.start").alias("start"), F.least("p.end", "g.end").alias("end"))
    tagged = p.withColumn("m", F.lit("hidden")).unionByName(g.withColumn("m", F.lit("gold"))).unionByName(both.withColumn("m", F.lit("both")))
    size = F.length(F.regexp_replace(F.expr("substring(text, start + 1, end - start)"), r"\s", ""))
    counted = tagged.join(docs.select("doc_id", "text"), "doc_id").withColumn("n", size)
    return counted.groupBy("doc_id").agg(*[F.sum(F.when(F.col("m") == m, F.col("n")).otherwise(0)).cast("long").alias(m) for m in ("hidden", "gold", "both")])


def char_precision_recall(counts: DataFrame) -> DataFrame:
    t = counts.agg(F.sum("hidden").alias("hidden"), F.sum("gold").alias("gold"), F.sum("both").alias("both"))
    return t.select("hidden", "gold", "both", F.when(F.col("hidden") > 0, F.col("both") / F.col("hidden")).otherwise(0.0).alias("precision"), F.when(F.col("gold") > 0, F.col("both") / F.col("gold")).otherwise(0.0).alias("recall"))


def mandatory_contextual(gold: DataFrame, masks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: span_recall and char_recall of mandatory gold spans, and accepted_precision.

    gold: doc_id, start, end, kind (mandatory or contextual). A masked code point is accepted if
    it lies in a gold span of either kind: what is contextual may be masked but need not be.
    """
    must = gold.where("kind = 'mandatory'")
    spans = covered(must, masks).agg(F.coalesce(F.avg(F.col("covered").cast("double")), F.lit(0.0)).alias("span_recall"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        return islands(rows.select("doc_id", "start", "end"), ["doc_id"]).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(name))

    def shared(a: Column, b: Column) -> Column:
        cut = lambda x, y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end"))
        return F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: cut(x, y)))), lambda s: s["start"] < s["end"])

    def chars(found: Column) -> Column:
        size = lambda s: F.length(F.regexp_replace(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), r"\s", ""))
        return F.coalesce(F.sum(F.aggregate(F.transform(found, size), F.lit(0), lambda n, x: n + x)), F.lit(0))

    rows = docs.select("doc_id", "text")
    for name, part in (("must", must), ("all", gold), ("masks", masks)):
        rows = rows.join(listed(part, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<start:int,end:int>>")))
    must_, all_, masks_ = F.col("must"), F.col("all"), F.col("masks")
    counts = rows.agg(chars(shared(masks_, must_)).alias("hit"), chars(must_).alias("must"), chars(shared(masks_, all_)).alias("accepted"), chars(masks_).alias("masked"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return spans.crossJoin(counts.select(share("hit", "must").alias("char_recall"), share("accepted", "masked").alias("accepted_precision")))  # one row each


def shareable(rows: DataFrame, text: str = "text") -> DataFrame:
    """Feedback rows whose text can be shared: letters become x or X and digits 0, so that only lengths, case and punctuation are left."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(text), r"\p{Lu}", "X"), r"[\p{L}&&[^X]]", "x"), r"\p{N}", "0")
    return rows.withColumn(text, shape)


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """The last verdict (by pos) of each doc_id, start, end, label."""
    return verdicts.groupBy("doc_id", "start", "end", "label").agg(F.max_by("verdict", "pos").alias("verdict"))


def run_diff(old: DataFrame, new: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, label, change: added, removed, fixed (a judged miss is found), regression (a judged hit is gone)."""
    keys = ["doc_id", "start", "end", "label"]
    o, n = old.select(*keys).distinct().withColumn("o", F.lit(True)), new.select(*keys).distinct().withColumn("n", F.lit(True))
    both = o.join(n, keys, "full").where("o is null or n is null")
    judged = last_verdicts(verdicts) if verdicts is not None else both.select(*keys, F.lit(None).cast("string").alias("verdict")).limit(0)
    rows = both.join(judged, keys, "left")
    change = F.when(F.col("n") & (F.col("verdict") == "fn"), "fixed").when(F.col("o") & (F.col("verdict") == "tp"), "regression").when(F.col("n"), "added").otherwise("removed")
    return rows.select(*keys, change.alias("change"))


def completeness(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """run_id, docs, entities and whether they are what the summary (run_id, n_docs, n_entities) says."""
    got = runs.groupBy("run_id").agg(F.countDistinct("doc_id").alias("docs"), F.count("start").alias("entities"))
    return summary.join(got, "run_id", "left").select("run_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("entities", F.lit(0)).alias("entities"), ((F.coalesce("docs", F.lit(0)) == F.col("n_docs")) & (F.coalesce("entities", F.lit(0)) == F.col("n_entities"))).alias("complete"))
