"""External detections: batches of spans by other detectors, joined to documents by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S

BATCH = "version int, document struct<sha256:string>, offsetUnit string, provider struct<id:string,name:string,version:string>, labelMap array<struct<providerLabel:string,entityLabel:string>>, detections array<struct<id:string,start:int,end:int,label:string,score:double>>"
# Limits of a batch, and what an id may be.
MAX_DETECTIONS, ID = 100_000, r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH).option("mode", "FAILFAST").json(path)


def detections(batches: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, errors). Offsets (utf-8, utf-16 or code points) become code points; labels are mapped.

    A batch with an unknown digest or version, too many detections, bad ids, scores or spans,
    or an unmapped label gives error rows (sha256, error_code, detail) and no entity of its own kind.
    """
    keyed = docs.select("doc_id", "text", F.sha2("text", 256).alias("sha256"))
    b = batches.withColumn("sha256", F.col("document.sha256")).join(keyed, "sha256", "left")
    whole = F.when(F.col("version") != 1, "unknown-version").when(F.col("doc_id").isNull(), "unknown-document").when(F.size("detections") > MAX_DETECTIONS, "too-many-detections").when(~F.col("provider.id").rlike(ID), "bad-provider-id")
    checked = b.withColumn("error_code", whole)
    rows = checked.where("error_code is null").select("doc_id", "text", "sha256", "offsetUnit", "provider", F.map_from_entries(F.transform("labelMap", lambda x: F.struct(x["providerLabel"], x["entityLabel"]))).alias("labels"), F.posexplode("detections").alias("seq", "d"))

    def point(at):
        bytes_ = F.length(F.decode(F.substring(F.encode("text", "utf-8"), F.lit(1), at), "utf-8"))
        return F.when(F.col("offsetUnit") == "utf-8", bytes_).when(F.col("offsetUnit") == "utf-16", S.from_utf16("text", at)).otherwise(at)

    placed = rows.withColumns({"start": point(F.col("d.start")).cast("int"), "end": point(F.col("d.end")).cast("int"), "label": F.try_element_at("labels", F.col("d.label"))})
    bad = F.when(~F.col("d.id").rlike(ID), "bad-detection-id").when(F.col("label").isNull(), "unmapped-label").when(F.isnan("d.score") | ~F.col("d.score").between(0, 1), "score-out-of-range").when(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.length("text")), "bad-span")
    tested = placed.withColumn("error_code", bad)
    entities = tested.where("error_code is null").select("doc_id", "start", "end", "label", F.expr("substring(text, start + 1, end - start)").alias("text"), F.col("d.score").alias("score"), F.lit("caller").alias("source"), F.col("provider.id").alias("provider_id"), F.col("d.id").alias("detection_id"), F.col("seq").cast("long").alias("seq"))
    errors = checked.where("error_code is not null").select("sha256", "error_code", F.lit("").alias("detail")).unionByName(tested.where("error_code is not null").select("sha256", "error_code", F.col("d.id").alias("detail")))
    return entities, errors


def duplicate_detections(entities: DataFrame) -> DataFrame:
    """(doc_id, provider_id, detection_id) that come more than once, an error of the caller."""
    return entities.groupBy("doc_id", "provider_id", "detection_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
