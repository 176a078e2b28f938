"""The registered queries op1 to op10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annlink, chat, common, language, mixing, oracle, packing, quality, repeats, setjoin, toxicity, trees


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(*(common.table(spark, sf_dir, t) for t in ("documents", "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    read = chat.digests(chat.conversations(chat.chains(rows)))
    return read.withColumn("conv_id", F.when(F.col("tree") != "null", F.col("tree")).cast("long")).drop("tree")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.fold("doc_id", 4) == 2
    model = language.fit(language.sample(docs, ~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents")).drop("shard")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annlink.near_links(common.table(spark, sf_dir, "embeddings"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = trees.fit(common.labelled_sample(docs, labels, "quality", common.fold("doc_id", 5) != 0))
    return trees.rules(docs, model)


def queries() -> dict:
    return {f.__name__: f for f in (op1_repeats, op2_toxicity, op3_chat, op4_quality, op5_language, op6_packing, op7_mixing, op8_jaccard, op9_embeddings, op10_rules)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
