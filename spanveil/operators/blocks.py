"""Rules over structured documents: rows doc_id, pos, block_id, text, meta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S

FINDING = ["doc_id", "block_id", "rule_id", "start", "end", "message", "action", "replacement"]
ACTIONS = ("report", "replace", "remove")


def analyse(blocks: DataFrame) -> DataFrame:
    """blocks with words (spans), n_bytes and norm."""
    return blocks.withColumns({"words": S.spans("text", r"[\p{L}\p{N}_]+"), "n_bytes": F.octet_length(F.encode("text", "utf-8")), "norm": F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))})


def neighbourhood(blocks: DataFrame, radius: int) -> DataFrame:
    """blocks with near: the texts of the blocks at most `radius` places away, in order."""
    if not 0 <= radius <= 255:
        raise ValueError("radius is 0 to 255")
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-radius, radius)
    return blocks.withColumn("near", F.collect_list("text").over(frame))


def document_facts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("n_words"), F.countDistinct("text").alias("n_texts"))


def block_rule(blocks: DataFrame, rule_id: str, pattern: str, message: str, action: str = "report", replacement: str | None = None) -> DataFrame:
    """Findings of a pattern in each block."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    rows = blocks.select("doc_id", "block_id", F.explode(S.spans("text", pattern)).alias("s"))
    return rows.select("doc_id", "block_id", F.lit(rule_id).alias("rule_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(message).alias("message"), F.lit(action).alias("action"), F.lit(replacement).cast("string").alias("replacement"))


def run_rules(blocks: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Findings of all rules, in the order of rules; a rule is a function from blocks to findings."""
    out = None
    for rule in rules.values():
        found = rule(blocks).select(*FINDING)
        out = found if out is None else out.unionByName(found)
    return out


def invalid(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings on unknown blocks or out of bounds, with error."""
    size = blocks.select("doc_id", "block_id", F.length("text").alias("_n"))
    checked = findings.join(size, ["doc_id", "block_id"], "left")
    error = F.when(F.col("_n").isNull(), "unknown-block").when((F.col("start") < 0) | (F.col("start") > F.col("end")) | (F.col("end") > F.col("_n")), "span-out-of-bounds")
    return checked.withColumn("error", error).where("error is not null").drop("_n")


def apply_actions(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """blocks with replaced or removed spans (disjoint, first start wins)."""
    edits = findings.where("action <> 'report'").select("doc_id", "block_id", F.struct("start", "end", F.when(F.col("action") == "replace", F.coalesce("replacement", F.lit(""))).otherwise("").alias("replacement")).alias("e"))
    per = edits.groupBy("doc_id", "block_id").agg(S.non_overlapping(F.collect_list("e")).alias("es"))
    return blocks.join(per, ["doc_id", "block_id"], "left").withColumn("text", F.when(F.col("es").isNull(), F.col("text")).otherwise(S.render("text", F.coalesce("es", F.array().cast("array<struct<start:int,end:int,replacement:string>>"))))).drop("es")


def apply_patches(blocks: DataFrame, patches: DataFrame, revision: Column | int) -> tuple[DataFrame, DataFrame]:
    """(patched blocks, rejected patches). patches: doc_id, revision, op (replace_text, insert_after, remove, replace_meta), block_id, new_id, text, meta.

    All patches of a document are taken or none: one with a stale revision or an unknown block rejects them all.
    """
    rev = revision if isinstance(revision, Column) else F.lit(revision)
    known = blocks.select("doc_id", "block_id").withColumn("_known", F.lit(True))
    checked = patches.join(known, ["doc_id", "block_id"], "left").withColumn("error", F.when(F.col("revision") != rev, "stale-revision").when(F.col("_known").isNull(), "unknown-block"))
    bad = checked.where("error is not null").select("doc_id").distinct()
    good = checked.join(bad, "doc_id", "left_anti")
    by = lambda op: good.where(F.col("op") == op)
    texts = by("replace_text").select("doc_id", "block_id", F.col("text").alias("_t"))
    metas = by("replace_meta").select("doc_id", "block_id", F.col("meta").alias("_m"))
    out = blocks.join(by("remove").select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti").join(texts, ["doc_id", "block_id"], "left").join(metas, ["doc_id", "block_id"], "left")
    out = out.withColumns({"text": F.coalesce("_t", "text"), "meta": F.coalesce("_m", "meta"), "_sub": F.lit(0)}).drop("_t", "_m")
    new = by("insert_after").join(blocks.select("doc_id", "block_id", "pos"), ["doc_id", "block_id"]).select("doc_id", F.col("new_id").alias("block_id"), "pos", "text", "meta", F.lit(1).alias("_sub"))
    rows = out.select("doc_id", "block_id", "pos", "text", "meta", "_sub").unionByName(new)
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "_sub", "block_id")) - 1).drop("_sub")
    return placed, checked.join(bad, "doc_id", "left_semi").drop("_known")
