"""Chat formatting of reply trees.

A tree is a table of nodes with parents. Root-to-leaf paths are enumerated by iterative
self-joins that double their reach: jump k of a node is its ancestor 2**k steps up, made by
joining jump k-1 with itself; then a leaf's path is gathered from the jumps, the long ones
first. A path of d nodes takes log2(d) joins, and only ids take part; texts are joined at
the end. Branches are ranked in their tree by score (mean over the path, ties by leaf), and
each chosen path is formatted as one conversation.

The template marks turns with control strings. Control strings inside texts and roles get a
backslash after their first character, one more if some are there, so undoing takes one
away and any text comes back. The loss mask is the list of spans, in code points of the
formatted string, that hold the texts of the assistant.

Null text: empty. Null role: empty. Null tree id: one tree of its own. A parent that isn't
there makes a root; nodes on a cycle have no root and no path. Repeated rows of a turn
follow each other, by role and text. Empty table: empty result. A conversation is one
output row by contract, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Control strings of public chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_RESTS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True))
_HIDE = re.compile(rf"([<\[])(\\*)({_RESTS})")
_SHOW = re.compile(rf"([<\[])\\(\\*)({_RESTS})")
PLAIN_ROLE = re.compile(r"\w+\Z", re.ASCII)


def escape(text: str) -> str:
    return _HIDE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _SHOW.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the loss mask."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = f"{BEGIN}{role if PLAIN_ROLE.match(role) else escape(json.dumps(role))}\n"
        body = escape(text)
        out += [head, body, END]
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted conversation."""
    turns = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((json.loads(unescape(role)) if role.startswith('"') else role, unescape(rest.removesuffix(END))))
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, up) of each root-to-leaf path; nodes: node and parent (null for a root)."""
    known = nodes.select(F.col("node").alias("parent"))
    jump = common.materialize(
        nodes.select("node", "parent").join(known.withColumn("there", F.lit(True)), "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("to"))
    )
    leaves = nodes.select("node").join(jump.where("to is not null").select(F.col("to").alias("node")).distinct(), "node", "left_anti")
    jumps, n = [jump], nodes.count()
    while not jumps[-1].where("to is not null").isEmpty() and 2 ** (len(jumps) - 1) <= n:
        last = jumps[-1].where("to is not null")
        jumps.append(common.materialize(last.alias("a").join(last.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", F.col("b.to").alias("to"))))
    # Who still has an ancestor after as many steps as there are nodes is on a cycle or leads to one.
    leaves = leaves.join(jumps[-1].where("to is not null").select("node"), "node", "left_anti") if 2 ** (len(jumps) - 1) > n else leaves
    reach = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        step = jumps[k].where("to is not null").select(F.col("node").alias("n"), "to")
        further = reach.join(step, reach["node"] == F.col("n")).select("leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        reach = common.materialize(reach.unionByName(further))  # else each step would plan the ones before twice
    return reach


def best_paths(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, node, up, score, place) of the `keep` best paths of each tree (all if None).

    nodes: tree, node, parent, score. place counts from 1, the highest mean score first.
    """
    steps = common.materialize(paths(nodes).join(nodes.select("tree", "node", "score"), "node"))
    ranked = steps.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("mean").desc_nulls_last(), "leaf"))
    ranked = ranked.withColumn("place", place)
    if keep is not None:
        ranked = ranked.where(F.col("place") <= keep)
    return steps.drop("score", "tree").join(ranked, "leaf").select("tree", "leaf", "node", "up", "mean", "place")


def conversations(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """tree, leaf, place, formatted, mask: one row for each chosen path. nodes: tree, node, parent, role, text, score."""
    nodes = common.materialize(nodes)
    chosen = best_paths(nodes, keep).join(nodes.select("node", "role", "text"), "node")
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.groupBy("tree", "leaf", "place").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(3).to_pylist()]
                mask = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([f for f, _ in done], pa.string()), mask], names=["tree", "leaf", "place", "formatted", "mask"])

    return rows.mapInArrow(run, "tree string, leaf string, place int, formatted string, mask array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted strings and their masks back gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(text)
                learnt = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((tree, len(turns), hashlib.sha256(said.encode("utf-8", "replace")).hexdigest(), len(learnt), hashlib.sha256(learnt.encode("utf-8", "replace")).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "formatted", "mask").mapInArrow(run, "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chains(rows: DataFrame) -> DataFrame:
    """Nodes of linear conversations (conv_id, turn, role, text): each turn replies to the one before it."""
    turn = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    placed = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))).withColumn("k", F.row_number().over(turn))
    return placed.select(
        "tree",
        F.concat_ws("/", "tree", F.lpad(F.col("k").cast("string"), 12, "0")).alias("node"),
        F.when(F.col("k") > 1, F.concat_ws("/", "tree", F.lpad((F.col("k") - 1).cast("string"), 12, "0"))).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
