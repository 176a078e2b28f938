"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix holds as many words as the corpus. Each source has a target (its share by
weight, never above `max_repeat` times its own size; the excess is reshared by weight
until no source is above). The mix is cut into equal-token blocks; blocks go to sources
by the highest quotients V/1, V/3, V/5, ... (Sainte-Lague), and each source's blocks go
to its shards in the same way, which gives integer quotas for each shard. Sources for which
a block is coarse (against the smallest shard, the target or the room below the repeats)
take their target first, dealt to their shards by single words; the blocks are those of the
words left. By words, no quota passes `max_repeat` times its shard. In a shard, the
documents stand in a seeded order as one line of words, and the quota is taken from the
line in whole rounds and one window of blocks at a seeded place.

Everything is built-in DataFrame functions. Only (id, source, size, digest) is shuffled.
A source with a third of all rows is split over shards and, inside them, over buckets of
the digest: the prefix sums run in two levels, so no task sees all rows of a source.

Null text: size 0. Null source: its own source, last in order. Null or repeated ids:
each row is taken on its own; rows that are equal in every respect share a place by size.
Empty table: empty result. Documents without words take nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .repeats import ID, TEXT, identified

WORD = r"[^\x20\x09-\x0D]+"
BLOCKS = 65536
#: Blocks that the smallest shard and the target hold at least where quotas are whole blocks.
LEAST_SHARD, LEAST_TARGET = 8, 256
SEED = 17


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """id, source, size in words, and the seeded digest that gives the shard, bucket and order."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("digest"),
    ).withColumns({"shard": F.substring("digest", 1, 1), "bucket": F.substring("digest", 2, 3)})


def targets(sources: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target); other columns stay.

    One row for each source: these windows run over the list of sources, not over rows.
    Water filling in closed form: with sources by cap / weight, the first one whose cap is
    not below its share of what is left sets the level for all that follow.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(max_repeat)
    by_ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (
        sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long"))
        .withColumn("ratio", cap.cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("w_left", F.sum("weight").over(after))
        .withColumn("over", (cap * F.col("w_left") < F.col("weight") * F.col("left")).cast("int"))
    )
    first = F.min(F.when(F.col("over") == 0, F.struct("ratio", F.struct(F.col("source").isNull(), F.col("source")).alias("at"), "left", "w_left"))).over(every)
    return level.withColumn("lvl", first).select(
        *sources.columns,
        "weight",
        F.when(F.col("lvl").isNull() | (cap * F.col("lvl.w_left") < F.col("weight") * F.col("lvl.left")), cap.cast("double"))
        .otherwise((F.col("weight") * F.col("lvl.left")).cast("double") / F.col("lvl.w_left").cast("double"))
        .alias("target"),
    )


def apportion(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: `seats` of each group go to its parties by the highest quotients.

    With V votes, S seats and n parties, the seats are the rounded votes / D for some divisor
    D. Rounding all shares misses the total by n / 2 at most, so V / D lies within n / 2 + 1
    of S, which bounds the seats of a party from both sides by its own votes. Only the
    quotients between the bounds compete: 5 n of them at most in all, not n for each party.
    """
    of = Window.partitionBy(*group)
    base = parties.withColumns({"_n": F.count(F.lit(1)).over(of), "_votes": F.sum(votes).over(of)})

    def bound(total):
        share = F.when(F.col("_votes") > 0, F.col(votes) * total / F.col("_votes")).otherwise(F.lit(0.0))
        return F.floor(share + 0.5).cast("long")

    slack = F.col("_n") / 2 + 1
    base = base.withColumn("_base", F.greatest(F.lit(0).cast("long"), bound(F.col(seats) - slack) - 1)).withColumn("_top", bound(F.col(seats) + slack) + 1)
    base = base.withColumn("_left", F.col(seats) - F.sum("_base").over(of))
    rank = Window.partitionBy(*group).orderBy(F.col("_q").desc(), *[F.col(k).asc_nulls_last() for k in key])
    won = (
        base.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_top"))))
        .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_won", ((F.row_number().over(rank) <= F.col("_left")) & (F.col(votes) > 0)).cast("long"))
    )
    keep = [c for c in parties.columns]
    return won.groupBy(*keep, "_base").agg(F.sum("_won").alias("_more")).select(*keep, (F.col("_base") + F.col("_more")).alias(out))


def mix(docs: DataFrame, max_repeat: int = 3, blocks: int = BLOCKS, seed: int = SEED, **names: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and shard of every row of docs."""
    rows = common.materialize(sized(docs, seed=seed, **names))
    cells = common.materialize(rows.groupBy("source", "shard", "bucket").agg(F.sum("size").alias("bucket_size")))
    shards = cells.groupBy("source", "shard").agg(F.sum("bucket_size").alias("shard_size"))
    sources = shards.groupBy("source").agg(F.sum("shard_size").alias("source_size"), F.min(F.when(F.col("shard_size") > 0, F.col("shard_size"))).alias("smallest"))
    all_sources = Window.partitionBy(F.lit(1))  # one row a source
    few = (F.col("smallest") < LEAST_SHARD * F.col("block")) | (F.col("target") < LEAST_TARGET * F.col("block"))
    cut = (F.col("source_size") * max_repeat - F.col("target")) * F.col("smallest") < F.col("block") * F.col("source_size")
    plan = (
        targets(sources, max_repeat)
        .withColumn("total", F.sum("source_size").over(all_sources))
        .withColumn("block", F.greatest(F.lit(1), F.floor(F.col("total") / blocks)).cast("long"))
        .withColumn("by_word", F.coalesce((F.col("block") > 1) & (few | cut), F.lit(False)))
        .withColumn("own", F.when(F.col("by_word"), F.round("target")).otherwise(0).cast("long"))
        .withColumn("seats", F.floor((F.col("total") - F.sum("own").over(all_sources)) / F.col("block")).cast("long"))
        .withColumn("one", F.lit(1))
    )
    fine = plan.where("by_word").withColumns({"block": F.lit(1).cast("long"), "source_blocks": F.col("own")})
    plan = apportion(plan.where("not by_word"), ["one"], ["source"], "target", "seats", "source_blocks").unionByName(fine).drop("one", "seats")
    same = F.col("p.source").eqNullSafe(F.col("c.source"))
    quota = (
        shards.alias("c")
        .join(plan.alias("p"), same)
        .select("c.source", "c.shard", "shard_size", "source_size", "target", "block", "source_blocks", F.col("shard_size").cast("double").alias("votes"))
    )
    quota = apportion(quota, ["source"], ["shard"], "votes", "source_blocks", "quota").withColumn(
        "words", F.least(F.col("quota") * F.col("block"), F.col("shard_size") * max_repeat)
    )
    # The window of blocks starts at a seeded place of the line and goes round its end.
    quota = quota.withColumns(
        {
            "rounds": F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"),
            "start": F.when(
                F.col("shard_size") > 0,
                F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("shard")).cast("binary")), 1, 8), 16, 10).cast("long") % F.col("shard_size"),
            ).otherwise(0),
        }
    ).withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
    up_to = Window.partitionBy("source", "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    where = cells.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
    places = (
        where.alias("c")
        .join(quota.alias("p"), same & (F.col("c.shard") == F.col("p.shard")))
        .select("c.source", "c.shard", "c.bucket", "bucket_start", "shard_size", "source_size", "target", "rounds", "start", "rest")
    )
    inner = Window.partitionBy("source", "shard", "bucket").orderBy("digest", "size", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    lined = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    at = (
        lined.alias("c")
        .join(places.alias("p"), same & (F.col("c.shard") == F.col("p.shard")) & (F.col("c.bucket") == F.col("p.bucket")))
        .withColumn("a", F.col("bucket_start") + F.col("in_bucket"))
    )

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), hi) - F.greatest(F.col("a"), lo))

    end = F.col("start") + F.col("rest")
    window = overlap(F.col("start"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0), end - F.col("shard_size"))
    return at.select(
        "c.doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds") + window).cast("long").alias("taken"), F.col("c.shard").alias("shard")
    )


def resampled(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """docs with each row as often as the mix takes it: its taken words over its size, rounded."""
    names = [f"`{c}`" for c in docs.columns]
    docs, _ = identified(docs, id_col, text)
    taken = mix(docs, id_col=ID, text=TEXT, source=source, **more).where("taken > 0")
    times = taken.select(F.col("doc_id").alias(ID), F.round(F.col("taken") / F.col("size")).cast("int").alias(f"{ID}_n")).where(F.col(f"{ID}_n") > 0)
    rows = docs.drop(TEXT).join(times, ID)
    return rows.withColumn(f"{ID}_copy", F.explode(F.sequence(F.lit(1), F.col(f"{ID}_n")))).select(*names)
