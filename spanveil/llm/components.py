"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _lowest(edges: DataFrame) -> DataFrame:
    """(v, m): for each v of the directed edges (v, w) the least of v and its w. Minima are taken before the shuffle."""
    return edges.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether edges (v > w) are stars around their smallest vertices: no v has two w, and no w has an edge of its own."""
    twice = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v")
    inner = edges.select(F.col("w").alias("v")).distinct().join(edges.select("v"), "v", "left_semi")
    return twice.unionByName(inner).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for each end of a link: the smallest v that its links reach.

    Large star: each vertex hands its larger neighbours to its least neighbour. Small star:
    it hands itself and its smaller neighbours there. Both keep components and never add
    edges; done in turns they end, after O(log^2 n) turns (Kiveris et al. 2014), in one star
    a component around its smallest vertex. Edges are written to the shared folder after
    every turn. A vertex with very many edges is never gathered: minima are combined in parts,
    and in the joins its rows may be split.
    """
    spark = edges.sparkSession
    ends = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("w")).where("v != w")  # v > w
    now = common.materialize(ends.distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("w").alias("v"), F.col("v").alias("w")))
        large = both.join(_lowest(both), "v").where("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v != w").distinct()
        least = _lowest(large)
        small = large.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).unionByName(least.select("v", F.col("m").alias("w")))
        new = common.materialize(small.where("v != w").distinct())
        common.drop(spark, now)
        now = new
    roots = now.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct()
    return now.select("v", F.col("w").alias("component")).unionByName(roots)


def classes(solved: DataFrame, copied: DataFrame) -> DataFrame:
    """(doc, class_id, n) of all documents with a link.

    solved: (doc, n, top), counts of links (several rows a doc add up) and links (doc, top) of
    a spanning forest; copied: (doc, rep, copies), the documents that are equal to others and
    the first of them, which alone is in solved.
    """
    exact = components(solved.where("doc != top"), "doc", "top").withColumnRenamed("v", "rep").withColumnRenamed("component", "class_id")
    counts = solved.groupBy(F.col("doc").alias("rep")).agg(F.sum("n").alias("n"))
    known = copied.where("doc = rep").select("rep", "copies").join(counts, "rep", "full").join(exact, "rep", "left")
    known = common.materialize(known.select("rep", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n")))
    after = copied.where("doc != rep").select("doc", "rep").join(known, "rep").select("doc", "class_id", "n")
    return known.select(F.col("rep").alias("doc"), "class_id", "n").unionByName(after).where("n > 0")


def with_classes(docs: DataFrame, found: DataFrame, row: str, id_col: str, row_is_id: bool) -> DataFrame:
    """docs with _class (the id of the first row of its class), _links and _kept; found as of classes(), by the inner id `row`."""
    done = docs.join(found.select(F.col("doc").alias(row), F.col("class_id").alias("_first"), F.col("n").alias("_links")), row, "left")
    done = done.withColumns({"_first": F.coalesce("_first", row), "_links": F.coalesce("_links", F.lit(0)).cast("long")})
    done = done.withColumn("_kept", F.col("_first") == F.col(row))
    if row_is_id:
        return done.withColumn("_class", F.col("_first").cast(docs.schema[id_col].dataType))
    return done.join(docs.select(F.col(row).alias("_first"), F.col(f"`{id_col}`").alias("_class")), "_first")
