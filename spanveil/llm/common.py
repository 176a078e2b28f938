"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Labelled rows that a classifier is fitted on, for each class, at most.
SAMPLE_PER_CLASS = 2000
#: Bytes of their texts, for each class, about.
SAMPLE_BYTES = 64 << 20
#: Size of the broadcast filters of ids: 2**26 bits, 8 MB.
FILTER_BITS = 26


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, however the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the cluster (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:  # unset, as in tests on one machine
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanveil-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanveil-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; this cuts lineage."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gather(df: DataFrame) -> DataFrame:
    """materialize() for a table much smaller than what it is made from: by its bytes, not a file a task.

    For each file in a local folder Hadoop starts three `chmod` processes, and until such a child
    runs its own program it counts as a second JVM of the executor's size.
    """
    return materialize(df.hint("rebalance"))


def hold(df: DataFrame) -> DataFrame:
    """df computed now and held on the executors' disks until unpersist(); no files, so no processes (see gather).

    For wide tables that end within the call. Lineage isn't cut: for scans, not for what was shuffled.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that is no longer needed."""
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def maybe(df: DataFrame, col: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """df with `_maybe`: true for each row whose `col` is in ids (one long column), false for most others.

    A bit filter of a fixed size, 2**bits bits (8 MB), made and read by built-in functions and
    broadcast whatever the number of ids is. Callers follow it with an exact join, so a full
    filter costs time and changes no result.
    """

    def place(c):
        return F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))

    width = 1 << 15  # bits of a row of the filter
    (name,) = ids.columns
    rows = ids.select(place(name).alias("p")).groupBy(F.floor(F.col("p") / width).alias("_row")).agg(F.bitmap_construct_agg(F.col("p") % width).alias("_bits"))
    at = place(f"`{col}`") % width
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = df.withColumns({"_row": F.floor(place(f"`{col}`") / width), "_at": at}).join(F.broadcast(rows), "_row", "left")
    hit = F.coalesce(byte.bitwiseAND(F.expr("cast(shiftleft(1, cast(_at % 8 as int)) as int)")) != 0, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias("_maybe"))


def scan_parts(df: DataFrame) -> int:
    """Partitions of the plan; it follows the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def fold(col: str | Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; 0 for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    usable: Column,
    per_class: int = SAMPLE_PER_CLASS,
    text: str = "text",
    id_col: str = "doc_id",
    most_bytes: int = SAMPLE_BYTES,
) -> list[tuple[int, str, int]]:
    """(id, whole text, 0/1) of at most `per_class` labelled documents and about `most_bytes` bytes of each class.

    The bounds are the documented parameters; the choice is by a hash of the id, so that
    reruns agree. Ids that carry both labels, null ids, null labels and null texts are left
    out; of rows that repeat an id, the smallest text counts. The ids (at most 2 * per_class)
    are broadcast, the texts are collected: documents of a class are taken in order until the
    next one would pass the bytes, but one at least.
    """
    one = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable)
        .groupBy(id_col)
        .agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
        .where("lo = hi")
        .select(F.col(id_col), F.col("hi").cast("int").alias("y"), F.xxhash64(F.lit("fit"), F.col(id_col)).alias("rank"))
    )
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy("rank", id_col).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select(id_col, F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(picked.select(id_col, "y", "rank")), id_col)
    single = found.groupBy(id_col, "y", "rank").agg(F.min("t").alias("t"))
    in_order = Window.partitionBy("y").orderBy("rank", id_col)
    within = single.withColumns({"bytes": F.sum(F.octet_length("t")).over(in_order), "k": F.row_number().over(in_order)}).where((F.col("k") == 1) | (F.col("bytes") <= most_bytes))
    rows = sorted(within.select(id_col, "t", "y", "rank").collect(), key=lambda r: (r["rank"], r[id_col]))
    return [(r[id_col], r["t"], r["y"]) for r in rows]
