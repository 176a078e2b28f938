"""Sources and sinks of text: files, HTML, results, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A file with a NUL in its first 8 KiB is binary.
SNIFF = 8192


def text_files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """path, text of all text files below a path, whole; binary files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    plain = files.where(~F.contains(F.substring("content", 1, SNIFF), F.lit(b"\x00")))
    return plain.select("path", F.decode("content", "utf-8").alias("text"))


# Named entities of HTML that are decoded, and the tags that break a line.
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"', "ldquo": "\u201c", "rdquo": "\u201d", "lsquo": "\u2018", "rsquo": "\u2019"}
BREAKS = "p|div|tr|h[1-6]|li|blockquote|pre"
#: Space but line breaks, spelled out: classes differ between dialects.
SPACE = "[ \\t\\r\\f\\x0B\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
ENTITY = "&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);"
#: What is replaced, in order, before and after entities are decoded.
BEFORE = [(r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (rf"(?i)</(?:{BREAKS})>|<br\b[^>]*>", "\n"), (r"<[^>]+>", " ")]
AFTER = [(SPACE + "+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")]


def decoded(entity: Column) -> Column:
    """The character of an entity; unknown names and numbers that are no character stay as they are."""
    body = F.substring(entity, 2, F.length(entity) - 2)
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.lit(12)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.lit(12))).try_cast("long")
    real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(body.startswith("#"), F.when(real, char).otherwise(entity)).otherwise(F.coalesce(F.try_element_at(named, F.lower(body)), entity))


def html_to_text(html: str | Column) -> Column:
    """Text of an HTML page: scripts, styles, comments and tags become spaces, ends of blocks break lines, entities are decoded once, space is collapsed, a blank line stays."""
    c = F.col(html) if isinstance(html, str) else html
    for pattern, to in BEFORE:
        c = F.regexp_replace(c, pattern, to)
    one = lambda gap, entity: F.concat(gap, F.when(entity.isNull(), F.lit("")).otherwise(decoded(entity)))
    whole = F.transform(F.array(c), lambda t: F.array_join(F.zip_with(F.split(t, ENTITY, -1), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), one), ""))[0]
    c = F.when(c.isNotNull(), whole)
    for pattern, to in AFTER:
        c = F.regexp_replace(c, pattern, to)
    return c


def result_json(redacted: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, json: {entityCount, entities, redactedText}, entities in order."""
    each = F.struct("start", "end", "label", "text")
    per = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("entities"))
    joined = redacted.select("doc_id", F.col("entity_count").alias("entityCount"), F.col("redacted_text").alias("redactedText")).join(per, "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct("entityCount", F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,label:string,text:string>>")).alias("entities"), "redactedText")).alias("json"))


def key_json(redacted: DataFrame) -> DataFrame:
    """doc_id, key: the redaction key of a document as JSON."""
    return redacted.select("doc_id", F.to_json(F.struct(F.lit(1).alias("version"), "redaction_map", "operator_map")).alias("key"))


def parse_key(key: Column) -> Column:
    return F.from_json(key, "version int, redaction_map array<struct<placeholder:string,original:string>>, operator_map array<struct<placeholder:string,operator:string>>", {"mode": "FAILFAST"})


def write_results(results: DataFrame, path: str, partition_by: list[str] | None = None, overwrite: bool = False) -> None:
    """Parquet results; an existing path is an error unless overwritten on purpose."""
    writer = results.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
