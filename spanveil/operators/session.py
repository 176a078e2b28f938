"""Redaction sessions: one numbering of placeholders over many documents.

The mapping of a session is a table: session_id, key, ident, number, placeholder, original.
Batch: known identities are joined, new ones are numbered on from the last number of their
key, in the order of documents that the caller gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from .redact import TOKEN, identity

# Limits of a session.
MAX_MAPPINGS, MAX_ID = 100_000, 64
MAPPING = "session_id string, key string, ident string, number long, placeholder string, original string"


def valid_id(session: Column) -> Column:
    return session.rlike(rf"^[A-Za-z0-9_-]{{1,{MAX_ID}}}$")


def token(session: Column, key: Column, number: Column) -> Column:
    return F.concat(F.lit("["), key, F.lit("_"), F.replace(session, F.lit("_"), F.lit("%5F")), F.lit("_"), number.cast("string"), F.lit("]"))


def status(observed: Column, created: Column, expires: Column, deleted: Column) -> Column:
    """active, not-yet-active, expired (observed at the expiry or later) or deleted; the caller gives the time."""
    return F.when(deleted, "deleted").when(observed < created, "not-yet-active").when(expires.isNotNull() & (observed >= expires), "expired").otherwise("active")


def plan(entities: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with placeholder, the new mapping). entities: session_id, doc_seq, start, label, text."""
    keyed = entities.withColumns({"key": S.label_key("label"), "ident": identity(F.col("label"), F.col("text"))})
    first = keyed.groupBy("session_id", "key", "ident").agg(F.min(F.struct("doc_seq", "start", "text")).alias("at"))
    new = first.join(mapping, ["session_id", "key", "ident"], "left_anti")
    last = mapping.groupBy("session_id", "key").agg(F.max("number").alias("last"))
    rank = F.row_number().over(Window.partitionBy("session_id", "key").orderBy("at", "ident"))
    numbered = new.join(last, ["session_id", "key"], "left").withColumn("number", (F.coalesce("last", F.lit(0)) + rank).cast("long"))
    added = numbered.select("session_id", "key", "ident", "number", token(F.col("session_id"), F.col("key"), F.col("number")).alias("placeholder"), F.col("at.text").alias("original"))
    after = mapping.unionByName(added)
    return keyed.join(after.select("session_id", "key", "ident", "number", "placeholder"), ["session_id", "key", "ident"]), after


def plan_batch(docs: DataFrame, entities: DataFrame, mapping: DataFrame, lifecycle: DataFrame | None = None, most: int = MAX_MAPPINGS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities with placeholder, the new mapping, errors) of documents (session_id, doc_id, text) and their entities.

    Errors (session_id, doc_id, error_code): a bad session id, a session that isn't active
    (lifecycle: session_id, status), a document that already holds tokens of its session, and
    a session that would have more than `most` mappings. Documents in error are left out as a
    whole: none of their entities is numbered. Nothing is changed until commit().
    """
    key = ["session_id", "doc_id"]
    state = docs.select(*key)
    bad = [state.where(~valid_id(F.col("session_id"))).withColumn("error_code", F.lit("bad-session-id")), collisions(docs).select(*key, F.lit("session-token-collision").alias("error_code"))]
    if lifecycle is not None:
        bad.append(state.join(lifecycle.select("session_id", "status"), "session_id", "left").where(F.coalesce("status", F.lit("unknown")) != "active").select(*key, F.lit("session-not-active").alias("error_code")))
    errors = bad[0]
    for more in bad[1:]:
        errors = errors.unionByName(more)
    errors = errors.groupBy(*key).agg(F.min("error_code").alias("error_code"))
    good = entities.join(errors.select(*key), key, "left_anti")
    _, after = plan(good, mapping)
    full = after.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("session_id")
    over = state.join(full, "session_id").join(errors.select(*key), key, "left_anti").withColumn("error_code", F.lit("too-many-mappings"))
    planned, after = plan(good.join(full, "session_id", "left_anti"), mapping)
    return planned, after, errors.unionByName(over)


def commit(mapping: DataFrame, path: str, version: int) -> None:
    """Write a mapping as the given version of a store, the first is 1. It is an error if that version exists: another commit came first."""
    mapping.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def current(spark: SparkSession, path: str, versions: int) -> DataFrame:
    """The mapping of the store after `versions` commits; empty before the first."""
    return spark.read.schema(MAPPING).parquet(f"{path.rstrip('/')}/version={versions}") if versions else spark.createDataFrame([], MAPPING)


def collisions(docs: DataFrame) -> DataFrame:
    """Documents (session_id, doc_id, text) that already hold tokens of their session; redacting them is an error."""
    own = F.replace(F.col("session_id"), F.lit("_"), F.lit("%5F"))
    mine = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), lambda t: F.contains(t, F.concat(F.lit("_"), own, F.lit("_"))))
    return docs.withColumn("tokens", mine).where(F.size("tokens") > 0).select("session_id", "doc_id", "tokens")


def restore(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs with restored and unknown (own tokens without a mapping: such a document is not restored).

    Tokens are exploded and joined with the mapping, so a large mapping is never gathered in one row.
    """
    own = F.replace(F.col("session_id"), F.lit("_"), F.lit("%5F"))
    pieces = docs.select("session_id", "doc_id", F.posexplode(F.arrays_zip(F.split("text", TOKEN, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("tok"))).alias("i", "p"))
    known = pieces.select("session_id", "doc_id", "i", F.col("p.gap").alias("gap"), F.col("p.tok").alias("placeholder")).join(mapping.select("session_id", "placeholder", "original"), ["session_id", "placeholder"], "left")
    lost = F.col("placeholder").isNotNull() & F.col("original").isNull() & F.contains(F.col("placeholder"), F.concat(F.lit("_"), own, F.lit("_")))
    back = known.groupBy("session_id", "doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("gap", F.coalesce("original", "placeholder", F.lit(""))).alias("s")))), lambda x: x["s"]), "").alias("restored"),
        F.sum(lost.cast("long")).alias("unknown"),
    )
    return back.withColumn("restored", F.when(F.col("unknown") == 0, F.col("restored")))


def inspect(mapping: DataFrame) -> DataFrame:
    """Counts by session and key, without any value."""
    return mapping.groupBy("session_id", "key").agg(F.count(F.lit(1)).alias("mappings"), F.max("number").alias("last_number"))


def delete(mapping: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The mapping without deleted sessions; the tombstones (session_id) stay with the caller."""
    return mapping.join(tombstones, "session_id", "left_anti")


def to_json(mapping: DataFrame) -> DataFrame:
    """One JSON document a session, entries in a fixed order."""
    entry = F.struct("key", "number", "ident", "placeholder", "original")
    return mapping.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("entries")).select("session_id", F.to_json(F.struct(F.lit(2).alias("version"), "session_id", "entries")).alias("state"))


def from_json(states: DataFrame) -> DataFrame:
    """Mappings of states. States of another version, with a bad session id or with a number or token that occurs twice are left out: see invalid_states()."""
    states = states.join(invalid_states(states).select("state"), "state", "left_anti")
    parsed = F.from_json("state", "version int, session_id string, entries array<struct<key:string,number:long,ident:string,placeholder:string,original:string>>")
    rows = states.select(parsed.alias("s")).where("s.version = 2").select("s.session_id", F.explode("s.entries").alias("e"))
    return rows.select("session_id", "e.key", "e.ident", "e.number", "e.placeholder", "e.original")


def invalid_states(states: DataFrame) -> DataFrame:
    """(state, error_code) of states that from_json() doesn't take."""
    parsed = F.from_json("state", "version int, session_id string, entries array<struct<key:string,number:long,ident:string,placeholder:string,original:string>>")
    tokens, numbers = F.transform("s.entries", lambda e: e["placeholder"]), F.transform("s.entries", lambda e: F.struct(e["key"], e["number"]))
    twice = (F.size(F.array_distinct(tokens)) < F.size("s.entries")) | (F.size(F.array_distinct(numbers)) < F.size("s.entries"))
    empty = F.exists("s.entries", lambda e: e["placeholder"].isNull() | e["original"].isNull() | F.coalesce(e["number"] < 1, F.lit(True)))
    code = F.when(F.col("s.entries").isNull(), "not-a-state").when(F.coalesce(F.col("s.version") != 2, F.lit(True)), "unknown-version").when(~F.coalesce(valid_id(F.col("s.session_id")), F.lit(False)), "bad-session-id").when(empty, "bad-entry").when(twice, "repeated-entry")
    return states.select("state", parsed.alias("s")).select("state", code.alias("error_code")).where("error_code is not null")


def seal(states: DataFrame, key: bytes) -> DataFrame:
    """Encrypted archives (AES-GCM with the session id as authenticated data; a format of our own)."""
    return states.select("session_id", F.aes_encrypt("state", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("session_id").cast("binary")).alias("sealed"))


def unseal(archives: DataFrame, key: bytes) -> DataFrame:
    return archives.select("session_id", F.aes_decrypt("sealed", F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.col("session_id").cast("binary")).cast("string").alias("state"))
