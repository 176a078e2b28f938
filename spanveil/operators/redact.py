"""Redaction: operators by label, placeholders, rendering, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S

# The replacement of the redact operator, and the shape of placeholders.
REDACTED = "[REDACTED]"
TOKEN = r"\[[^\s\[\]]+_[1-9][0-9]*\]"


def identity(label: Column, text: Column) -> Column:
    """What makes two texts of a label the same: case, separators or prefixes that don't matter are dropped."""
    squeezed = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    key = S.label_key(label)
    return (
        F.when(key == "EMAIL_ADDRESS", F.lower(F.trim(text)))
        .when(key == "PHONE_NUMBER", F.regexp_replace(F.regexp_replace(text, "[^0-9]", ""), "^00", ""))
        .when(key == "CREDIT_CARD_NUMBER", F.regexp_replace(text, "[^0-9]", ""))
        .when((key == "CRYPTO") & text.rlike("^(?i)(0x|bc1)"), F.lower(F.trim(text)))
        .when(key.isin("IBAN", "BANK_ACCOUNT_NUMBER", "TAX_IDENTIFICATION_NUMBER", "REGISTRATION_NUMBER", "IDENTITY_CARD_NUMBER", "SOCIAL_SECURITY_NUMBER", "NATIONAL_IDENTIFICATION_NUMBER", "BIRTH_NUMBER", "PASSPORT_NUMBER"), F.upper(F.regexp_replace(text, r"[\s\-/.]", "")))
        .when(key.isin("PERSON", "ORGANIZATION", "ADDRESS", "COUNTRY", "LAND_PARCEL", "MISC"), squeezed)
        .otherwise(F.trim(text))
    )


def greedy(entities: DataFrame) -> DataFrame:
    """Rows without overlaps, in each document the first start wins (then the first end, then the order)."""
    fields = [c for c in entities.columns if c not in ("doc_id", "start", "end", "seq")]
    e = F.struct("start", "end", "seq", *fields)
    return entities.groupBy("doc_id").agg(F.collect_list(e).alias("es")).select("doc_id", F.explode(S.non_overlapping(F.col("es"))).alias("e")).select("doc_id", "e.*").select(*entities.columns)


def check_operators(operators: dict[str, dict] | None) -> dict[str, dict]:
    rows = operators or {}
    for name, spec in rows.items():
        if spec.get("type") not in ("replace", "redact", "keep", "mask"):
            raise ValueError(f"unknown operator for {name!r}: {spec!r}")
        if spec["type"] == "mask" and (len(spec.get("char", "*")) != 1 or spec.get("n", 1) < 1 or spec.get("from", "start") not in ("start", "end")):
            raise ValueError(f"bad mask for {name!r}: {spec!r}")
    return rows


def with_operators(entities: DataFrame, operators: dict[str, dict] | None = None) -> DataFrame:
    """Columns op, mask_char, mask_n, mask_from by label; labels without an entry are replaced."""
    rows = check_operators(operators)

    def pick(field: str, default):
        out = F.lit(default)
        for name, spec in rows.items():
            out = F.when(F.col("label") == name, F.lit(spec.get(field, default))).otherwise(out)
        return out

    return entities.withColumns({"op": pick("type", "replace"), "mask_char": pick("char", "*"), "mask_n": pick("n", 2**31 - 1), "mask_from": pick("from", "start")})


def masked(text: Column, char: Column, n: Column, side: Column) -> Column:
    """n grapheme clusters of the text, from a side, replaced by a character."""
    parts = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    hide = F.least(n, F.size(parts))
    head = F.concat(F.repeat(char, hide), F.array_join(F.slice(parts, hide + 1, F.greatest(F.size(parts) - hide, F.lit(0))), ""))
    tail = F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - hide), ""), F.repeat(char, hide))
    return F.when(side == "end", tail).otherwise(head)


def placeholders(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """entities with key, number and placeholder.

    In a document, identities of a label are numbered by first appearance; numbers whose
    token is already in the text are skipped. An alias takes the number of its source text.
    """
    said = F.coalesce(F.col("source_text"), F.col("text")) if "source_text" in entities.columns else F.col("text")
    keyed = entities.withColumns({"key": S.label_key("label"), "ident": identity(F.col("label"), said)})
    first = keyed.groupBy("doc_id", "key", "ident").agg(F.min(F.struct("start", "seq")).alias("_at"))
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("_at", "ident")))
    taken = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("tok"))
    taken = taken.select("doc_id", F.regexp_extract("tok", r"^\[(.+)_([0-9]+)\]$", 1).alias("key"), F.regexp_extract("tok", r"^\[(.+)_([0-9]+)\]$", 2).try_cast("int").alias("n"))
    taken = taken.where("n is not null").groupBy("doc_id", "key").agg(F.collect_set("n").alias("_taken"))
    numbered = ranked.join(taken, ["doc_id", "key"], "left")
    free = F.array_except(F.sequence(F.lit(1), F.col("_rank") + F.coalesce(F.size("_taken"), F.lit(0))), F.coalesce("_taken", F.array().cast("array<int>")))
    numbered = numbered.select("doc_id", "key", "ident", F.when(F.col("_taken").isNull(), F.col("_rank")).otherwise(F.element_at(free, F.col("_rank"))).alias("number"))
    return keyed.join(numbered, ["doc_id", "key", "ident"]).withColumn("placeholder", F.concat(F.lit("["), F.col("key"), F.lit("_"), F.col("number").cast("string"), F.lit("]")))


def _operator(operators: dict[str, dict], label: Column, field: str, default):
    out = F.lit(default)
    for name, spec in operators.items():
        out = F.when(label == name, F.lit(spec.get(field, default))).otherwise(out)
    return out


def redact_arrays(docs: DataFrame, operators: dict[str, dict] | None = None, entities: str = "entities") -> DataFrame:
    """docs (doc_id, text, entities: array of start, end, label, text, seq and perhaps source_text) redacted, row by row.

    Returns doc_id, redacted_text, redaction_map, operator_map, replacements, entity_count and the
    other columns of docs. Kept spans, masked spans and replaced or redacted spans are each made
    disjoint; a mask that a replaced span overlaps is dropped. Nothing is shuffled.
    """
    rows = check_operators(operators)
    fields = docs.schema[entities].dataType.elementType.names

    def chosen(e: Column) -> Column:
        said = F.coalesce(e["source_text"], e["text"]) if "source_text" in fields else e["text"]
        return F.struct(
            e["start"].alias("start"), e["end"].alias("end"), e["seq"].alias("seq"), e["label"].alias("label"), e["text"].alias("text"), said.alias("said"),
            _operator(rows, e["label"], "type", "replace").alias("op"), S.label_key(e["label"]).alias("key"), identity(e["label"], said).alias("ident"),
        )

    def of(*ops: str):
        return lambda all_: S.non_overlapping(F.filter(all_, lambda e: e["op"].isin(*ops)))

    def shown(e: Column, repl: Column, original: Column) -> Column:
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["op"].alias("op"), repl.alias("repl"), original.alias("original"))

    token = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    taken = F.when(F.col("text").rlike(TOKEN), F.array_distinct(token)).otherwise(F.array().cast("array<string>"))
    taken = F.filter(F.transform(taken, lambda t: F.struct(F.regexp_extract(t, r"^\[(.+)_([0-9]+)\]$", 1).alias("key"), F.regexp_extract(t, r"^\[(.+)_([0-9]+)\]$", 2).try_cast("int").alias("n"))), lambda t: t["n"].isNotNull())

    def placeholder(e: Column, pairs: Column, used: Column) -> Column:
        """The token of a span: its identity's place among those of its key, past the numbers that the text uses."""
        rank = F.array_position(F.transform(F.filter(pairs, lambda p: p["key"] == e["key"]), lambda p: p["ident"]), e["ident"]).cast("int")
        own = F.transform(F.filter(used, lambda t: t["key"] == e["key"]), lambda t: t["n"])
        free = lambda r: F.when(F.size(used) == 0, r).otherwise(F.element_at(F.array_except(F.sequence(F.lit(1), r + F.size(own)), own), r))
        return F.concat(F.lit("["), e["key"], F.lit("_"), S.bound(rank, free).cast("string"), F.lit("]"))

    hidden_rows = lambda h, used: S.bound(
        F.array_distinct(F.transform(F.filter(h, lambda e: e["op"] == "replace"), lambda e: F.struct(e["key"].alias("key"), e["ident"].alias("ident")))),
        lambda pairs: F.transform(h, lambda e: F.when(e["op"] == "replace", shown(e, placeholder(e, pairs, used), e["said"])).otherwise(shown(e, F.lit(REDACTED), e["text"]))),
    )

    def mask_of(e: Column) -> Column:
        return masked(e["text"], *(_operator(rows, e["label"], f, d) for f, d in (("char", "*"), ("n", 2**31 - 1), ("from", "start"))))

    def settled(all_: Column, used: Column) -> Column:
        parts = [S.bound(of("replace", "redact")(all_), lambda h: hidden_rows(h, used))]
        if any(spec["type"] == "mask" for spec in rows.values()):
            crossed = lambda m, h: F.exists(h, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]))
            free = S.bound(of("replace", "redact")(all_), lambda h: F.filter(of("mask")(all_), lambda m: ~crossed(m, h)))
            parts.append(F.transform(free, lambda e: shown(e, mask_of(e), e["text"])))
        if any(spec["type"] == "keep" for spec in rows.values()):
            parts.append(F.transform(of("keep")(all_), lambda e: shown(e, F.lit(None).cast("string"), e["text"])))
        return F.array_sort(F.concat(*parts))

    es = F.coalesce(F.col(entities), F.filter(F.array(F.col(entities)[0]), lambda _: F.lit(False)))
    done = S.computed(docs, _es=S.bound(taken, lambda used: S.bound(F.transform(es, chosen), lambda all_: settled(all_, used))))
    cut = F.transform(F.filter("_es", lambda e: e["repl"].isNotNull()), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["repl"].alias("replacement")))
    said = F.transform(F.filter("_es", lambda e: e["op"] == "replace"), lambda e: F.struct(e["repl"].alias("placeholder"), e["original"].alias("original")))
    # The first original of each placeholder: a span is the first if no earlier one has its token.
    first = S.bound(said, lambda m: S.bound(F.transform(m, lambda x: x["placeholder"]), lambda names: F.filter(m, lambda x, i: F.array_position(names, x["placeholder"]) == i + 1)))
    ops = F.transform("_es", lambda e: F.struct(F.when(e["op"] == "keep", e["original"]).otherwise(e["repl"]).alias("placeholder"), e["op"].alias("operator")))
    more = [c for c in docs.columns if c not in ("doc_id", "text", entities)]
    return done.select("doc_id", S.render("text", cut).alias("redacted_text"), first.alias("redaction_map"), F.array_distinct(ops).alias("operator_map"), cut.alias("replacements"), F.size("_es").alias("entity_count"), *more)


def redact(docs: DataFrame, entities: DataFrame, operators: dict[str, dict] | None = None) -> DataFrame:
    """redact_arrays() of rows of entities: they are gathered by document and joined to the texts once."""
    fields = ["start", "end", "label", "text", "seq", *(["source_text"] if "source_text" in entities.columns else [])]
    per = entities.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("entities"))
    return redact_arrays(docs.select("doc_id", "text").join(per, "doc_id", "left"), operators)


def restore(text: Column, redaction_map: Column, only: list[str] | None = None) -> Column:
    """The original text: placeholders (all, or those named) replaced by what they stand for, in one pass over the text.

    One pass over the pieces between tokens, so an original that looks like a token isn't replaced again.
    """
    known = F.map_from_entries(F.transform(redaction_map, lambda m: F.struct(m["placeholder"], m["original"])))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)

    def one(gap: Column, token: Column) -> Column:
        back = F.coalesce(F.try_element_at(known, token), token)
        if only is not None:
            back = F.when(token.isin(only), back).otherwise(token)
        return F.concat(gap, F.when(token.isNull(), F.lit("")).otherwise(back))

    return F.array_join(F.zip_with(gaps, tokens, one), "")


def deanonymise(text: Column, redaction_map: Column) -> Column:
    """Sequential replacement of each entry, which may cascade."""
    return F.aggregate(redaction_map, text, lambda acc, m: F.replace(acc, m["placeholder"], m["original"]))


def quarantine(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, error_code, detail of entities that don't fit their document: empty, reversed or out of bounds, bad scores."""
    size = docs.select("doc_id", F.length("text").alias("_n"))
    checked = entities.join(size, "doc_id", "left")
    code = F.when(F.col("_n").isNull(), "unknown-document").when(F.col("start") >= F.col("end"), "empty-or-reversed-span").when((F.col("start") < 0) | (F.col("end") > F.col("_n")), "span-out-of-bounds").when(F.isnan("score") | ~F.col("score").between(0, 1), "score-out-of-range")
    return checked.withColumn("error_code", code).where("error_code is not null").select("doc_id", "error_code", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("detail"))
