"""Span arithmetic as built-in column expressions.

A span is [start, end) in code points of the original text, counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])

ENTITY = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_detail", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source_text", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Matches that one step of a running sum takes; arrays grow by steps, so that their copies stay linear.
STEP = 64


def running(items: Column, none, advance, emit, keep) -> Column:
    """array of emit(at, item) over the items that keep(at, item) wants; `at` starts at 0 and is advance(at, item) after each item.

    A fold that appends to its array copies it for each item. Here a fold over steps of STEP
    items appends whole arrays, and a fold inside each step starts with an empty one. none:
    makes an empty array of the result's type from the items.
    """

    def one(acc: Column, x: Column) -> Column:
        out = F.when(keep(acc["at"], x), F.concat(acc["out"], F.array(emit(acc["at"], x)))).otherwise(acc["out"])
        return F.struct(advance(acc["at"], x).alias("at"), out.alias("out"))

    def fold(all_: Column) -> Column:
        empty = none(all_)
        start = lambda at: F.struct(at.alias("at"), empty.alias("out"))

        def step(acc: Column, part: Column) -> Column:
            done = F.aggregate(part, start(acc["at"]), one)
            return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STEP).cast("int")), lambda k: F.slice(all_, k * STEP + 1, STEP))
        begin = F.struct(F.lit(0).alias("at"), F.filter(F.array(empty), lambda _: F.lit(False)).alias("out"))
        many = F.aggregate(steps, begin, step, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(all_) <= STEP, F.aggregate(all_, start(F.lit(0)), one, lambda acc: acc["out"])).otherwise(many)

    return F.transform(F.array(items), fold)[0]  # a variable: what makes the items is evaluated once


def empty_of(kind: T.DataType):
    return lambda _: F.array().cast(T.ArrayType(kind))


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(column: str, pattern: str) -> str:
    """spans() of a column as SQL text, which is parsed at once: catalogues have many patterns, and built call by call each takes a hundred calls."""
    c, p, kind = f"`{column}`", sql_string(pattern), "array<struct<start:int,end:int,value:string>>"
    items = f"zip_with(split({c}, {p}, -1), regexp_extract_all({c}, {p}, 0), (g, v) -> named_struct('g', length(g), 'n', coalesce(length(v), 0), 'v', v))"
    one = "(acc, x) -> named_struct('at', acc.at + x.g + x.n, 'out', if(x.v is null, acc.out, concat(acc.out, array(named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.n, 'value', x.v)))))"
    begin = lambda at: f"named_struct('at', {at}, 'out', cast(array() as {kind}))"
    steps = f"transform(sequence(0, cast(floor((size(all_) - 1) / {STEP}) as int)), k -> slice(all_, k * {STEP} + 1, {STEP}))"
    step = f"(acc, part) -> element_at(transform(array(aggregate(part, {begin('acc.at')}, {one})), d -> named_struct('at', d.at, 'out', concat(acc.out, array(d.out)))), 1)"
    many = f"aggregate({steps}, named_struct('at', 0, 'out', cast(array() as array<{kind}>)), {step}, acc -> flatten(acc.out))"
    found = f"element_at(transform(array({items}), all_ -> if(size(all_) <= {STEP}, aggregate(all_, {begin(0)}, {one}, acc -> acc.out), {many})), 1)"
    return f"if({c} is not null and rlike({c}, {p}), {found}, cast(array() as {kind}))"


def spans(text: str | Column, pattern: str, when: Column | None = None) -> Column:
    """array<struct<start,end,value>> of all matches of a pattern that never matches nothing.

    Matches and the gaps between them alternate, so running lengths give the offsets. `when`
    is a cheap condition that must hold for any match; other texts skip the scan.
    """
    if isinstance(text, str):
        found = F.expr(spans_sql(text, pattern))
        return F.when(when, found).otherwise(F.array().cast(T.ArrayType(SPAN))) if when is not None else found
    t = col(text)
    values = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = F.split(t, pattern, -1)
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("g"), F.coalesce(F.length(v), F.lit(0)).alias("n"), v.alias("v")))
    emit = lambda at, x: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["v"].alias("value"))
    placed = running(pairs, empty_of(SPAN), lambda at, x: at + x["g"] + x["n"], emit, lambda _, x: x["v"].isNotNull())
    found = F.when(t.isNull() | ~t.rlike(pattern), F.array().cast(T.ArrayType(SPAN))).otherwise(placed)
    return F.when(when, found).otherwise(F.array().cast(T.ArrayType(SPAN))) if when is not None else found


def before(text: str | Column, start: Column, n: int) -> Column:
    """The n code points before a span (fewer at the start of the text)."""
    return F.substring(col(text), F.greatest(F.lit(1), start + 1 - n), F.least(F.lit(n), start))


def after(text: str | Column, end: Column, n: int) -> Column:
    return F.substring(col(text), end + 1, F.lit(n))


# Search text: the same number of code points, so spans need no mapping back.
FOLD_FROM = "\u00a0\u2007\u202f\u2013\u2014\u201c\u201d\u201e"
FOLD_TO = '   --"""'


def normalize_search(text: str | Column) -> Column:
    """Special spaces to space, dashes to '-', curly double quotes to '"'; idempotent, keeps the length."""
    return F.when(col(text).rlike(f"[{FOLD_FROM}]"), F.translate(col(text), FOLD_FROM, FOLD_TO)).otherwise(col(text))


def label_key(label: str | Column) -> Column:
    return F.regexp_replace(F.upper(col(label)), r"\s+", "_")


def utf8_offset(text: str | Column, at: Column) -> Column:
    """Bytes before a code point offset."""
    return F.octet_length(F.encode(F.substring(col(text), F.lit(1), at), "utf-8"))


def utf16_offset(text: str | Column, at: Column) -> Column:
    """UTF-16 units before a code point offset."""
    return at + F.regexp_count(F.substring(col(text), F.lit(1), at), F.lit("[\\x{10000}-\\x{10FFFF}]"))


def from_utf16(text: str | Column, at: Column) -> Column:
    """Code points before a UTF-16 offset; null inside a surrogate pair."""
    wide = F.regexp_extract_all(col(text), F.lit("(?s)."), F.lit(0))
    steps = F.aggregate(
        wide,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("u")),
        lambda a, c: F.when(a["u"] >= at, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["u"] + F.when(c.rlike("[\\x{10000}-\\x{10FFFF}]"), 2).otherwise(1)).alias("u"))),
    )
    return F.when(steps["u"] == at, steps["n"])


def explode_spans(docs: DataFrame, found: Column, label: str, score: float, source: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, end, label, text, score, source: one row a span."""
    return docs.select(F.col(id_col), F.explode(found).alias("s")).select(
        F.col(id_col), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(label).alias("label"), F.col("s.value").alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source")
    )


def non_overlapping(entities: Column) -> Column:
    """Greedy, first start wins: entities (array of structs that begin with start, end) without overlaps."""
    free = lambda at, e: e["start"] >= at
    return running(F.array_sort(entities), lambda all_: F.filter(all_, lambda _: F.lit(False)), lambda at, e: F.when(free(at, e), e["end"]).otherwise(at), lambda _, e: e, free)


def bound(value: Column, use) -> Column:
    """use(value) with the value as a variable, so that it is evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are evaluated once a row, however often they are used.

    The optimiser inlines a projection where its column is used once, even if that is in a
    lambda that runs for each item, and pushes filters down through it; a generator that
    makes one row of one row stops both. Only for expensive columns.
    """
    made = F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made)


def render(text: str | Column, replacements: Column) -> Column:
    """Splice replacements (array of structs start, end, replacement, in order, disjoint) into the text."""
    t = col(text)
    pieces = F.aggregate(
        replacements,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, r["start"] - acc["at"]), r["replacement"]).alias("out")),
    )
    return F.concat(pieces["out"], F.substring(t, pieces["at"] + 1, F.lit(2**31 - 1)))
