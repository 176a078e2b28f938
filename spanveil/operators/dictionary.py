"""Dictionary detectors as joins: deny list, gazetteer (exact and fuzzy), countries, and dictionary assembly.

Documents are cut into words with their places; n-grams of up to the longest term's words
are looked up by a hash join on the folded text. The dictionary is a DataFrame; Spark
broadcasts it if it is small enough and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S
from . import lookup as L

WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’.-]*"
MAX_WORDS = 6  # of ngrams() by itself; the detectors take the longest term of their dictionary
FUZZY_DISTANCE, FUZZY_LENGTH = 2, 4


def fold(term: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(S.normalize_search(term)), r"\s+", " "))


def words(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, i, start, end, word."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(S.spans(S.normalize_search(text), WORD)).alias("i", "s"))
    trimmed = F.regexp_replace("s.value", r"[.'’-]+$", "")
    return found.select("doc_id", "i", F.col("s.start").alias("start"), (F.col("s.start") + F.length(trimmed)).alias("end"), trimmed.alias("word"))


def longest(terms: DataFrame, size: Column) -> Column:
    """The largest size of a term, 1 at least: one row, computed before the scan."""
    return F.coalesce(terms.agg(F.greatest(F.max(size), F.lit(1))).scalar(), F.lit(1))


def most_words(terms: DataFrame) -> Column:
    return longest(terms, F.regexp_count("term", F.lit(WORD)))


def ngrams(docs: DataFrame, most: int | Column = MAX_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, surface: runs of 1 to `most` words of a line, one narrow expression a document."""
    tokens = S.spans(S.normalize_search(text), WORD)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_t"), tokens.alias("w"), (most if isinstance(most, Column) else F.lit(most)).alias("_most"))
    pairs = F.flatten(F.transform("w", lambda w, i: F.transform(F.slice(F.col("w"), i + 1, F.col("_most")), lambda v: F.struct(w["start"].alias("start"), v["end"].alias("end")))))
    rows = base.where(F.size("w") > 0).select("doc_id", "_t", F.explode(pairs).alias("p")).select("doc_id", "p.start", "p.end", F.expr("substring(_t, p.start + 1, p.end - p.start)").alias("surface"))
    cut = F.regexp_replace("surface", r"[.'’-]+$", "")
    return rows.where(~F.contains("surface", F.lit("\n"))).select("doc_id", "start", (F.col("start") + F.length(cut)).alias("end"), cut.alias("surface"))


def begun(docs: DataFrame, most: int, begins, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """ngrams() whose first character matches `begins`: the other words, most of a text, never become rows."""

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(lo, 200) for b in batches for lo in range(0, b.num_rows, 200)):
            at, starts, ends, surfaces = [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for a, b in L.runs(L.plain(body), most, begins) if body else ():
                    at.append(i)
                    starts.append(a)
                    ends.append(b)
                    surfaces.append(body[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(surfaces, pa.string())], names=["doc_id", "start", "end", "surface"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.DataType.fromDDL("start int, end int, surface string").fields]))


def assemble(terms: DataFrame, common_words: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """term, labels, sources: admitted terms with merged labels. terms: value, label, source.

    '|' and '\\' are dropped; single common words (other than addresses), dotted acronyms of two
    letters or less and address terms that are months are not admitted.
    """
    clean = terms.withColumn("term", fold(F.regexp_replace("value", r"[|\\]", ""))).where(F.length("term") > 0).where(~F.col("term").rlike(r"^\p{L}\.\p{L}?\.?$"))
    if common_words is not None:
        clean = clean.join(common_words.select(fold(F.col("word")).alias("term"), F.lit(True).alias("_common")), "term", "left").where(F.col("_common").isNull() | (F.col("label") == "address")).drop("_common")
    if months is not None:
        clean = clean.join(months.select(fold(F.col("month")).alias("term"), F.lit(True).alias("_month")), "term", "left").where(F.col("_month").isNull() | (F.col("label") != "address")).drop("_month")
    return clean.groupBy("term").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.array_sort(F.collect_set("source")).alias("sources"))


def city_heads(cities: DataFrame) -> DataFrame:
    """First words of cities of several words."""
    parts = F.split(F.trim("value"), r"\s+")
    return cities.where(F.size(parts) > 1).select(parts[0].alias("head")).distinct()


def region_codes(regions: DataFrame, wanted: list[str]) -> DataFrame:
    """Country codes of named regions (region, code), in order of the request; 'all' means no filter (null)."""
    if "all" in wanted:
        return regions.select(F.lit(None).cast("string").alias("code")).limit(1)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(wanted) for x in (r, i)])
    return regions.where(F.col("region").isin(wanted)).groupBy("code").agg(F.min(rank[F.col("region")]).alias("k")).orderBy("k", "code").select("code")


HITS = "start int, end int, label string, text string, score double, source string, seq long"


def carried(docs: DataFrame, found, score: float, source: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of hits from found(text) -> (start, end, label) that runs on each text with a small dictionary."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "end", "label", "text", "score", "source", "seq"]
        for batch in batches:
            rows, at = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                for a, b, label in found(L.plain(body)) if body else ():
                    rows.append((a, b, label, body[a:b], score, source, 0))
                    at.append(i)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64())
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T.DataType.fromDDL(HITS).fields]))


def deny_list(docs: DataFrame, dictionary: DataFrame, stopwords: DataFrame | None = None, joined: bool | None = None, **names: str) -> DataFrame:
    """Curated hits: must begin in upper case; a single stopword and a hit inside a longer one lose.

    joined: True joins on n-grams, False carries the dictionary with the tasks, None decides by its size.
    """
    rows = L.small(dictionary, "term") if joined is not True else None
    stop = L.small(stopwords, "word") if rows is not None and stopwords is not None else []
    if rows is not None and stop is not None:
        lexicon, words_ = L.Lexicon((r["term"], r["labels"]) for r in rows), {L.folded(r["word"]) for r in stop if r["word"]}
        return carried(docs, lambda t: L.deny_list(t, lexicon, words_), 0.9, "deny-list", **names)
    most = dictionary.agg(F.max(F.regexp_count("term", F.lit(WORD)))).first()[0] or 1
    hits = begun(docs, most, L.UPPER_OR_DIGIT, **names).withColumn("term", fold(F.col("surface"))).join(dictionary, "term")
    if stopwords is not None:
        hits = hits.join(stopwords.select(fold(F.col("word")).alias("term")), "term", "left_anti")
    rows = hits.select("doc_id", "start", "end", F.explode("labels").alias("label"), F.col("surface").alias("text"), F.lit(0.9).alias("score"), F.lit("deny-list").alias("source"), F.lit(0).cast("long").alias("seq"))
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "label").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("end", (-F.col("start")).alias("s"))).over(order)
    inside = (F.col("end") < reach["end"]) | ((F.col("end") == reach["end"]) & (F.col("start") > -reach["s"]))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(False))).where("not _in").drop("_in")


def custom_deny_list(docs: DataFrame, terms: DataFrame, **names: str) -> DataFrame:
    """The caller's terms (value, label): no case or stopword filters, whole words."""
    terms = terms.select(fold(F.col("value")).alias("term"), "label").distinct()
    hits = ngrams(docs, most_words(terms), **names).withColumn("term", fold(F.col("surface"))).join(terms, "term")
    return hits.select("doc_id", "start", "end", "label", F.col("surface").alias("text"), F.lit(0.9).alias("score"), F.lit("deny-list").alias("source"), F.lit("custom-deny-list").alias("source_detail"), F.lit(0).cast("long").alias("seq"))


def gazetteer_terms(entries: DataFrame) -> DataFrame:
    """term, label, canonical from entries (canonical, label, variants, and pos if their order is known).

    The last label of a term wins and its first canonical form: by pos, else by canonical form and label.
    """
    e = entries.withColumn("_pos", F.struct(*[F.col(c) for c in ("pos", "canonical", "label") if c in entries.columns]))
    rows = e.select("_pos", "canonical", "label", F.explode(F.array_union(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))).alias("v"))
    return rows.groupBy(fold(F.col("v")).alias("term")).agg(F.max_by("label", "_pos").alias("label"), F.min_by("canonical", "_pos").alias("canonical"))


def gazetteer(docs: DataFrame, terms: DataFrame, fuzzy: bool = True, **names: str) -> DataFrame:
    """Exact hits (0.9), and near ones (0.85) that no exact hit overlaps.

    Near hits share a key with a term: each side yields its text without one of its first
    characters in turn or the first characters themselves, so the join is an equality and
    levenshtein() only decides about pairs that meet.
    """
    # An edit may also split a word, so near hits have up to as many words more as edits.
    grams = ngrams(docs, most_words(terms) + (FUZZY_DISTANCE if fuzzy else 0), **names).withColumn("term", fold(F.col("surface")))
    exact = grams.join(terms, "term").select("doc_id", "start", "end", "label", F.col("surface").alias("text"), F.lit(0.9).alias("score"), F.lit("gazetteer").alias("source"), F.lit(0).cast("long").alias("seq"))
    if not fuzzy:
        return exact
    # Of three pieces of a term, two edits leave one whole, moved by two places at most.
    def pieces(t: Column) -> Column:
        third = F.ceil(F.length(t) / 3).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("k"), F.substring(t, k * third + 1, third).alias("p")))

    def windows(t: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.length(t) + d >= FUZZY_LENGTH)

        def of(d: Column) -> Column:
            third = F.ceil((F.length(t) + d) / 3).cast("int")
            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda m: F.struct(k.alias("k"), F.substring(t, F.greatest(k * third + m, F.lit(0)) + 1, third).alias("p")))))

        return F.array_distinct(F.flatten(F.transform(sizes, of)))

    long_terms = terms.where(F.length("term") >= FUZZY_LENGTH).select("label", F.col("term").alias("known"), F.explode(F.array_distinct(pieces(F.col("term")))).alias("key"))
    surfaces = grams.where(F.length("term").between(F.lit(FUZZY_LENGTH - FUZZY_DISTANCE), longest(terms, F.length("term")) + FUZZY_DISTANCE)).select("term").distinct().select("term", F.explode(windows(F.col("term"))).alias("key"))
    near = surfaces.join(long_terms, "key").where(F.abs(F.length("term") - F.length("known")) <= FUZZY_DISTANCE).select("term", "known", "label").distinct()
    near = near.withColumn("distance", F.levenshtein("term", "known", FUZZY_DISTANCE)).where(F.col("distance").between(1, FUZZY_DISTANCE))
    best = near.groupBy("term").agg(F.min(F.struct("distance", "known", "label")).alias("b")).select("term", F.col("b.label").alias("label"))
    fuzzy_rows = grams.join(best, "term").select("doc_id", "start", "end", "label", F.col("surface").alias("text"), F.lit(0.85).alias("score"), F.lit("gazetteer").alias("source"), F.lit(1).cast("long").alias("seq"))
    taken = exact.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    free = fuzzy_rows.join(taken, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end")), "left_anti")
    return exact.unionByName(free)


def countries(docs: DataFrame, surfaces: DataFrame, ambiguous: DataFrame | None = None, **names: str) -> DataFrame:
    """Country names (surface, code) that begin like a proper noun, 0.95."""
    terms = surfaces.select(fold(F.col("surface")).alias("term"), "code").where(F.length("term") > 3).distinct()
    if ambiguous is not None:
        terms = terms.join(ambiguous.select(fold(F.col("surface")).alias("term")), "term", "left_anti")
    hits = ngrams(docs, most_words(terms), **names).withColumn("term", fold(F.col("surface"))).join(terms, "term").where(F.col("surface").rlike(r"^\p{Lu}"))
    return hits.select("doc_id", "start", "end", F.lit("country").alias("label"), F.col("surface").alias("text"), F.lit(0.95).alias("score"), F.lit("country").alias("source"), F.lit(0).cast("long").alias("seq"))


def literal_scan(docs: DataFrame, passages: DataFrame, words_in_key: int = 5) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage (item_id, text) literally.

    An equi-join on a key of the passage, then contains(); no nested loop. The key is words
    from the second one on: they stand between separators in the passage, so they are whole
    words of any document that holds it, whatever touches the passage's ends. Passages with too
    few words for that are keyed by their first 1, 2, 4, 8 or 16 characters, and documents
    yield their runs of as many characters if there is such a passage.
    """
    sep = r"[ \n]"
    parts = F.split("text", sep)
    inner = F.slice(parts, 2, words_in_key)
    lengths = [1, 2, 4, 8, 16]
    width = F.greatest(*[F.when(F.length("text") >= n, n).otherwise(0) for n in lengths])
    wordy = F.size(parts) >= words_in_key + 2
    known = passages.where(F.length("text") > 0)
    first = known.select("item_id", F.col("text").alias("passage"), F.when(wordy, F.array_join(inner, " ")).otherwise(F.substring("text", 1, width)).alias("key"))
    widths = known.where(~wordy).agg(F.collect_set(width).alias("n")).scalar()
    grams = tokens = F.split("text", sep)
    for k in range(1, words_in_key):  # the words one further on, again and again: linear in the text
        grams = F.zip_with(grams, F.slice(tokens, k + 1, F.size(tokens)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    none = F.array().cast("array<string>")
    runs = [F.when(F.array_contains("_widths", n), F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).otherwise(none) for n in lengths]
    cut = docs.where(F.col("text").isNotNull()).select("doc_id", "text", widths.alias("_widths"))
    keys = cut.select("doc_id", F.explode(F.array_distinct(F.concat(grams, *runs))).alias("key")).join(first, "key").select("doc_id", "item_id", "passage").distinct()
    return keys.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id").distinct()
