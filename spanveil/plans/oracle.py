"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from .queries import EMAIL, HOT, OPERATORS

IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
CARD = r"\b[0-9]{13,19}\b"
NANP = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
SECRET = r'token = "[0-9a-f]{40}"'

LUHN = """(list_sum(list_transform(range(1, length(v) + 1), lambda k: CASE WHEN (length(v) - k) % 2 = 1
  THEN CAST(substr(v, k, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(v, k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END
  ELSE CAST(substr(v, k, 1) AS INTEGER) END)) % 10 = 0)"""
OCTETS = "(list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS INTEGER))) <= 255)"


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def spans(pattern: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """key, s, e, v, k: matches with their offsets in code points and their number."""
    p = q(pattern)
    return f"""SELECT {key}, k, v, CAST(s AS INTEGER) AS s, CAST(s + length(v) AS INTEGER) AS e FROM (
      SELECT {key}, k, vs[k] AS v, list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[1:k - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT {key}, vs, gs, unnest(range(1, len(vs) + 1)) AS k FROM (
        SELECT {key}, regexp_extract_all({text}, '{p}') AS vs, string_split_regex({text}, '{p}') AS gs FROM {source} WHERE regexp_matches({text}, '{p}'))))"""


RULES = [
    (EMAIL, "email address", 0.9, "true"), (IPV4, "ip address", 1.0, OCTETS), (CARD, "credit card number", 1.0, LUHN), (NANP, "phone number", 0.9, "true"), (SECRET, "secret", 0.9, "true"),
    (r"token = ", "cue", 0.4, "true"), (r"\b[0-9]{4,19}\b", "number", 0.35, "true"), (r"[A-Za-z0-9-]+\.(?:com|org|net|example|test|io)\b", "domain", 0.5, "true"),
]


def union(n: int, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    parts = [f"SELECT {key} AS doc_id, s, e, v, '{label}' AS label, CAST({score} AS DOUBLE) AS score, 'regex' AS source, CAST({i} * 1048576 + k - 1 AS BIGINT) AS seq FROM ({spans(p, source, key, text)}) WHERE {test}" for i, (p, label, score, test) in enumerate(RULES[:n])]
    return "(" + " UNION ALL ".join(parts) + ")"


FIVE, MIXED = union(5), union(8)


def greedy(entities: str) -> str:
    """Rows that survive when, in each document, the first start wins: a walk from row to row."""
    return f"""(WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, seq) AS rn FROM {entities}),
      w AS (SELECT doc_id, rn, e AS reach, true AS kept FROM o WHERE rn = 1
        UNION ALL SELECT o.doc_id, o.rn, CASE WHEN o.s < w.reach THEN w.reach ELSE o.e END, o.s >= w.reach FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT o.* EXCLUDE rn FROM o JOIN w USING (doc_id, rn) WHERE kept)"""


PRIO = "(CASE source WHEN 'gazetteer' THEN 5 WHEN 'trigger' THEN 4 WHEN 'legal-form' THEN 3 WHEN 'regex' THEN 3 WHEN 'country' THEN 3 WHEN 'deny-list' THEN 2 WHEN 'coreference' THEN 2 WHEN 'caller' THEN 1 WHEN 'ner' THEN 1 ELSE 0 END)"
SPAN = "s AS span_start, e AS span_end"


def islands(entities: str) -> str:
    return f"""(SELECT doc_id, CAST(min(s) AS INTEGER) AS s, CAST(max(e) AS INTEGER) AS e, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {entities})) GROUP BY doc_id, g)"""


GOLD = f"(SELECT doc_id, s, CASE WHEN doc_id % 3 = 0 THEN e - 1 ELSE e END AS e, v, label, score, source, seq FROM {FIVE} WHERE doc_id % 5 <> 0)"
KEY = "regexp_replace(upper(label), '\\s+', '_', 'g')"
IDENT = f"CASE {KEY} WHEN 'EMAIL_ADDRESS' THEN lower(trim(v)) WHEN 'PHONE_NUMBER' THEN regexp_replace(regexp_replace(v, '[^0-9]', '', 'g'), '^00', '') WHEN 'CREDIT_CARD_NUMBER' THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE trim(v) END"


def numbered(entities: str, taken: dict[str, list[int]] | None = None) -> str:
    """entities with key, ident and number; `taken` numbers are skipped."""
    number = "rank"
    if taken:
        cases = " ".join(f"WHEN '{k}' THEN list_filter(range(1, 10000), lambda x: NOT list_contains({v}, x))[rank]" for k, v in taken.items())
        number = f"CASE key {cases} ELSE rank END"
    return f"""(SELECT t.*, {number} AS number FROM (SELECT *, {KEY} AS key, {IDENT} AS ident FROM {entities}) t
      JOIN (SELECT doc_id, key, ident, row_number() OVER (PARTITION BY doc_id, key ORDER BY first_at, sq, ident) AS rank FROM (
        SELECT doc_id, {KEY} AS key, {IDENT} AS ident, min(s) AS first_at, arg_min(seq, (s, seq)) AS sq FROM {entities} GROUP BY ALL)) USING (doc_id, key, ident))"""


def rendered(entities: str, repl: str, source: str = "documents") -> str:
    """doc_id, out, n: texts with `repl` of each (disjoint) entity spliced in."""
    return f"""(SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE body || substr(text, last + 1) END AS out, coalesce(n, 0) AS n FROM {source} d LEFT JOIN (
      SELECT doc_id, string_agg(substr(text, prev + 1, s - prev) || repl, '' ORDER BY s) AS body, max(e) AS last, count(*) AS n FROM (
        SELECT x.*, text, {repl} AS repl, coalesce(lag(e) OVER (PARTITION BY x.doc_id ORDER BY s), 0) AS prev FROM {entities} x JOIN {source} USING (doc_id)) GROUP BY doc_id) USING (doc_id))"""


HTML = "html"
for _pattern, _to in ((r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</(?:p|div|tr|h[1-6]|li|blockquote|pre)>|<br\b[^>]*>", "\n"), (r"<[^>]+>", " ")):
    HTML = f"regexp_replace({HTML}, '{q(_pattern)}', '{_to}', 'g')"
_ENTITY, _NUMBER = "&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);", "TRY_CAST(CASE WHEN lower(x[3]) = 'x' THEN '0x' || x[4:-2] ELSE x[3:-2] END AS BIGINT)"
_NAMES = "CASE lower(x) WHEN '&amp;' THEN '&' WHEN '&apos;' THEN chr(39) WHEN '&gt;' THEN '>' WHEN '&lt;' THEN '<' WHEN '&nbsp;' THEN ' ' WHEN '&quot;' THEN chr(34) WHEN '&ldquo;' THEN chr(8220) WHEN '&rdquo;' THEN chr(8221) WHEN '&lsquo;' THEN chr(8216) WHEN '&rsquo;' THEN chr(8217) ELSE x END"
_ONE = f"CASE WHEN x[2] = '#' THEN CASE WHEN {_NUMBER} BETWEEN 1 AND 55295 OR {_NUMBER} BETWEEN 57344 AND 1114111 THEN chr(CAST({_NUMBER} AS INTEGER)) ELSE x END ELSE {_NAMES} END"
HTML = f"""list_transform([{HTML}], lambda t: array_to_string(list_transform(list_zip(string_split_regex(t, '{_ENTITY}'), list_transform(regexp_extract_all(t, '{_ENTITY}'), lambda x: {_ONE})), lambda z: z[1] || coalesce(z[2], '')), ''))[1]"""
for _pattern, _to in ((r"[ \t\r\f\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+$", "")):
    HTML = f"regexp_replace({HTML}, '{_pattern}', '{_to}', 'g')"

FOLDED = "translate(text, chr(160) || chr(8199) || chr(8239) || chr(8211) || chr(8212) || chr(8220) || chr(8221) || chr(8222), '   --\"\"\"')"
#: `\\b` means ASCII words in one engine and all letters in the other: English documents only.
ENGLISH = "(SELECT * FROM documents WHERE lang = 'en')"
CAPS = r"\b[A-Z][a-z]{5,}\b"
ADJACENT = f"""(WITH o AS (SELECT x.*, text, max(e) OVER (PARTITION BY x.doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({spans(CAPS, ENGLISH)}) x JOIN documents USING (doc_id)),
  f AS (SELECT *, CASE WHEN prev <= s AND s - prev <= 3 AND regexp_full_match(substr(text, prev + 1, s - prev), '[ \\t,\\-]*') THEN 0 ELSE 1 END AS fresh FROM o),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f)
  SELECT doc_id, min(s) AS span_start, max(e) AS span_end, substr(any_value(text), min(s) + 1, max(e) - min(s)) AS text FROM g GROUP BY doc_id, g.g)"""
WORDS_OF = "(SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)"
TOKENS_OF = f"(SELECT doc_id, regexp_replace(unnest(regexp_extract_all({FOLDED}, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}''’.-]*')), '[.''’-]+$', '') AS w FROM documents)"
TERMS = "(SELECT DISTINCT lower(regexp_extract(text, '^([A-Z][a-z]{4,12})\\b', 1)) AS term FROM documents WHERE lang = 'en' AND regexp_extract(text, '^([A-Z][a-z]{4,12})\\b', 1) <> '')"
HITS = " UNION ALL ".join(
    f"SELECT doc_id, s AS hs, e AS he, {k} AS rule, '{label}' AS target, {change} AS adj, {before} AS bef, {after} AS aft, {'NULL' if new is None else repr(new)} AS newlabel FROM ({spans(rf'\b{word}\b', '(SELECT doc_id, lower(text) AS text FROM documents)')})"
    for k, (word, label, change, before, after, new) in enumerate(HOT)
)
SESSION = f"(SELECT *, 's_' || CAST(doc_id % 7 AS VARCHAR) AS session_id, {KEY} AS key, {IDENT} AS ident FROM {FIVE})"
DIGITS = {f"d{i}": f"CAST(substr(v, {i}, 1) AS INTEGER)" for i in range(1, 11)}


def weigh(weights: list[int], v: str = "v") -> str:
    return "(" + " + ".join(f"CAST(substr({v}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def check11(weights: list[int], v: str, n: int) -> str:
    return f"((11 - {weigh(weights, v)} % 11) % 11 <> 10 AND (11 - {weigh(weights, v)} % 11) % 11 = CAST(substr({v}, {n}, 1) AS INTEGER))"


COUNTS = "sum(CASE WHEN kind = 'tp' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN kind = 'fp' THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN kind = 'fn' THEN 1 ELSE 0 END) AS fn"
SEEN = f"(SELECT * FROM {FIVE} WHERE doc_id % 7 <> 1)"
EXACT = f"(SELECT coalesce(p.label, g.label) AS label, CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 'tp' WHEN p.doc_id IS NOT NULL THEN 'fp' ELSE 'fn' END AS kind FROM {SEEN} p FULL JOIN {GOLD} g ON p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.label = g.label)"
# In this gold, a span overlaps at most one detected span of its label, so greedy matching is a plain join.
OVERLAP = f"(SELECT coalesce(p.label, g.label) AS label, CASE WHEN p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL THEN 'tp' WHEN p.doc_id IS NOT NULL THEN 'fp' ELSE 'fn' END AS kind FROM {SEEN} p FULL JOIN {GOLD} g ON p.doc_id = g.doc_id AND p.label = g.label AND (least(p.e, g.e) - greatest(p.s, g.s)) * 2 >= greatest(p.e, g.e) - least(p.s, g.s))"
F1 = "CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END"


def solid(source: str) -> str:
    return f"(SELECT coalesce(sum(length(regexp_replace(substr(text, s + 1, e - s), '\\s', '', 'g'))), 0) FROM {source} JOIN documents USING (doc_id))"


DIFF = f"""SELECT change, label, count(*) AS n FROM (SELECT coalesce(o.label, n.label) AS label, CASE WHEN n.doc_id IS NOT NULL AND o.doc_id IS NULL THEN 'added' WHEN o.doc_id % 2 = 0 THEN 'regression' ELSE 'removed' END AS change
  FROM (SELECT DISTINCT doc_id, s, e, label FROM {GOLD}) o FULL JOIN (SELECT DISTINCT doc_id, s, e, label FROM {SEEN}) n ON o.doc_id = n.doc_id AND o.s = n.s AND o.e = n.e AND o.label = n.label WHERE o.doc_id IS NULL OR n.doc_id IS NULL) GROUP BY ALL"""
CELL = "(SELECT doc_id, s AS n_start, e AS n_end, v AS name FROM (" + spans(CAPS, ENGLISH) + "))"
MASKED = "repeat('*', greatest(least(12, length(v)), 0)) || substr(v, 13)"
FREE_MIXED = f"(SELECT *, CASE label {' '.join(f"WHEN '{k}' THEN '{v['type']}'" for k, v in OPERATORS.items())} ELSE 'replace' END AS op FROM {FIVE})"


def oracle_sql() -> dict[str, str]:
    out = {name: f"SELECT doc_id, {SPAN}, v AS value FROM {union(8)} WHERE label = '{label}'" for name, label in (("email_spans", "email address"), ("ipv4_spans", "ip address"), ("card_luhn_spans", "credit card number"), ("nanp_phone_spans", "phone number"), ("secret_token_spans", "secret"))}
    out["summary_by_language"] = f"SELECT lang, label, count(*) AS n_entities, count(DISTINCT doc_id) AS n_docs, count(DISTINCT v) AS n_values FROM {greedy(FIVE)} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang, label"
    out["normalize_search"] = f"SELECT doc_id, sha256({FOLDED}) AS digest, true AS same_length, true AS idempotent FROM documents"
    out["entities_rollup"] = f"SELECT lang, label, count(*) AS n_entities FROM {FIVE} JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (lang, label)"
    out["non_overlapping_spans"] = f"SELECT doc_id, {SPAN}, label FROM {greedy(MIXED)}"
    out["merge_priority"] = f"""SELECT doc_id, {SPAN}, label, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY score DESC, {PRIO} DESC, seq) AS rn FROM (
      SELECT * FROM {MIXED} UNION ALL SELECT doc_id, s, e, v, 'alt ' || label, score, CASE WHEN label = 'number' THEN 'caller' ELSE 'trigger' END, seq + 1073741824 FROM {MIXED} WHERE label IN ('email address', 'number'))) WHERE rn = 1"""
    base = f"SELECT * FROM {MIXED} WHERE label IN ('credit card number', 'number')"
    out["same_span_conflicts"] = f"""WITH a AS ({base}), u AS (SELECT doc_id, s, e, label, source FROM a UNION ALL SELECT doc_id, s, e, 'address', 'trigger' FROM a UNION ALL SELECT doc_id, s, e, 'person', 'trigger' FROM a WHERE label = 'number'),
      m AS (SELECT *, bool_or(label = 'person') OVER w AS hasp, max({PRIO}) OVER w AS top FROM u WINDOW w AS (PARTITION BY doc_id, s, e)),
      k AS (SELECT *, bool_or(label <> 'address') OVER (PARTITION BY doc_id, s, e) AS precise FROM m WHERE NOT (hasp AND label IN ('address', 'country', 'land parcel')) AND {PRIO} = top)
      SELECT doc_id, {SPAN}, label, source FROM k WHERE NOT precise OR label <> 'address'"""
    out["mask_union_islands"] = f"SELECT doc_id, s AS mask_start, e AS mask_end, n AS n_spans FROM {islands(MIXED)}"
    out["nested_same_label"] = f"""SELECT doc_id, {SPAN}, label FROM (SELECT *, max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e DESC, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT * REPLACE (CASE WHEN label IN ('credit card number', 'number') THEN 'digits' ELSE label END AS label) FROM {MIXED})) WHERE reach IS NULL OR e > reach"""
    out["merge_adjacent"] = f"SELECT * FROM {ADJACENT}"
    out["near_miss_boost"] = f"""SELECT doc_id, {SPAN}, label, round(fin, 6) AS score FROM (SELECT w.*, CASE WHEN score >= 0.42 THEN score WHEN score >= 0.27 THEN least(1.0, score + 0.05 * (
        SELECT count(*) FROM {MIXED} a WHERE a.doc_id = w.doc_id AND a.score >= 0.9 AND abs((a.s + a.e) / 2 - (w.s + w.e) / 2) <= 150)) ELSE 0 END AS fin FROM {MIXED} w) WHERE fin >= 0.42"""
    out["threshold_and_labels"] = f"SELECT label, count(*) AS n FROM {MIXED} WHERE label IN ('cue', 'domain', 'email address') AND score >= 0.45 GROUP BY label"
    out["hotword_decay"] = f"""WITH x AS (SELECT * FROM {MIXED}), h AS ({HITS}),
      j AS (SELECT x.doc_id, s, e, label, seq, hs, rule, newlabel, adj, CASE WHEN he <= s THEN s - he WHEN hs >= e THEN hs - e ELSE 0 END AS gap, CASE WHEN he <= s THEN bef ELSE aft END AS reach FROM x JOIN h ON x.doc_id = h.doc_id AND x.label = h.target),
      b AS (SELECT *, adj * (1 - gap / reach) AS eff FROM j WHERE gap <= reach),
      t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY abs(eff) DESC, hs, rule) = 1)
      SELECT x.doc_id, x.s AS span_start, x.e AS span_end, CASE WHEN eff > 0 AND newlabel IS NOT NULL THEN newlabel ELSE x.label END AS label, round(greatest(0.0, least(1.0, x.score + coalesce(eff, 0.0))), 6) AS score
      FROM x LEFT JOIN t ON x.doc_id = t.doc_id AND x.seq = t.seq"""
    heading = q(r"^\s*(?:(?:I\.|1\.)\s|(?i:article|art\.|section|clause|artikel|abschnitt|článek|čl\.|articolo|artículo)\s*[0-9IVX]|§\s*[0-9])")
    signing = q(r"(?i)(?:in witness whereof|/s/|signature|signed by|unterschrift|ort, datum|podpis|fait à|firma)")

    def lines(source: str) -> str:
        return f"""(WITH l AS (SELECT doc_id, k, ls[k] AS l, CAST(k - 1 + coalesce(list_sum(list_transform(ls[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS a FROM (
          SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {source}))),
          b AS (SELECT doc_id, coalesce(min(CASE WHEN regexp_matches(l, '{heading}') THEN a END), 0) AS head, max(CASE WHEN regexp_matches(l, '{signing}') THEN a END) AS sign FROM l GROUP BY doc_id)
          SELECT l.doc_id, a, CAST(a + length(l) AS INTEGER) AS b, CASE WHEN a < head AND (sign IS NULL OR sign >= head) THEN 'header' WHEN a >= sign THEN 'signature' WHEN length(l) - length(replace(l, chr(9), '')) >= 2 THEN 'table' ELSE 'body' END AS zone FROM l JOIN b USING (doc_id))"""

    out["zone_of_entity"] = f"""SELECT x.doc_id, x.s AS span_start, label, coalesce(zone, 'body') AS zone, round(least(1.0, score + CASE coalesce(zone, 'body') WHEN 'header' THEN 0.1 WHEN 'signature' THEN 0.15 WHEN 'table' THEN 0.05 ELSE 0 END), 6) AS score
      FROM {FIVE} x LEFT JOIN {lines('documents')} z ON x.doc_id = z.doc_id AND (x.s + x.e) // 2 BETWEEN z.a AND z.b"""
    conv = "(SELECT conv_id * 100 + turn AS doc_id, CASE WHEN turn % 2 = 0 THEN 'HEAD' || chr(10) || '1. Terms' || chr(10) ELSE 'a' || chr(9) || 'b' || chr(9) || 'c' || chr(10) END || text || chr(10) || 'signed by x' || chr(10) || 'end' AS text FROM conversations)"
    out["zone_lines"] = f"SELECT zone, count(*) AS n_lines, CAST(sum(a) AS BIGINT) AS sum_start FROM {lines(conv)} GROUP BY zone"
    out["dictionary_terms"] = f"SELECT lower(w) AS term, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM {TOKENS_OF} WHERE regexp_matches(w, '^[\\p{{Lu}}\\p{{N}}]') AND lower(w) IN (SELECT term FROM {TERMS}) GROUP BY lower(w)"
    out["dictionary_anti"] = f"SELECT doc_id, count(*) AS n_unknown FROM {WORDS_OF} WHERE regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN (SELECT term FROM {TERMS}) GROUP BY doc_id"
    out["dictionary_assembly"] = """SELECT term, string_agg(DISTINCT label, '|' ORDER BY label) AS labels, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM (
      SELECT lower(c_mktsegment) AS term, 'organization' AS label, 'deny-list' AS source FROM customer UNION ALL SELECT lower(n_name), 'country', 'country' FROM nation
      UNION ALL SELECT lower(r_name), 'address', 'deny-list' FROM region UNION ALL SELECT lower(n_name), 'address', 'deny-list' FROM nation) GROUP BY term"""
    out["country_hits"] = """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(5 AS INTEGER) AS span_start, CAST(5 + length(n_name) AS INTEGER) AS span_end,
      array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS text FROM nation"""
    out["fuzzy_gazetteer"] = """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS doc_id, lower(n_name) AS n, lower(substr(n_name, 1, 2) || 'x' || substr(n_name, 4)) AS x FROM nation),
      g AS (SELECT n FROM t WHERE n NOT LIKE '% %'),
      surf AS (SELECT doc_id, 3 AS s, x AS w FROM t UNION ALL SELECT doc_id, 8 + length(x), n FROM t),
      words AS (SELECT doc_id, s, w FROM surf WHERE w NOT LIKE '% %' UNION ALL SELECT doc_id, 0, 'at' FROM t UNION ALL SELECT doc_id, 4 + length(x), 'and' FROM t
        UNION ALL SELECT doc_id, CAST(s + list_sum(list_transform(string_split(w, ' ')[1:k - 1], lambda y: length(y) + 1)) AS INTEGER), string_split(w, ' ')[k] FROM (SELECT *, unnest(range(1, len(string_split(w, ' ')) + 1)) AS k FROM surf WHERE w LIKE '% %') WHERE k > 1
        UNION ALL SELECT doc_id, s, string_split(w, ' ')[1] FROM surf WHERE w LIKE '% %')
      SELECT doc_id, CAST(s AS INTEGER) AS span_start, CAST(s + length(w) AS INTEGER) AS span_end, w AS text, CASE WHEN w IN (SELECT n FROM g) THEN 0.9 ELSE 0.85 END AS score FROM words
      WHERE w IN (SELECT n FROM g) OR (length(w) >= 2 AND EXISTS (SELECT 1 FROM g WHERE length(n) >= 4 AND levenshtein(n, w) BETWEEN 1 AND 2))"""
    disjoint = greedy(FIVE)
    out["placeholder_numbers"] = f"SELECT doc_id, s AS span_start, '[' || key || '_' || CAST(number AS VARCHAR) || ']' AS placeholder FROM {numbered(disjoint)}"
    out["placeholder_reserved"] = f"SELECT doc_id, s AS span_start, '[' || key || '_' || CAST(number AS VARCHAR) || ']' AS placeholder FROM {numbered(disjoint, {'EMAIL_ADDRESS': [1], 'IP_ADDRESS': [2, 3]})}"
    mails = f"(SELECT * FROM {FIVE} WHERE label = 'email address')"
    out["redact_constant"] = f"SELECT doc_id, sha256(out) AS digest, CAST(n AS BIGINT) AS entity_count FROM {rendered(mails, chr(39) + '[REDACTED]' + chr(39))}"
    tokens = f"(SELECT *, '[' || key || '_' || CAST(number AS VARCHAR) || ']' AS tok FROM {numbered(disjoint)})"
    out["redact_replace"] = f"SELECT doc_id, out AS redacted_text, CAST(keys AS BIGINT) AS n_keys FROM {rendered(tokens, 'tok')} JOIN (SELECT doc_id, count(DISTINCT tok) AS keys FROM {tokens} GROUP BY doc_id) USING (doc_id)"
    out["mask_last4"] = f"SELECT doc_id, s AS span_start, repeat('*', length(v) - 4) || right(v, 4) AS masked FROM {FIVE} WHERE label = 'credit card number'"
    out["operator_counts"] = f"""WITH h AS (SELECT * FROM {greedy(f"(SELECT * FROM {FREE_MIXED} WHERE op = 'redact')")}), m AS (SELECT * FROM {greedy(f"(SELECT * FROM {FREE_MIXED} WHERE op = 'mask')")}), k AS (SELECT * FROM {greedy(f"(SELECT * FROM {FREE_MIXED} WHERE op = 'keep')")}),
      o AS (SELECT DISTINCT doc_id, '[REDACTED]' AS p, op FROM h UNION ALL SELECT DISTINCT doc_id, {MASKED}, op FROM m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = m.doc_id AND h.s < m.e AND m.s < h.e) UNION ALL SELECT DISTINCT doc_id, v, op FROM k)
      SELECT op AS operator, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM o GROUP BY op"""
    out["restore_roundtrip"] = f"SELECT count(*) AS n_docs, count(*) AS n_restored, (SELECT count(DISTINCT doc_id) FROM {FIVE}) AS n_changed FROM documents"
    out["pipeline_roundtrip"] = "SELECT count(*) AS n_docs, count(text) AS n_restored, CAST(0 AS BIGINT) AS n_crossing, CAST(0 AS BIGINT) AS n_other FROM documents"
    out["invalid_spans"] = f"SELECT CASE WHEN seq % 3 = 0 THEN 'empty-or-reversed-span' ELSE 'score-out-of-range' END AS error_code, count(*) AS n FROM {MIXED} WHERE seq % 3 = 0 OR seq % 5 = 0 GROUP BY ALL"
    out["session_cross_document"] = f"""WITH x AS (SELECT * FROM {SESSION}), f AS (SELECT session_id, key, ident, min(doc_id % 2) AS odd, arg_min((doc_id, s), (doc_id % 2, doc_id, s)) AS first_at FROM x GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY odd, first_at, ident) AS n FROM f)
      SELECT session_id, doc_id, s AS span_start, '[' || key || '_' || replace(session_id, '_', '%5F') || '_' || CAST(n AS VARCHAR) || ']' AS placeholder FROM x JOIN r USING (session_id, key, ident)"""
    out["session_status"] = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' WHEN TIMESTAMP '1995-06-01' < CAST(o_orderdate AS TIMESTAMP) THEN 'not-yet-active' WHEN TIMESTAMP '1995-06-01' >= CAST(o_orderdate AS TIMESTAMP) + INTERVAL 365 DAYS THEN 'expired' ELSE 'active' END AS status, count(*) AS n FROM orders GROUP BY ALL"
    out["coref_alias_asof"] = f"SELECT m.doc_id, m.s AS m_start, m.v AS mail, n.name, n.n_end FROM (SELECT * FROM {FIVE} WHERE label = 'email address') m ASOF JOIN {CELL} n ON m.doc_id = n.doc_id AND m.s >= n.n_end WHERE m.s - n.n_end <= 200"
    out["html_to_text"] = f"SELECT page_id, {HTML} AS body FROM pages"
    out["page_pii"] = f"SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_pages FROM {union(5, f'(SELECT page_id AS doc_id, {HTML} AS text FROM pages)')} GROUP BY label"
    out["prf_by_label"] = f"SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS p, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS r, round({F1}, 9) AS f1 FROM (SELECT label, {COUNTS} FROM {EXACT} GROUP BY label)"
    out["prf_overlap"] = f"SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round({F1}, 9) AS f1 FROM (SELECT label, {COUNTS} FROM {OVERLAP} GROUP BY label)"
    both = f"(SELECT p.doc_id, greatest(p.s, g.s) AS s, least(p.e, g.e) AS e FROM {islands(MIXED)} p JOIN {islands(GOLD)} g ON p.doc_id = g.doc_id AND p.s < g.e AND g.s < p.e)"
    out["char_precision_recall"] = f"SELECT CAST(hidden AS BIGINT) AS hidden, CAST(gold AS BIGINT) AS gold, CAST(shared AS BIGINT) AS shared, round(CASE WHEN hidden > 0 THEN shared / hidden ELSE 0 END, 9) AS p, round(CASE WHEN gold > 0 THEN shared / gold ELSE 0 END, 9) AS r FROM (SELECT {solid(islands(MIXED))} AS hidden, {solid(islands(GOLD))} AS gold, {solid(both)} AS shared)"
    out["entity_recall"] = f"""WITH m AS (SELECT x.doc_id, label, CASE WHEN label = 'ip address' THEN 'QUASI' ELSE 'DIRECT' END AS t, CASE WHEN EXISTS (SELECT 1 FROM {islands(f"(SELECT * FROM {GOLD} WHERE doc_id % 7 <> 1)")} k WHERE k.doc_id = x.doc_id AND k.s <= x.s AND x.e <= k.e) THEN 1.0 ELSE 0.0 END AS c FROM {FIVE} x WHERE label <> 'secret')
      SELECT CAST(1 AS BIGINT) AS annotator, round((SELECT avg(c) FROM m WHERE t = 'DIRECT'), 9) AS direct_recall, round((SELECT avg(c) FROM m WHERE t = 'QUASI'), 9) AS quasi_recall, round((SELECT avg(c) FROM m), 9) AS mention_recall, round((SELECT avg(c) FROM (SELECT min(c) AS c FROM m GROUP BY doc_id, label)), 9) AS entity_recall"""
    out["run_diff"] = DIFF
    out["label_quality"] = f"SELECT quality, label, count(*) AS n FROM {FIVE} JOIN labels USING (doc_id) GROUP BY quality, label"
    out["benchmark_overlap"] = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0"
    out["blocks_neighbourhood"] = "SELECT conv_id AS doc_id, turn AS pos, CAST(len(l) AS BIGINT) AS n_near, sha256(array_to_string(l, chr(10))) AS digest FROM (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM conversations)"
    out["document_facts"] = "SELECT conv_id AS doc_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(DISTINCT text) AS n_texts FROM conversations GROUP BY conv_id"
    out["block_findings"] = "SELECT conv_id AS doc_id, turn AS pos, sha256(regexp_replace(text, '[A-Za-z]{14,}', '<long>', 'g')) AS digest FROM conversations"
    out["offsets"] = f"SELECT doc_id, s AS span_start, CAST(strlen(substr(text, 1, s)) AS BIGINT) AS utf8, CAST(s + length(regexp_replace(substr(text, 1, s), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS utf16 FROM {FIVE} JOIN (SELECT doc_id, text FROM documents) USING (doc_id)"
    out["label_keys"] = "SELECT regexp_replace(upper(p_type), '\\s+', '_', 'g') AS key, count(*) AS n FROM part GROUP BY ALL"
    luhn9 = LUHN
    out["validators"] = f"""WITH o AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 9, '1') AS v, '1' || lpad(CAST(o_orderkey AS VARCHAR), 9, '1') AS w FROM orders)
      SELECT CAST(sum(CASE WHEN {weigh([3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS us_rtn,
      CAST(sum(CASE WHEN ({weigh([9, 8, 7, 6, 5, 4, 3, 2])} - CAST(substr(v, 9, 1) AS INTEGER)) % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nl_bsn,
      CAST(sum(CASE WHEN {check11([5, 4, 3, 2, 7, 6, 5, 4], 'v', 9)} THEN 1 ELSE 0 END) AS BIGINT) AS ch_uid, CAST(sum(CASE WHEN {check11([3, 2, 7, 6, 5, 4, 3, 2], 'v', 9)} THEN 1 ELSE 0 END) AS BIGINT) AS no_orgnr,
      CAST(sum(CASE WHEN {check11([10, 9, 8, 7, 6, 5, 4, 3, 2], 'w', 10)} THEN 1 ELSE 0 END) AS BIGINT) AS nhs, CAST(sum(CASE WHEN {weigh([6, 5, 7, 2, 3, 4, 5, 6, 7], 'w')} % 11 = CAST(substr(w, 10, 1) AS INTEGER) THEN 1 ELSE 0 END) AS BIGINT) AS pl_nip,
      CAST(sum(CASE WHEN {luhn9} THEN 1 ELSE 0 END) AS BIGINT) AS fr_siren, CAST(sum(CASE WHEN CAST(v || '131400' AS BIGINT) % 97 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS mod97 FROM o"""
    out["tumbling_event_counts"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL"
    out["session_windows"] = """SELECT user_id, count(DISTINCT g) AS n_sessions, count(*) AS n_events FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id"""
    out["percentile_report"] = f"SELECT label, quantile_cont(length(v), 0.5) AS p50, quantile_cont(length(v), 0.95) AS p95, count(*) AS n FROM {FIVE} GROUP BY label"
    return out
