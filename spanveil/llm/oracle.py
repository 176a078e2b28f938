"""DuckDB SQL for the operators that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from .chat import BEGIN, CONTROL, END
from .mixing import BLOCKS, SEED

REACH = """reach(v, w) AS (SELECT v, v FROM nodes UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.w)"""

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, p0, substr(h, 2 * p0 + 1, 710) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 256)) AS p0 FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, p0 + i AS s, md5(substr(part, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, p0, part, unnest(range(0, least(256, length(part) // 2 - 99))) AS i FROM k)),
f AS (SELECT m, min((doc_id, s)) AS first FROM w GROUP BY m HAVING count(*) > 1),
c AS (SELECT doc_id, s, s + 100 AS e FROM w JOIN f USING (m) WHERE (doc_id, s) <> first),
g AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY doc_id ORDER BY s) THEN 0 ELSE 1 END AS fresh FROM c)) GROUP BY doc_id, g),
p AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (s - prev)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS gone, count(*) AS n FROM (
  SELECT g.*, h, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM g JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id)
"""

_FIRST = "".join(sorted({"\\" + c[0] for c in CONTROL}))
_REST = "|".join("".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in c[1:]) for c in sorted(CONTROL, key=lambda c: -len(c)))
_HIDDEN = f"[{_FIRST}]\\\\*(?:{_REST})"

OP3 = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN) + 1 + len(END)} + length(role) + length(text) + len(regexp_extract_all(text, '{_HIDDEN}'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
l AS (SELECT *, substr(digest, 1, 1) AS shard, coalesce(sum(size) OVER (PARTITION BY source, substr(digest, 1, 1) ORDER BY digest, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
fill AS (SELECT 0 AS round, source, ss, w, false AS capped FROM src
  UNION ALL SELECT round + 1, source, ss, w, capped OR w * left_ > 3 * ss * w_left FROM (
    SELECT *, sum(ss) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * ss END) OVER (), 0) AS left_, sum(CASE WHEN NOT capped THEN w END) OVER () AS w_left FROM fill) WHERE round < 40),
goal AS (SELECT source, ss, CASE WHEN capped THEN CAST(3 * ss AS DOUBLE) ELSE CAST(w * left_ AS DOUBLE) / CAST(w_left AS DOUBLE) END AS target, total FROM (
  SELECT *, sum(ss) OVER () AS total, sum(ss) OVER () - coalesce(sum(CASE WHEN capped THEN 3 * ss END) OVER (), 0) AS left_, sum(CASE WHEN NOT capped THEN w END) OVER () AS w_left FROM fill WHERE round = 40)),
blk AS (SELECT *, greatest(1, total // {BLOCKS}) AS block, total // greatest(1, total // {BLOCKS}) AS seats FROM goal),
q1 AS (SELECT source, ss, target, block, seats, target / (2 * k + 1) AS q FROM blk, range(0, {BLOCKS} * 2) t(k) WHERE target > 0 AND k <= target * seats / total + 40),
b1 AS (SELECT source, count(*) AS blocks FROM (SELECT * FROM q1 QUALIFY row_number() OVER (ORDER BY q DESC, source NULLS LAST) <= seats) GROUP BY source),
sh AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS sh_size FROM l GROUP BY ALL),
q2 AS (SELECT sh.source, shard, blocks, CAST(sh_size AS DOUBLE) / (2 * k + 1) AS q FROM sh JOIN b1 ON sh.source IS NOT DISTINCT FROM b1.source JOIN src ON src.source IS NOT DISTINCT FROM sh.source, range(0, {BLOCKS} * 2) t(k) WHERE sh_size > 0 AND k <= CAST(sh_size AS DOUBLE) * blocks / ss + 40),
b2 AS (SELECT source, shard, count(*) AS quota FROM (SELECT * FROM q2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) <= blocks) GROUP BY ALL),
cell AS (SELECT sh.source, sh.shard, sh_size, ss, target, CAST(least(coalesce(quota, 0) * block, 3 * sh_size) AS BIGINT) AS words FROM sh JOIN blk ON sh.source IS NOT DISTINCT FROM blk.source LEFT JOIN b2 ON sh.source IS NOT DISTINCT FROM b2.source AND sh.shard = b2.shard),
win AS (SELECT *, CASE WHEN sh_size > 0 THEN words // sh_size ELSE 0 END AS rounds, CASE WHEN sh_size > 0 THEN CAST('0x' || substr(md5('{SEED}/' || coalesce(source, '') || '/' || shard), 1, 8) AS BIGINT) % sh_size ELSE 0 END AS start FROM cell),
fin AS (SELECT *, words - rounds * sh_size AS rest FROM win)
SELECT doc_id, size, ss AS source_size, target, CAST(size * rounds + greatest(0, least(a + size, least(start + rest, sh_size)) - greatest(a, start)) + greatest(0, least(a + size, start + rest - sh_size) - greatest(a, 0)) AS BIGINT) AS taken
FROM l JOIN fin ON l.source IS NOT DISTINCT FROM fin.source AND l.shard = fin.shard
"""

OP8 = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
nodes AS (SELECT DISTINCT a AS v FROM links), {REACH}
SELECT doc_id, coalesce((SELECT min(w) FROM reach WHERE v = doc_id), doc_id) AS class_id, CAST((SELECT count(*) FROM links WHERE a = doc_id) AS BIGINT) AS n_links,
  coalesce((SELECT min(w) FROM reach WHERE v = doc_id), doc_id) = doc_id AS kept FROM documents
"""

OP9 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS norm FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.norm > 0 AND y.norm > 0 AND list_inner_product(x.v, y.v) / (x.norm * y.norm) >= 0.93),
nodes AS (SELECT DISTINCT a AS v FROM links), {REACH}
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links, coalesce((SELECT min(w) FROM reach WHERE v = vec_id), vec_id) AS component_id,
  coalesce((SELECT min(w) FROM reach WHERE v = vec_id), vec_id) = vec_id AS kept FROM embeddings
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_repeats": OP1, "op3_chat": OP3, "op7_mixing": OP7, "op8_jaccard": OP8, "op9_embeddings": OP9}
