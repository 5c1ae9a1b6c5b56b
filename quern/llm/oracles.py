"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
grams AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hits AS (SELECT rid, n, i, item FROM grams JOIN win USING (n, gram)),
pos AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, n, i FROM hits)) GROUP BY 1),
its AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
ln AS (SELECT rid, host, text, line, regexp_extract_all(line, '{_WORD}') AS lw FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d)),
li AS (SELECT rid, host, text, line, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '), '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g') AS norm FROM ln WHERE len(lw) > 0),
dup AS (SELECT rid, CAST(sum(c - 1) AS BIGINT) AS n_dup_lines FROM (SELECT rid, line, count(*) AS c FROM li GROUP BY 1, 2) GROUP BY 1),
gr AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
tw AS (SELECT rid, i FROM gr JOIN (SELECT rid, gram FROM gr GROUP BY 1, 2 HAVING count(*) > 1) USING (rid, gram)),
rp AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS k FROM tw) GROUP BY 1),
hs AS (SELECT host, greatest(10.0, 0.05 * count(DISTINCT text)) AS most FROM d GROUP BY 1),
fq AS (SELECT host, norm FROM li JOIN hs USING (host) GROUP BY host, norm, most HAVING count(DISTINCT text) > most),
lost AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_frequent_words FROM li JOIN fq USING (host, norm) GROUP BY 1),
base AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_frequent_words, 0) AS n_frequent_words FROM d LEFT JOIN dup USING (rid) LEFT JOIN rp USING (rid) LEFT JOIN lost USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_frequent_words >= 0.3 * n_words AS kept, n_frequent_words FROM judged
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
sz AS (SELECT rid, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM sh x JOIN sh y USING (s) WHERE x.rid < y.rid GROUP BY 1, 2),
ed AS (SELECT a, b FROM pr JOIN sz x ON a = x.rid JOIN sz y ON b = y.rid WHERE 100 * k >= 75 * (x.n + y.n - k)),
ends AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
walk AS (SELECT rid AS node, rid AS seen FROM d UNION SELECT w.node, e.b FROM walk w JOIN ends e ON w.seen = e.a),
comp AS (SELECT node, min(doc_id) AS component_id FROM walk JOIN d ON seen = rid GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN sz USING (rid) JOIN comp ON node = d.rid
"""
