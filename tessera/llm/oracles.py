"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
p AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fit AS (
  SELECT p.r, u.rule, u.verdict, row_number() OVER (PARTITION BY p.r ORDER BY length(u.rule) DESC) AS k
  FROM p JOIN rules u ON starts_with(p.path, substr(u.rule, instr(u.rule, '/')))
   AND (p.host = split_part(u.rule, '/', 1) OR ends_with(p.host, '.' || split_part(u.rule, '/', 1))))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit f ON f.r = p.r AND f.k = 1
"""

OP8 = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS participant FROM m),
x AS (
  SELECT m.conv_id, s.participant, floor(m.place / 64.0)::BIGINT AS segment, m.place,
         CASE WHEN m.role = s.participant THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(replace(m.role, '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) END AS head,
         replace(replace(m.text, '<|', '<\|'), '|>', '|\>') || chr(10) || '<|end|>' AS body,
         CASE WHEN m.role = s.participant THEN 1 ELSE 0 END AS mask
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, segment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM x)
SELECT conv_id, participant, segment,
       string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
       string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)) || ':' || mask, ',' ORDER BY place) AS spans,
       count(*)::BIGINT AS n_messages, sum(mask)::BIGINT AS n_trained
FROM y GROUP BY conv_id, participant, segment
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, list_slice(w, s, s + 9) AS terms
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(terms) AS n FROM win),
places AS (
  SELECT r, s, n, list_slice(w, s, s + n - 1) AS terms
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT a.r, a.s, a.n, win.item FROM places a JOIN win ON a.terms = win.terms),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(m.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked m ON m.r = d.r LEFT JOIN named n ON n.r = d.r
"""

ORACLES = {"op5_url_filter": OP5, "op8_perspectives": OP8, "op9_positional_index": OP9}
