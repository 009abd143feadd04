"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH captures AS (
  SELECT page_id, nullif(lower(rtrim(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '.')), '') AS host,
         DATE '2023-01-01' + CAST((page_id * 7919) % 1095 AS INT) AS fetched
  FROM pages),
labels AS (SELECT page_id, host, fetched, string_split(host, '.') AS l FROM captures),
asked AS (
  SELECT page_id, host, fetched, i - 1 AS place, CASE WHEN len(l) < 2 THEN host ELSE array_to_string(l[i:], '.') END AS domain
  FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM labels WHERE host IS NOT NULL)),
hashed AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 2) AS INT) AS v, CAST('0x' || substr(md5(domain), 3, 3) AS INT) % 700 AS d
  FROM (SELECT DISTINCT domain FROM asked)),
spans AS (
  SELECT domain, (['adult', 'gambling', 'malware', 'spam'])[v % 4 + 1] AS category, DATE '2023-01-01' + d AS valid_from,
         CASE WHEN v % 3 = 0 THEN DATE '2023-01-01' + (d + 90) ELSE DATE '9999-12-31' END AS valid_to
  FROM hashed WHERE v < 128
  UNION ALL
  SELECT domain, (['adult', 'gambling', 'malware', 'spam'])[v % 4 + 1], DATE '2023-01-01' + (d + 200), DATE '9999-12-31'
  FROM hashed WHERE v < 128 AND v % 9 = 0),
hits AS (
  SELECT a.page_id, s.domain, s.category, s.valid_from, row_number() OVER (PARTITION BY a.page_id ORDER BY a.place, s.category) AS k
  FROM asked a JOIN spans s ON a.domain = s.domain AND a.fetched >= s.valid_from AND a.fetched < s.valid_to)
SELECT c.page_id, c.host, c.fetched, h.page_id IS NOT NULL AS blocked, h.domain, h.category, h.valid_from
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.k = 1
"""

OP10 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS opens,
         length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?INST\]|SEP\]|/?s>)')) AS chars,
         length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?INST\]|SEP\]|/?s>)')) AS role_chars
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars + CASE WHEN opens THEN 13 + role_chars + 4 ELSE 5 END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP11 = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sized AS (SELECT i.*, least(h, coalesce(n, 0)) AS hb FROM ids i LEFT JOIN (SELECT c AS base, count(*) AS n FROM own GROUP BY c) ON base = c - c % 20),
rebuilt AS (
  SELECT i.c, pos AS d, role, text FROM sized i JOIN own o ON o.c = i.c - i.c % 20 AND pos <= h
  UNION ALL SELECT i.c, pos - h + hb, role, text FROM sized i JOIN own o ON o.c = i.c AND pos > h),
paths AS (
  SELECT c, 0 AS d, '' AS key, 0 AS words FROM ids
  UNION ALL
  SELECT c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)), len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
  FROM rebuilt),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (
  SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM linked GROUP BY key, d),
children AS (SELECT up AS key, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
full_ AS (SELECT o.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes o LEFT JOIN children k ON k.key = o.key AND k.d = o.d LEFT JOIN nodes p ON p.key = o.up AND p.d = o.d - 1),
sums AS (
  SELECT q.key, q.d, CAST(sum(o.own) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves
  FROM full_ o JOIN paths q ON q.c = o.conv_id AND q.d <= o.d GROUP BY q.key, q.d)
SELECT conv_id, CAST(o.d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_ o JOIN sums s ON s.key = o.key AND s.d = o.d
"""

OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS r(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
split AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
within AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS more FROM split, range(2, 5) AS s(j), range(1, 5) AS t(i) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
kept AS (SELECT s.* FROM split s LEFT JOIN within h ON h.lang = s.lang AND h.phrase = s.phrase WHERE more IS NULL OR 100 * more < 100 * a),
cuts AS (
  SELECT s.lang, s.phrase, s.a, j, l.a AS l, r.a AS r, n, CAST(1000 * CAST(s.a AS HUGEINT) * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM kept s JOIN range(1, 5) AS c(j) ON j < s.k JOIN sizes z ON z.lang = s.lang
  JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(w[:j], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS k FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE k = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_temporal_list": OP1, "op10_chat_relational": OP10, "op11_prefix_trie": OP11, "op12_phrase_collocations": OP12}
