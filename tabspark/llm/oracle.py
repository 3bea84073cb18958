"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tabspark.llm.chat import CONTROL, OPEN, OTHER, PLANTED, TURNS

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(k: int) -> str:
    return f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END"


NGRAM_JOIN = f"""
WITH RECURSIVE s AS (SELECT doc_id, {_shingles(3)} AS f FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
e AS (SELECT doc_id, len(f) AS n, unnest(f) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM c UNION SELECT y, x FROM c),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(f) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON s.doc_id = m.x
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, length(coalesce(text, '')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / CASE WHEN size > 0 THEN 1.0 / (1.0 + abs(chars / size - 6.0) / 6.0) ELSE 1e-6 END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS FIRST) AS place FROM s),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5 - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, place) FROM v WHERE level * w <= cap) * w, cap)) AS target FROM v),
j AS (SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND ahead + size / 2 < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""

WARC = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages))
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, unnest({_shingles(5)}) AS g FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, {_shingles(5)} AS f FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
u AS (SELECT item_id, len(f) AS n, unnest(f) AS g FROM i)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared, count(*) / n AS containment FROM u JOIN d USING (g) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LEAD = " ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)} + length(t)" for r, (a, b) in TURNS.items())
_ESCAPED = f"regexp_replace({{}}, {_quoted(f'({CONTROL})')}, '\\\\\\1', 'g')"
_PLANTED = ", ".join(f"({c}, {n}, '{r}', {_quoted(t)})" for c, n, r, t in PLANTED)

CHAT = f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {_PLANTED})),
e AS (SELECT *, {_ESCAPED.format("text")} AS t, {_ESCAPED.format("role")} AS r FROM a)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST({len(OPEN)} + sum(CASE {_LEAD} ELSE {sum(map(len, OTHER))} + length(r) + length(t) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL = {"op1_ngram_jaccard_join": NGRAM_JOIN, "op2_mix_sources": MIX, "op4_warc_normalise": WARC, "op5_decontaminate": DECONTAMINATE, "op8_chat_format": CHAT}
