"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Windows of 13 words by hash of their text; the smallest id with each decides.
ORACLES["op8_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
g AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS h FROM s),
r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < doc_id),
gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM r, (SELECT unnest(range(0, 13)) AS k)),
marked AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN marked USING (doc_id)
"""

# All pairs that share a shingle, then the smallest id reachable by links.
ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p:p + 4], ' ') END) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS p FROM w WHERE len(ws) > 0)),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY w.doc_id
"""

# Every query against every other row.
ORACLES["op9_nearest_neighbours"] = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# Digests from the turns themselves; the formatted length counts each turn as often as the
# windows of budget 512 and history 96 show it.
ORACLES["op5_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
c AS (
  SELECT *, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 4 AS cost FROM t),
u AS (
  SELECT *, sum(cost) OVER o AS upto, row_number() OVER o AS place, max(cost) OVER (PARTITION BY conv_id) AS longest,
    first_value(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER o AS sys
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
s AS (
  SELECT *, CAST(floor((upto - cost) / greatest(1, 512 - 96 - sys - longest + 1)) AS BIGINT) AS span FROM u),
w AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY span) - 1 AS win FROM s),
x AS (
  SELECT *, max(upto) OVER (PARTITION BY conv_id, win) AS span_end, max(win) OVER (PARTITION BY conv_id) + 1 AS wins,
    place = 1 AND role = 'system' AS lead FROM w),
y AS (
  SELECT *, 1 + CASE WHEN lead THEN wins - 1 WHEN win + 1 < wins AND span_end - upto + cost <= 96 THEN 1 ELSE 0 END AS shown,
    24 + length(replace(regexp_replace(role, '<(\|+)', '<|\1', 'g'), chr(10), '<|n|>'))
       + length(regexp_replace(text, '<(\|+)', '<|\1', 'g')) AS chars FROM x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown * chars) AS BIGINT) AS formatted_chars
FROM y GROUP BY conv_id
"""

# Nodes level by level, then a walk up from each leaf; a run is a pair or a last single node.
ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS before,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS after,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, b: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)),
      CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(before || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || after) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(before || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || after) END AS tampered
  FROM d),
langs AS (
  SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) AS g, count(*) OVER () AS langs
  FROM (SELECT DISTINCT lang FROM documents)),
placed AS (
  SELECT doc_id, leaf, tampered, g, langs,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n
  FROM leaves l JOIN langs k ON l.lang IS NOT DISTINCT FROM k.lang),
nodes(lvl, g, p, n, h) AS (
  SELECT 0, g, p, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, g, p // 2, (n + 1) // 2, sha256(h || coalesce(beside, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY p) AS beside FROM nodes WHERE n > 1) WHERE p % 2 = 0),
subroots AS (
  SELECT g, h AS subroot FROM nodes WHERE n = 1),
tops(lvl, p, n, h) AS (
  SELECT 0, g - 1, (SELECT count(*) FROM langs), subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, p // 2, (n + 1) // 2, sha256(h || coalesce(beside, ''))
  FROM (SELECT *, lead(h) OVER (ORDER BY p) AS beside FROM tops WHERE n > 1) WHERE p % 2 = 0),
walk(g, p, lvl, n, proof, fold) AS (
  SELECT g, p, 0, n, '', coalesce(tampered, leaf) FROM placed
  UNION ALL
  SELECT w.g, w.p, w.lvl + 1, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN (w.p >> w.lvl) % 2 = 1 THEN s.h || w.fold ELSE w.fold || coalesce(s.h, '') END)
  FROM walk w LEFT JOIN nodes s ON s.g = w.g AND s.lvl = w.lvl AND s.p = xor(w.p >> w.lvl, 1) WHERE w.n > 1),
climb(g, p, lvl, n, proof, fold) AS (
  SELECT g, p, 0, (SELECT count(*) FROM langs), proof, fold FROM walk WHERE n = 1
  UNION ALL
  SELECT w.g, w.p, w.lvl + 1, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN ((w.g - 1) >> w.lvl) % 2 = 1 THEN s.h || w.fold ELSE w.fold || coalesce(s.h, '') END)
  FROM climb w LEFT JOIN tops s ON s.lvl = w.lvl AND s.p = xor((w.g - 1) >> w.lvl, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = r.h AS verified
FROM placed JOIN subroots USING (g) JOIN climb c USING (g, p) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r
WHERE c.n = 1
"""
