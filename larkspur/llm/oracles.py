"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_KEY = r"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND k.doc_id <> f.keeper) AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

CHAT = """
WITH RECURSIVE t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
asked AS (SELECT conv_id, turn, text FROM t WHERE role = 'user'),
deep(conv_id, turn, depth) AS (
  SELECT a.conv_id, a.turn, 0::BIGINT FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM asked b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
  UNION ALL
  SELECT a.conv_id, a.turn, d.depth + 1 FROM asked a JOIN deep d ON a.conv_id = d.conv_id AND a.turn = d.turn + 2),
told AS (SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS result FROM t WHERE role = 'assistant' GROUP BY ALL),
led AS (SELECT conv_id, arg_min(text, turn) AS system FROM t WHERE role = 'system' GROUP BY conv_id),
x AS (
  SELECT a.conv_id, 't' || a.turn AS call_id, d.depth, CASE WHEN r.result IS NULL THEN 'no result' ELSE 'ok' END AS status,
         length(a.text) > 0 AS valid, a.turn, a.text, l.system, r.result
  FROM asked a JOIN deep d USING (conv_id, turn) LEFT JOIN told r USING (conv_id, turn) LEFT JOIN led l USING (conv_id))
SELECT conv_id, call_id, depth, status, valid,
       sha256('{"arguments":{"prompt":' || to_json(text)::VARCHAR || coalesce(',"system":' || to_json(system)::VARCHAR, '') || ',"turn":' || turn
              || '},"depth":' || depth || ',"id":"' || call_id || '","name":"reply","result":' || coalesce(to_json(result)::VARCHAR, 'null')
              || ',"status":"' || status || '"}') AS json_sha256
FROM x
"""
