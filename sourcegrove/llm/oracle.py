"""DuckDB SQL for the queries that SQL can express."""

ORACLE_SQL: dict[str, str] = {
    # The tables have no tool calls; tests cover those.
    "op2_chat_format": r"""
SELECT conv_id, turn, role, turn AS order_turn, 0::INTEGER AS level, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked,
  0::BIGINT AS n_errors, '' AS errors,
  '{' || concat_ws(',', '"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR) || '}' AS message
FROM conversations
""",
    "op3_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""",
}
