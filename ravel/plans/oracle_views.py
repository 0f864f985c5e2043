"""DuckDB text of the domain views (FIXTURES.md §2); used as CTEs in the
oracle SQL. The Spark side builds the same tables in ``ravel.sources.views``."""

VIEW_SQL = {
    "reviews": """SELECT o_orderkey AS id, 'team' || CAST(c_nationkey % 5 AS STRING) || '/repo' || CAST(o_custkey % 20 AS STRING) AS repo_full_name,
 CAST(o_orderkey % 997 AS INT) AS pr_number, 'PR ' || o_orderpriority AS pr_title, 'user_' || CAST(o_custkey AS STRING) AS author_login,
 'h' || o_orderstatus AS head_sha, CAST(floor(o_totalprice) AS BIGINT) % 101 AS overall_score,
 CASE WHEN o_orderkey % 3 = 0 THEN 'gitlab' ELSE 'github' END AS provider,
 CASE o_orderstatus WHEN 'F' THEN 'APPROVE' WHEN 'O' THEN 'REQUEST_CHANGES' ELSE 'COMMENT' END AS review_event,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Summary of ' || o_orderpriority END AS summary, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "review_comments": """SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS id, l_orderkey AS review_id,
 'src/mod' || CAST(l_suppkey % 10 AS STRING) || '/file' || CAST(l_partkey % 50 AS STRING) || '.py' AS file_path,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 400 END AS line_number,
 CASE l_partkey % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'architecture' WHEN 2 THEN 'performance' WHEN 3 THEN 'style' ELSE 'correctness' END AS category,
 CASE WHEN l_suppkey % 10 = 0 THEN 'critical' WHEN l_suppkey % 3 = 0 THEN 'warning' WHEN l_suppkey % 3 = 1 THEN 'info' ELSE 'suggestion' END AS severity,
 'issue ' || CAST(l_partkey % 40 AS STRING) AS title, 'Consider change ' || CAST(l_suppkey AS STRING) || ' here.' AS suggestion
FROM lineitem""",
    "raw_examples": """SELECT d.doc_id AS example_id, d.source AS repo, CAST(d.doc_id % 50 AS INT) AS pr_number, 'src/' || d.lang || '/f' || CAST(d.doc_id % 30 AS STRING) || '.py' AS file_path,
 d.text || CASE d.doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN ' You should use `foo` here.' WHEN 2 THEN ' Done. nit: typo'
  WHEN 3 THEN ' Consider caching this query; the index is missing.' WHEN 4 THEN ' SQL injection risk: call sanitize() with "user input".' WHEN 5 THEN ' lgtm'
  WHEN 6 THEN ' This function might deadlock, extract it.' WHEN 7 THEN ' The token is unsafe; replace `md5` instead of "sha one".' WHEN 8 THEN ' null error on an edge case' ELSE ' coupling with the abstraction layer' END AS review_comment,
 CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE substr(d.text, 1, 2000) END AS patch,
 coalesce(l.quality = 1, false) AS author_ack, CAST(d.doc_id % 5 AS INT) AS reactions,
 CASE d.doc_id % 4 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'NONE' ELSE 'CONTRIBUTOR' END AS association,
 CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE CAST(d.doc_id % 300 AS INT) END AS comment_line
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "pulls": """SELECT DISTINCT 'org/r' || CAST(conv_id % 4 AS STRING) AS repo, conv_id AS pr_number, 'assistant' AS author_login, 'closed' AS state,
 CASE WHEN conv_id % 6 = 0 THEN NULL ELSE conv_id END AS merged_seq, conv_id * 7919 % 1000 AS updated_seq,
 'Change ' || CAST(conv_id AS STRING) AS pr_title,
 CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'Adds part ' || CAST(conv_id AS STRING) || repeat(' and more', CAST(conv_id % 80 AS INT)) END AS pr_body FROM conversations""",
    "pr_comments": """SELECT 'org/r' || CAST(conv_id % 4 AS STRING) AS repo, conv_id AS pr_number, conv_id * 100 + turn AS comment_id,
 CASE WHEN turn = 0 THEN NULL ELSE conv_id * 100 END AS in_reply_to_id, role AS user_login, CASE WHEN role = 'system' THEN 'Bot' ELSE 'User' END AS user_type,
 'src/f' || CAST(conv_id % 7 AS STRING) || '.js' AS path,
 CASE WHEN (conv_id + turn) % 9 = 0 THEN 'nit: ' ELSE '' END || text || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' Good catch, fixed' ELSE '' END AS body,
 CAST(turn % 4 AS INT) AS reactions, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(turn * 3 + 1 AS INT) END AS line,
 CASE conv_id % 4 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' WHEN 2 THEN 'NONE' ELSE 'CONTRIBUTOR' END AS association,
 TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS created_at FROM conversations""",
    "pr_files": """SELECT 'org/r' || CAST(conv_id % 4 AS STRING) AS repo, conv_id AS pr_number, turn AS pos,
 'src/f' || CAST((conv_id + CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) % 7 AS STRING) || '.js' AS path,
 CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE '@@ -1 +1 @@' || chr(10) || '-old ' || CAST(99 - turn AS STRING) || chr(10) || '+new' || chr(10) || '+more' END AS patch FROM conversations""",
    "changed_files": """SELECT o_custkey AS pr_id, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS pos,
 'src/mod' || CAST(l_suppkey % 10 AS STRING) || '/file' || CAST(l_partkey % 50 AS STRING) || '.py' AS filename,
 CAST(l_quantity AS INT) AS additions, l_linenumber AS deletions, CAST(l_quantity AS INT) + l_linenumber AS changes,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE '@@' || chr(10) || '+' || l_linestatus END AS patch FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "pr_events": """SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'gitlab' ELSE 'github' END AS provider,
 CASE WHEN event_type = 'error' THEN 'other' WHEN event_id % 3 = 0 THEN 'Merge Request Hook' ELSE 'pull_request' END AS event_name,
 CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'opened' END WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'update' ELSE 'synchronize' END
  WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'reopen' ELSE 'reopened' END ELSE 'closed' END AS action,
 'org/r' || CAST(user_id % 10 AS STRING) AS repo_full_name, CAST(event_id % 400 AS INT) AS pr_number, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS body, 'user_' || CAST(user_id AS STRING) AS author_login,
 CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'Change ' || CAST(event_id AS STRING) END AS pr_title, 'h' || CAST(event_id AS STRING) AS head_sha,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'b' || CAST(event_id % 1000 AS STRING) END AS base_sha,
 CASE WHEN event_id % 3 <> 0 THEN user_id * 10 END AS installation_id, CASE WHEN event_id % 3 = 0 THEN user_id * 10 + 1 END AS project_id FROM events""",
    "responses": """SELECT doc_id AS example_id, CASE WHEN doc_id % 2 = 0 THEN 'tuned' ELSE 'base' END AS model,
 CASE doc_id % 5 WHEN 0 THEN 'security' WHEN 1 THEN 'performance' WHEN 2 THEN 'style' WHEN 3 THEN 'correctness' ELSE NULL END AS expected_category,
 replace(CASE doc_id % 13 WHEN 0 THEN 'not json at all: @text' WHEN 1 THEN '' WHEN 2 THEN '{"overallScore": 90, "summary": "@text", "comments": []}'
  WHEN 3 THEN '{"overallScore": 150, "summary": "too high: @text", "comments": []}'
  WHEN 4 THEN '```json' || chr(10) || '{"overallScore": 55, "summary": "@text", "comments": [{"filePath": "a.py", "line": 3, "category": "security", "severity": "critical", "title": "Use `verify()`", "suggestion": "@text You should replace decode() here."}]}' || chr(10) || '```'
  WHEN 5 THEN '```' || chr(10) || '{"overallScore": 70, "summary": "@text", "comments": []}' || chr(10) || '```'
  WHEN 6 THEN '{"overallScore": 60, "summary": "@text", "comments": [{"filePath": 5, "category": "style", "severity": "info", "title": "t", "suggestion": "x"}, {"filePath": "b.py", "category": "bogus", "severity": "info", "title": "t", "suggestion": "x"}]}'
  WHEN 7 THEN 'null' WHEN 8 THEN '{"overallScore": 60, "summary": "@text", "comments": {}}' WHEN 9 THEN '{"overallScore": 88, "summary": "@text", "comments": []} trailing'
  WHEN 10 THEN '{"summary": "no score: @text", "comments": [{"filePath": "c.py", "line": null, "category": "style", "severity": "info", "title": "@text", "suggestion": "@text"}]}'
  WHEN 12 THEN '{"overallScore": 72.5, "summary": "@text", "comments": []}'
  ELSE '{"overallScore": 86, "summary": "@text", "comments": [{"filePath": "c.py", "line": 9, "category": "correctness", "severity": "warning", "title": "t", "suggestion": "@text Consider this method", "codeExample": null}]}' END, '@text', substr(CAST(to_json(coalesce(text, '')) AS VARCHAR), 2, length(CAST(to_json(coalesce(text, '')) AS VARCHAR)) - 2)) AS raw_text,
 CASE WHEN doc_id % 29 = 0 THEN 'timeout' ELSE NULL END AS error FROM documents""",
    "pr_bodies": """SELECT doc_id AS pr_id, source AS repo, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'fix stuff'
 WHEN 2 THEN '## What' || chr(10) || 'text' || chr(10) || '## Why' || chr(10) || 'because' || chr(10) || '## Testing' || chr(10) || 'unit'
 WHEN 3 THEN '## what' || chr(10) || '[Describe what this PR does]' || chr(10) || '## Testing' || chr(10) || 'manual'
 WHEN 4 THEN '## Summary' || chr(10) || 'Added a feature' || chr(10) ELSE text END AS body FROM documents""",
    "request_log": """SELECT event_id, ts, 'ip_' || CAST(user_id AS STRING) AS client_key, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS status,
 CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, '/api/' || event_type AS url, CAST(floor(value * 10) AS BIGINT) AS duration_ms FROM events""",
    "review_jobs": """SELECT c_custkey AS pr_id, 'team' || CAST(c_nationkey % 5 AS STRING) || '/repo' || CAST(c_custkey % 20 AS STRING) AS repo_full_name,
 'PR ' || c_name AS pr_title, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Segment ' || c_mktsegment END AS pr_body, o.created_at
FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey""",
    "repo_languages": """SELECT 'team' || CAST(CAST(floor(doc_id / 20) AS BIGINT) % 5 AS STRING) || '/repo' || CAST(doc_id % 20 AS STRING) AS repo, lang,
 min(doc_id) AS pos, sum(n_chars) AS bytes FROM documents GROUP BY 1, 2""",
    "pr_templates": """SELECT repo, arg_min(body, pr_id) AS content FROM pr_bodies WHERE len(regexp_extract_all(body, '(?m)^## ')) >= 2 GROUP BY repo""",
}
