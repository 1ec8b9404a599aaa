"""The star-schema git tables as plain SQL, for checking results in DuckDB.

``WITH_TABLES`` is a prefix for a query over the eleven tables. ``languages``
adds the language of each file path, ``python_source`` the words and lines the
Python blobs were made from.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "repositories": "SELECT 'repo-' || CAST(n_nationkey AS VARCHAR) AS repository_id FROM nation",
    "commit_seq": """
        SELECT 'repo-' || CAST(c.c_nationkey AS VARCHAR) AS repository_id, o.o_orderkey,
               md5('commit-' || CAST(o.o_orderkey AS VARCHAR)) AS commit_hash,
               lower(c.c_mktsegment) AS segment,
               row_number() OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderdate, o.o_orderkey) AS seq
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "commits": """
        SELECT repository_id, commit_hash, commit_author_name, commit_author_email, commit_author_when,
               commit_author_name AS committer_name, commit_author_email AS committer_email,
               commit_author_when AS committer_when, commit_message, tree_hash,
               CASE WHEN parent IS NULL THEN '[]' ELSE '["' || parent || '"]' END AS commit_parents
        FROM (
          SELECT 'repo-' || CAST(c.c_nationkey AS VARCHAR) AS repository_id,
                 md5('commit-' || CAST(o.o_orderkey AS VARCHAR)) AS commit_hash,
                 c.c_name AS commit_author_name,
                 lower(replace(c.c_name, '#', '.')) || '@example.com' AS commit_author_email,
                 o.o_orderdate AS commit_author_when,
                 o.o_orderpriority || ' ' || o.o_orderstatus AS commit_message,
                 md5('tree-' || CAST(o.o_orderkey AS VARCHAR)) AS tree_hash,
                 lag(md5('commit-' || CAST(o.o_orderkey AS VARCHAR))) OVER (
                   PARTITION BY c.c_nationkey ORDER BY o.o_orderdate, o.o_orderkey) AS parent
          FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) x""",
    "ref_tip": """
        SELECT repository_id, 'HEAD' AS ref_name, max(seq) AS tip_seq FROM commit_seq GROUP BY repository_id
        UNION ALL
        SELECT repository_id, 'refs/heads/' || segment AS ref_name, max(seq) AS tip_seq
        FROM commit_seq GROUP BY repository_id, segment""",
    "refs": """
        SELECT t.repository_id, t.ref_name, s.commit_hash
        FROM ref_tip t JOIN commit_seq s ON t.repository_id = s.repository_id AND t.tip_seq = s.seq""",
    "ref_commits": """
        SELECT t.repository_id, s.commit_hash, t.ref_name, CAST(t.tip_seq - s.seq AS BIGINT) AS history_index
        FROM ref_tip t JOIN commit_seq s ON t.repository_id = s.repository_id AND s.seq <= t.tip_seq""",
    "contents": """
        SELECT md5('blob-' || CAST(doc_id AS VARCHAR)) AS blob_hash,
               CASE WHEN doc_id > 1 AND doc_id % 6 = 0 THEN
                 'def f(s):' || chr(10) || '    return [' || callee || '(w_' ||
                 regexp_replace(
                   regexp_replace(text, '[^A-Za-z\\n]+', '), ' || callee || '(w_', 'g'), '\\n+',
                   ')]' || chr(10) || 'def f(s):' || chr(10) || '    return [' || callee || '(w_', 'g') ||
                 ')]' || chr(10)
               ELSE text END AS blob_content
        FROM (SELECT *, CASE WHEN doc_id % 12 = 6 THEN 'trim' ELSE 'strip' END AS callee FROM documents) d
        UNION ALL
        SELECT md5('page-' || CAST(page_id AS VARCHAR)), html FROM pages
        UNION ALL
        SELECT md5('event-' || CAST(event_id AS VARCHAR)), props FROM events""",
    "order_files": """
        SELECT l.o_orderkey, md5('blob-' || CAST(d.doc_id AS VARCHAR)) AS blob_hash,
               CASE WHEN d.doc_id = 0 THEN 'LICENSE' WHEN d.doc_id = 1 THEN 'README.md'
                    ELSE 'src/' || d.source || '/f' || CAST(d.doc_id AS VARCHAR) ||
                         CASE d.doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js'
                                           WHEN 3 THEN '.rb' WHEN 4 THEN '.go' ELSE '.bash' END
               END AS file_path
        FROM (SELECT DISTINCT l_orderkey AS o_orderkey,
                     l_partkey % (SELECT count(*) FROM documents) AS doc_id FROM lineitem) l
        JOIN documents d ON d.doc_id = l.doc_id
        UNION ALL
        SELECT o_orderkey, md5('page-' || CAST(n AS VARCHAR)), 'site/p' || CAST(n AS VARCHAR) || '.html'
        FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM pages) AS n FROM orders) p
        UNION ALL
        SELECT o_orderkey, md5('event-' || CAST(n AS VARCHAR)), 'data/e' || CAST(n AS VARCHAR) || '.json'
        FROM (SELECT o_orderkey, o_orderkey % (SELECT count(*) FROM events) AS n FROM orders) e""",
    "commit_files": """
        SELECT s.repository_id, s.commit_hash, f.file_path, f.blob_hash,
               md5('tree-' || CAST(s.o_orderkey AS VARCHAR)) AS tree_hash
        FROM order_files f JOIN commit_seq s ON f.o_orderkey = s.o_orderkey""",
    "files": """
        SELECT f.repository_id, f.file_path, f.blob_hash, f.tree_hash, b.blob_content,
               CAST(strlen(b.blob_content) AS BIGINT) AS blob_size
        FROM (SELECT DISTINCT repository_id, file_path, blob_hash, tree_hash FROM commit_files) f
        JOIN contents b ON f.blob_hash = b.blob_hash""",
    "blobs": """
        SELECT f.repository_id, f.blob_hash, CAST(strlen(b.blob_content) AS BIGINT) AS blob_size,
               b.blob_content
        FROM (SELECT DISTINCT repository_id, blob_hash FROM commit_files) f
        JOIN contents b ON f.blob_hash = b.blob_hash""",
    "commit_blobs": "SELECT DISTINCT repository_id, commit_hash, blob_hash FROM commit_files",
    "commit_trees": "SELECT repository_id, commit_hash, tree_hash FROM commits",
    "tree_entries": """
        SELECT DISTINCT repository_id, tree_hash, blob_hash, file_path AS tree_entry_name,
               '100644' AS tree_entry_mode
        FROM commit_files""",
    "remotes": """
        SELECT repository_id, 'origin' AS remote_name,
               'https://example.com/' || repository_id || '.git' AS remote_url
        FROM repositories""",
    "languages": """
        SELECT *, CASE WHEN file_path = 'LICENSE' THEN 'Text'
                       WHEN file_path LIKE '%.md' THEN 'Markdown'
                       WHEN file_path LIKE '%.py' THEN 'Python'
                       WHEN file_path LIKE '%.java' THEN 'Java'
                       WHEN file_path LIKE '%.js' THEN 'JavaScript'
                       WHEN file_path LIKE '%.rb' THEN 'Ruby'
                       WHEN file_path LIKE '%.go' THEN 'Go'
                       WHEN file_path LIKE '%.bash' THEN 'Shell'
                       WHEN file_path LIKE '%.html' THEN 'HTML'
                       WHEN file_path LIKE '%.json' THEN 'JSON' END AS language
        FROM commit_files""",
    "python_source": """
        SELECT md5('blob-' || CAST(doc_id AS VARCHAR)) AS blob_hash, doc_id % 12 = 6 AS trims,
               CAST(len(regexp_extract_all(text, '\\n+')) AS BIGINT) + 1 AS functions,
               CAST(len(regexp_extract_all(text, '[^A-Za-z\\n]+')) +
                    len(regexp_extract_all(text, '\\n+')) AS BIGINT) + 1 AS calls
        FROM documents WHERE doc_id > 1 AND doc_id % 6 = 0""",
    # JSON of the calls and functions of each Python blob, from the words and lines of its text.
    "python_calls": """
        SELECT blob_hash, i, j, callee,
               '{"@type":"Identifier","@role":["Identifier","Expression"],"@token":"' || callee || '",' || pos ||
               ',"attrs":{"Name":"' || callee || '"},"children":[]}' AS callee_node,
               '{"@type":"Identifier","@role":["Identifier","Expression"],"@token":"w_' || word || '",' || pos ||
               ',"attrs":{"Name":"w_' || word || '"},"children":[]}' AS argument_node, pos
        FROM (
          SELECT blob_hash, callee, i, unnest(words) AS word, unnest(generate_series(1, len(words))) AS j,
                 '"@pos":{"start":' || CAST(2 * i AS VARCHAR) || ',"end":' || CAST(2 * i AS VARCHAR) || '}' AS pos
          FROM (
            SELECT blob_hash, callee, i, string_split_regex(line, '[^A-Za-z]+') AS words
            FROM (
              SELECT md5('blob-' || CAST(doc_id AS VARCHAR)) AS blob_hash,
                     CASE WHEN doc_id % 12 = 6 THEN 'trim' ELSE 'strip' END AS callee,
                     unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i
              FROM (SELECT doc_id, string_split_regex(text, '\\n+') AS lines FROM documents
                    WHERE doc_id > 1 AND doc_id % 6 = 0) d) l) w) c""",
    "python_functions": """
        SELECT blob_hash, i,
               '{"@type":"FunctionGroup","@role":["Function","Declaration"],"@pos":{"start":' ||
               CAST(2 * i - 1 AS VARCHAR) || ',"end":' || CAST(2 * i AS VARCHAR) ||
               '},"attrs":{"Name":"f"},"children":[{"@type":"Identifier","@role":["Identifier","Name"],"@token":"f",' ||
               head || ',"attrs":{"Name":"f"},"children":[]},{"@type":"arguments","attrs":{},"children":[' ||
               '{"@type":"Argument","@role":["Argument"],' || head || ',"attrs":{"Name":"s"},"children":[]}]},' ||
               '{"@type":"Return","@role":["Return","Statement"],' || pos || ',"attrs":{},"children":[' ||
               '{"@type":"List",' || pos || ',"attrs":{},"children":[' || calls || ']}]}]}' AS function
        FROM (
          SELECT blob_hash, i, pos, string_agg(
                   '{"@type":"Call","@role":["Call","Expression"],' || pos || ',"attrs":{},"children":[' ||
                   '{"@type":"QualifiedIdentifier","@role":["Identifier","Expression","Callee"],' || pos ||
                   ',"attrs":{},"children":[' || callee_node || ']},' || argument_node || ']}', ',' ORDER BY j) AS calls,
                 '"@pos":{"start":' || CAST(2 * i - 1 AS VARCHAR) || ',"end":' || CAST(2 * i - 1 AS VARCHAR) || '}' AS head
          FROM python_calls GROUP BY blob_hash, i, pos) c""",
    "python_trees": """
        SELECT blob_hash, '[' || string_agg(function, ',' ORDER BY i) || ']' AS functions
        FROM python_functions GROUP BY blob_hash""",
    "trim_calls": """
        SELECT blob_hash, '[' || string_agg(callee_node, ',' ORDER BY i, j) || ']' AS calls
        FROM python_calls WHERE callee = 'trim' GROUP BY blob_hash""",
}

WITH_TABLES = "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + "\n"
