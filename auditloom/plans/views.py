"""Input views over the given tables, as SQL that Spark and DuckDB both run.

Every view keeps all rows and whole texts of its tables; attributes such as
"ignored" or "changed" come from columns of the data (labels, language).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _path(doc: str) -> str:
    return (
        f"'repo/' || CASE {doc} % 8 WHEN 0 THEN 'build' WHEN 1 THEN 'src/net' WHEN 2 THEN 'src/core' "
        "WHEN 3 THEN 'include' WHEN 4 THEN 'node_modules/x' WHEN 5 THEN 'lib' WHEN 6 THEN 'docs' "
        f"ELSE 'src' END || '/f' || CAST({doc} AS VARCHAR(20)) || CASE {doc} % 7 WHEN 0 THEN '.c' "
        "WHEN 1 THEN '.H' WHEN 2 THEN '.go' WHEN 3 THEN '.md' WHEN 4 THEN '.py' WHEN 5 THEN '.h' "
        "ELSE '.tar.RS' END"
    )


def _json(text: str) -> str:
    """The text as the inside of a JSON string."""
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for code, escaped in ((34, "chr(92) || chr(34)"), (10, "chr(92) || 'n'"), (13, "chr(92) || 'r'"), (9, "chr(92) || 't'")):
        out = f"replace({out}, chr({code}), {escaped})"
    return out


FENCE = "chr(96) || chr(96) || chr(96)"
NL = "chr(10)"

VIEWS = {
    "source_files": f"""
SELECT source AS run_id, doc_id AS file_id, {_path('doc_id')} AS path,
  CASE WHEN doc_id % 29 = 0 THEN text || chr(0) ELSE text END AS content
FROM documents""",
    "runs": "SELECT DISTINCT source AS run_id FROM documents UNION ALL SELECT 'empty' AS run_id",
    "ignored_paths": """
SELECT s.run_id, s.path FROM source_files s JOIN labels l ON s.file_id = l.doc_id WHERE l.quality = 0""",
    "base_files": """
SELECT s.run_id,
  CASE WHEN l.toxic = 1 THEN 'repo/old/f' || CAST(s.file_id AS VARCHAR(20)) || '.c' ELSE s.path END AS path,
  CASE WHEN l.quality = 0 THEN s.content || 'x' ELSE s.content END AS content
FROM source_files s JOIN labels l ON s.file_id = l.doc_id""",
    "changed_paths": f"""
SELECT source AS run_id, CASE lang WHEN 'en' THEN {_path('doc_id')} WHEN 'fr' THEN '/work/' || {_path('doc_id')}
  WHEN 'de' THEN './' || {_path('doc_id')} ELSE '' END AS path FROM documents
UNION ALL SELECT run_id, '/work/' || path FROM base_files""",
    "changed_roots": """
SELECT DISTINCT source AS run_id, '/work/repo/src' AS root FROM documents
UNION ALL SELECT DISTINCT source AS run_id, '/work/repo/lib' AS root FROM documents
UNION ALL SELECT DISTINCT source AS run_id, '/work/repo/src/net' AS root FROM documents""",
    "ignore_rules": """
SELECT d.source AS run_id, CASE d.doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'repo' ELSE 'repo/src' END AS folder, d.doc_id AS line,
  CASE d.doc_id % 8 WHEN 0 THEN '*' || CAST(d.doc_id % 10 AS VARCHAR(20)) || '.c' WHEN 1 THEN '/src/net/' WHEN 2 THEN '!f*[13].?'
    WHEN 3 THEN '# f1.c' WHEN 4 THEN 'core/f?' || CAST(d.doc_id % 10 AS VARCHAR(20)) || '.*  ' WHEN 5 THEN '**/docs/**'
    WHEN 6 THEN 'lib' ELSE '!src/**/f*' || CAST(d.doc_id % 10 AS VARCHAR(20)) || '.go' END AS rule
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1""",
    "reports": f"""
SELECT d.source AS run_id, d.doc_id AS file_id, {_path('d.doc_id')} AS display_name,
  CASE WHEN l.toxic = 1 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN l.toxic = 1 THEN 'api 500: no answer for ' || {_path('d.doc_id')} ELSE '' END AS error,
  CASE d.doc_id % 8
  WHEN 0 THEN '>>> HIGH: Stack overflow | ' || d.text || {NL} || '>>> low: Minor leak'
  WHEN 1 THEN d.text || {NL} || {FENCE} || 'json' || {NL}
    || '[{{"severity":"critical","title":"Bad memcpy","function":"f' || CAST(d.doc_id AS VARCHAR(20))
    || '()","description":"' || {_json('d.text')} || '","fix":"check len"}},{{"severity":"clean","title":"ok"}},5,{{"severity":"odd","title":" ","description":7}}]'
    || {NL} || {FENCE}
  WHEN 2 THEN '## [HIGH] Unchecked length in parser' || {NL} || d.text || {NL}
    || '## Summary' || {NL} || 'overflow' || {NL} || '### helper() leak' || {NL} || '#### Other place' || {NL} || d.text
  WHEN 3 THEN 'One medium concern remains in this file.' || {NL} || d.text
  WHEN 4 THEN '[' || {NL} || '  1: {{"severity":"critical","title":"A","description":"' || {_json('d.text')} || ' ' || chr(92) || 'q"}},' || {NL}
    || '  2: {{"severity":"low","title":"B","description":"y"}}' || {NL} || ']'
  WHEN 5 THEN '# Critical overflow' || {NL} || 'writes past buf[64] here' || {NL} || d.text
  WHEN 6 THEN '{{"findings":[{{"severity":"informational","title":"Note","description":"' || {_json('d.text')} || '"}}]}}'
  ELSE d.text END AS report
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "contexts": f"""
SELECT d.source AS run_id, d.doc_id AS file_id,
  'Briefing for ' || {_path('d.doc_id')} || {NL} || d.text AS content,
  CAST(d.n_chars AS INT) AS prompt_tokens, CAST(12 AS INT) AS completion_tokens,
  CAST(d.n_chars + 12 AS INT) AS total_tokens, coalesce(e.value, CAST(0 AS DOUBLE)) AS elapsed_s,
  CASE WHEN e.event_type = 'error' THEN 'api 429: slow down' END AS error
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id""",
    "scans": """
SELECT r.run_id, r.file_id, r.report AS content,
  CAST(length(r.report) AS INT) AS prompt_tokens, CAST(34 AS INT) AS completion_tokens,
  CAST(length(r.report) + 34 AS INT) AS total_tokens,
  CAST(length(r.report) AS DOUBLE) / CAST(64 AS DOUBLE) AS elapsed_s,
  CASE WHEN r.status = 'error' THEN r.error END AS error
FROM reports r""",
    "triage_findings": f"""
SELECT DISTINCT coalesce(d.source, 'none') AS run_id, c.conv_id AS finding_id, {_path('c.conv_id')} AS file,
  'Finding ' || CAST(c.conv_id AS VARCHAR(20)) || ' in /x y' AS title,
  CASE c.conv_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low'
    ELSE 'informational' END AS severity,
  CASE WHEN d.lang = 'en' THEN 'Reported while reading ' || {_path('c.conv_id')} ELSE '' END AS description,
  CASE WHEN c.conv_id % 3 = 0 THEN '' ELSE 'Body of ' || CAST(c.conv_id AS VARCHAR(20)) END AS body
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id""",
    "rounds": f"""
SELECT coalesce(d.source, 'none') AS run_id, c.conv_id AS finding_id, CAST(c.turn + 1 AS INT) AS round_no,
  CASE (c.conv_id * 7 + c.turn * 3) % 10 WHEN 0 THEN 'INVALID' WHEN 1 THEN 'INVALID' WHEN 2 THEN 'UNCERTAIN'
    WHEN 3 THEN 'ERROR' ELSE 'VALID' END AS verdict,
  c.text || {NL} || 'GREP: ' || split_part(c.text, ' ', 2) || '|' || split_part(c.text, ' ', 3) || ' '
    || split_part(c.text, ' ', 4) || {NL} || 'please grep for "' || split_part(c.text, ' ', 1) || '"' AS reasoning
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id""",
    "last_rounds": """
SELECT run_id, finding_id, max(round_no) AS last_round FROM rounds GROUP BY run_id, finding_id""",
    "round_responses": f"""
SELECT coalesce(d.source, 'none') AS run_id, c.conv_id AS finding_id, CAST(c.turn + 1 AS INT) AS round_no,
  CASE c.role WHEN 'user' THEN
    '{{"verdict":"' || CASE WHEN c.turn % 3 = 0 THEN 'valid' WHEN c.turn % 3 = 1 THEN 'Invalid' ELSE 'maybe' END
    || '","reasoning":"' || {_json('c.text')} || '","crux":"' || {_json("split_part(c.text, ' ', 1)")}
    || '","grep":"GREP: ' || chr(96) || {_json("split_part(c.text, ' ', 2)")} || chr(96) || '"}}'
  WHEN 'assistant' THEN CASE WHEN c.turn % 4 = 1 THEN ' Valid: ' ELSE 'invalid since ' END || c.text
  ELSE 'I looked.' || {NL} || '{{"verdict":"UNCERTAIN","reasoning":" ","crux":5}} done' END AS content,
  CASE WHEN (c.conv_id + c.turn) % 9 = 4 THEN 'api 503: busy' END AS error,
  CAST(length(c.text) AS INT) AS total_tokens, CAST(length(c.text) AS DOUBLE) / CAST(64 AS DOUBLE) AS elapsed_s
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id""",
    "call_log": """
SELECT event_id AS call_id, event_id - event_id % 3 AS request_id, ts, value AS elapsed_s,
  CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 WHEN 'click' THEN 400 ELSE 200 END AS status_code,
  CASE WHEN event_type = 'error' AND value < 20 THEN 'insufficient_quota'
    WHEN event_type = 'error' THEN 'Rate limit reached for requests per min'
    WHEN event_type = 'view' AND value < 5 THEN 'Too Many Requests' ELSE props END AS body
FROM events""",
    "wire": """
SELECT event_id AS call_id, CASE event_type
  WHEN 'error' THEN '{"error":{"message":"' || user_id || '"}}'
  WHEN 'signup' THEN '{"choices":[],"usage":{"total_tokens":3}}'
  WHEN 'click' THEN '{"choices":[{"message":{"content":"","reasoning_content":"why ' || user_id || '"}}],"error":null}'
  WHEN 'view' THEN '{"choices":[{"message":{"content":"answer ' || event_id || '"}},{"message":{"content":"second"}}],"usage":{"prompt_tokens":'
    || user_id || ',"completion_tokens":7,"total_tokens":' || (user_id + 7) || '}}'
  ELSE '{"choices":[{"message' END AS body
FROM events""",
}


def depends(name: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Views and tables a view needs, in definition order, itself last."""
    seen: set[str] = set()

    def visit(item: str) -> None:
        if item in seen:
            return
        seen.add(item)
        words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", views.get(item, "")))
        for word in words:
            if word in views or word in TABLES:
                visit(word)

    visit(name)
    return [t for t in TABLES if t in seen] + [v for v in views if v in seen]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    if "documents" not in depends(name):
        return view_over(spark, sf_dir, name, {})
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return view_over(spark, sf_dir, name, {"documents": documents})


def view_over(spark: SparkSession, sf_dir: str, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A view with some tables replaced by given frames, e.g. streams."""
    prepare(spark)
    ctes = []
    for item in depends(name):
        if item in tables:
            body = f"SELECT * FROM {{{item}}}"
        else:
            body = VIEWS.get(item) or f"SELECT * FROM parquet.`{sf_dir}/{item}.parquet`"
            if tables:  # the text is a format string only when frames are passed
                body = body.replace("{", "{{").replace("}", "}}")
        ctes.append(f"{item} AS ({body})")
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}", **tables)
