"""The DuckDB counterpart of every query that plain SQL can express.

``STEPS`` are named intermediate results on top of the shared views; each query's
text is its final SELECT with the steps it needs in front.
"""

from __future__ import annotations

from ..functions import fixed
from .registry import (
    ARBITER_TEMPLATE,
    CONTEXT_HEADING,
    EARLIER_REVIEWS,
    EXAMPLE,
    MAX_BYTES,
    MODEL,
    PROJECT,
    ROUND_TEMPLATE,
    SCAN_SYSTEM,
    STAMP,
    SYSTEM,
    USER_TEMPLATE,
)
from .views import VIEWS, depends

NL = "chr(10)"
NUL = "chr(0)"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
QUOTES = "chr(96) || chr(34) || chr(39)"
FENCE3 = "'```'"


def lit(text: str) -> str:
    """A text literal, line ends spelled out."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def words(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def trim(x: str) -> str:
    return f"trim({x}, {SPACE})"


def norm(x: str) -> str:
    known = words((*fixed.SEVERITIES, fixed.CLEAN))
    return f"CASE WHEN lower({trim(x)}) IN ({known}) THEN lower({trim(x)}) ELSE 'medium' END"


def rank(x: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(fixed.SEVERITIES))
    return f"CASE {x} {cases} ELSE 5 END"


def prefix(x: str, n: int) -> str:
    """First n bytes, whole characters only."""

    def inside(pos: int) -> str:
        return f"substr(hex({x}), {2 * pos - 1}, 1) IN ('8', '9', 'A', 'B')"

    cut = (
        f"CASE WHEN NOT {inside(n + 1)} THEN {n} WHEN NOT {inside(n)} THEN {n - 1} "
        f"WHEN NOT {inside(n - 1)} THEN {n - 2} ELSE {n - 3} END"
    )
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} ELSE decode(unhex(substr(hex({x}), 1, 2 * ({cut})))) END"


def shorten(x: str, n: int) -> str:
    t = trim(x)
    return (
        f"CASE WHEN length({t}) <= {n} THEN {t} ELSE {trim(f'left({t}, {n - 15})')} || {NL} || {NL} "
        f"|| '_[truncated]_' END"
    )


def slug(x: str) -> str:
    s = rf"trim(regexp_replace(replace(replace({x}, '/', '_'), chr(92), '_'), '[^\w.\-]+', '_', 'g'), '_')"
    return f"CASE WHEN {s} = '' THEN 'unnamed' ELSE left({s}, 120) END"


def field(x: str, key: str) -> str:
    return (
        f"CASE WHEN json_type({x}, '$.{key}') = 'VARCHAR' AND {trim(f'json_extract_string({x}, ' + repr('$.' + key) + ')')} <> '' "
        f"THEN json_extract_string({x}, '$.{key}') END"
    )


def first_of(items: str) -> str:
    """Distinct list elements in first-seen order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def lines(x: str) -> str:
    return f"CAST(strlen({x}) - strlen(replace({x}, chr(10), '')) AS INTEGER)"


def percent(x: str) -> str:
    return f"CAST(CAST(round({x} * 100) AS INTEGER) AS VARCHAR) || '%'"


def template(text: str, *args: str) -> str:
    """``text`` with its %s and %d filled by SQL expressions."""
    import re

    parts = re.split("%[sd]", text)
    out = lit(parts[0])
    for arg, part in zip(args, parts[1:]):
        out += f" || CAST({arg} AS VARCHAR) || {lit(part)}"
    return out


EXT = r"lower(regexp_extract(path, '(\.[^./]*)$', 1))"
EXTS = words(fixed.EXTENSIONS)
DIRS = r"regexp_matches(path, '(?:^|/)(?:\.git|node_modules|target|dist|build)/')"
MARKER = r"'(?im-s)^>>>\s*(CRITICAL|HIGH|MEDIUM|LOW)\s*:\s*(.+)'"
FENCED = r"'(?s)```(?:json)?\s*\n?(.*?)```'"
SEVWORD = r"'(?i)\b(critical|high|medium|low|informational)\b'"
BUG = "'" + fixed.BUG_KEYWORD.replace(fixed.WORD_END, r"\b") + "'"
JUNK = "'" + fixed.JUNK_TITLE.replace(fixed.WORD_END, r"\b") + "'"
HEAD = r"'(?im-s)^#{1,4}\s+(.+)'"
VALID_SHARE = "floor(count(*) FILTER (WHERE verdict = 'VALID')::DOUBLE / count(*) * 100 + 0.5) / 100"
FIVE = ", ".join(fixed.SEVERITIES)

STEPS = {
    **VIEWS,
    # ---- corpus
    "measured": f"""
SELECT run_id, path, {lines('content')} AS lines, CASE
  WHEN NOT {EXT} IN ({EXTS}) THEN 'extension'
  WHEN strlen(content) > {MAX_BYTES} THEN 'too large (' || CAST(strlen(content) AS VARCHAR) || ' bytes)'
  WHEN contains(content, {NUL}) THEN 'binary' END AS other
FROM source_files WHERE NOT {DIRS}""",
    "whole_tree": """
SELECT run_id, path, content FROM source_files
UNION ALL SELECT run_id, 'repo/.github/_f' || file_id || '.c', content FROM source_files WHERE file_id % 5 = 0
UNION ALL SELECT run_id, 'apart/single.c', content FROM source_files s WHERE file_id = (SELECT min(file_id) FROM source_files m WHERE m.run_id = s.run_id)""",
    "tree": f"""
SELECT run_id, path, content FROM source_files WHERE NOT {DIRS}
UNION ALL SELECT run_id, 'repo/.github/_f' || file_id || '.c', content FROM source_files WHERE file_id % 5 = 0
UNION ALL SELECT run_id, 'apart/single.c', content FROM source_files s WHERE file_id = (SELECT min(file_id) FROM source_files m WHERE m.run_id = s.run_id)""",
    "rule_patterns": """
SELECT run_id, folder, line, kind IN (2, 7) AS taken_back, kind = 1 AS only_dirs, CASE kind WHEN 0 THEN '^(.*/)?[^/]*' || n || '[.]c$'
  WHEN 1 THEN '^src/net$' WHEN 2 THEN '^(.*/)?f[^/]*[13][.][^/]$' WHEN 4 THEN '^core/f[^/]' || n || '[.][^/]*$'
  WHEN 5 THEN '^(.*/)?docs/.+$' WHEN 6 THEN '^(.*/)?lib$' ELSE '^src/(.*/)?f[^/]*' || n || '[.]go$' END AS pattern
FROM (SELECT *, line % 8 AS kind, line % 10 AS n FROM ignore_rules) WHERE kind <> 3""",
    "path_heads": """
SELECT run_id, path, array_to_string(parts[1:k], '/') AS head, k < len(parts) AS is_dir, k FROM (
  SELECT run_id, path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM source_files)""",
    "judged_heads": """
SELECT h.run_id, h.path, h.head, arg_max(r.taken_back, (len(r.folder), r.line)) AS taken_back FROM path_heads h JOIN rule_patterns r
  ON r.run_id = h.run_id AND (r.folder = '' OR starts_with(h.head, r.folder || '/')) AND (h.is_dir OR NOT r.only_dirs)
  AND regexp_matches(CASE WHEN r.folder = '' THEN h.head ELSE substr(h.head, len(r.folder) + 2) END, r.pattern)
GROUP BY h.run_id, h.path, h.head""",
    "classified": """
SELECT m.run_id, m.path, m.lines, CASE WHEN i.path IS NOT NULL THEN 'gitignore' ELSE m.other END AS reason
FROM measured m LEFT JOIN ignored_paths i ON m.run_id = i.run_id AND m.path = i.path""",
    "totals": """
SELECT r.run_id, coalesce(files, 0) AS files, coalesce(skipped, 0) AS skipped, coalesce(total_lines, 0) AS total_lines
FROM runs r LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE reason IS NULL)::BIGINT AS files, count(*) FILTER (WHERE reason IS NOT NULL)::BIGINT AS skipped,
  sum(CASE WHEN reason IS NULL THEN lines END)::BIGINT AS total_lines FROM classified GROUP BY run_id) c ON r.run_id = c.run_id""",
    "split_lines": """
SELECT run_id, path, unnest(parts) AS raw, generate_subscripts(parts, 1)::INTEGER AS line FROM (
  SELECT run_id, path, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1)
    ELSE content END, chr(10)) AS parts FROM source_files WHERE content <> '')""",
    "all_lines": """
SELECT run_id, path, line, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS text
FROM split_lines""",
    "searchable": f"""
SELECT l.* FROM all_lines l
  JOIN (SELECT run_id, path FROM source_files WHERE NOT contains(content, {NUL})) t ON l.run_id = t.run_id AND l.path = t.path
  LEFT JOIN ignored_paths i ON l.run_id = i.run_id AND l.path = i.path WHERE i.path IS NULL""",
    # ---- findings
    "parsed": f"""
SELECT *, regexp_matches(report, {MARKER}) AS marked,
  CASE WHEN regexp_matches({trim('report')}, {FENCED}) THEN {trim(f'regexp_extract({trim("report")}, {FENCED}, 1)')}
    ELSE {trim('report')} END AS cand FROM reports""",
    "repaired": rf"""
SELECT *, regexp_replace(CASE WHEN NOT starts_with(s2, '[') AND contains(s2, '{{') THEN '[' || s2 ELSE s2 END,
  '\\([^"\\/bfnrtu])', '\\\\\1', 'g') AS num FROM (
  SELECT *, {trim("CASE WHEN starts_with(s1, '[,') THEN substr(s1, 3) ELSE s1 END")} AS s2 FROM (
    SELECT *, {trim(r"regexp_replace(cand, ',?\s*\d+\s*:\s*\{', ', {', 'g')")} AS s1,
      regexp_extract(cand, '\[[^\[\]]*\]') AS chunk,
      regexp_matches(cand, '^(true|false|null|-?[0-9]+[^.eE0-9]|-?[0-9]+$|"[^"\\]*")') AS scalar FROM parsed))""",
    "decoded": """
SELECT *, CASE WHEN json_valid(cand) THEN 'whole' WHEN scalar THEN 'scalar'
    WHEN contains(cand, '"severity"') AND json_valid(num) THEN 'numbered'
    WHEN chunk <> '' AND json_valid(chunk) THEN 'array' END AS json_from,
  CASE WHEN json_valid(cand) THEN cand WHEN scalar THEN NULL
    WHEN contains(cand, '"severity"') AND json_valid(num) THEN num
    WHEN chunk <> '' AND json_valid(chunk) THEN chunk END AS j
FROM repaired""",
    "valued": """
SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]')
  WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.severity') THEN [CAST(j AS JSON)]
  WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.findings') = 'ARRAY' THEN json_extract(j, '$.findings[*]') END AS vals
FROM decoded""",
    "marker_rows": f"""
SELECT run_id, file_id, pos, {norm('s')} AS severity, {trim("split_part(t, '|', 1)")} AS title, '' AS function,
  '' AS description, {trim('t')} AS body FROM (
  SELECT run_id, file_id, unnest(regexp_extract_all(report, {MARKER}, 1)) AS s, unnest(regexp_extract_all(report, {MARKER}, 2)) AS t,
    generate_subscripts(regexp_extract_all(report, {MARKER}, 1), 1)::INTEGER - 1 AS pos FROM reports)""",
    "json_rows": f"""
SELECT run_id, file_id, marked, json_from, (row_number() OVER (PARTITION BY run_id, file_id ORDER BY idx) - 1)::INTEGER AS pos,
  severity, title, function, full_text AS description, full_text AS body FROM (
  SELECT run_id, file_id, marked, json_from, idx, {norm(f"coalesce({field('v', 'severity')}, 'medium')")} AS severity,
    coalesce({field('v', 'title')}, 'Untitled finding') AS title, coalesce({field('v', 'function')}, '') AS function,
    coalesce({field('v', 'description')}, '') || coalesce({NL} || {NL} || 'Fix: ' || {field('v', 'fix')}, '') AS full_text
  FROM (SELECT run_id, file_id, marked, json_from, unnest(vals) AS v, generate_subscripts(vals, 1) AS idx FROM valued)
  WHERE json_type(v) = 'OBJECT') WHERE severity <> 'clean'""",
    "sections": rf"""
SELECT run_id, file_id, unnest(parts) AS section, generate_subscripts(parts, 1) AS idx FROM (
  SELECT run_id, file_id, string_split(regexp_replace(report, '(?im-s)^(#{{1,4}}\s+.+)', chr(1) || '\1', 'g'), chr(1))[2:] AS parts FROM reports)""",
    "heading_rows": rf"""
SELECT run_id, file_id, (row_number() OVER (PARTITION BY run_id, file_id ORDER BY idx) - 1)::INTEGER AS pos,
  CASE WHEN regexp_extract(body, {SEVWORD}, 1) = '' THEN 'medium' ELSE lower(regexp_extract(body, {SEVWORD}, 1)) END AS severity,
  title, '' AS function, '' AS description, body FROM (
  SELECT run_id, file_id, idx, {trim('section')} AS body,
    {trim(r"regexp_replace(regexp_replace(trim(" + trim(f"regexp_extract(section, {HEAD}, 1)") + r", '* '), '(?i)^severity\s*[:/]\s*', ''), '(?i)^[\(\[]?\s*(critical|high|medium|low|informational)\s*[\)\]]?\s*[:/]?\s*', '')")} AS title
  FROM sections)
WHERE title <> '' AND NOT regexp_matches(title, {JUNK}) AND NOT regexp_matches(title, '(?i)^[`\s]*\w+[\w_]*\s*[\(/]')
  AND (regexp_matches(title, {BUG}) OR regexp_matches({prefix('body', 300)}, {BUG}))""",
    "word_rows": f"""
SELECT run_id, file_id, 0 AS pos, lower(regexp_extract(report, {SEVWORD}, 1)) AS severity, 'Unstructured finding' AS title,
  '' AS function, '' AS description, {trim('report')} AS body
FROM reports WHERE regexp_matches(report, {SEVWORD})""",
    "tiers": """
SELECT v.run_id, v.file_id, v.display_name, v.status, CASE WHEN v.marked THEN 'marker' WHEN v.vals IS NOT NULL THEN 'json'
  WHEN h.file_id IS NOT NULL THEN 'heading' WHEN w.file_id IS NOT NULL THEN 'unstructured' ELSE 'none' END AS tier
FROM valued v LEFT JOIN (SELECT DISTINCT run_id, file_id FROM heading_rows) h ON v.run_id = h.run_id AND v.file_id = h.file_id
  LEFT JOIN word_rows w ON v.run_id = w.run_id AND v.file_id = w.file_id""",
    "tier_rows": """
SELECT 'marker' AS tier, run_id, file_id, pos, severity, title, function, description, body FROM marker_rows
UNION ALL SELECT 'json', run_id, file_id, pos, severity, title, function, description, body FROM json_rows WHERE NOT marked
UNION ALL SELECT 'heading', run_id, file_id, pos, severity, title, function, description, body FROM heading_rows
UNION ALL SELECT 'unstructured', run_id, file_id, pos, severity, title, function, description, body FROM word_rows""",
    "all_findings": """
SELECT t.run_id, t.file_id, t.display_name, t.status, t.tier, f.pos, f.severity, f.title, f.function, f.description, f.body
FROM tiers t JOIN tier_rows f ON t.run_id = f.run_id AND t.file_id = f.file_id AND t.tier = f.tier""",
    "findings": "SELECT * EXCLUDE (status) FROM all_findings WHERE status = 'ok'",
    "counts": f"""
SELECT r.run_id, r.file_id, r.display_name, r.status, r.error, {', '.join(f"count(*) FILTER (WHERE f.severity = '{s}')::INTEGER AS {s}" for s in fixed.SEVERITIES)}
FROM reports r LEFT JOIN findings f ON r.run_id = f.run_id AND r.file_id = f.file_id GROUP BY ALL""",
    "results": f"""
SELECT c.*, {lines('s.content')} AS lines FROM counts c JOIN source_files s ON c.run_id = s.run_id AND c.file_id = s.file_id""",
    # ---- evidence
    "raw_requests": rf"""
SELECT run_id, finding_id, round_no, list_filter(list_transform(list_concat(
    regexp_extract_all(reasoning, '(?i-s)GREP:\s*(.+)', 1),
    regexp_extract_all(reasoning, '(?i)grep\s+(?:for\s+)?[`"]([^`"]+)[`"]', 1),
    list_filter(regexp_extract_all(reasoning, '(?i)grep\s+(?:for\s+)?(\w[\w_:.*]+\(?)', 1), lambda x: strlen(x) > 6)),
  lambda x: trim({trim('x')}, {QUOTES})), lambda x: x <> '') AS raw FROM rounds""",
    "requests": f"""
SELECT run_id, finding_id, round_no, flatten(list_transform({first_of('raw')}[1:3], lambda x: string_split(x, '|'))) AS items
FROM raw_requests""",
    "cleaned_a": rf"""
SELECT run_id, finding_id, round_no, list_filter(list_transform(list_transform(list_transform(items,
    lambda x: trim({trim('x')}, {QUOTES})), lambda x: regexp_replace(x, '\\[bBdDwWsS]', '', 'g')),
    lambda x: regexp_replace(x, '(?-s)\\(.)', '\1', 'g')),
  lambda x: strlen(x) >= 3 AND x NOT IN ({words(fixed.STOP_PATTERNS)})) AS items FROM requests""",
    "cleaned_b": rf"""
SELECT run_id, finding_id, round_no, list_filter(list_transform(items, lambda x:
    CASE WHEN regexp_matches(x, '(?-s)^[\w/\\]+\.\w+[:\s]+(.+)') THEN {trim(r"regexp_extract(x, '(?-s)^[\w/\\]+\.\w+[:\s]+(.+)', 1)")} ELSE x END),
  lambda x: NOT regexp_matches(x, '^\d+[:\s]*$')) AS items FROM cleaned_a""",
    "cleaned_c": rf"""
SELECT run_id, finding_id, round_no, list_filter(list_transform(items, lambda x: CASE WHEN contains(x, ', ') OR strlen(x) > 60 THEN
    coalesce(list_filter(list_filter(regexp_extract_all(x, '[a-zA-Z_]\w*(?:->[\w]+)*'), lambda y: strlen(y) > 5 AND y NOT IN ({words(fixed.STOP_PATTERNS)})),
      lambda y: strlen(y) = list_max(list_transform(list_filter(regexp_extract_all(x, '[a-zA-Z_]\w*(?:->[\w]+)*'),
        lambda w: strlen(w) > 5 AND w NOT IN ({words(fixed.STOP_PATTERNS)})), lambda z: strlen(z))))[1], x) ELSE x END),
  lambda x: strlen(x) >= 3 AND x NOT IN ({words(fixed.STOP_PATTERNS)})) AS items FROM cleaned_b""",
    "cleaned": f"SELECT run_id, finding_id, round_no, {first_of('items')}[1:6] AS items FROM cleaned_c",
    "patterns": """
SELECT run_id, finding_id, round_no, unnest(items) AS pattern, generate_subscripts(items, 1)::INTEGER - 1 AS pos FROM cleaned""",
    "matches": """
SELECT p.run_id, p.pattern, l.path, l.line, l.text FROM (SELECT DISTINCT run_id, pattern FROM patterns) p
JOIN searchable l ON p.run_id = l.run_id AND contains(l.text, p.pattern)""",
    "top_lines": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pattern ORDER BY contains(text, '#define') DESC,
  ends_with(path, '.h') DESC, path, line)::INTEGER AS rn FROM matches) WHERE rn <= {fixed.MAX_MATCHES}""",
    "blocks": f"""
SELECT p.run_id, p.pattern, 'GREP `' || p.pattern || '`:' || {NL} || {FENCE3} || {NL} ||
  coalesce(string_agg(t.path || ':' || CAST(t.line AS VARCHAR) || ':' || CASE WHEN strlen(replace(t.text, {NUL}, '')) > 2000
    THEN {prefix(f"replace(t.text, {NUL}, '')", 2000)} || '...' ELSE replace(t.text, {NUL}, '') END, {NL} ORDER BY t.rn), '(no matches in repo)')
  || {NL} || {FENCE3} AS block
FROM (SELECT DISTINCT run_id, pattern FROM patterns) p LEFT JOIN top_lines t ON p.run_id = t.run_id AND p.pattern = t.pattern
GROUP BY p.run_id, p.pattern""",
    "evidence": f"""
SELECT p.run_id, p.finding_id, p.round_no, string_agg(b.block, {NL} || {NL} ORDER BY p.pos) AS evidence
FROM patterns p JOIN blocks b ON p.run_id = b.run_id AND p.pattern = b.pattern GROUP BY p.run_id, p.finding_id, p.round_no""",
    "rounds_ev": """
SELECT r.*, e.evidence, e.evidence IS NOT NULL AS grep_used FROM rounds r LEFT JOIN evidence e
  ON r.run_id = e.run_id AND r.finding_id = e.finding_id AND r.round_no = e.round_no""",
    "full_reviews": f"""
SELECT run_id, finding_id, round_no, CASE WHEN coalesce(evidence, '') <> '' THEN reasoning || {lit(fixed.EVIDENCE_HEADING)} || evidence
  ELSE reasoning END AS full_text FROM rounds_ev""",
    "cut_reviews": f"""
SELECT *, position({NL} || {NL} || '[GREP RESULTS' IN full_text) AS start_at FROM full_reviews""",
    "review_lines": f"""
SELECT run_id, finding_id, round_no, {trim('piece')} AS piece, idx FROM (
  SELECT run_id, finding_id, round_no, unnest(string_split(substr(full_text, start_at), {NL})) AS piece,
    generate_subscripts(string_split(substr(full_text, start_at), {NL}), 1) AS idx FROM cut_reviews WHERE start_at > 0)""",
    "told_lines": """
SELECT *, sum(keep) OVER (PARTITION BY run_id, finding_id, round_no ORDER BY idx ROWS UNBOUNDED PRECEDING) AS upto FROM (
  SELECT *, contains(piece, '(no matches') AS missing,
    CASE WHEN contains(piece, '(no matches') OR contains(piece, ':') THEN 1 ELSE 0 END AS keep FROM review_lines
  WHERE piece <> '' AND NOT starts_with(piece, '```') AND NOT starts_with(piece, 'GREP `'))""",
    "stops": """
SELECT run_id, finding_id, round_no, min(idx) AS stop FROM told_lines WHERE NOT missing AND upto >= 6
GROUP BY run_id, finding_id, round_no""",
    "condensed_lines": f"""
SELECT t.run_id, t.finding_id, t.round_no, string_agg('- ' || t.piece, {NL} ORDER BY t.idx) AS short
FROM told_lines t LEFT JOIN stops s ON t.run_id = s.run_id AND t.finding_id = s.finding_id AND t.round_no = s.round_no
WHERE t.keep = 1 AND (s.stop IS NULL OR t.idx <= s.stop) GROUP BY t.run_id, t.finding_id, t.round_no""",
    "condensed": f"""
SELECT c.run_id, c.finding_id, c.round_no, c.full_text, CASE WHEN c.start_at = 0 THEN c.full_text WHEN l.short IS NULL THEN left(c.full_text, c.start_at - 1)
  ELSE left(c.full_text, c.start_at - 1) || {lit(fixed.CONDENSED_HEADING)} || l.short END AS condensed
FROM cut_reviews c LEFT JOIN condensed_lines l ON c.run_id = l.run_id AND c.finding_id = l.finding_id AND c.round_no = l.round_no""",
    # ---- triage
    "coded": f"""
SELECT f.*, '[' || upper(f.severity) || '] ' || f.title || {NL} || {NL} || CASE WHEN f.body <> '' THEN f.body WHEN f.description <> '' THEN f.description
    ELSE '{{"severity":"' || f.severity || '","title":"' || f.title || '","file":"' || f.file || '"}}' END AS finding_text,
  coalesce(s.content, '') AS code, coalesce(c.content, '') AS context
FROM triage_findings f LEFT JOIN source_files s ON s.run_id = f.run_id AND s.file_id = f.finding_id
  LEFT JOIN contexts c ON c.run_id = f.run_id AND c.file_id = f.finding_id""",
    "priors": f"""
SELECT r.run_id, r.finding_id, r.round_no, count(p.round_no) AS n_prior, string_agg('**Reviewer ' || CAST(p.k AS VARCHAR) || '**:' || {NL} ||
  CASE WHEN p.round_no < r.previous THEN p.condensed ELSE p.full_text END || {NL} || {NL}, '' ORDER BY p.round_no) AS told
FROM (SELECT *, lag(round_no) OVER (PARTITION BY run_id, finding_id ORDER BY round_no) AS previous FROM rounds) r
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY run_id, finding_id ORDER BY round_no) AS k FROM condensed) p
  ON p.run_id = r.run_id AND p.finding_id = r.finding_id AND p.round_no < r.round_no
GROUP BY r.run_id, r.finding_id, r.round_no""",
    "every_round": """
SELECT r.run_id, r.finding_id, r.round_no, r.verdict, r.reasoning, r.round_no = l.last_round AS is_arbiter
FROM rounds r JOIN last_rounds l ON r.run_id = l.run_id AND r.finding_id = l.finding_id
WHERE r.round_no < l.last_round OR r.verdict IN ('VALID', 'INVALID')""",
    "triage": f"""
SELECT e.run_id, e.finding_id, f.file, f.title, f.severity, arg_max(e.verdict, e.round_no) AS verdict,
  arg_max(e.reasoning, e.round_no) AS reasoning, {VALID_SHARE.replace('verdict', 'e.verdict')} AS confidence,
  string_agg(CASE WHEN e.is_arbiter THEN '->' ELSE '' END || left(e.verdict, 1), '' ORDER BY e.round_no) AS verdicts, count(*) AS n_rounds,
  f.description, f.body
FROM every_round e JOIN triage_findings f ON e.run_id = f.run_id AND e.finding_id = f.finding_id
GROUP BY e.run_id, e.finding_id, f.file, f.title, f.severity, f.description, f.body""",
    "ordered": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN verdict = 'VALID' THEN 0 ELSE 1 END, confidence DESC, file, finding_id) AS position
FROM triage""",
    "survivors": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, file, finding_id) AS position
FROM triage WHERE verdict = 'VALID'""",
    "failing": f"""
SELECT * FROM triage WHERE verdict = 'VALID' AND confidence >= 0.7 AND {rank('severity')} <= 1""",
    # ---- reports
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY critical DESC, high DESC, medium DESC, low DESC, display_name, file_id) AS position
FROM results""",
    "raw_ranked": f"""
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {rank('severity')}, display_name, title, file_id, pos) AS position FROM findings""",
    "summary": f"""
SELECT r.run_id, coalesce(files_scanned, 0) AS files_scanned, coalesce(critical_files, 0) AS critical_files, coalesce(high_files, 0) AS high_files,
  coalesce(clean_files, 0) AS clean_files, coalesce(error_files, 0) AS error_files, t.skipped AS files_skipped, t.total_lines
FROM runs r JOIN totals t ON r.run_id = t.run_id LEFT JOIN (
  SELECT run_id, count(*) AS files_scanned, count(*) FILTER (WHERE status <> 'error' AND critical > 0)::BIGINT AS critical_files,
    count(*) FILTER (WHERE status <> 'error' AND high > 0)::BIGINT AS high_files,
    count(*) FILTER (WHERE status <> 'error' AND {' + '.join(fixed.SEVERITIES)} = 0)::BIGINT AS clean_files,
    count(*) FILTER (WHERE status = 'error')::BIGINT AS error_files FROM results GROUP BY run_id) c ON r.run_id = c.run_id""",
    "sarif_rows": f"""
SELECT run_id, severity, title, description, body, display_name AS uri, 'raw' AS source, CAST(NULL AS DOUBLE) AS confidence FROM findings
UNION ALL SELECT run_id, severity, title, description, body, file, 'validated', CASE WHEN confidence > 0 THEN confidence END
FROM triage WHERE verdict = 'VALID'""",
    "sarif_flat": """SELECT run_id, severity AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning'
    WHEN severity IN ('low', 'informational') THEN 'note' ELSE 'none' END AS level,
  title || coalesce(': ' || coalesce(nullif(description, ''), nullif(body, '')), '') AS message, uri, 1 AS start_line, source, confidence FROM sarif_rows""",
    "kept_valid": "SELECT * FROM survivors WHERE confidence >= 0.75",
    "valid_ranked": "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, file, finding_id)::INTEGER AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM kept_valid",
    "raw_left": """
SELECT *, position::INTEGER AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM raw_ranked
WHERE run_id NOT IN (SELECT run_id FROM kept_valid)""",
    "scan_rows": f"""
SELECT s.run_id, s.file_id, s.path AS display_name, CASE WHEN coalesce(c.error, n.error) IS NULL THEN 'ok' ELSE 'error' END AS status,
  coalesce(c.error, n.error, '') AS error, CASE WHEN c.error IS NULL THEN c.content ELSE '' END AS context,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN n.content ELSE '' END AS report,
  CASE WHEN c.error IS NULL THEN c.total_tokens ELSE 0 END AS context_tokens,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN n.prompt_tokens ELSE 0 END AS prompt_tokens,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN n.completion_tokens ELSE 0 END AS completion_tokens,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN n.total_tokens ELSE 0 END AS total_tokens,
  CASE WHEN c.error IS NULL THEN floor(c.elapsed_s * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS context_elapsed,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN floor(n.elapsed_s * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS scan_elapsed,
  CASE WHEN coalesce(c.error, n.error) IS NULL THEN floor((c.elapsed_s + n.elapsed_s) * 10 + 0.5::DOUBLE) / 10 ELSE 0 END AS total_elapsed
FROM source_files s JOIN contexts c ON s.run_id = c.run_id AND s.file_id = c.file_id JOIN scans n ON s.run_id = n.run_id AND s.file_id = n.file_id""",
    "requests_out": f"""
SELECT run_id, file_id, md5('context' || chr(31) || run_id || chr(31) || CAST(file_id AS VARCHAR)) AS request_id, 'context' AS stage,
  '{MODEL}' AS model, false AS json_mode, CAST(to_json({{'messages': [{{'role': 'system', 'content': {lit(SYSTEM)}}},
    {{'role': 'user', 'content': 'File: ' || path || {NL} || {NL} || {FENCE3} || {NL} || content || {NL} || {FENCE3}}}], 'model': '{MODEL}'}}) AS VARCHAR) AS payload
FROM source_files WHERE NOT contains(content, {NUL})""",
    "classes": """
SELECT *, CASE WHEN NOT (contains(lower(body), 'insufficient_quota') OR contains(lower(body), 'quota exceeded')) AND
    CASE WHEN status_code = 429 THEN contains(lower(body), 'rate limit') OR contains(lower(body), 'too many requests')
      OR contains(lower(body), 'requests per min') OR contains(lower(body), 'rpm') OR body = ''
    ELSE contains(lower(body), 'rate limit reached') OR contains(lower(body), 'too many requests') END THEN 'rate_limited'
  WHEN status_code = 429 OR status_code >= 500 THEN 'retryable' WHEN status_code <> 200 THEN 'fatal' ELSE 'ok' END AS class FROM call_log""",
    "recorded_tries": """
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ts, call_id) AS attempt, status_code, class
FROM classes
UNION ALL SELECT request_id, count(*) + 1, 404, 'fatal' FROM call_log GROUP BY request_id""",
    "arbiter_votes": f"""
SELECT run_id, finding_id, string_agg('Round ' || CAST(round_no AS VARCHAR) || ' (' || verdict || '): ' || {prefix('reasoning', 500)} ||
    CASE WHEN coalesce(evidence, '') <> '' THEN {NL} || evidence ELSE '' END, {NL} ORDER BY round_no) AS key_evidence,
  string_agg(left(verdict, 1), '' ORDER BY round_no) AS verdicts, count(*) FILTER (WHERE verdict = 'VALID')::BIGINT AS valid,
  count(*) FILTER (WHERE verdict = 'INVALID')::BIGINT AS invalid FROM rounds_ev GROUP BY run_id, finding_id HAVING count(*) > 1""",
    "verdict_json": r"""
SELECT *, CASE WHEN error IS NULL THEN CASE WHEN json_valid(content) THEN content
  WHEN regexp_extract(content, '\{[^{}]*\}') <> '' AND json_valid(regexp_extract(content, '\{[^{}]*\}')) THEN regexp_extract(content, '\{[^{}]*\}') END END AS j
FROM round_responses""",
    "done": """
SELECT r.*, e.ts AS done_at FROM results r LEFT JOIN events e ON e.event_id = r.file_id""",
}

_RULES = ",".join(
    f'{{"id":"{s}","name":"{s}","shortDescription":{{"text":"auditloom {s} finding"}}}}'
    for s in fixed.SEVERITIES
)
_LOG_HEAD = (
    f'{{"version":"{fixed.SARIF_VERSION}","$schema":"{fixed.SARIF_SCHEMA}","runs":[{{"tool":{{"driver":'
    f'{{"name":"auditloom","rules":[{_RULES}]}}}},"results":['
)
_PAGE_HEAD = [
    "'# Scan results'", "''", "'- **Target**: `repo`'", f"'- **Date**: `{STAMP}`'", f"'- **Model**: `{MODEL}`'",
    "'- **Files scanned**: `' || CAST(files_scanned AS VARCHAR) || '`'",
    "'- **Files skipped**: `' || CAST(files_skipped AS VARCHAR) || '`'",
    "'- **Wall time**: `' || CAST(files_scanned // 2 AS VARCHAR) || CASE WHEN files_scanned % 2 = 1 THEN '.5s`' ELSE '.0s`' END",
    "CASE WHEN run_id IN (SELECT run_id FROM failing) THEN '- **CI result**: failed policy threshold' ELSE '- **CI result**: passed policy threshold' END",
    "''", "'| File | Lines | Critical | High | Medium | Low | Status |'",
    "'|------|-------|----------|------|--------|-----|--------|'",
]


def _cell(x: str) -> str:
    return trim(f"replace(replace({x}, chr(10), ' '), '|', chr(92) || '|')")


STEPS["pages_out"] = "\nUNION ALL ".join(
    [f"SELECT run_id, 1 AS section, {i + 1}::BIGINT AS position, {x} AS line FROM summary" for i, x in enumerate(_PAGE_HEAD)]
    + [
        f"""SELECT run_id, 2, position, '| ' || {_cell('display_name')} || ' | ' || lines || ' | ' || critical || ' | ' || high || ' | '
  || medium || ' | ' || low || ' | ' || {_cell('status')} || ' |' FROM ranked""",
        "SELECT DISTINCT run_id, 3, k::BIGINT, x FROM failing, (VALUES (1, ''), (2, '## Policy failures'), (3, '')) AS h(k, x)",
        f"""SELECT run_id, 3, 3 + row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, file, finding_id),
  '- `' || file || '`: **' || severity || '** ' || {percent('confidence')} || ' - ' || title FROM failing""",
    ]
)

COMMENT_BODY = shorten(f"CASE WHEN {trim('description')} <> '' THEN description ELSE body END", 1200)
COMMENT_TITLE = f"'#### ' || title || {NL} || {NL} || '- **File**: `' || @file || '`' || {NL} || '- **Severity**: `' || severity || '`' || {NL}"
REPORT_SECTION = """SELECT *, CASE WHEN n_valid > 0 THEN 'validated' WHEN n_raw > 0 AND n_triaged > 0 THEN 'raw, none survived triage'
  WHEN n_raw > 0 THEN 'raw, not triaged' WHEN n_errors > 0 THEN 'errors' ELSE 'none' END AS section FROM (
  SELECT r.run_id, (SELECT count(*) FROM kept_valid t WHERE t.run_id = r.run_id) AS n_valid,
    (SELECT count(*) FROM triage t WHERE t.run_id = r.run_id) AS n_triaged,
    (SELECT count(*) FROM findings t WHERE t.run_id = r.run_id) AS n_raw,
    (SELECT count(*) FROM reports t WHERE t.run_id = r.run_id AND t.status = 'error') AS n_errors FROM runs r)"""

ROUND_PROMPTS = f"""SELECT p.run_id, p.finding_id, p.round_no, p.n_prior::INTEGER AS n_prior,
  {template(ROUND_TEMPLATE, f"'{PROJECT}'", 'f.finding_text', 'f.file', 'f.code')}
  || CASE WHEN f.context <> '' THEN {NL} || {NL} || '**Security context for this file:**' || {NL} || {prefix('f.context', 2000)} ELSE '' END
  || CASE WHEN p.n_prior > 0 THEN {lit(EARLIER_REVIEWS)} || p.told ELSE '' END AS prompt
FROM priors p JOIN coded f ON p.run_id = f.run_id AND p.finding_id = f.finding_id"""

DETAIL_DOCS = f"""SELECT o.run_id, 'triage' AS kind, printf('T%04d_', o.position) || {slug('o.file')} || '_' || {slug('o.title')} || '.md' AS name, o.position,
  '# Triage ' || printf('T%04d', o.position) || ': ' || o.title || {NL} || {NL} || '- **File**: `' || o.file || '`' || {NL} || '- **Verdict**: `' || o.verdict || '`' || {NL}
  || '- **Confidence**: `' || {percent('o.confidence')} || ' [' || o.verdicts || ']`' || {NL} || {NL} || '## Finding' || {NL} || {NL} || o.description
  || {NL} || {NL} || '## Triage rounds' || {NL} || {NL} || (SELECT string_agg('### Round ' || r.round_no || ': ' || r.verdict || {NL} || {NL} || r.reasoning || {NL} || {NL}
    || CASE WHEN coalesce(r.evidence, '') <> '' THEN '#### Grep results' || {NL} || {NL} || r.evidence || {NL} || {NL} ELSE '' END, '' ORDER BY r.round_no)
    FROM rounds_ev r WHERE r.run_id = o.run_id AND r.finding_id = o.finding_id) AS text FROM ordered o
UNION ALL SELECT run_id, 'finding', printf('VULN-%03d_', position) || {slug('file')} || '.md', position, '# ' || printf('VULN-%03d', position) || ': ' || title || {NL} || {NL}
  || '- **File**: `' || file || '`' || {NL} || '- **Severity**: `' || severity || '`' || {NL} || '- **Confidence**: `' || {percent('confidence')} || ' [' || verdicts || ']`' || {NL}
  || '- **Date**: `{STAMP}`' || {NL} || {NL} || '## Scanner finding' || {NL} || {NL} || description || {NL} || {NL} || '## Triage reasoning' || {NL} || {NL} || reasoning || {NL} FROM survivors
UNION ALL SELECT run_id, 'survivors', 'triage_survivors.md', position, '## ' || file || ': ' || title || {NL} || {NL} || '- **Severity**: `' || severity || '`' || {NL}
  || '- **Confidence**: `' || {percent('confidence')} || ' [' || verdicts || ']`' || {NL} || {NL} || reasoning || {NL} || {NL} || '---' || {NL} || {NL} FROM survivors
UNION ALL SELECT r.run_id, 'report', {slug('r.display_name')} || '.md', 1::BIGINT, '# Scan: ' || r.display_name || {NL} || {NL} || r.report FROM reports r WHERE r.status = 'ok'
UNION ALL SELECT r.run_id, 'context', {slug('r.display_name')} || '.context.md', 1::BIGINT, '# Context: ' || r.display_name || {NL} || {NL} || c.content
  FROM reports r JOIN contexts c ON r.run_id = c.run_id AND r.file_id = c.file_id WHERE r.status = 'ok'"""

COMMENT_PAGE = f"""SELECT run_id, 1 AS section, 1::BIGINT AS position, '## Review' || {NL} || {NL} || '- **Model**: `{MODEL}`' || {NL}
  || '- **Files scanned**: `' || files_scanned || '`' || {NL} || '- **Files skipped**: `' || files_skipped || '`' || {NL}
  || CASE WHEN error_files > 0 THEN '- **Files with errors**: `' || error_files || '`' || {NL} ELSE '' END
  || CASE WHEN run_id IN (SELECT run_id FROM failing) THEN '- **Result**: failing policy threshold' ELSE '- **Result**: passing policy threshold' END
  || {NL} || {NL} || '| File | Critical | High | Medium | Low | Status |' || {NL} || '|------|----------|------|--------|-----|--------|' AS text FROM summary
UNION ALL SELECT run_id, 2, position, '| ' || {_cell('display_name')} || ' | ' || critical || ' | ' || high || ' | ' || medium || ' | ' || low || ' | ' || {_cell('status')} || ' |' FROM ranked
UNION ALL SELECT run_id, 3, 1, CASE section WHEN 'validated' THEN {NL} || '### Validated Findings' || {NL} || {NL}
  WHEN 'raw, none survived triage' THEN {NL} || '### Raw Findings' || {NL} || {NL} || '_No findings survived triage; raw scanner findings are listed for visibility._' || {NL} || {NL}
  WHEN 'raw, not triaged' THEN {NL} || '### Raw Findings' || {NL} || {NL} || '_Triage did not run; these findings are unvalidated._' || {NL} || {NL}
  WHEN 'errors' THEN {NL} || '### Scan Errors' || {NL} || {NL} ELSE {NL} || 'No findings were reported.' || {NL} END FROM ({REPORT_SECTION})
UNION ALL SELECT run_id, 4, rn, {COMMENT_TITLE.replace('@file', 'file')} || '- **Confidence**: `' || {percent('confidence')} || ' [' || verdicts || ']`' || {NL} || {NL}
  || CASE WHEN {COMMENT_BODY} <> '' THEN {COMMENT_BODY} || {NL} || {NL} ELSE '' END
  || CASE WHEN {trim('reasoning')} <> '' THEN '<details><summary>Triage reasoning</summary>' || {NL} || {NL} || {shorten('reasoning', 1800)} || {NL} || {NL} || '</details>' || {NL} || {NL} ELSE '' END
  FROM valid_ranked WHERE rn <= 20
UNION ALL SELECT run_id, 4, rn, {COMMENT_TITLE.replace('@file', 'display_name')} || CASE WHEN coalesce("function", '') <> '' THEN '- **Function**: `' || "function" || '`' || {NL} ELSE '' END
  || CASE WHEN coalesce({COMMENT_BODY}, '') <> '' THEN {NL} || {COMMENT_BODY} || {NL} || {NL} ELSE {NL} END FROM raw_left WHERE rn <= 20
UNION ALL SELECT run_id, 4, 21, '_' || (n - 20) || ' more validated finding(s) omitted from this comment._' || {NL} || {NL} FROM valid_ranked WHERE rn = 1 AND n > 20
UNION ALL SELECT run_id, 4, 21, '_' || (n - 20) || ' more raw finding(s) omitted from this comment._' || {NL} || {NL} FROM raw_left WHERE rn = 1 AND n > 20
UNION ALL SELECT run_id, 4, position, '- `' || display_name || '`: ' || {shorten(f"CASE WHEN {trim('error')} = '' THEN 'scan failed' ELSE error END", 500)} FROM ranked
  WHERE status = 'error' AND run_id IN (SELECT run_id FROM ({REPORT_SECTION}) WHERE section = 'errors')"""

RUNNING_TOTALS = f"""SELECT run_id, file_id, row_number() OVER w AS done, (sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER w)::BIGINT AS errors,
  {', '.join(f'(sum({s}) OVER w)::BIGINT AS total_{s}' for s in fixed.SEVERITIES)}
FROM done WINDOW w AS (PARTITION BY run_id ORDER BY done_at NULLS FIRST, file_id ROWS UNBOUNDED PRECEDING)"""


QUERIES = {
    "corpus_scan": """SELECT run_id, path, 'file' AS kind, strlen(content)::BIGINT AS length, sha256(content) AS digest FROM whole_tree""",
    "ignore_rules": """SELECT DISTINCT run_id, path FROM judged_heads WHERE NOT taken_back""",
    "prune_dirs": f"SELECT run_id, path, strlen(content)::INTEGER AS chars FROM source_files WHERE NOT {DIRS}",
    "ext_filter": f"SELECT run_id, path, strlen(content)::INTEGER AS chars FROM source_files WHERE {EXT} IN ({EXTS})",
    "size_gate": f"SELECT run_id, path, strlen(content)::INTEGER AS chars FROM source_files WHERE strlen(content) <= {MAX_BYTES}",
    "binary_gate": f"SELECT run_id, path, strlen(content)::INTEGER AS chars FROM source_files WHERE NOT contains(content, {NUL})",
    "ignore_antijoin": """SELECT s.run_id, s.path, CASE WHEN i.path IS NULL THEN 'kept' ELSE 'gitignore' END AS reason
FROM source_files s LEFT JOIN ignored_paths i ON s.run_id = i.run_id AND s.path = i.path""",
    "changed_scope": """SELECT DISTINCT p.run_id, p.full_path AS path FROM (
  SELECT run_id, CASE WHEN starts_with(path, '/') THEN path ELSE '/work/' || replace(path, './', '') END AS full_path
  FROM changed_paths WHERE path <> '') p
WHERE EXISTS (SELECT 1 FROM changed_roots r WHERE r.run_id = p.run_id AND (p.full_path = r.root OR starts_with(p.full_path, r.root || '/')))""",
    "snapshot_diff": """SELECT * FROM (WITH gone AS (
  SELECT o.run_id, o.content, count(*) AS n FROM base_files o WHERE NOT EXISTS (
    SELECT 1 FROM source_files n WHERE n.run_id = o.run_id AND n.path = o.path) GROUP BY ALL),
added AS (
  SELECT h.run_id, h.path, h.content, row_number() OVER (PARTITION BY h.run_id, h.content ORDER BY h.path) AS nth
  FROM source_files h WHERE NOT EXISTS (SELECT 1 FROM base_files b WHERE b.run_id = h.run_id AND b.path = h.path))
SELECT a.run_id, a.path, 'A' AS change FROM added a LEFT JOIN gone g ON a.run_id = g.run_id AND a.content = g.content
WHERE a.nth > coalesce(g.n, 0)
UNION ALL SELECT h.run_id, h.path, 'M' FROM source_files h JOIN base_files b ON h.run_id = b.run_id AND h.path = b.path
WHERE h.content <> b.content)""",
    "skip_ledger": "SELECT run_id, path, reason FROM classified WHERE reason IS NOT NULL",
    "skip_counts": "SELECT run_id, reason, count(*) AS n_files FROM classified WHERE reason IS NOT NULL GROUP BY ALL",
    "source_profile": f"""SELECT run_id, path, substr(path, 6) AS display_name, {lines('content')} AS lines,
  strlen(content)::INTEGER AS chars FROM source_files""",
    "corpus_totals": "SELECT run_id, files, skipped, total_lines FROM totals",
    "corpus_lines": "SELECT run_id, path, line, text FROM all_lines",
    "context_requests": "SELECT * FROM requests_out",
    "scan_requests": f"""SELECT s.run_id, s.file_id, md5('scan' || chr(31) || s.run_id || chr(31) || CAST(s.file_id AS VARCHAR)) AS request_id, 'scan' AS stage,
  '{MODEL}' AS model, false AS json_mode, CAST(to_json({{'messages': [
    {{'role': 'system', 'content': {lit(SCAN_SYSTEM + CONTEXT_HEADING)} || c.content}},
    {{'role': 'user', 'content': {lit(EXAMPLE[0])}}}, {{'role': 'assistant', 'content': {lit(EXAMPLE[1])}}},
    {{'role': 'user', 'content': {template(USER_TEMPLATE, 's.path', 's.content')}}}], 'model': '{MODEL}'}}) AS VARCHAR) AS payload
FROM source_files s JOIN contexts c ON s.run_id = c.run_id AND s.file_id = c.file_id
WHERE NOT contains(s.content, {NUL}) AND c.error IS NULL""",
    "run_completions": """SELECT request_id, 'read ' || CAST(length(payload) AS VARCHAR) AS content, length(payload)::INTEGER AS prompt_tokens,
  2 AS completion_tokens, (length(payload) + 2)::INTEGER AS total_tokens, 0.5::DOUBLE AS elapsed_s, CAST(NULL AS VARCHAR) AS error FROM requests_out""",
    "replay_completions": """SELECT q.request_id, s.content, s.prompt_tokens, s.completion_tokens, s.total_tokens, s.elapsed_s,
  CASE WHEN s.file_id IS NULL THEN 'no recorded response' END AS error
FROM requests_out q LEFT JOIN (SELECT * FROM scans WHERE error IS NULL) s ON q.run_id = s.run_id AND q.file_id = s.file_id""",
    "decode_completions": """SELECT call_id, CASE event_type WHEN 'click' THEN 'why ' || user_id WHEN 'view' THEN 'answer ' || event_id END AS content,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN user_id END::INTEGER AS prompt_tokens,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 7 END::INTEGER AS completion_tokens,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN user_id + 7 END::INTEGER AS total_tokens,
  CASE event_type WHEN 'error' THEN 'api error: ' || json_extract(body, '$.error') WHEN 'signup' THEN 'api response contained no choices'
    WHEN 'purchase' THEN 'invalid response' END AS error
FROM (SELECT w.call_id, CASE WHEN json_valid(w.body) THEN w.body END AS body, e.event_type, e.user_id, e.event_id
  FROM wire w JOIN events e ON w.call_id = e.event_id)""",
    "classify_calls": "SELECT call_id, class FROM classes",
    "retry_backlog": """SELECT request_id, attempts, greatest(limited + INTERVAL 1 MINUTE, failed + to_seconds(1 << attempts)) AS eligible_at FROM (
  SELECT request_id, count(*) FILTER (WHERE class IN ('ok', 'fatal')) AS finished, count(*) FILTER (WHERE class = 'retryable')::INTEGER AS attempts,
    date_trunc('minute', max(CASE WHEN class = 'rate_limited' THEN ts END)) AS limited,
    max(CASE WHEN class = 'retryable' THEN ts END) AS failed FROM classes GROUP BY request_id) WHERE finished = 0 AND attempts < 3""",
    "scan_results": "SELECT * FROM scan_rows",
    "marker_findings": "SELECT * FROM marker_rows",
    "json_findings": "SELECT * EXCLUDE (marked, json_from) FROM json_rows WHERE json_from = 'whole'",
    "json_salvage": """SELECT v.run_id, v.file_id, v.json_from AS method, v.j AS json_text, count(r.file_id)::INTEGER AS n_items
FROM valued v LEFT JOIN json_rows r ON v.run_id = r.run_id AND v.file_id = r.file_id
WHERE v.json_from IN ('numbered', 'array') GROUP BY ALL""",
    "heading_findings": "SELECT * FROM heading_rows",
    "unstructured_findings": "SELECT * FROM word_rows",
    "parse_findings": "SELECT * FROM findings",
    "normalize_severity": f"""SELECT raw, {norm('raw')} AS severity, count(*) AS n FROM (
  SELECT upper(severity) AS raw FROM triage_findings UNION ALL SELECT severity || ' ' || chr(10) FROM triage_findings
  UNION ALL SELECT ' ' || chr(9) || upper(left(status, 1)) || substr(status, 2) || chr(10) FROM reports) GROUP BY raw""",
    "severity_threshold": f"SELECT run_id, file_id, pos, severity, {rank('severity')} AS severity_rank FROM findings WHERE {rank('severity')} <= 1",
    "severity_counts": f"SELECT run_id, file_id, display_name, {FIVE} FROM counts WHERE status = 'ok'",
    "top_severity": f"""SELECT run_id, file_id, CASE {' '.join(f"WHEN {s} > 0 THEN '{s}'" for s in fixed.SEVERITIES)} ELSE 'clean' END AS top_severity
FROM counts WHERE status = 'ok'""",
    "search_requests": "SELECT run_id, finding_id, round_no, unnest(items) AS request, generate_subscripts(items, 1)::INTEGER - 1 AS pos FROM requests",
    "clean_patterns": "SELECT run_id, finding_id, round_no, pos, pattern FROM patterns",
    "corpus_search": "SELECT * FROM matches",
    "corpus_search_wide": """SELECT DISTINCT l.run_id, w.pattern, l.path, l.line, l.text FROM (
  SELECT DISTINCT run_id, substr(path, 6, 20) AS pattern FROM source_files
  UNION SELECT DISTINCT run_id, substr(content, 3, 24) FROM source_files) w
JOIN searchable l ON l.run_id = w.run_id AND contains(l.text, w.pattern) WHERE w.pattern <> ''""",
    "top_matches": "SELECT run_id, pattern, rn, path, line FROM top_lines",
    "evidence_blocks": "SELECT * FROM evidence",
    "condense_evidence": "SELECT run_id, finding_id, round_no, condensed FROM condensed",
    "triage_candidates": f"""SELECT f.run_id, f.file_id, f.pos, f.severity, f.title FROM all_findings f
JOIN scan_rows s ON f.run_id = s.run_id AND f.file_id = s.file_id WHERE s.status = 'ok' AND {rank('f.severity')} <= 2""",
    "round_prompts": ROUND_PROMPTS,
    "parse_verdicts": f"""SELECT run_id, finding_id, round_no, CASE WHEN error IS NOT NULL THEN 'ERROR'
    WHEN json_type(j) = 'OBJECT' THEN CASE WHEN upper({field('j', 'verdict')}) IN ('VALID', 'INVALID', 'UNCERTAIN') THEN upper({field('j', 'verdict')}) ELSE 'UNCERTAIN' END
    WHEN starts_with(upper({trim('content')}), 'INVALID') THEN 'INVALID' WHEN starts_with(upper({trim('content')}), 'VALID') THEN 'VALID'
    ELSE 'UNCERTAIN' END AS verdict,
  CASE WHEN error IS NOT NULL THEN error WHEN json_type(j) = 'OBJECT' THEN coalesce({field('j', 'reasoning')}, content)
    || coalesce({NL} || {NL} || 'CRUX: ' || {field('j', 'crux')}, '')
    || coalesce({NL} || 'GREP: ' || nullif(trim(regexp_replace({field('j', 'grep')}, '^GREP:', ''), {QUOTES} || ' '), ''), '')
    ELSE content END AS reasoning, total_tokens AS tokens, floor(elapsed_s * 10 + 0.5) / 10 AS elapsed_s FROM verdict_json""",
    "triage_requests": f"""SELECT p.run_id, p.finding_id, p.round_no,
  md5('round' || chr(31) || p.run_id || chr(31) || CAST(p.finding_id AS VARCHAR) || chr(31) || CAST(p.round_no AS VARCHAR)) AS request_id,
  'round' AS stage, '{MODEL}' AS model, true AS json_mode, CAST(to_json({{'messages': [{{'role': 'system', 'content': {lit(SYSTEM)}}},
    {{'role': 'user', 'content': p.prompt}}], 'model': '{MODEL}', 'response_format': {{'type': 'json_object'}}}}) AS VARCHAR) AS payload
FROM ({ROUND_PROMPTS}) p""",
    "round_evidence": "SELECT run_id, finding_id, round_no, verdict, grep_used, evidence FROM rounds_ev",
    "confidence": f"SELECT run_id, finding_id, count(*) AS n_rounds, {VALID_SHARE} AS confidence FROM rounds GROUP BY run_id, finding_id",
    "verdict_string": "SELECT run_id, finding_id, string_agg(left(verdict, 1), '' ORDER BY round_no) AS verdicts FROM rounds GROUP BY run_id, finding_id",
    "arbiter_requests": f"""SELECT v.run_id, v.finding_id, v.verdicts, v.valid, v.invalid,
  {template(ARBITER_TEMPLATE, f"'{PROJECT}'", 'f.title', 'f.finding_text', 'v.key_evidence', 'v.verdicts', 'v.valid', 'v.invalid', 'f.file', 'f.code')} AS prompt
FROM arbiter_votes v JOIN coded f ON v.run_id = f.run_id AND v.finding_id = f.finding_id""",
    "final_verdict": "SELECT * EXCLUDE (description, body) FROM triage",
    "triage_order": "SELECT run_id, finding_id, position, verdict, confidence FROM ordered",
    "verdict_tally": f"""SELECT r.run_id, {', '.join(f"count(*) FILTER (WHERE t.verdict = '{v}')::BIGINT AS {v.lower()}" for v in fixed.VERDICTS)}
FROM runs r LEFT JOIN triage t ON r.run_id = t.run_id GROUP BY r.run_id""",
    "file_ranking": f"SELECT run_id, display_name, position, {FIVE} FROM ranked",
    "run_summary": "SELECT * FROM summary",
    "survivors": """SELECT run_id, finding_id, row_number() OVER (PARTITION BY run_id ORDER BY confidence DESC, file, finding_id) AS position, confidence
FROM survivors WHERE confidence >= 0.5""",
    "raw_ranking": "SELECT run_id, file_id, pos, position, severity, title FROM raw_ranked",
    "gate_validated": "SELECT run_id, finding_id, file, severity, confidence FROM failing",
    "gate_raw": f"SELECT run_id, display_name AS file, title, severity, 'VALID' AS verdict, 1.0::DOUBLE AS confidence FROM findings WHERE {rank('severity')} <= 1",
    "gate_status": """SELECT run_id, error_files, failures, failures > 0 AS should_fail,
  CASE WHEN error_files > 0 THEN 2 WHEN failures > 0 THEN 1 ELSE 0 END AS exit_code FROM (
  SELECT r.run_id, (SELECT count(*) FROM reports p WHERE p.run_id = r.run_id AND p.status = 'error') AS error_files,
    (SELECT count(*) FROM failing f WHERE f.run_id = r.run_id) AS failures FROM runs r)""",
    "sarif_results": "SELECT * FROM sarif_flat",
    "sarif_log": f"""SELECT run_id, shard, count(*) AS n_results, {lit(_LOG_HEAD)} || string_agg(item, ',' ORDER BY n) || ']}}]}}' AS sarif FROM (
  SELECT *, CAST((n - 1) // 5000 AS INTEGER) AS shard FROM (
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY source, uri, rule_id, sha256(message), confidence) AS n,
      '{{"ruleId":"' || rule_id || '","level":"' || level || '","message":{{"text":' || CAST(to_json(message) AS VARCHAR)
      || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || CAST(to_json(uri) AS VARCHAR)
      || '}},"region":{{"startLine":1}}}}}}],"properties":{{"source":"' || source || '"'
      || coalesce(',"confidence":' || CAST(confidence AS VARCHAR), '') || '}}}}' AS item FROM sarif_flat)) GROUP BY run_id, shard""",
    "write_run": f"""SELECT output, run_id, count(*) AS n_rows FROM (
  SELECT 'summary' AS output, run_id FROM summary UNION ALL SELECT 'results', run_id FROM results WHERE status = 'ok'
  UNION ALL SELECT 'triage', run_id FROM triage UNION ALL SELECT 'pages', run_id FROM pages_out
  UNION ALL SELECT 'documents', run_id FROM reports WHERE status = 'ok' UNION ALL SELECT 'documents', run_id FROM reports WHERE status = 'ok'
  UNION ALL SELECT DISTINCT 'sarif', run_id FROM sarif_flat) GROUP BY output, run_id""",
    "run_files": f"""SELECT path, sha256(content) AS digest FROM (
  SELECT 'run=' || run_id || '/' || CASE kind WHEN 'triage' THEN 'triages/' WHEN 'finding' THEN 'findings/' WHEN 'report' THEN 'reports/'
    ELSE 'contexts/' END || name AS path, text AS content FROM ({DETAIL_DOCS}) WHERE kind <> 'survivors'
  UNION ALL SELECT 'run=' || run_id || '/triage_survivors.md', string_agg(text, '' ORDER BY position) FROM ({DETAIL_DOCS}) WHERE kind = 'survivors' GROUP BY run_id
  UNION ALL SELECT 'run=' || run_id || '/summary.md', string_agg(line, {NL} ORDER BY section, position) || {NL} FROM pages_out GROUP BY run_id
  UNION ALL SELECT 'run=' || run_id || '/pr-comment.md', string_agg(text, {NL} ORDER BY section, position) FROM ({COMMENT_PAGE}) GROUP BY run_id
  UNION ALL SELECT 'run=' || s.run_id || '/summary.json', CAST(to_json({{'timestamp': '{STAMP}', 'target': 'repo', 'model': '{MODEL}',
    'files_scanned': files_scanned, 'files_skipped': files_skipped, 'total_lines': total_lines, 'wall_time_seconds': files_scanned / 2.0::DOUBLE,
    'critical_files': critical_files, 'high_files': high_files, 'clean_files': clean_files, 'error_files': error_files,
    'should_fail': n_failing > 0, 'failures': n_failing, 'min_confidence': 0.0::DOUBLE}}) AS VARCHAR)
    FROM (SELECT *, (SELECT count(*) FROM failing f WHERE f.run_id = s.run_id) AS n_failing FROM summary s) s)""",
    "attempts": """SELECT request_id, CAST(attempt AS INTEGER) AS attempt, status_code, class FROM (
  SELECT *, count(*) FILTER (WHERE class IN ('ok', 'fatal')) OVER before AS finished, count(*) FILTER (WHERE class = 'retryable') OVER before AS failed
  FROM recorded_tries WINDOW before AS (PARTITION BY request_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE finished = 0 AND failed < 3""",
    "comment_topk": f"""SELECT run_id, 'validated' AS section, rn, file, title, severity,
  {shorten(f"CASE WHEN {trim('description')} <> '' THEN description ELSE body END", 1200)} AS body, greatest(n - 20, 0) AS omitted FROM valid_ranked WHERE rn <= 20
UNION ALL SELECT run_id, 'raw', rn, display_name, title, severity,
  {shorten(f"CASE WHEN {trim('description')} <> '' THEN description ELSE body END", 1200)}, greatest(n - 20, 0) FROM raw_left WHERE rn <= 20""",
    "report_section": REPORT_SECTION,
    "comment_page": COMMENT_PAGE,
    "markdown_table": "SELECT * FROM pages_out",
    "truncate_text": f"""SELECT doc_id, {shorten('text', 1200)} AS body, {shorten('text', 1800)} AS reasoning, {shorten('text', 500)} AS error FROM documents""",
    "safe_names": f"""SELECT run_id, file_id, slug, count(*) OVER (PARTITION BY run_id, slug) AS n_same,
  count(*) OVER (PARTITION BY run_id, slug) > 1 AS collides FROM (
  SELECT run_id, file_id, {slug("'/' || path || '  é!'")} AS slug FROM source_files)""",
    "artifact_numbers": f"""SELECT run_id, finding_id, 'triage' AS kind, printf('T%04d_', position) || {slug('file')} || '_' || {slug('title')} || '.md' AS name FROM ordered
UNION ALL SELECT run_id, finding_id, 'finding', printf('VULN-%03d_', position) || {slug('file')} || '.md' FROM survivors""",
    "grand_totals": f"""SELECT run_id, {', '.join(f'sum({s})::BIGINT AS {s}' for s in fixed.SEVERITIES)},
  sum({' + '.join(fixed.SEVERITIES)})::BIGINT AS total_findings FROM results GROUP BY run_id""",
    "severity_rollup": "SELECT run_id, severity, count(*) AS n_findings FROM findings GROUP BY ROLLUP (run_id, severity)",
    "detail_docs": DETAIL_DOCS,
    "running_totals": RUNNING_TOTALS,
    "stream_running_totals": RUNNING_TOTALS,
    "stream_severity": f"""SELECT run_id, count(*) AS done, count(*) FILTER (WHERE status = 'error')::BIGINT AS errors, {', '.join(f'sum({s})::BIGINT AS {s}' for s in fixed.SEVERITIES)}
FROM results GROUP BY run_id""",
    "stream_corpus": f"""SELECT run_id, path, CASE WHEN starts_with(path, 'repo/') THEN substr(path, 6) ELSE path END AS display_name,
  {lines('content')} AS lines, strlen(content)::INTEGER AS chars, CASE WHEN NOT {EXT} IN ({EXTS}) THEN 'extension'
  WHEN strlen(content) > {MAX_BYTES} THEN 'too large (' || CAST(strlen(content) AS VARCHAR) || ' bytes)'
  WHEN contains(content, {NUL}) THEN 'binary' END AS reason FROM tree""",
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, final in QUERIES.items():
        needed = depends("", {**STEPS, "": final})
        ctes = [f"{step} AS ({STEPS[step]})" for step in STEPS if step in needed]
        out[name] = f"WITH {', '.join(ctes)} {final}" if ctes else final
    return out
