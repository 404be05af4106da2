"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from . import license_scan as lic
from . import line_frequency as lf

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
gone AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY words) AS lowest FROM windows) WHERE lowest < doc_id),
covered AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM gone, (SELECT unnest(range(13)) AS k) GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN covered USING (doc_id)),
marked AS (
  SELECT doc_id, i, x, c.doc_id IS NOT NULL AS out
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
  LEFT JOIN (SELECT doc_id, unnest(places) AS i FROM covered) c USING (doc_id, i)),
texts AS (SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT out), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN texts USING (doc_id)
"""

MINHASH = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
best AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN best USING (doc_id) LEFT JOIN n USING (doc_id)
"""

LINE_FREQUENCY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, md5(coalesce(text, '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
repeated AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, digest, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
    regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line
  FROM (SELECT doc_id, host, digest, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT digest) AS n FROM d GROUP BY host),
frequent AS (
  SELECT l.host, l.line FROM lines l JOIN hosts h ON l.host = h.host GROUP BY l.host, l.line, h.n
  HAVING count(DISTINCT digest) >= {lf.MIN_DOCS} AND 100 * count(DISTINCT digest) > {lf.SHARE_PCT} * h.n),
gone AS (
  SELECT doc_id, sum(words) AS n FROM lines l JOIN frequent f ON l.host = f.host AND l.line = f.line GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{lf.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {lf.MIN_WORDS} OR 100 * n_repeat_words > {lf.MAX_REPEAT_PCT} * n_words AS base_failed,
  n_words >= {lf.MIN_WORDS} AND 100 * n_repeat_words <= {lf.MAX_REPEAT_PCT} * n_words
    AND 100 * removed_words <= {lf.MAX_REMOVED_PCT} * n_words AS kept,
  removed_words
FROM m
"""

_WORDS = r"regexp_extract_all(lower({0}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(lic.TEMPLATES))

LICENSE_SCAN = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM words),
places AS (
  SELECT doc_id, pos, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by'
    WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' ELSE 'reserved' END AS label
  FROM grams WHERE (a = 'cc' AND b = 'by') OR (a = 'general' AND b = 'public' AND c = 'license')
    OR (a = 'all' AND b = 'rights' AND c = 'reserved')),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY doc_id),
tw AS (SELECT template, label, {_WORDS.format("body")} AS w FROM (VALUES {_VALUES}) AS t(template, label, body)),
tg AS (
  SELECT template, label, len(w) AS t_words, len(w) - 2 AS n_grams, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM tw)),
hits AS (SELECT g.doc_id, template, label, t_words, n_grams, tpos, pos, pos - tpos AS diagonal FROM grams g JOIN tg USING (a, b, c)),
diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
islands AS (
  SELECT doc_id, template, diagonal, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {lic.GAP}
      THEN 1 ELSE 0 END AS apart FROM diagonals)),
spans AS (
  SELECT doc_id, label, n_grams, count(DISTINCT tpos) AS matched, t_words, min(pos) AS s, max(pos) + {lic.GRAM} AS e
  FROM hits JOIN islands USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, n_grams, t_words, span),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(matched AS DOUBLE) / CAST(n_grams AS DOUBLE)) AS best FROM spans
  WHERE 100 * matched >= {lic.COVERAGE_PCT} * n_grams AND 100 * (e - s) <= {lic.STRETCH_PCT} * t_words GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(best, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
l AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS lead FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id < lead THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < lead THEN lead END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM l
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a byte enters with the first of its eight steps."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, b: {step}), 4294967295)"


PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY conv_id),
h AS (SELECT *, {_crc32('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (
  SELECT conv_id, depth, turns[1:depth] AS prefix, len(turns) = depth AS ends
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM r)),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM m GROUP BY prefix, depth),
kids AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN depth > 0 THEN (n_convs - 1) * length(prefix[depth].text) ELSE 0 END AS saved
  FROM n LEFT JOIN kids USING (prefix, depth)),
sums AS (
  SELECT prefix[1:top] AS prefix, top AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT prefix, leaf, saved, unnest(range(0, depth + 1)) AS top FROM w) GROUP BY ALL)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN sums s ON s.prefix = w.prefix AND s.depth = w.depth
LEFT JOIN w p ON p.depth = w.depth - 1 AND p.prefix = w.prefix[1:w.depth - 1]
"""


def _repair() -> str:
    """Backwards over the rows, one column a state: 0 nothing yet, 1 after s, 2 after a, 3 after u.

    A value is (cost, audit, lines), the least by cost and then audit.
    """
    after, role = (3, 3, 3, 2), ("user", "user", "user", "assistant")
    keeps = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}

    def made(cost: str, letter: str, line: str | None, rest: str) -> str:
        lines = f"list_concat([{line}], {rest}.o)" if line else f"{rest}.o"
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'o': {lines}}}"

    impossible = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}"

    def own(state: int) -> str:
        ways = [made("3", "D", None, f"v{state}")]
        ways += [
            f"CASE WHEN free AND initial = '{first}' THEN {made('late', 'K', 'line', f'v{to}')} ELSE {impossible} END"
            for (at, first), to in keeps.items() if at == state
        ]
        again = f"'{role[state]}:' || text"
        ways.append(f"CASE WHEN free THEN {made('late + 2', 'R', again, f'v{after[state]}')} ELSE {impossible} END")
        return f"list_min([{', '.join(ways)}]) AS w{state}"

    def inserted(state: int) -> str:
        first, second = after[state], after[after[state]]
        once = made("2", "I", f"'{role[state]}:'", f"w{first}")
        twice = (
            f"{{'c': w{second}.c + 4, 'a': 'II' || w{second}.a, "
            f"'o': list_concat(['{role[state]}:', '{role[first]}:'], w{second}.o)}}"
        )
        return f"list_min([w{state}, {once}, {twice}]) AS v{state}"

    ends = ("[]", "['user:', 'assistant:']", "[]", "['assistant:']")
    start = ", ".join(
        f"{{'c': CAST({2 * len(x)} AS BIGINT), 'a': '{'I' * len(x)}', 'o': CAST({e} AS VARCHAR[])}} AS v{k}"
        for k, (x, e) in enumerate(zip(("", "II", "", "I"), ends))
    )
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, role || ':' || text AS line,
    CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) || left(role, 1) AS pair FROM placed),
rows AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM faults),
path AS (
  SELECT key, max(i) + 1 AS i, {start} FROM rows GROUP BY key
  UNION ALL
  SELECT key, i, {', '.join(inserted(k) for k in range(4))} FROM (
    SELECT r.key, r.i, {', '.join(own(k) for k in range(4))} FROM path JOIN rows r ON r.key = path.key AND r.i = path.i - 1)),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY key),
ids AS (SELECT DISTINCT conv_id, key FROM raw)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost,
  coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (key) LEFT JOIN (SELECT key, v0 FROM path WHERE i = 1) USING (key)
"""


CONVERSATION_REPAIR = _repair()


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_DEDUP,
        "op4_minhash": MINHASH,
        "op5_line_frequency": LINE_FREQUENCY,
        "op8_warc": WARC,
        "op9_license_scan": LICENSE_SCAN,
        "op11_prefix_trie": PREFIX_TRIE,
        "op13_conversation_repair": CONVERSATION_REPAIR,
    }
