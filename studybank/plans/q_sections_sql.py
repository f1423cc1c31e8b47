"""SQL oracles for the sectioning queries (line-based restatement of the rule).

A header can only start a line (it begins with a newline).  Line k >= 1 is a
candidate when it reads `` NAME:`` followed by a blank on the same line
(inline) or by the line end with a further line (newline type).  After a chosen
header the search resumes at the first newline of its body, so the line right
after a chosen newline-type header is skipped: inside a run of consecutive
newline-type candidates the choice alternates, and any other candidate is
chosen unless it directly follows a chosen newline-type header.
"""

from __future__ import annotations

from studybank import constants as K
from studybank.plans.q_text import _normalise_sql, _q

SECTIONED_SQL = """
src AS (
  SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id,
         CASE WHEN lang = 'en' THEN 'HDR' || chr(10) || ' FINDINGS: ' || string_split(text, '.')[1] || chr(10)
                                    || ' IMPRESSION: ' || coalesce(CASE WHEN strpos(text, '.') > 0 THEN substring(text, strpos(text, '.') + 1) END, '')
              WHEN lang = 'fr' THEN 'EXAM' || chr(10) || ' CHEST, TWO VIEWS: ' || text
              WHEN lang = 'de' THEN 'X' || chr(10) || ' HISTORY: ' || replace(text, chr(10), chr(10) || ' ' || chr(10))
              ELSE text END AS text
  FROM documents)
"""

WS_CLASS = "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def sections_sql() -> str:
    body = _q(K.BODY_SECTIONS[0]) + ", " + _q(K.BODY_SECTIONS[1])
    return SECTIONED_SQL + f""",
ln AS (SELECT study_id, text, string_split(text, chr(10)) AS ls FROM src),
lx AS (SELECT study_id, text, ls, unnest(range(len(ls))) AS k FROM ln),
lines AS (
  SELECT study_id, text, k, len(ls) AS m, ls[k + 1] AS l,
         CAST(coalesce(list_sum(list_transform(ls[1:k], lambda x: length(x) + 1)), 0) AS BIGINT) AS s
  FROM lx),
cand AS (
  SELECT *, k >= 1 AND (regexp_matches(l, '^ [A-Z ()/,-]+:[ \\t\\x0B\\f\\r]')
                        OR (regexp_matches(l, '^ [A-Z ()/,-]+:$') AND k < m - 1)) AS is_c,
         k >= 1 AND regexp_matches(l, '^ [A-Z ()/,-]+:$') AND k < m - 1 AS is_nl
  FROM lines),
prevs AS (
  SELECT *, coalesce(lag(is_nl) OVER (PARTITION BY study_id ORDER BY k), false) AS prev_nl FROM cand),
runs AS (
  SELECT *, sum(CASE WHEN is_nl AND NOT prev_nl THEN 1 ELSE 0 END)
              OVER (PARTITION BY study_id ORDER BY k) AS blk
  FROM prevs),
runpos AS (
  SELECT *, CASE WHEN is_nl THEN k - min(k) OVER (PARTITION BY study_id, blk, is_nl) END AS rp FROM runs),
chosen0 AS (
  SELECT *, CASE WHEN is_nl THEN rp % 2 = 0 ELSE is_c END AS ch0 FROM runpos),
chosen1 AS (
  SELECT *, coalesce(lag(ch0) OVER (PARTITION BY study_id ORDER BY k), false) AS prev_ch FROM chosen0),
chosen AS (
  SELECT *, CASE WHEN is_c AND NOT is_nl AND prev_nl AND prev_ch THEN false ELSE ch0 AND is_c END AS ch
  FROM chosen1),
hdr AS (
  SELECT study_id, text, k, s, regexp_extract(l, '^ ([A-Z ()/,-]+):', 1) AS name,
         s + 1 + length(regexp_extract(l, '^ ([A-Z ()/,-]+):', 1)) + 2 AS bstart
  FROM chosen WHERE ch),
hseq AS (
  SELECT *, lead(s) OVER (PARTITION BY study_id ORDER BY k) AS next_s,
         row_number() OVER (PARTITION BY study_id ORDER BY k) AS hn FROM hdr),
raw AS (
  SELECT study_id, CAST(hn AS INTEGER) AS rpos, lower(name) AS hname,
         substring(text, bstart + 1, coalesce(next_s - 1, length(text)) - bstart) AS t,
         CAST(bstart AS INTEGER) AS start FROM hseq
  UNION ALL
  SELECT h.study_id, 0, 'preamble', substring(h.text, 1, h.s + 1), 0 FROM hseq h WHERE h.hn = 1
  UNION ALL
  SELECT study_id, 0, 'full report', text, 0 FROM src WHERE study_id NOT IN (SELECT study_id FROM hdr)),
named AS (SELECT study_id, rpos, {_normalise_sql('hname')} AS name, t, start FROM raw),
kept AS (SELECT * FROM named WHERE NOT (name IN ({body}) AND NOT regexp_matches(t, '[^' || {_q(WS_CLASS[1:-1])} || ']'))),
agg AS (SELECT study_id, bool_or(name IN ({body})) AS has_body, max(rpos) AS last_rpos FROM kept GROUP BY study_id),
lastp AS (
  SELECT k.*, strpos(k.t, chr(10) || ' ' || chr(10)) AS brk FROM kept k JOIN agg a
  ON a.study_id = k.study_id AND k.rpos = a.last_rpos WHERE NOT a.has_body),
expanded AS (
  SELECT k.study_id, k.rpos, k.name, k.t, k.start FROM kept k
  WHERE NOT EXISTS (SELECT 1 FROM lastp p WHERE p.study_id = k.study_id AND p.rpos = k.rpos AND p.brk > 0)
  UNION ALL SELECT study_id, rpos, name, substring(t, 1, brk - 1), start FROM lastp WHERE brk > 0
  UNION ALL SELECT study_id, rpos + 1, 'last_paragraph', substring(t, brk + 3), CAST(start + brk - 1 AS INTEGER)
            FROM lastp WHERE brk > 0),
secs AS (
  SELECT study_id, CAST(row_number() OVER (PARTITION BY study_id ORDER BY rpos) - 1 AS INTEGER) AS pos,
         name, t AS text, start FROM expanded)
"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^' || {_q(WS_CLASS)} || '+|' || {_q(WS_CLASS)} || '+$', '', 'g')"


_PRI = " ".join(f"WHEN {_q(n)} THEN {i + 1}" for i, n in enumerate(K.SECTION_PRIORITY))

SECTION_ORACLES = {
    "section_split": "WITH " + sections_sql() + " SELECT study_id, pos, name, text, start FROM secs",
    "last_paragraph": "WITH " + sections_sql()
    + " SELECT study_id, pos, name, text, start FROM secs WHERE name = 'last_paragraph'",
    "last_section_pick": "WITH " + sections_sql() + f""",
pr AS (SELECT *, CASE name {_PRI} END AS p FROM secs),
best AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p NULLS LAST, pos DESC) AS rn FROM pr)
SELECT study_id, CASE WHEN p IS NULL THEN '' ELSE {_strip('text')} END AS report FROM best WHERE rn = 1
""",
    "report_concat": "WITH " + sections_sql() + f""",
l AS (SELECT study_id, name, arg_max(text, pos) AS t FROM secs
      WHERE name IN ('impression', 'findings', 'last_paragraph') GROUP BY ALL),
o AS (SELECT study_id, {_strip('t')} AS t,
             CASE name WHEN 'impression' THEN 1 WHEN 'findings' THEN 2 ELSE 3 END AS ord FROM l),
j AS (SELECT study_id, string_agg(t, '' ORDER BY ord) AS report FROM o WHERE t <> '' GROUP BY study_id)
SELECT s.study_id, coalesce(j.report, '') AS report FROM (SELECT DISTINCT study_id FROM secs) s
LEFT JOIN j ON j.study_id = s.study_id
""",
    "impression_filter": "WITH " + sections_sql() + f""",
a AS (SELECT study_id, count(*) FILTER (WHERE name = 'impression') AS n,
             arg_max(text, pos) FILTER (WHERE name = 'impression') AS impression FROM secs GROUP BY study_id)
SELECT study_id, impression,
       CASE WHEN n = 0 THEN 'no_impression' WHEN n > 1 THEN 'several_impressions'
            WHEN NOT regexp_matches(impression, '[^' || {_q(WS_CLASS[1:-1])} || ']') THEN 'empty_impression'
            ELSE 'ok' END AS status
FROM a
""",
}


PICK = f"""
pr AS (SELECT *, CASE name {_PRI} END AS p FROM secs),
best AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY p NULLS LAST, pos DESC) AS rn FROM pr),
pick AS (SELECT study_id, CASE WHEN p IS NULL THEN '' ELSE {_strip('text')} END AS report FROM best WHERE rn = 1)
"""

SECTION_ORACLES["section_drop_empty"] = "WITH " + sections_sql() + """,
r AS (SELECT study_id, count(*) AS raw FROM named GROUP BY study_id),
k AS (SELECT study_id, count(*) AS kept FROM kept GROUP BY study_id)
SELECT r.study_id, CAST(r.raw AS INTEGER) AS raw, CAST(coalesce(k.kept, 0) AS INTEGER) AS kept
FROM r LEFT JOIN k ON k.study_id = r.study_id
"""

SECTION_ORACLES["join_overrides"] = "WITH " + sections_sql() + ", " + PICK + f""",
ov AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS study_id, source FROM documents),
sl AS (SELECT s.study_id, substring(s.text, 6, 55) AS report FROM src s JOIN ov ON ov.study_id = s.study_id
       WHERE ov.source = 'src3'),
nm AS (SELECT ov.study_id, (SELECT {_strip('arg_max(x.text, x.pos)')} FROM secs x
                            WHERE x.study_id = ov.study_id AND x.name = 'preamble') AS report
       FROM ov WHERE ov.source = 'src4'),
pl AS (SELECT p.study_id, p.report FROM pick p JOIN ov ON ov.study_id = p.study_id
       WHERE ov.source NOT IN ('src3', 'src4'))
SELECT study_id, report, CASE WHEN report IS NULL THEN 'missing_section' ELSE 'ok' END AS status
FROM (SELECT * FROM sl UNION ALL SELECT * FROM nm UNION ALL SELECT * FROM pl)
"""

# none of the fixed override studies occurs in the driver tables, so every
# study takes the priority pick
SECTION_ORACLES["sectioner_overrides"] = "WITH " + sections_sql() + ", " + PICK + """
SELECT study_id, report, 'ok' AS status FROM pick
"""

# the job writes the pick and reads it back
SECTION_ORACLES["job_section_files"] = SECTION_ORACLES["last_section_pick"]


def _attach():
    from studybank.plans.registry import ORACLES, QUERIES
    for name, sql in SECTION_ORACLES.items():
        if name in QUERIES:
            ORACLES[name] = sql.strip()


_attach()
