"""SQL of the longer checks: entries of all layouts, nested records."""

from __future__ import annotations

from tidelog.operators.templates import LEVELS


def _level_sql(text: str) -> str:
    words: dict[str, list[str]] = {}
    for w, to in LEVELS.items():
        words.setdefault(to, []).append(w)
    cases = " ".join(f"WHEN lower({text}) IN ({', '.join(repr(w) for w in ws)}) THEN '{to}'" for to, ws in words.items())
    return f"CASE {cases} ELSE '' END"


ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
SEC = r"1\d{9}(?:\.\d+)?"
# The layouts of the test tables, written down by hand: kind of time, regex, and the groups of time, level, component.
HEADS = (
    ("iso", rf"^({ISO}) +([A-Za-z]+) +\[([\w.\-]+)\]", 1, 2, 3),
    ("iso", rf"^({ISO}) +\[[\w\-]+\] +([A-Za-z]+) +([\w.\-]+) +-", 1, 2, 3),
    ("iso", rf"^\[({ISO}): +([A-Za-z]+)/([\w.\-]+)\]", 1, 2, 3),
    ("iso", r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?) +UTC +\[\d+\] +([\w.\-]+) +([A-Za-z]+):", 1, 3, 2),
    ("clf", r"^\d{1,3}(?:\.\d{1,3}){3} - - \[(\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\]", 1, 0, 0),
    ("bsd", r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) +\S+ +([A-Za-z_][\w\-]*)\[\d+\]:", 1, 0, 2),
    ("bsd", r"^([A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d) +", 1, 0, 0),
    ("sec", rf"^({SEC})\|([A-Za-z]+)\|([\w.\-]+)\|", 1, 2, 3),
    ("compact", r"^([A-Z])(\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ +([\w.\-]+):\d+\]", 2, 1, 3),
    ("clock", r"^(\d\d:\d\d:\d\d(?:[.,]\d+)?) +([A-Za-z]+)/([\w.\-]+):", 1, 2, 3),
    ("", r"^([A-Za-z]+):([\w\-]+\.[\w.\-]+):", 0, 1, 2),
    ("iso", rf"^ts=({ISO}) level=([A-Za-z]+) component=([\w.\-]+)", 1, 2, 3),
    ("sec", rf'^severity=([A-Za-z]+) logger=([\w.\-]+) msg="(?:[^"\\]|\\.)*" ts=({SEC})', 3, 1, 2),
    ("iso", rf'^level=([A-Za-z]+) time="({ISO})" msg="(?:[^"\\]|\\.)*" component="([\w.\-]+)"', 2, 1, 3),
    ("iso", rf'^\{{\s*"time"\s*:\s*"({ISO})"\s*,\s*"level"\s*:\s*"([A-Za-z]+)"\s*,\s*"logger"\s*:\s*"([\w.\-]+)"', 1, 2, 3),
    ("iso", rf'^\{{\s*"@timestamp"\s*:\s*"({ISO})"\s*,\s*"log"\s*:\s*\{{\s*"level"\s*:\s*"([A-Za-z]+)"\s*,\s*"logger"\s*:\s*"([\w.\-]+)"', 1, 2, 3),
    ("ms", r'^\{\s*"severity"\s*:\s*"([A-Za-z]+)"\s*,\s*"msg"\s*:\s*"(?:[^"\\]|\\.)*"\s*,\s*"component"\s*:\s*"([\w.\-]+)"\s*,\s*"ts"\s*:\s*(1\d{12})', 3, 1, 2),
)


LEVEL_SQL = _level_sql("lv")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(value) -> str:
    return "CASE h " + " ".join(f"WHEN {i} THEN {value(i, x)}" for i, x in enumerate(HEADS)) + " END"


_WHICH = "CASE " + " ".join(f"WHEN regexp_matches(p, {_q(x[1])}) THEN {i}" for i, x in enumerate(HEADS)) + " END"
_GROUP = lambda k: _pick(lambda i, x: f"regexp_extract(p, {_q(x[1])}, {x[k]})" if x[k] else "''")
_STAMP = "epoch_us(TRY_CAST(CASE WHEN regexp_matches({x}, '(Z|[+-]\\d\\d:?\\d\\d)$') THEN {x} ELSE {x} || 'Z' END AS TIMESTAMPTZ))"


def _iso_sql(x: str) -> str:
    """Microseconds; a zone without colon gets one."""
    return _STAMP.format(x=rf"regexp_replace(replace(replace({x}, ',', '.'), '/', '-'), '([+-]\d\d)(\d\d)$', '\1:\2')")


_NEAREST = """(SELECT arg_min(c, (abs(c - ts_us), c)) FROM (SELECT {of} AS c FROM (VALUES (-1), (0), (1)) AS y(k)) WHERE c IS NOT NULL)"""
_YEARLY = _NEAREST.format(of="epoch_us(try_strptime((year(make_timestamp(ts_us)) + k)::VARCHAR || ' ' || {x}, '{f}'))")

#: Physical lines with their layout and what its groups hold; ``gid`` numbers the entries of a stream.
P2_HEADS = f"""lines AS (
  SELECT 'log_entry' AS source_table, coalesce(labels['stream'], '') AS stream, seq AS row_id, 0 AS line_no, epoch_us(ts) AS ts_us, coalesce(line, '') AS line FROM log_entry
  UNION ALL SELECT 'grouped_entry', stream, group_id, k - 1, ts_us, coalesce(all_lines[k], '') FROM (
    SELECT coalesce(labels['stream'], '') AS stream, group_id, epoch_us(ts) AS ts_us, list_concat([line], coalesce(continuation_lines, [])) AS all_lines, unnest(range(1, len(coalesce(continuation_lines, [])) + 2)) AS k FROM grouped_entry)),
 plain AS (SELECT *, rtrim(regexp_replace(line, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM lines),
 which AS (SELECT *, {_WHICH} AS h FROM plain),
 parts AS (SELECT source_table, stream, row_id, line_no, ts_us, h, line, p, {_pick(lambda i, x: _q(x[0]))} AS kind, {_GROUP(2)} AS t, {_GROUP(3)} AS lv, coalesce({_GROUP(4)}, '') AS component FROM which),
 heads AS (SELECT *, sum(CASE WHEN h IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY source_table, stream ORDER BY row_id, line_no) AS gid FROM parts)"""

P2_TIMED = f"""{P2_HEADS},
 entries AS (SELECT source_table, min(row_id) FILTER (h IS NOT NULL) AS row_id, arg_min(line_no, (row_id, line_no)) AS line_no, arg_min(ts_us, (row_id, line_no)) AS ts_us, arg_min(kind, (row_id, line_no)) AS kind, arg_min(t, (row_id, line_no)) AS t, arg_min(lv, (row_id, line_no)) AS lv, arg_min(component, (row_id, line_no)) AS component, CAST(count(*) AS INTEGER) AS n_lines, string_agg(line, chr(10) ORDER BY row_id, line_no) AS entry_text, arg_min(line, (row_id, line_no)) AS message
  FROM heads WHERE gid > 0 GROUP BY source_table, stream, gid),
 timed AS (SELECT source_table, row_id, line_no, coalesce(CASE kind
   WHEN 'iso' THEN {_iso_sql('t')}
   WHEN 'clf' THEN epoch_us(try_strptime(t, '%d/%b/%Y:%H:%M:%S %z'))
   WHEN 'bsd' THEN {_YEARLY.format(x="regexp_replace(t, ' +', ' ', 'g')", f='%Y %b %d %H:%M:%S')}
   WHEN 'compact' THEN {_YEARLY.format(x="t", f='%Y %m%d %H:%M:%S.%f')}
   WHEN 'sec' THEN CAST(CAST(t AS DECIMAL(20, 6)) * 1000000 AS BIGINT)
   WHEN 'ms' THEN CAST(t AS BIGINT) * 1000
   WHEN 'clock' THEN {_NEAREST.format(of="epoch_us(try_strptime(strftime(make_timestamp(ts_us), '%Y-%m-%d ') || rpad(replace(CASE WHEN contains(t, '.') OR contains(t, ',') THEN t ELSE t || '.0' END, ',', '.'), 15, '0'), '%Y-%m-%d %H:%M:%S.%f')) + k * 86400000000")}
  END, ts_us) AS event_us, {LEVEL_SQL} AS log_level, component, n_lines, message, entry_text FROM entries)"""
P2_FOUND = f"WITH {P2_TIMED} SELECT source_table, row_id, line_no, event_us, log_level, component, n_lines FROM timed"
P2_ENTRIES = f"WITH {P2_TIMED} SELECT source_table, row_id, line_no, event_us, log_level, component, message, entry_text FROM timed"

_OPENED = r"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches(json_extract_string({x}, '$'), '^\s*[\[{{]') AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"
_CHILD = "json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1'))"
_KEYS = "unnest(CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS k"

#: Members without positions: one that is an array of objects here and an object there is mixed, however it is reached.
P5_ROWS = f"""recs AS (SELECT 'es_hit' AS source_table, hit_id AS row_id, _source AS t FROM es_hit UNION ALL SELECT 'log_entry', seq, raw FROM log_entry),
 docs AS (SELECT source_table, row_id, {_OPENED.format(x="x")} AS j FROM (SELECT *, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS x FROM recs) WHERE x IS NOT NULL),
 reach AS (
  SELECT source_table, '' AS s, j, FALSE AS named FROM docs
  UNION ALL
  SELECT source_table, CASE WHEN json_type(j) = 'OBJECT' THEN s || '.' || k ELSE s || '[]' END, {_OPENED.format(x=_CHILD)}, json_type(j) = 'OBJECT' FROM (SELECT *, {_KEYS} FROM reach)),
 held AS (SELECT source_table, replace(s, '[]', '') AS s, json_type(j) = 'ARRAY' AS arr FROM reach WHERE named AND (json_type(j) = 'OBJECT' OR (json_type(j) = 'ARRAY' AND len(list_filter(range(CAST(json_array_length(j) AS BIGINT)), lambda i: json_type({_OPENED.format(x="json_extract(j, '/' || i)")}) = 'OBJECT')) > 0))),
 mixed AS (SELECT source_table, s FROM held GROUP BY 1, 2 HAVING bool_or(arr) AND NOT bool_and(arr)),
 walk AS (
  SELECT source_table, row_id, '' AS path, '' AS s, '' AS tab, '' AS parent, j, FALSE AS elem FROM docs
  UNION ALL
  SELECT c.source_table, c.row_id, CASE WHEN c.obj THEN (CASE WHEN c.path = '' THEN k ELSE c.path || '.' || k END) || (CASE WHEN m.s IS NOT NULL AND json_type(c.v) = 'OBJECT' THEN '[0]' ELSE '' END) ELSE c.path || '[' || k || ']' END,
    CASE WHEN c.obj THEN c.s || '.' || k ELSE c.s END,
    CASE WHEN c.obj THEN (CASE WHEN c.path = '' THEN k ELSE c.tab || '.' || k END) || (CASE WHEN m.s IS NOT NULL AND json_type(c.v) = 'OBJECT' THEN '[]' ELSE '' END) ELSE c.tab || '[]' END,
    CASE WHEN c.elem THEN c.path ELSE c.parent END, c.v, json_type(c.v) = 'OBJECT' AND (NOT c.obj OR m.s IS NOT NULL)
  FROM (SELECT *, json_type(j) = 'OBJECT' AS obj, {_OPENED.format(x=_CHILD)} AS v FROM (SELECT *, {_KEYS} FROM walk)) c LEFT JOIN mixed m ON c.obj AND m.source_table = c.source_table AND m.s = c.s || '.' || k),
 found AS (SELECT source_table, row_id, path AS child_path, tab, parent AS parent_path, CAST(len(list_filter(json_keys(j), lambda k: json_type({_CHILD}) <> 'NULL')) AS INTEGER) AS n_fields FROM walk WHERE elem)"""

P5_FOUND = f"WITH RECURSIVE {P5_ROWS} SELECT source_table, row_id, child_path, parent_path, n_fields FROM found"
P5_TABLES = f"WITH RECURSIVE {P5_ROWS} SELECT source_table, tab AS table_path, count(*) AS n_rows, count(DISTINCT row_id) AS n_records, max(n_fields) AS max_fields FROM found GROUP BY 1, 2"
