"""The registered queries as DuckDB SQL, written independently of the Spark operators.

Headers are taken apart with whole-message regular expressions here, positions come from one global
window and exact segments from a recursive query.
"""

from logweir.functions import fixed
from logweir.plans.settings import (
    CONSOLE_EXCLUDE, CONSOLE_INCLUDE, FORWARD_RULES, PAGE_AT, PAGE_SINCE, POLLED, POSITIONS,
    RARE, ROUTES,
)

_MONTHS = "|".join(fixed.MONTHS)
_PRI = r"<([0-9]{1,2}|1[0-8][0-9]|19[01]|0[0-9]{2})>"
_R5 = (
    r"\A" + _PRI + r"0?1 ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*) ([^ ]*)(?:( )([\s\S]*))?\z"
)
_R3 = (
    r"\A" + _PRI + r"((?:" + _MONTHS + r") +(?:0?[1-9]|[12][0-9]|3[01]) +"
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]) ?([^ ]*)(?:( )([\s\S]*))?\z"
)


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_EVENTS = """
e AS (
  SELECT *, CAST((event_id * 37) % 200 AS VARCHAR) AS pri,
    'host' || CAST(user_id % 20 AS VARCHAR) AS host,
    event_type || ' value=' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)
      || ' props=' || props AS body,
    strftime(ts, '%H:%M:%S') AS hms,
    """ + _list(fixed.MONTHS) + """[month(ts)] || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') AS md,
    strftime(ts, '%Y-%m-%d') AS ymd
  FROM events),
dg AS (
  SELECT event_id AS seq, date_trunc('second', ts) AS rcv,
    '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS src,
    CASE
      WHEN event_id % 10 <= 4 THEN '<' || pri || '>' || md || ' ' || hms || ' ' || host || ' '
        || event_type || '[' || CAST(user_id AS VARCHAR) || ']: ' || body
      WHEN event_id % 10 <= 6 THEN '<' || pri || '>1 ' || ymd || 'T' || hms || 'Z ' || host || ' '
        || event_type || ' ' || CAST(user_id AS VARCHAR) || ' ID' || CAST(event_id % 50 AS VARCHAR)
        || ' [meta k="1"] ' || body
      WHEN event_id % 10 = 7 THEN '<' || pri || '>1 - - - - - - ' || body
      WHEN event_id % 10 = 8 THEN '<' || pri || '>' || md || ' ' || hms || ' ' || host || ' '
        || event_type || ' plain text ' || CAST(event_id AS VARCHAR)
      ELSE props END AS payload
  FROM e)"""

_DOCUMENTS = """
dg AS (
  SELECT doc_id AS seq, TIMESTAMP '2026-01-01 00:00:00' AS rcv, source AS src,
    '<' || CAST((doc_id * 13) % 192 AS VARCHAR) || '>1 - ' || source || ' ' || lang || ' '
      || CAST(doc_id AS VARCHAR) || ' - ' || text AS payload
  FROM documents)"""

# Sent as ISO-8859-1, every accented letter is one byte that starts no well-formed sequence (the
# letters are U+00C0-U+00FC, and no continuation byte 80-BF ever follows).
_LATIN1_DOCUMENTS = _DOCUMENTS.replace("|| text", "|| regexp_replace(text, '[^\\x00-\\x7F]', '\ufffd', 'g')")

_CONVERSATIONS = """
dg AS (
  SELECT conv_id * 1000 + turn AS seq, TIMESTAMP '2026-01-01 00:00:00' AS rcv, role AS src,
    '<' || CAST((conv_id + turn) % 192 AS VARCHAR) || '>Mar  4 05:06:07 chat ' || role || '['
      || CAST(conv_id AS VARCHAR) || ']: ' || text AS payload
  FROM conversations)"""

_PARSED = f"""
x AS (
  SELECT seq, strftime(rcv, '%Y-%m-%dT%H:%M:%SZ') AS rcv, src,
    regexp_replace(payload, '[\\r\\n]+\\z', '') AS raw FROM dg),
g AS (
  SELECT *,
    regexp_matches(raw, '{_R5}') AS is5,
    regexp_extract(raw, '{_R5}', ['pri','ts','host','app','pid','msgid','sp','msg']) AS a,
    regexp_matches(raw, '{_R3}') AS is3,
    regexp_extract(raw, '{_R3}', ['pri','ts','host','sp','rest']) AS b
  FROM x),
t AS (
  SELECT *, instr(b.rest, ':') AS colon,
    CASE WHEN instr(b.rest, ':') > 0 THEN left(b.rest, instr(b.rest, ':') - 1)
      ELSE split_part(b.rest, ' ', 1) END AS tag,
    CASE WHEN instr(b.rest, ':') > 0
        THEN regexp_replace(substr(b.rest, instr(b.rest, ':') + 1), '\\A ', '')
      WHEN instr(b.rest, ' ') > 0 THEN substr(b.rest, instr(b.rest, ' ') + 1)
      ELSE '' END AS body
  FROM g),
u AS (
  SELECT *, CASE WHEN is5 THEN 'RFC5424' WHEN is3 THEN 'RFC3164' ELSE 'UNKNOWN' END AS proto,
    CAST(CASE WHEN is5 THEN a.pri WHEN is3 THEN b.pri END AS INTEGER) AS pri,
    regexp_matches(tag, '\\A([^\\[]*)\\[([\\s\\S]*)\\]\\z') AS boxed,
    regexp_extract(tag, '\\A([^\\[]*)\\[([\\s\\S]*)\\]\\z', ['app','pid']) AS box
  FROM t),
p AS (
  SELECT seq, rcv, src, raw, proto, pri,
    CAST(pri // 8 AS INTEGER) AS facility_code, CAST(pri % 8 AS INTEGER) AS severity_code,
    CASE WHEN is5 THEN 1 END AS version,
    {_list(fixed.FACILITY_NAMES)}[pri // 8 + 1] AS facility,
    {_list(fixed.SEVERITY_NAMES)}[pri % 8 + 1] AS severity,
    CASE WHEN is5 THEN nullif(a.host, '-')
      WHEN is3 AND NOT (b.host = '' AND b.sp = '') THEN b.host END AS hostname,
    CASE WHEN is5 THEN nullif(a.app, '-')
      WHEN is3 THEN nullif(CASE WHEN boxed THEN box.app ELSE rtrim(tag, ' ') END, '') END AS app,
    CASE WHEN is5 THEN nullif(a.pid, '-')
      WHEN is3 AND boxed THEN nullif(box.pid, '') END AS pid,
    CASE WHEN is5 AND NOT (a.msgid = '' AND a.sp = '') THEN nullif(a.msgid, '-') END AS msgid,
    CASE WHEN is5 THEN nullif(a.ts, '-') WHEN is3 THEN b.ts END AS msg_time,
    CASE WHEN is5 THEN a.msg WHEN is3 THEN body ELSE raw END AS message
  FROM u)"""

_LINES = """
l AS (
  SELECT *, CAST(to_json({'rcv': rcv, 'src': src, 'proto': proto, 'facility': facility,
    'severity': severity, 'hostname': hostname, 'app': app, 'pid': pid, 'msgid': msgid,
    'msg_time': msg_time, 'message': message}) AS VARCHAR) AS line
  FROM p),
n AS (SELECT *, CAST(strlen(line) + 1 AS BIGINT) AS nbytes FROM l),
w AS (
  SELECT *, CAST(coalesce(sum(nbytes) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM n)"""


def _values(rows) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


_CODES = _values(list(fixed.FACILITY_CODES.items()))
_ROUTES = f"""
routes(sink, facility_spec, include_malformed, write_text, write_jsonl, max_bytes, max_files) AS
  (SELECT * FROM {_values(ROUTES)} AS v),
codes(name, code) AS (SELECT * FROM {_CODES} AS v),
names AS (
  SELECT sink, lower(trim(unnest(string_split(facility_spec, ',')))) AS name
  FROM routes WHERE facility_spec IS NOT NULL AND facility_spec NOT LIKE '%*%'),
compiled AS (
  SELECT DISTINCT sink, code AS facility_code FROM names JOIN codes USING (name)
  UNION ALL SELECT sink, NULL FROM routes
  WHERE facility_spec IS NULL OR facility_spec LIKE '%*%')"""
_ROUTED = """
routed AS (
  SELECT r.*, n.* FROM n JOIN routes r ON
    EXISTS (SELECT 1 FROM compiled c WHERE c.sink = r.sink
      AND (c.facility_code IS NULL OR c.facility_code = n.facility_code))
    AND (n.proto <> 'UNKNOWN' OR r.include_malformed)),
sized AS (
  SELECT *, CAST(CASE WHEN write_text THEN strlen(raw) + 1 ELSE 0 END AS BIGINT) AS text_bytes,
    CAST(CASE WHEN write_jsonl THEN nbytes ELSE 0 END AS BIGINT) AS json_bytes
  FROM routed),
placed AS (
  SELECT *,
    CAST(coalesce(sum(text_bytes) OVER before, 0) AS BIGINT) AS text_pos,
    CAST(coalesce(sum(json_bytes) OVER before, 0) AS BIGINT) AS json_pos,
    CAST(coalesce(sum(nbytes) OVER before, 0) AS BIGINT) AS pos
  FROM sized
  WINDOW before AS (PARTITION BY sink ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING))"""
# The first row of the next segment is the first one at which a counter has reached the limit.
_SEGMENTS = """
starts AS (
  SELECT sink, CAST(0 AS BIGINT) AS generation, min(seq) AS seq, CAST(0 AS BIGINT) AS text_pos,
    CAST(0 AS BIGINT) AS json_pos
  FROM placed GROUP BY sink
  UNION ALL
  SELECT p.sink, s.generation + 1, min(p.seq), min(p.text_pos), min(p.json_pos)
  FROM starts s JOIN placed p ON p.sink = s.sink
    AND (p.text_pos >= s.text_pos + p.max_bytes OR p.json_pos >= s.json_pos + p.max_bytes)
  GROUP BY p.sink, s.generation),
cut AS (
  SELECT p.*, s.generation FROM placed p ASOF JOIN starts s ON p.sink = s.sink AND p.seq >= s.seq),
latest AS (SELECT sink, max(generation) AS latest FROM cut GROUP BY sink),
aged AS (SELECT cut.*, latest - generation AS age FROM cut JOIN latest USING (sink))"""
_RULES = f"""
rules(target, enabled, facility_spec, max_message_size) AS
  (SELECT * FROM {_values(FORWARD_RULES)} AS v),
codes(name, code) AS (SELECT * FROM {_CODES} AS v),
wanted AS (
  SELECT target, code FROM (
    SELECT target, lower(trim(unnest(string_split(facility_spec, ',')))) AS name
    FROM rules WHERE facility_spec IS NOT NULL) JOIN codes USING (name)),
fw AS (
  SELECT p.*, r.target, r.max_message_size AS lim, strlen(raw) AS size,
    '[TRUNCATED: ' || CAST(strlen(raw) AS VARCHAR) || ' bytes]' AS note
  FROM p JOIN rules r ON r.enabled AND (coalesce(r.facility_spec, '*') = '*' OR
    EXISTS (SELECT 1 FROM wanted w WHERE w.target = r.target AND w.code = p.facility_code))),
fwd AS (
  SELECT target, seq, CASE WHEN lim = 0 OR size <= lim THEN raw
    WHEN strlen(note) >= lim THEN left(raw, lim)
    ELSE left(raw, lim - strlen(note)) || note END AS payload
  FROM fw)"""


def _q(body: str, *ctes: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(ctes) + "\n" + body


def _log(body: str, dg: str = _EVENTS) -> str:
    return _q(body, dg, _PARSED, _LINES)


def _parsed(body: str) -> str:
    return _q(body, _EVENTS, _PARSED)


def _routed(body: str) -> str:
    return _q(body, _EVENTS, _PARSED, _LINES, _ROUTES, _ROUTED)


def _segmented(body: str) -> str:
    return _q(body, _EVENTS, _PARSED, _LINES, _ROUTES, _ROUTED, _SEGMENTS, recursive=True)


_ALL = (
    "seq, rcv, src, proto, pri, facility_code, severity_code, version, facility, severity, "
    "hostname, app, pid, msgid, msg_time, message, raw"
)
_RECORD = ", ".join(fixed.RECORD_FIELDS)
_HIT = "seq, pos, line"
_ERR = "severity IN ('EMERGENCY', 'ALERT', 'CRITICAL', 'ERROR')"
_COMBINED = (
    "severity IN ('ERROR', 'WARNING', 'NOTICE') AND facility IN ('auth', 'mail', 'local3', 'cron') "
    "AND (contains(lower(line), 'purchase') OR contains(lower(line), 'host1')) "
    "AND NOT contains(lower(line), 'value=1')"
)
_CONSOLE = (
    "(" + " OR ".join(f"contains(lower(message), '{p.lower()}')" for p in CONSOLE_INCLUDE) + ")"
    + "".join(f" AND NOT contains(lower(message), '{p.lower()}')" for p in CONSOLE_EXCLUDE)
)
_SHORT = "'[' || substr(rcv, 6, 5) || ' ' || substr(rcv, 12, 8) || ']'"
_TEXT = (
    f"concat_ws(' ', {_SHORT}, facility, severity, hostname, app, "
    "CASE WHEN pid <> '' THEN '[' || pid || ']' END, message)"
)


def _facility_label(column: str = "facility") -> str:
    return f"coalesce(lower({column}), 'unknown')"


def _summary(page: str, start: str, following: str) -> str:
    return f"""
SELECT count(*) AS lines,
  CAST(CASE WHEN t.total = 0 THEN 0 WHEN count(*) = 0 THEN {start} ELSE min(pos) END AS BIGINT)
    AS first_offset,
  CAST({following} AS BIGINT) AS next_offset,
  t.total AS total, t.total AS tail_offset
FROM (SELECT CAST(coalesce(sum(nbytes), 0) AS BIGINT) AS total FROM w) t LEFT JOIN ({page}) g ON true
GROUP BY t.total"""


def _locations() -> str:
    ask = _values([(p,) for p in POSITIONS])
    return f"""
SELECT CAST(a.position AS BIGINT) AS position, s.generation AS generation,
  CAST(least(a.position - s.start, s.size) AS BIGINT) AS "offset"
FROM {ask} AS a(position) ASOF JOIN (
  SELECT generation, min(pos) AS start, sum(nbytes) AS size FROM cut WHERE sink = 'main'
  GROUP BY generation) s ON a.position >= s.start"""


def sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    details = ", ".join(
        f"{{'ord': {i}, 'label': '{label}', 'value': coalesce({name}, '—')}}"
        for i, (name, label) in enumerate(fixed.DETAIL_LABELS)
    )
    hit = "contains(lower(line), 'value=2')"
    numbered = f"""
SELECT seq, pos, k, shown, total_matches,
  CASE WHEN total_matches > shown
    THEN format('{{}} / {{}} (of {{}})', k, shown, total_matches)
    ELSE format('{{}} / {{}}', k, total_matches) END AS counter,
  CAST(k % shown + 1 AS INTEGER) AS next_k,
  CASE WHEN k = 1 THEN shown ELSE k - 1 END AS prev_k
FROM (
  SELECT seq, pos, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS k,
    CAST(count(*) OVER () AS INTEGER) AS shown,
    (SELECT count(*) FROM w WHERE {hit}) AS total_matches
  FROM (SELECT * FROM w WHERE {hit} ORDER BY pos LIMIT 200))"""
    per_segment = """
SELECT sink, generation, count(*) AS lines, CAST(sum(nbytes) AS BIGINT) AS bytes,
  min(pos) AS first_pos, min(seq) AS first_seq, max(seq) AS last_seq
FROM cut GROUP BY sink, generation"""
    forward = f"SELECT * FROM w WHERE pos >= {PAGE_AT} AND {_COMBINED} ORDER BY pos LIMIT 20"
    backward = f"SELECT * FROM w WHERE pos < {PAGE_AT} AND {_ERR} ORDER BY pos DESC LIMIT 50"
    return {
        "parse_all": _parsed(f"SELECT {_ALL} FROM p"),
        "parse_documents": _q(f"SELECT {_ALL} FROM p", _DOCUMENTS, _PARSED),
        "parse_conversations": _q(f"SELECT {_ALL} FROM p", _CONVERSATIONS, _PARSED),
        "repair_latin1": _log("SELECT seq, app, message, nbytes FROM n", _LATIN1_DOCUMENTS),
        "pri_decode": _parsed(
            "SELECT seq, pri, facility_code, severity_code, facility, severity FROM p"
        ),
        "proto_counts": _parsed("SELECT proto, count(*) AS n FROM p GROUP BY proto"),
        "urgent_messages": _parsed(
            f"SELECT seq, rcv, severity, hostname, app, message FROM p WHERE {_ERR} "
            "AND app IS NOT NULL"
        ),
        "facility_facet": _parsed(
            f"SELECT {_facility_label()} AS label, count(*) AS n FROM p GROUP BY 1"
        ),
        "facility_labels": _parsed(f"SELECT DISTINCT {_facility_label()} AS label FROM p"),
        "severity_counts": _parsed(
            "SELECT coalesce(upper(severity), 'UNKNOWN') AS label, count(*) AS n FROM p GROUP BY 1"
        ),
        "route_fanout": _routed("SELECT sink, seq, proto, facility FROM routed"),
        "route_counts": _routed("SELECT sink, count(*) AS n FROM routed GROUP BY sink"),
        "select_forwards": _q(
            "SELECT target, seq, proto, facility FROM fw", _EVENTS, _PARSED, _RULES
        ),
        "forward_truncated": _q(
            "SELECT target, seq, payload, CAST(strlen(payload) AS INTEGER) AS size FROM fwd",
            _EVENTS, _PARSED, _RULES,
        ),
        "stream_forward": _q("SELECT target, seq, payload FROM fwd", _EVENTS, _PARSED, _RULES),
        "forward_outbox": _q("SELECT target, seq, payload FROM fwd", _EVENTS, _PARSED, _RULES),
        "jsonl_lines": _log("SELECT seq, line FROM l"),
        "jsonl_documents": _log("SELECT seq, line, nbytes FROM n", _DOCUMENTS),
        "jsonl_round_trip": _log(f"SELECT seq, {_RECORD} FROM l"),
        "jsonl_sink": _log(f"SELECT {_RECORD}, line FROM l"),
        "text_sink": _routed("SELECT sink, raw FROM sized WHERE write_text"),
        "filter_sev": _log(f"SELECT {_HIT} FROM w WHERE severity IN ('ERROR', 'WARNING')"),
        "filter_fac": _log(f"SELECT {_HIT} FROM w WHERE facility IN ('auth', 'cron')"),
        "filter_fac_codes": _parsed("SELECT seq, facility_code FROM p WHERE facility_code IN (4, 15)"),
        "filter_inc_exc": _log(
            f"SELECT {_HIT} FROM w WHERE (contains(lower(line), 'signup') "
            "OR contains(lower(line), 'host7')) AND NOT contains(lower(line), 'value=1')"
        ),
        "filter_combined": _log(f"SELECT {_HIT} FROM w WHERE {_COMBINED}"),
        "filter_raw_lines": _log(f"SELECT seq, line FROM w WHERE {_COMBINED}"),
        "filter_message": _log(f"SELECT seq, message FROM w WHERE {_CONSOLE}"),
        "hide_sev": _log(
            f"SELECT {_HIT} FROM w WHERE severity IS NOT NULL "
            "AND severity NOT IN ('DEBUG', 'INFO', 'EMERGENCY')"
        ),
        "keep_malformed": _parsed("SELECT seq, proto FROM p WHERE proto <> 'UNKNOWN'"),
        "drop_bad_lines": _parsed(
            "SELECT seq, raw AS line FROM p WHERE starts_with(raw, '{')"
        ),
        "positions": _log("SELECT seq, nbytes, pos FROM w"),
        "positions_documents": _log("SELECT seq, nbytes, pos FROM w", _DOCUMENTS),
        "positions_by_sink": _routed("SELECT sink, seq, nbytes, pos FROM placed"),
        "log_summary": _log(
            "SELECT CAST(sum(nbytes) AS BIGINT) AS total, CAST(sum(nbytes) AS BIGINT) "
            "AS tail_offset FROM w"
        ),
        "locate": _segmented(_locations()),
        "page_forward": _log(f"SELECT {_HIT} FROM ({forward})"),
        "page_forward_summary": _log(_summary(
            forward, str(PAGE_AT),
            f"CASE WHEN count(*) = 0 THEN {PAGE_AT} WHEN count(*) = 20 "
            "THEN max(pos + nbytes) ELSE t.total END",
        )),
        "page_backward": _log(f"SELECT {_HIT} FROM ({backward})"),
        "page_backward_summary": _log(_summary(backward, str(PAGE_AT), str(PAGE_AT))),
        "tail_n": _log(f"SELECT {_HIT} FROM w ORDER BY pos DESC LIMIT 200"),
        "tail_filtered": _log(f"SELECT {_HIT} FROM w WHERE {_ERR} ORDER BY pos DESC LIMIT 200"),
        "tail_console": _log(
            f"SELECT text FROM (SELECT pos, {_TEXT} AS text FROM w WHERE {_CONSOLE} "
            "ORDER BY pos DESC LIMIT 10)"
        ),
        "since_page": _log(
            f"SELECT {_HIT} FROM w WHERE pos >= {PAGE_SINCE} ORDER BY pos DESC LIMIT 200"
        ),
        "context": _log(
            f"SELECT {_HIT} FROM w WHERE pos >= (SELECT min(pos) FROM w WHERE {hit}) "
            "ORDER BY pos LIMIT 200"
        ),
        "show_all": _log(f"SELECT pos, {_TEXT} AS text FROM w WHERE {_CONSOLE}"),
        "latest_rows": _log(f"SELECT {_HIT} FROM w WHERE {hit} ORDER BY pos DESC LIMIT 2000"),
        "search_hits": _log(f"SELECT {_HIT} FROM w WHERE {hit} AND {_ERR} ORDER BY pos LIMIT 200"),
        "search_total": _log(
            f"SELECT count(*) AS total_matches FROM w WHERE {hit} AND {_ERR}"
        ),
        "search_numbered": _log(numbered),
        "search_documents": _log(
            "SELECT seq, pos FROM w WHERE contains(lower(line), 'license') ORDER BY pos LIMIT 200",
            _DOCUMENTS,
        ),
        "search_documents_total": _log(
            "SELECT count(*) AS total_matches FROM w WHERE contains(lower(line), 'license')",
            _DOCUMENTS,
        ),
        "search_conversations_total": _log(
            "SELECT count(*) AS total_matches FROM w WHERE contains(lower(line), 'data') "
            "AND pos >= 10000", _CONVERSATIONS,
        ),
        "segments_exact": _segmented("SELECT sink, seq, generation FROM cut"),
        "segment_table": _segmented(
            "SELECT sink, generation, min(pos) AS start, CAST(sum(nbytes) AS BIGINT) AS size, "
            "count(*) AS lines FROM cut GROUP BY sink, generation"
        ),
        "segment_ages": _segmented("SELECT sink, seq, age FROM aged"),
        "retained": _segmented(
            "SELECT sink, seq, generation FROM aged WHERE max_files = 0 OR age <= max_files"
        ),
        "retained_positions": _segmented(
            "SELECT sink, seq, pos - min(pos) OVER (PARTITION BY sink) AS rel_pos "
            "FROM aged WHERE max_files = 0 OR age <= max_files"
        ),
        "stored_table": _segmented(per_segment),
        "stored_tail": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND {_ERR} ORDER BY pos DESC LIMIT 100"
        ),
        "stored_page": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND pos >= {PAGE_AT} AND {_ERR} "
            "ORDER BY pos LIMIT 100"
        ),
        "expired_dropped": _segmented(
            "SELECT sink, generation, count(*) AS lines FROM aged "
            "WHERE max_files = 0 OR age <= max_files GROUP BY sink, generation"
        ),
        "log_chain": _segmented(
            "SELECT age, pos - (SELECT min(pos) FROM aged "
            "WHERE sink = 'main' AND age <= 10) AS pos, nbytes, line "
            "FROM aged WHERE sink = 'main' AND age <= 10"
        ),
        "log_chain_all": _segmented("SELECT age, pos, nbytes, line FROM aged WHERE sink = 'main'"),
        "chain_page": _segmented(
            f"SELECT pos, line FROM aged WHERE sink = 'main' AND pos >= {PAGE_AT} AND {_COMBINED} "
            "ORDER BY pos LIMIT 20"
        ),
        "chain_tail": _segmented(
            f"SELECT pos, line FROM aged WHERE sink = 'main' AND {_ERR} ORDER BY pos DESC LIMIT 200"
        ),
        "chain_search": _segmented(
            f"SELECT pos, line FROM aged WHERE sink = 'main' AND {hit} AND {_ERR} ORDER BY pos LIMIT 200"
        ),
        "chain_search_total": _segmented(
            f"SELECT count(*) AS total_matches FROM aged WHERE sink = 'main' AND {hit} AND {_ERR}"
        ),
        "landed_datagrams": _q(
            "SELECT seq, strftime(rcv, '%Y-%m-%dT%H:%M:%SZ') AS rcv, src, payload FROM dg", _EVENTS
        ),
        "stream_ingest": _segmented(per_segment.replace(
            "FROM cut", "FROM aged WHERE max_files = 0 OR age <= max_files"
        )),
        "ingest_text": _segmented(
            "SELECT sink, generation, raw AS line FROM aged "
            "WHERE write_text AND (max_files = 0 OR age <= max_files)"
        ),
        "ingest_jsonl": _segmented(
            "SELECT sink, generation, line FROM aged "
            "WHERE write_jsonl AND (max_files = 0 OR age <= max_files)"
        ),
        "ingest_retained": _segmented(
            "SELECT sink, generation, count(*) AS lines, count(*) AS stored_lines FROM aged "
            "WHERE max_files = 0 OR age <= max_files GROUP BY sink, generation"
        ),
        "stream_follow_sink": _segmented(
            "SELECT line FROM aged WHERE sink = 'jobs' AND (max_files = 0 OR age <= max_files)"
        ),
        "follow_from_end": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND pos >= "
            "(SELECT sum(nbytes) // 2 FROM cut WHERE sink = 'main')"
        ),
        "stored_backward": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND pos < {PAGE_AT} AND {_ERR} "
            "ORDER BY pos DESC LIMIT 50"
        ),
        "stored_search": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND {hit} AND {_ERR} ORDER BY pos LIMIT 200"
        ),
        "stored_search_total": _segmented(
            f"SELECT count(*) AS total_matches FROM cut WHERE sink = 'main' AND {hit} AND {_ERR}"
        ),
        "stored_since": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND pos >= {PAGE_SINCE} ORDER BY pos DESC LIMIT 200"
        ),
        "stored_rare": _segmented(
            f"SELECT {_HIT} FROM cut WHERE sink = 'main' AND contains(lower(line), '{RARE.lower()}') "
            "ORDER BY pos LIMIT 200"
        ),
        "stored_locate": _segmented(_locations()),
        "stored_facet": _segmented(
            f"SELECT {_facility_label()} AS label, count(*) AS n FROM cut WHERE sink = 'main' GROUP BY 1"
        ),
        "stored_segments": _segmented(
            "SELECT sink, generation, min(pos) AS start, CAST(sum(nbytes) AS BIGINT) AS size, "
            "count(*) AS lines FROM cut GROUP BY sink, generation"
        ),
        "poll_lines": _segmented(
            f"SELECT CAST((row_number() OVER (ORDER BY pos) - 1) // {fixed.POLL_LINES} AS INTEGER) AS poll, "
            f"seq, pos FROM cut WHERE sink = '{POLLED}'"
        ),
        "ingest_compacted": _segmented(per_segment.replace(
            "FROM cut", "FROM aged WHERE max_files = 0 OR age <= max_files"
        )),
        "ingest_arrivals": _segmented(
            "SELECT * REPLACE ((SELECT count(*) FROM dg WHERE dg.seq < first_seq) AS first_seq, "
            "(SELECT count(*) FROM dg WHERE dg.seq < last_seq) AS last_seq) FROM (" + per_segment.replace(
                "FROM cut", "FROM aged WHERE max_files = 0 OR age <= max_files") + ")"
        ),
        "ingest_facets": _segmented(
            "SELECT sink, severity AS name, count(*) AS n FROM aged "
            "WHERE max_files = 0 OR age <= max_files GROUP BY sink, severity"
        ),
        "ingest_summary": _segmented(
            "SELECT sink, CAST(sum(nbytes) FILTER (max_files = 0 OR age <= max_files) AS BIGINT) AS kept_bytes, "
            "count(*) FILTER (max_files = 0 OR age <= max_files) AS kept_lines, "
            "CAST(sum(nbytes) AS BIGINT) AS tail_offset FROM aged GROUP BY sink"
        ),
        "stream_follow": _log(f"SELECT {_TEXT} AS text FROM w WHERE {_CONSOLE}"),
        "format_line": _log(f"SELECT seq, {_TEXT} AS text FROM w"),
        "format_line_columns": _log(
            "SELECT seq, concat_ws(' ', message, '[' || substr(rcv, 12, 8) || ']', src, proto, "
            "msgid) AS text FROM w"
        ),
        "grid_view": _log(
            "SELECT seq, coalesce(msg_time, '') AS time, src, coalesce(app, '') AS app, "
            "coalesce(upper(severity), 'UNKNOWN') AS sev, message FROM w"
        ),
        "grid_view_local": _log(
            "SELECT seq, coalesce(msg_time, '') AS time, strftime(CAST(replace(replace(rcv, 'T', "
            "' '), 'Z', '') AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS rcv, src, "
            "coalesce(hostname, '') AS hostname, coalesce(app, '') AS app, "
            "coalesce(pid, '') AS pid, coalesce(upper(severity), 'UNKNOWN') AS sev, proto, "
            "coalesce(msgid, '') AS msgid, message FROM w"
        ),
        "detail_view": _log(
            f"SELECT seq, d.ord AS ord, d.label AS label, d.value AS value FROM "
            f"(SELECT seq, unnest([{details}]) AS d FROM w)"
        ),
        "completeness": _parsed(
            "SELECT e.seq AS seq, count(p.seq) AS copies FROM (SELECT unnest(range(min(event_id), "
            "max(event_id) + 1)) AS seq FROM events) e LEFT JOIN p ON p.seq = e.seq "
            "AND p.proto <> 'UNKNOWN' GROUP BY e.seq HAVING count(p.seq) <> 1"
        ),
        "completeness_fanout": _routed(
            "SELECT e.seq AS seq, count(r.seq) AS copies FROM (SELECT unnest(range(min(event_id), "
            "max(event_id) + 1)) AS seq FROM events) e LEFT JOIN routed r ON r.seq = e.seq "
            "GROUP BY e.seq HAVING count(r.seq) <> 1"
        ),
        "completeness_batches": _routed(
            "SELECT e.seq AS seq, count(r.seq) AS copies FROM (SELECT unnest(range(min(seq), "
            "max(seq) + 1)) AS seq FROM routed) e LEFT JOIN routed r ON r.seq = e.seq "
            "GROUP BY e.seq HAVING count(r.seq) <> 1"
        ),
    }
