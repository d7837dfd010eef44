"""DuckDB SQL for the queries of the catalog, written independently of the
library: the regex profiles are applied by DuckDB's RE2 engine as they are."""

from __future__ import annotations

import re

from emberlog.catalog import CUSTOM_PROFILE, K, N, SECRETS
from emberlog.functions.normalize import DEFAULT_PROFILE, EXTENDED_PROFILE
from emberlog.functions.text import SPACES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _normalized(col: str, profile) -> str:
    for r in profile:
        repl = re.sub(r"\$\{(\d)\}", r"\\\1", r.replace).replace("$$", "$")
        col = f"regexp_replace({col}, {_q(r.pattern)}, {_q(repl)}, 'g')"
    return col


LOGS = """logs AS (
  SELECT ts AS event_time, md5('s' || user_id) AS stream_id,
    '{app="app' || (user_id % 3) || '",host="h' || (user_id % 5 + 1) || '"}' AS stream,
    CASE event_id % 6
      WHEN 0 THEN strftime(ts, '%d.%m.%Y %H:%M:%S.%f') || ' +00:00 | E | order uid: '
        || upper(left(md5(event_id::VARCHAR), 16)) || ' rejected'
      WHEN 1 THEN 'connection refused to 10.' || (event_id % 250) || '.1.' || (user_id % 250) || ':8443'
      WHEN 2 THEN 'user=' || substr(md5(event_id::VARCHAR), 1, 8) || '-' || substr(md5(event_id::VARCHAR), 9, 4)
        || '-' || substr(md5(event_id::VARCHAR), 13, 4) || '-' || substr(md5(event_id::VARCHAR), 17, 4)
        || '-' || substr(md5(event_id::VARCHAR), 21, 12) || ' failed'
      WHEN 3 THEN 'timeout after ' || (event_id % 40) || 'ms on shard ' || event_id
      WHEN 4 THEN 'Ошибка' || (event_id % 9) || ' в модуле ' || event_id
      ELSE 'at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' payload ' || props
    END AS msg,
    'h' || (user_id % 5 + 1) AS host, 'app' || (user_id % 3) AS app,
    CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
      WHEN 'view' THEN 'info' ELSE 'debug' END AS level,
    'mod' || (user_id % 2) AS module, 'ingest' AS job
  FROM events)"""

DOC_LOGS = """doc_lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS msg,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
doc_logs AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_seconds(pos) AS event_time,
    md5('d' || doc_id) AS stream_id, '' AS stream, msg, source AS host, lang AS app,
    CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'error' WHEN quality = 1 THEN 'info'
      ELSE 'warn' END AS level, '' AS module, '' AS job
  FROM doc_lines LEFT JOIN labels USING (doc_id))"""

TURN_LOGS = """turn_logs AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id) + to_seconds(turn) AS event_time,
    md5('c' || conv_id) AS stream_id, '' AS stream, text AS msg, 'chat' AS host, role AS app,
    CASE role WHEN 'system' THEN 'critical' WHEN 'user' THEN 'error' ELSE 'info' END AS level,
    '' AS module, '' AS job
  FROM conversations)"""

ALERTS = "alerts AS (SELECT * FROM logs WHERE level IN ('error', 'critical'))"

_RANK = ("CASE level WHEN 'critical' THEN 40 WHEN 'error' THEN 30 WHEN 'warn' THEN 20 WHEN 'warning' THEN 20 "
         "WHEN 'info' THEN 10 WHEN 'debug' THEN 5 ELSE 0 END")
_FP = "sha1(host || chr(0) || app || chr(0) || normalized_msg)"
_LEVEL = f"arg_min(level, row(-({_RANK}), event_time, level))"
_MODULE = "arg_min(module, row(event_time, module))"
_STREAMS = "count(DISTINCT nullif(stream_id, ''))"


def _norm(source: str, name: str = "norm", profile=DEFAULT_PROFILE) -> str:
    return f"{name} AS (SELECT *, {_normalized('msg', profile)} AS normalized_msg FROM {source})"


def _inc(source: str, name: str = "inc", extra: str = "", where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT {extra}host, app, {_FP} AS fingerprint, {_LEVEL} AS level, {_MODULE} AS module, count(*) AS cnt,
    min(event_time) AS first_seen, max(event_time) AS last_seen, {_STREAMS} AS streams, normalized_msg
  FROM {source} WHERE {where} GROUP BY {extra}host, app, normalized_msg)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (LOGS, ALERTS, _norm("alerts"))
INC = (*BASE, _inc("norm"))
DOC = (DOC_LOGS, _norm("doc_logs"))
APPS = """apps AS (SELECT host, app,
    sum(CASE WHEN level = 'error' THEN cnt ELSE 0 END)::BIGINT AS error,
    sum(CASE WHEN level = 'critical' THEN cnt ELSE 0 END)::BIGINT AS critical,
    sum(cnt)::BIGINT AS total FROM inc GROUP BY host, app)"""
HOST_TOTALS = """SELECT host, count(*) FILTER (level = 'error') AS error,
    count(*) FILTER (level = 'critical') AS critical, count(*) AS total FROM {} GROUP BY host"""
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY cnt DESC, first_seen, fingerprint) AS rank
    FROM inc)"""
TOP = f"top AS (SELECT * FROM ranked WHERE cnt >= {K} AND rank <= {N})"
MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"
NOW = "TIMESTAMP '2024-01-30 23:00:00'"
LO, HI = "TIMESTAMP '2024-01-01 05:00:00'", "TIMESTAMP '2024-01-31 05:00:00'"
IN_WINDOW = f"event_time >= {LO} AND event_time < {HI}"
LEDGER = """ledger AS (SELECT md5(strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')) AS run_id,
    date_trunc('hour', ts)::TIMESTAMP AS window_from, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS window_to,
    CASE event_type WHEN 'click' THEN 'cover_sent' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
      ELSE 'started' END AS status, ts AS happened, event_id AS seq, user_id, props FROM events)"""


def _runs(name: str = "runs", where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT run_id, min(window_from) AS window_from, min(window_to) AS window_to,
    coalesce(arg_max(status, row(happened, seq)) FILTER (status <> 'started'), 'started') AS status,
    arg_max(seq, row(happened, seq)) FILTER (status = 'cover_sent') AS cover_msg_id,
    coalesce(arg_max(user_id % 5 + 1, row(happened, seq)) FILTER (status = 'done'), 0) AS files_sent,
    min(happened) AS created_at, max(happened) FILTER (status IN ('done', 'failed')) AS completed_at,
    arg_max(props, row(happened, seq)) FILTER (status = 'failed') AS err
    FROM ledger WHERE {where} GROUP BY run_id)"""


RUNS = (LEDGER, _runs())
NO_NULLS = "SELECT * REPLACE (coalesce(cover_msg_id, -1) AS cover_msg_id, coalesce(err, '') AS err) FROM runs"
WINDOWS = "windows AS (SELECT DISTINCT window_from, window_to FROM ledger)"
EARLY_RUNS = (LEDGER, WINDOWS, _runs(where=f"happened < {MIDDLE}"))
DAILY = (*BASE[:2],
         "dated AS (SELECT *, time_bucket(INTERVAL 24 HOUR, event_time, TIMESTAMP '2024-01-01 05:00:00') AS window_start FROM alerts)",
         _norm("dated"), _inc("norm", extra="window_start, "))
CYCLES = """cycles AS (SELECT ts AS t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' WHEN 'view' THEN 'skipped'
    ELSE 'ok' END AS outcome, CASE WHEN event_type = 'click' THEN user_id % 3 + 1 ELSE 0 END AS errors FROM events)"""
CYCLE_DAYS = """days AS (SELECT date_trunc('day', t)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (outcome IN ('ok', 'partial')) AS ok,
    count(*) FILTER (outcome IN ('failed', 'partial')) AS bad FROM cycles GROUP BY 1)"""
GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN level <> 'warn' THEN event_time END AS event_time, CASE WHEN level <> 'debug' THEN host END AS host) FROM logs)"""


def _rolling(col: str, days: int) -> str:
    return f"(sum({col}) OVER (ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW))::BIGINT"


EDGES = ["0.1", "0.5", "1.0", "5.0", "10.0", "30.0", "60.0", "120.0", "300.0", "600.0", "1200.0", "3600.0"]
EDGE_ROWS = "edges(edge_no, le, upper) AS (VALUES " + ", ".join(
    f"({i}, '{e}', {e}::DOUBLE)" for i, e in enumerate(EDGES)) + f", ({len(EDGES)}, '+Inf', 'inf'::DOUBLE))"


def _seen(source: str) -> str:
    # record by record, without buckets
    return f"""seen AS (SELECT *, lag(event_time) OVER (PARTITION BY host, app, normalized_msg
      ORDER BY event_time, level <> 'critical') AS previous_seen FROM {source})"""


def _new_criticals(days: int, columns: str = ", previous_seen") -> str:
    return f"""SELECT host, app, {_FP} AS fingerprint, event_time{columns} FROM seen
WHERE level = 'critical' AND (previous_seen IS NULL OR event_time - previous_seen > INTERVAL {days} DAY)"""


_URL = ("replace(replace(replace(replace(url_encode({0}), '%20', '+'), '*', '%2A'), '%7E', '~'), '%2520', '%2520')")
_EXPR = """'{host="' || host || '"} level:=' || level || ' app:="' || app || '"'"""
LINKED = f"""linked AS (SELECT *, {_EXPR} AS expr,
    greatest(first_seen - INTERVAL 1 MINUTE, {LO}) AS start_at, least(last_seen + INTERVAL 1 MINUTE, {HI}) AS end_at FROM inc),
ranged AS (SELECT *, CASE WHEN start_at < end_at THEN start_at ELSE {LO} END AS link_from,
    CASE WHEN start_at < end_at THEN end_at ELSE {HI} END AS link_to FROM linked)"""


def _link(expr: str, lo: str, hi: str) -> str:
    panes = (f"""'{{"a":{{"datasource":"ds1","queries":[{{"refId":"A","datasource":{{"uid":"ds1","type":"logs"}},"expr":"' """
             f"""|| replace({expr}, '"', chr(92) || '"') || '"}}],"range":{{"from":"' || (epoch_us({lo}) // 1000) || '","to":"' || (epoch_us({hi}) // 1000) || '"}}}}}}'""")
    return f"'https://logs.example.com/view/explore?orgId=2&panes=' || {_URL.format(panes)} || '&schemaVersion=1'"


def _esc(col: str) -> str:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        col = f"replace({col}, {_q(a)}, {_q(b)})"
    return col


def _masked(col: str) -> str:
    for s in SECRETS:
        if s:
            col = f"replace({col}, {_q(s)}, '***')"
    return col


def _time(t: str) -> str:
    return f"strftime({t} + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S')"


_LINE = f"trim(string_split(text, chr(10))[1], {_q(SPACES)})"
_TITLE = "trim(string_split(normalized_msg, chr(10))[1])"
HOST_ROWS = f"""host_list(host_no, host, label) AS (VALUES (1, 'h1', 'Primary'), (2, 'h2', ''), (3, 'h3', 'Backup'),
    (4, 'h4', ''), (5, 'h5', ''), (6, 'h6', '')),
counts AS ({HOST_TOTALS.format('recs')}),
noise AS (SELECT host, count(*) AS incidents, count(*) FILTER (cnt < {K}) AS below,
    coalesce(sum(cnt) FILTER (cnt < {K}), 0)::BIGINT AS below_records FROM inc GROUP BY host),
listed AS (SELECT host, count(*) AS listed FROM top GROUP BY host),
top_app AS (SELECT host, app AS top_app FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY total DESC, app) AS r
    FROM apps) WHERE r = 1),
host_rows AS (SELECT host_no, host, label, coalesce(error, 0) AS error, coalesce(critical, 0) AS critical,
    coalesce(total, 0) AS total, coalesce(incidents, 0) AS incidents, coalesce(below, 0) AS below,
    coalesce(below_records, 0) AS below_records, coalesce(listed, 0) AS listed, coalesce(top_app, '') AS top_app,
    {_link("'{host=\"' || host || '\"} (level:=error OR level:=critical)'", LO, HI)} AS link
    FROM host_list LEFT JOIN counts USING (host) LEFT JOIN noise USING (host) LEFT JOIN listed USING (host)
    LEFT JOIN top_app USING (host))"""
DIGEST = (LOGS, f"recs AS (SELECT * FROM logs WHERE level IN ('error', 'critical') AND {IN_WINDOW})",
          _norm("recs"), _inc("norm"), APPS, RANKED, TOP, HOST_ROWS)
REPORT = f"""linked_top AS (SELECT r.*, {_link(_EXPR.replace('host ||', 'r.host ||'), 'link_from', 'link_to')} AS link FROM (
    SELECT *, CASE WHEN a < b THEN a ELSE {LO} END AS link_from, CASE WHEN a < b THEN b ELSE {HI} END AS link_to FROM (
      SELECT *, greatest(first_seen - INTERVAL 1 MINUTE, {LO}) AS a, least(last_seen + INTERVAL 1 MINUTE, {HI}) AS b FROM top)) r),
msgs AS (SELECT host, app, normalized_msg, msg, min(event_time) AS t FROM norm GROUP BY ALL),
ex AS (SELECT * FROM (SELECT m.*, top.rank, row_number() OVER (PARTITION BY m.host, m.app, m.normalized_msg ORDER BY t, msg) AS example_no
    FROM msgs m JOIN top USING (host, app, normalized_msg)) WHERE example_no <= 3),
app_rows AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY total DESC, app) AS no FROM apps),
blocks AS (
  SELECT host, 0 AS s, 0 AS i, [
    '# Отчёт по ошибкам: `' || host || '`' || CASE WHEN label <> '' THEN ' (' || label || ')' ELSE '' END, '',
    '**Период:** ' || {_time(LO)} || ' — ' || {_time(HI)} || ' (Europe/Moscow)',
    '**Сгенерирован:** ' || {_time(NOW)}, '',
    '**Итого:** error = **' || error || '**, critical = **' || critical || '**, записей всего: **' || total
      || '**, инцидентов (fingerprint''ов): **' || incidents || '**', ''] || CASE WHEN total = 0
    THEN ['За окно ошибок уровня `error` / `critical` не обнаружено.', '', '[Открыть в Grafana →](' || link || ')', '']
    ELSE ['## Агрегаты по приложениям', '', '| app | error | critical | всего |', '|-----|------:|---------:|------:|'] END AS lines
  FROM host_rows
  UNION ALL SELECT host, 1, no, ['| `' || app || '` | ' || error || ' | ' || critical || ' | ' || total || ' |'] FROM app_rows
  UNION ALL SELECT host, 2, 0, ['', '', '## Топ-' || listed || ' инцидентов', ''] FROM host_rows WHERE total > 0
  UNION ALL SELECT host, 3, rank * 10000, ['### ' || rank || '. [`' || app || '`] ' || {_TITLE}, '',
    '- **count:** ' || cnt, '- **level:** `' || level || '`', '- **module:** `' || module || '`',
    '- **first / last:** ' || {_time('first_seen')} || ' → ' || {_time('last_seen')},
    '- **fingerprint:** `' || left(fingerprint, 12) || '` (уникальных стримов: ' || streams || ')',
    '- **Grafana:** [посмотреть ' || cnt || ' событий →](' || link || ')', '', 'Выдержки:', ''] FROM linked_top
  UNION ALL SELECT host, 3, rank * 10000 + example_no, ['```', msg, '```', ''] FROM ex
  UNION ALL SELECT host, 3, rank * 10000 + 9999, ['', ''] FROM top
  UNION ALL SELECT host, 4, 0, CASE WHEN below > 0 THEN ['## Прочее (ниже шум-порога K={K})', '',
    '**' || below || '** инцидентов, **' || below_records || '** записей. [Открыть в Grafana →](' || link || ')', '', '', '']
    ELSE ['', ''] END FROM host_rows WHERE total > 0),
flat AS (SELECT host, s, i, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM blocks),
report AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY s, i, p) AS ord, line FROM flat)"""
COVER_ROW = f"""rpad(host, 10, ' ') || ' ' || lpad(error::VARCHAR, 6, ' ') || ' ' || lpad(critical::VARCHAR, 6, ' ')
    || '  ' || {_esc('top_app')}"""
_ALL_EXPR = "{host=~\"h1|h2|h3|h4|h5|h6\"} (level:=error OR level:=critical)"
COVER = f"""body AS (SELECT concat_ws(chr(10), '<b>Ежедневный отчёт об ошибках торговых серверов</b>',
    '<b>Период:</b> 01.01.2024 08:00 — 31.01.2024 08:00 (Europe/Moscow)', '', '<b>Итог по серверам:</b>',
    '<pre>host        error   crit  top-app', string_agg({COVER_ROW}, chr(10) ORDER BY host_no), '</pre>', '',
    '<b>Всего:</b> ' || sum(error) || ' error, ' || sum(critical) || ' critical',
    '<b>Уникальных инцидентов:</b> ' || sum(incidents), '',
    '<a href="' || {_link(_q(_ALL_EXPR), LO, HI)} || '">Открыть все за сутки в Grafana →</a>', '', '', '') AS body FROM host_rows)"""

_LOG_COLS = "event_time, stream_id, stream, msg, host, app, level, module, job"
_THROTTLE = f"""secs AS (SELECT host, app, {_FP} AS fingerprint, epoch_us(event_time) AS s, count(*) AS n
    FROM norm WHERE level = 'critical' GROUP BY host, app, normalized_msg, s),
nexts AS (SELECT a.host, a.app, a.fingerprint, a.s, min(b.s) AS next_s FROM secs a LEFT JOIN secs b
    ON a.fingerprint = b.fingerprint AND b.s >= a.s + 600000000 GROUP BY ALL),
chain AS (SELECT host, app, fingerprint, min(s) AS s FROM secs GROUP BY ALL
  UNION ALL SELECT c.host, c.app, c.fingerprint, n.next_s FROM chain c JOIN nexts n USING (fingerprint, s) WHERE n.next_s IS NOT NULL),
spans AS (SELECT *, lead(s) OVER (PARTITION BY fingerprint ORDER BY s) AS until FROM chain)
SELECT p.host, p.app, p.fingerprint, make_timestamp(p.s) AS alert_at, sum(n)::BIGINT AS records
FROM spans p JOIN secs q ON p.fingerprint = q.fingerprint AND q.s >= p.s AND (p.until IS NULL OR q.s < p.until)
GROUP BY p.host, p.app, p.fingerprint, p.s"""

_THROTTLE_LONG = _THROTTLE.replace("a.s + 600000000", "a.s + 43200000000")

SQL: dict[str, str] = {
    "read_jsonl": _with(LOGS) + f"SELECT {_LOG_COLS} FROM logs",
    "long_lines": """SELECT md5('d' || doc_id) AS stream_id, strlen(coalesce(repeat(text, 40), ''))::BIGINT AS bytes,
  md5(coalesce(repeat(text, 40), '')) AS digest FROM documents""",
    "quarantine": "SELECT event_id FROM events WHERE event_type <> 'error'",
    "union_sources": _with(LOGS, DOC_LOGS, TURN_LOGS) + """SELECT host, app, level, count(*) AS records,
  sum(strlen(msg))::BIGINT AS bytes FROM (SELECT * FROM logs UNION ALL SELECT * FROM doc_logs UNION ALL SELECT * FROM turn_logs)
GROUP BY host, app, level""",
    "source_freshness": _with(LOGS) + f"""SELECT host, max(event_time) AS last_seen,
  count(*) FILTER (event_time >= {NOW} - INTERVAL 1 HOUR) AS recent_records,
  count(*) FILTER (event_time >= {NOW} - INTERVAL 1 HOUR) > 0 AS is_fresh
FROM logs WHERE event_time <= {NOW} GROUP BY host""",
    "stored_freshness": _with(LOGS) + f"""SELECT host, max(event_time) AS last_seen,
  count(*) FILTER (event_time >= {NOW} - INTERVAL 1 HOUR) AS recent_records,
  count(*) FILTER (event_time >= {NOW} - INTERVAL 1 HOUR) > 0 AS is_fresh
FROM logs WHERE event_time <= {NOW} GROUP BY host""",
    "logs_by_host": _with(LOGS) + f"SELECT {_LOG_COLS} FROM logs WHERE host = 'h2'",
    "logs_by_level": _with(LOGS, ALERTS) + f"SELECT {_LOG_COLS} FROM alerts",
    "logs_window": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs
WHERE event_time >= TIMESTAMP '2024-01-10 05:00:00' AND event_time < TIMESTAMP '2024-01-11 05:00:00'""",
    "logs_extra_filter": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs WHERE host = 'h3' AND level IN ('error', 'critical') AND {IN_WINDOW}
  AND app = 'app1' AND regexp_matches(msg, 'refused|модуле')""",
    "logs_all_hosts": _with(LOGS, ALERTS) + f"SELECT {_LOG_COLS} FROM alerts WHERE host IN ('h1', 'h4') AND {IN_WINDOW}",
    "logs_last_hours": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs
WHERE event_time >= {NOW} - INTERVAL 30 HOUR AND event_time <= {NOW} - INTERVAL 6 HOUR""",
    "host_totals_zero_filled": _with(LOGS, ALERTS, f"t AS ({HOST_TOTALS.format('alerts')})") + """SELECT host_no::INTEGER AS host_no, host,
  coalesce(error, 0) AS error, coalesce(critical, 0) AS critical, coalesce(total, 0) AS total
FROM (VALUES (1, 'h1'), (2, 'h2'), (3, 'h3'), (4, 'h4'), (5, 'h5'), (6, 'h6')) c(host_no, host) LEFT JOIN t USING (host)""",
    "host_labels": _with(LOGS, ALERTS, f"t AS ({HOST_TOTALS.format('alerts')})") + """SELECT t.*, coalesce(label, '') AS label
FROM t LEFT JOIN (VALUES ('h1', 'Primary'), ('h3', 'Backup')) l(host, label) USING (host)""",
    "pending_windows": _with(*EARLY_RUNS) + """SELECT window_from, window_to FROM windows w
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.status = 'done' AND r.window_from = w.window_from AND r.window_to = w.window_to)""",
    "new_fingerprints_antijoin": _with(*BASE, _inc("norm", "old", where=f"event_time < {MIDDLE}"),
                                       _inc("norm", "cur", where=f"event_time >= {MIDDLE}")) + f"""
SELECT host, app, fingerprint, cnt, first_seen FROM cur WHERE NOT EXISTS (SELECT 1 FROM old
  WHERE old.host = cur.host AND old.fingerprint = cur.fingerprint AND old.last_seen >= {MIDDLE} - INTERVAL 7 DAY)""",
    "incidents": _with(*INC) + "SELECT * FROM inc",
    "doc_incidents": _with(*DOC, _inc("norm")) + "SELECT * FROM inc",
    "incident_examples": _with(*BASE, "msgs AS (SELECT host, app, normalized_msg, msg, min(event_time) AS first_seen FROM norm GROUP BY ALL)")
    + f"""SELECT host, {_FP} AS fingerprint, row_number() OVER (PARTITION BY host, app, normalized_msg ORDER BY first_seen, msg) AS example_no,
  first_seen, msg FROM msgs QUALIFY example_no <= 3""",
    "doc_examples": _with(*DOC, "msgs AS (SELECT host, app, normalized_msg, msg, min(event_time) AS first_seen FROM norm GROUP BY ALL)")
    + f"""SELECT host, {_FP} AS fingerprint, row_number() OVER (PARTITION BY host, app, normalized_msg ORDER BY first_seen, msg) AS example_no,
  first_seen, msg FROM msgs QUALIFY example_no <= 3""",
    "incident_streams": _with(LOGS, _norm("logs"), _inc("norm")) + "SELECT host, fingerprint, streams FROM inc",
    "level_escalation": _with(LOGS, _norm("logs"), _inc("norm")) + "SELECT host, fingerprint, level, module, cnt FROM inc",
    "app_totals": _with(*INC, APPS) + "SELECT * FROM apps",
    "host_totals": _with(LOGS) + HOST_TOTALS.format("logs"),
    "noise_summary": _with(*INC) + f"""SELECT host, sum(cnt)::BIGINT AS records, count(*) AS incidents,
  count(*) FILTER (cnt >= {K}) AS above, count(*) FILTER (cnt < {K}) AS below,
  coalesce(sum(cnt) FILTER (cnt < {K}), 0)::BIGINT AS below_records FROM inc GROUP BY host""",
    "cover_totals": _with(*INC, f"t AS ({HOST_TOTALS.format('alerts')})", "n AS (SELECT host, count(*) AS incidents FROM inc GROUP BY host)")
    + """SELECT coalesce(host, '*') AS host, sum(error)::BIGINT AS error, sum(critical)::BIGINT AS critical,
  sum(incidents)::BIGINT AS incidents FROM t JOIN n USING (host) GROUP BY ROLLUP (host)""",
    "hosts": _with(LOGS) + "SELECT DISTINCT host FROM logs ORDER BY host",
    "hits_histogram": _with(LOGS) + """SELECT host, level, date_trunc('hour', event_time)::TIMESTAMP AS bucket, count(*) AS hits
FROM logs GROUP BY ALL""",
    "hits_series": _with(LOGS, ALERTS, """h AS (SELECT host, app, date_trunc('hour', event_time)::TIMESTAMP AS bucket, count(*) AS hits
  FROM alerts GROUP BY ALL)""") + """SELECT host, app, (sum(hits) OVER (PARTITION BY host, app))::BIGINT AS total,
  (row_number() OVER (PARTITION BY host, app ORDER BY bucket) - 1)::INTEGER AS no, bucket, hits FROM h""",
    "stats_by_host_level": _with(LOGS) + "SELECT host, level, count(*) AS rows FROM logs GROUP BY host, level",
    "stats_by_app": _with(LOGS, ALERTS) + "SELECT app, count(*) AS rows FROM alerts GROUP BY app",
    "dedup_ratio": _with(*INC) + """SELECT host, sum(cnt)::BIGINT AS records, count(*) AS incidents,
  sum(cnt)::DOUBLE / greatest(1, count(*)) AS ratio FROM inc GROUP BY host""",
    "incident_levels": _with(LOGS, _norm("logs")) + f"""SELECT host, app, {_FP} AS fingerprint, level, count(*) AS cnt
FROM norm GROUP BY host, app, normalized_msg, level""",
    "incident_level_map": _with(LOGS, _norm("logs")) + f"""SELECT host, app, {_FP} AS fingerprint,
  count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'error') AS error, count(*) FILTER (level = 'warn') AS warn,
  count(*) FILTER (level = 'info') AS info, count(*) FILTER (level = 'debug') AS debug FROM norm GROUP BY host, app, normalized_msg""",
    "app_share": _with(*INC, APPS) + """SELECT *, (sum(total) OVER (PARTITION BY host))::BIGINT AS host_total,
  total * 100.0::DOUBLE / (sum(total) OVER (PARTITION BY host))::DOUBLE AS share FROM apps""",
    "top_pattern_others": _with(*INC, RANKED) + """SELECT host, max(fingerprint) FILTER (rank = 1) AS fingerprint,
  max(app) FILTER (rank = 1) AS app, max(normalized_msg) FILTER (rank = 1) AS pattern, max(cnt) FILTER (rank = 1) AS pattern_records,
  coalesce(sum(cnt) FILTER (rank > 1), 0)::BIGINT AS other_records, count(*) FILTER (rank > 1) AS other_incidents,
  sum(cnt)::BIGINT AS total FROM ranked GROUP BY host""",
    "field_values": _with(LOGS) + "SELECT stream AS value, count(*) AS hits FROM logs GROUP BY stream",
    "incident_rank": _with(*INC, RANKED) + "SELECT host, fingerprint, cnt, first_seen, rank FROM ranked",
    "incident_top": _with(*INC, RANKED, TOP) + "SELECT host, fingerprint, cnt, first_seen, rank::INTEGER AS rank FROM top",
    "incident_sections": _with(*INC, RANKED) + f"""SELECT host, app, fingerprint, cnt,
  CASE WHEN cnt >= {K} AND rank <= {N} THEN rank::INTEGER ELSE 0 END AS rank,
  CASE WHEN cnt < {K} THEN 'below' WHEN rank <= {N} THEN 'top' ELSE 'overflow' END AS section FROM ranked""",
    "top_app_per_host": _with(*INC, APPS) + """SELECT host, app, error, critical, total FROM apps
QUALIFY row_number() OVER (PARTITION BY host ORDER BY total DESC, app) = 1""",
    "top_apps": _with(LOGS) + "SELECT app, count(*) AS rows FROM logs GROUP BY app ORDER BY rows DESC, app LIMIT 2",
    "host_cap": _with(LOGS, GAPS) + """SELECT host, event_time, msg FROM gaps
QUALIFY row_number() OVER (PARTITION BY host ORDER BY event_time NULLS LAST, msg, stream_id, app, level, module) <= 1000""",
    "host_cap_summary": _with(LOGS, GAPS) + """SELECT host, count(*) AS total, least(count(*), 1000) AS kept, count(*) > 1000 AS is_cut
FROM gaps GROUP BY host""",
    "normalize": _with(LOGS, _norm("logs")) + "SELECT event_time, msg, normalized_msg FROM norm",
    "normalize_documents": f"SELECT doc_id, {_normalized('text', DEFAULT_PROFILE)} AS normalized_msg FROM documents",
    "normalize_custom": _with(LOGS, _norm("logs", profile=CUSTOM_PROFILE)) + "SELECT event_time, msg, normalized_msg FROM norm",
    "normalize_extended": _with(LOGS, _norm("logs", profile=EXTENDED_PROFILE)) + f"""SELECT strftime(event_time, '%Y%m%d%H%M%S%f') AS id,
  normalized_msg FROM norm UNION ALL SELECT doc_id::VARCHAR, {_normalized('text', EXTENDED_PROFILE)} FROM documents""",
    "fingerprint": _with(LOGS, _norm("logs")) + f"SELECT event_time, {_FP} AS fingerprint, left({_FP}, 12) AS short FROM norm",
    "level_rank": _with(LOGS, DOC_LOGS) + f"""SELECT level, ({_RANK})::INTEGER AS level_rank, count(*) AS records FROM (
  SELECT level FROM logs UNION ALL SELECT level FROM doc_logs UNION ALL SELECT event_type FROM events) GROUP BY level""",
    "first_line": f"""SELECT kind, id, turn, CASE WHEN strlen(line) > 160 THEN left(line, 160) || '…' ELSE line END AS first_line
FROM (SELECT kind, id, turn, {_LINE} AS line FROM (SELECT 'd' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents
  UNION ALL SELECT 'c', conv_id, turn, text FROM conversations))""",
    "fmt_time": _with(LOGS) + """SELECT event_time,
  CASE WHEN level = 'debug' THEN '—' ELSE strftime(event_time + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') END AS long_form,
  CASE WHEN level = 'debug' THEN '—' ELSE strftime(event_time + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') END AS short_form FROM logs""",
    "html_escape": f"SELECT page_id, {_esc('html')} AS escaped FROM pages",
    "mask_secrets": _with(LOGS) + f"SELECT event_time, {_masked('msg')} AS masked FROM logs",
    "truncate_example": """SELECT doc_id, CASE WHEN strlen(text) <= 2048 THEN text ELSE
  left(text, len(list_filter(range(1, 2046), lambda i: strlen(left(text, i)) <= 2045))) || '…' END AS example FROM documents""",
    "link_expr": _with(*INC) + f"""SELECT fingerprint, {_EXPR} AS expr, '{{host="' || host || '"}} (level:=error OR level:=critical)' AS host_expr,
  {_q(_ALL_EXPR)} AS all_expr FROM inc""",
    "link_range": _with(*INC, LINKED) + "SELECT fingerprint, link_from, link_to FROM ranged",
    "explore_link": _with(*INC, LINKED) + f"SELECT fingerprint, {_link('expr', 'link_from', 'link_to')} AS link FROM ranged",
    "report_files": _with(LOGS) + """SELECT host, strftime(max(event_time) + INTERVAL 3 HOUR, '%Y-%m-%d') AS report_date,
  host || '_' || strftime(max(event_time) + INTERVAL 3 HOUR, '%Y-%m-%d') || '.md' AS file_name FROM logs GROUP BY host""",
    "daily_incidents": _with(*DAILY) + "SELECT window_start, host, app, fingerprint, level, module, cnt, first_seen, last_seen, streams FROM inc",
    "new_critical": _with(*BASE, _seen("norm")) + _new_criticals(7),
    "doc_new_critical": _with(*DOC, _seen("norm")) + _new_criticals(1),
    "alert_throttle": "WITH RECURSIVE " + ",\n".join((LOGS, _norm("logs"))) + ",\n" + _THROTTLE,
    "alert_throttle_long": "WITH RECURSIVE " + ",\n".join((LOGS, _norm("logs"))) + ",\n" + _THROTTLE_LONG,
    "stream_incident_counts": _with(*BASE) + f"""SELECT date_trunc('hour', event_time)::TIMESTAMP AS window_start, host, app,
  {_FP} AS fingerprint, level, count(*) AS cnt, min(event_time) AS first_seen, max(event_time) AS last_seen FROM norm
GROUP BY date_trunc('hour', event_time), host, app, normalized_msg, level
HAVING date_trunc('hour', event_time) + INTERVAL 1 HOUR <= (SELECT max(event_time) FROM norm) - INTERVAL 10 MINUTE""",
    "stream_new_critical": _with(*BASE, _seen("norm")) + _new_criticals(7, ""),
    "stream_throttled_alerts": "SELECT host, app, fingerprint, alert_at FROM (WITH RECURSIVE "
    + ",\n".join((LOGS, _norm("logs"))) + ",\n" + _THROTTLE + ")",
    "stream_throttled_long": "SELECT host, app, fingerprint, alert_at FROM (WITH RECURSIVE "
    + ",\n".join((LOGS, _norm("logs"))) + ",\n" + _THROTTLE_LONG + ")",
    "stream_handed_over": "SELECT * FROM (" + _with(*BASE, _seen("norm")) + _new_criticals(7, "")
    + ") WHERE event_time >= TIMESTAMP '2024-01-16'",
    "run_status": _with(*RUNS) + NO_NULLS,
    "stored_runs": _with(*RUNS) + NO_NULLS,
    "begin_run_actions": _with(*EARLY_RUNS) + """SELECT window_from, window_to,
  coalesce(run_id, md5(strftime(window_from, '%Y-%m-%d %H:%M:%S') || '|' || strftime(window_to, '%Y-%m-%d %H:%M:%S'))) AS run_id,
  CASE WHEN status = 'done' THEN 'skip' WHEN status IS NOT NULL THEN 'resume' ELSE 'new' END AS action
FROM windows LEFT JOIN runs USING (window_from, window_to)""",
    "completed_run": _with(*RUNS) + NO_NULLS + " WHERE window_from = TIMESTAMP '2024-01-10 07:00:00' AND status = 'done' LIMIT 1",
    "recent_runs": _with(*RUNS) + NO_NULLS + " ORDER BY created_at DESC, run_id LIMIT 10",
    "fingerprint_history": _with(*BASE, _inc("norm", "old", where=f"event_time < {MIDDLE}"),
                                 _inc("norm", "cur", where=f"event_time >= {MIDDLE}")) + """
SELECT host, app, fingerprint, least(o.first_seen, c.first_seen) AS first_seen, greatest(o.last_seen, c.last_seen) AS last_seen,
  coalesce(o.cnt, 0) + coalesce(c.cnt, 0) AS count_total, coalesce(c.cnt, 0) AS count_last,
  coalesce(o.normalized_msg, c.normalized_msg) AS sample_msg
FROM old o FULL JOIN cur c USING (host, app, fingerprint)""",
    "retention": _with(*INC) + f"SELECT host, fingerprint, last_seen FROM inc WHERE last_seen >= {NOW} - INTERVAL 10 DAY",
    "retained_runs": _with(*RUNS) + f"""SELECT run_id, status, completed_at FROM runs
WHERE NOT (status = 'done' AND completed_at < {NOW} - INTERVAL 14 DAY)""",
    "history_by_version": _with(*BASE, _inc("norm", "cur", where=f"event_time >= {MIDDLE}"))
    + "SELECT host, app, fingerprint, first_seen, last_seen, cnt AS count_total FROM cur",
    "report_lines": _with(*DIGEST, REPORT) + "SELECT host, ord::INTEGER AS ord, line FROM report",
    "report_bodies": _with(*DIGEST, REPORT) + """SELECT host, '2024-01-31' AS report_date, host || '_2024-01-31.md' AS file_name,
  string_agg(line, chr(10) ORDER BY ord) AS body FROM report GROUP BY host""",
    "cover_rows": _with(*DIGEST) + f"SELECT host_no::INTEGER AS host_no, host, {COVER_ROW} AS line FROM host_rows",
    "cover": _with(*DIGEST, COVER) + "SELECT body, length(body)::INTEGER AS chars, length(body) <= 4096 AS fits FROM body",
    "cycle_outcomes": _with(CYCLES) + "SELECT outcome, count(*) AS cycles FROM cycles GROUP BY 1",
    "metric_partial_errors": _with(CYCLES) + "SELECT sum(errors)::BIGINT AS partial_errors FROM cycles WHERE outcome IN ('ok', 'partial')",
    "source_status": """SELECT * FROM (VALUES ('events', false), ('documents', false), ('conversations', false), ('missing', true)) s(source, failed)""",
    "source_partial": "SELECT true AS partial",
    "has_recent": _with(LOGS) + f"SELECT true AS found FROM logs WHERE event_time >= {NOW} - INTERVAL 1 HOUR AND event_time <= {NOW} LIMIT 1",
    "logs_scheduled_window": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs
WHERE event_time >= TIMESTAMP '2024-01-19 09:00:00' AND event_time < TIMESTAMP '2024-01-20 09:00:00'""",
    "first_records": _with(LOGS) + f"SELECT {_LOG_COLS} FROM logs ORDER BY event_time, stream_id, stream, msg, host, app, level, module, job LIMIT 100",
    "history_kept": _with(*BASE, _inc("norm", "old", where=f"event_time < {MIDDLE}"), _inc("norm", "cur", where=f"event_time >= {MIDDLE}"))
    + f"""SELECT host, app, fingerprint, least(o.first_seen, c.first_seen) AS first_seen, greatest(o.last_seen, c.last_seen) AS last_seen,
  coalesce(o.cnt, 0) + coalesce(c.cnt, 0) AS count_total, coalesce(c.cnt, 0) AS count_last_24h
FROM old o FULL JOIN cur c USING (host, app, fingerprint) WHERE greatest(o.last_seen, c.last_seen) >= {NOW} - INTERVAL 10 DAY""",
    "duration_histogram": _with(EDGE_ROWS) + """SELECT event_type, edge_no::INTEGER AS edge_no, le,
  count(*) FILTER (value <= upper) AS cumulative FROM events, edges GROUP BY event_type, edge_no, le""",
    "metric_host_records": _with(LOGS, ALERTS) + "SELECT host, level, count(*) AS records FROM alerts GROUP BY host, level",
    "metric_host_incidents": _with(*INC) + "SELECT host, count(*) AS incidents FROM inc GROUP BY host",
    "patterns": _with(*INC) + """SELECT app, normalized_msg, sum(cnt)::BIGINT AS cnt, max(cnt) AS max_cnt, count(DISTINCT host) AS host_count,
  max(cnt) >= 10 OR count(DISTINCT host) >= 2 AS is_pattern
FROM inc GROUP BY app, normalized_msg""",
    "pattern_hosts": _with(*INC) + """SELECT app, normalized_msg, host, cnt FROM inc
QUALIFY max(cnt) OVER (PARTITION BY app, normalized_msg) >= 10 OR count(*) OVER (PARTITION BY app, normalized_msg) >= 2""",
    "pattern_flags": _with(*INC, "p AS (SELECT app, normalized_msg, count(DISTINCT host) AS host_count FROM inc GROUP BY ALL)")
    + """SELECT host, app, fingerprint, cnt, host_count, cnt >= 10 OR host_count >= 2 AS is_pattern FROM inc JOIN p USING (app, normalized_msg)""",
    "new_patterns_per_day": _with(*DAILY) + """SELECT window_start, count(*) AS new_patterns FROM (
  SELECT min(window_start) AS window_start FROM inc GROUP BY host, fingerprint) GROUP BY window_start""",
    "slo_success_rate": _with(CYCLES, CYCLE_DAYS) + f"""SELECT day, {_rolling('ok', 28)} AS succeeded, {_rolling('n', 28)} AS cycles,
  {_rolling('ok', 28)} / {_rolling('n', 28)}::DOUBLE AS rate FROM days""",
    "slo_failed_share": _with(CYCLES, CYCLE_DAYS) + f"""SELECT day, {_rolling('bad', 7)} AS failed, {_rolling('n', 7)} AS cycles,
  {_rolling('bad', 7)} / {_rolling('n', 7)}::DOUBLE AS share, {_rolling('bad', 7)} / {_rolling('n', 7)}::DOUBLE > 2.0::DOUBLE / 7 AS is_alert FROM days""",
    "slo_latency": _with(*RUNS, EDGE_ROWS, """timed AS (SELECT date_trunc('day', window_from)::TIMESTAMP AS day,
  (epoch_us(completed_at) - epoch_us(created_at))::DOUBLE / 1000000.0::DOUBLE AS seconds FROM runs WHERE status = 'done'),
h AS (SELECT d.day, edge_no, upper, count(*) FILTER (seconds <= upper) AS c FROM (SELECT DISTINCT day FROM timed) d
  JOIN timed t ON t.day <= d.day AND t.day > d.day - INTERVAL 7 DAY CROSS JOIN edges GROUP BY ALL),
b AS (SELECT *, coalesce(lag(c) OVER w, 0) AS p, coalesce(lag(upper) OVER w, 0) AS lo,
  0.95::DOUBLE * max(c) OVER (PARTITION BY day) AS target FROM h WINDOW w AS (PARTITION BY day ORDER BY edge_no))""")
    + """SELECT day, lo + (CASE WHEN isinf(upper) THEN 3600 ELSE upper END - lo) * ((target - p) / (c - p)) AS quantile
FROM b WHERE target > p AND target <= c""",
    "delivery_state": _with(*RUNS) + f"""SELECT max(completed_at) FILTER (status = 'done') AS last_success,
  max(completed_at) FILTER (status = 'done') < {NOW} - INTERVAL 26 HOUR AS is_overdue FROM runs""",
    "burn_rate": _with(LOGS, """m AS (SELECT host, date_trunc('minute', event_time)::TIMESTAMP AS minute, count(*) AS n,
  count(*) FILTER (level = 'error') AS bad FROM logs GROUP BY ALL)""", "s AS (SELECT host, minute, " + ", ".join(
        f"(sum(bad) OVER {w})::DOUBLE / (sum(n) OVER {w})::DOUBLE AS {name}" for name, w in (
            (nm, f"(PARTITION BY host ORDER BY minute RANGE BETWEEN INTERVAL {ln - 1} MINUTES PRECEDING AND CURRENT ROW)")
            for nm, ln in (("fast_long", 60), ("fast_short", 5), ("slow_long", 360), ("slow_short", 30)))) + " FROM m)")
    + """SELECT *, fast_long > (1 - 0.99::DOUBLE) * 14.4::DOUBLE AND fast_short > (1 - 0.99::DOUBLE) * 14.4::DOUBLE AS fast_alert,
  slow_long > (1 - 0.99::DOUBLE) * 6.0::DOUBLE AND slow_short > (1 - 0.99::DOUBLE) * 6.0::DOUBLE AS slow_alert FROM s""",
    "damaged_source": _with(LOGS) + """SELECT host, app, level, count(*) AS records, sum(strlen(msg))::BIGINT AS bytes
FROM logs WHERE host IN ('h1', 'h3') GROUP BY host, app, level""",
    "damaged_source_status": "SELECT * FROM (VALUES ('h1', false), ('h2', true), ('h3', false)) s(source, failed)",
    "stored_records": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs WHERE host IN ('h2', 'h4') AND level IN ('error', 'critical')
AND event_time >= TIMESTAMP '2024-01-10 05:00:00' AND event_time < TIMESTAMP '2024-01-11 05:00:00'""",
    "stored_stream": _with(LOGS) + f"""SELECT {_LOG_COLS} FROM logs WHERE stream_id = (SELECT min(stream_id) FROM logs)
AND event_time >= TIMESTAMP '2024-01-01 05:00:00' AND event_time < TIMESTAMP '2024-01-31 05:00:00'""",
    # exact quantiles and counts: the sketches hold all values at this size
    "slo_latency_sketch": _with("c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, value AS seconds FROM events WHERE event_type NOT IN ('error', 'view'))") + """SELECT d.day, count(*) AS cycles, quantile_disc(c.seconds, 0.95) AS quantile
FROM (SELECT DISTINCT day FROM c) AS d JOIN c ON c.day <= d.day AND c.day > d.day - INTERVAL 7 DAY GROUP BY d.day""",
    "rollup_streams": _with(*BASE) + f"""SELECT host, app, count(*) AS records, count(DISTINCT nullif(stream_id, '')) AS streams FROM norm
WHERE event_time >= TIMESTAMP '2024-01-10 05:00:00' GROUP BY host, app""",
    "rollup_templates": _with(*DAILY) + f"""SELECT host, window_start, count(DISTINCT normalized_msg) AS templates,
  count(DISTINCT normalized_msg) FILTER (window_start = first) AS new_templates
FROM (SELECT host, window_start, normalized_msg, min(window_start) OVER (PARTITION BY host, normalized_msg) AS first
  FROM inc WHERE window_start >= TIMESTAMP '2024-01-10 05:00:00') GROUP BY host, window_start""",
    "template_search": _with(*DAILY) + f"""SELECT window_start, host, app, fingerprint, cnt FROM inc
WHERE contains(normalized_msg, 'модуле <') AND window_start >= TIMESTAMP '2024-01-10 00:00:00'""",
    "template_search_short": _with(*DAILY) + "SELECT window_start, host, app, fingerprint, cnt FROM inc WHERE contains(normalized_msg, ' <')",
    "incident_browse": _with(*DAILY) + f"""SELECT window_start, host, app, fingerprint, cnt FROM inc
WHERE host = 'h2' AND level = 'critical' AND contains(normalized_msg, '<ip>') AND window_start >= {NOW} - INTERVAL 10 DAY""",
}
