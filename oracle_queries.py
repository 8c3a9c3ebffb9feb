"""The expected result of each query, as SQL over the same parquet tables."""

from __future__ import annotations

# Fixed value: the pattern of a well-formed line.
PATTERN = (
    r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+)\s*(\S*)\s*" (\d{3}) (\S+)'
)
DAY = "2024-01-15"
PAGE = 5
CLOCK = "2024-02-01 12:00:00"

LINES = """
lines AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'malformed line ' || event_id ELSE
    'host' || user_id || '.example.net - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' -0400] "'
    || CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END
    || ' /' || event_type || '/' || (k % 20)
    || CASE WHEN event_id % 41 = 0 THEN '' ELSE ' HTTP/1.0' END || '" '
    || CASE event_type
         WHEN 'error' THEN CASE k % 4 WHEN 0 THEN '404' WHEN 1 THEN '403' WHEN 2 THEN '500' ELSE '501' END
         WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN '304' ELSE '200' END
         WHEN 'signup' THEN '302' ELSE '200' END
    || ' '
    || CASE WHEN event_id % 53 = 0 THEN '-' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END
    END AS value
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events)
)"""

LOGS = f"""{LINES},
fields AS (
  SELECT unnest(regexp_extract(value, '{PATTERN}',
    ['host','client_identd','user_id','raw_time','method','endpoint','protocol','rc','sz'])) FROM lines
),
timed AS (
  SELECT *, strptime(split_part(raw_time, ' ', 1), '%d/%b/%Y:%H:%M:%S') AS event_time
  FROM fields WHERE host <> ''
),
logs AS (
  SELECT host, client_identd, user_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS date_time,
    method, endpoint, protocol, CAST(rc AS INTEGER) AS response_code,
    CASE WHEN sz = '-' THEN 0 ELSE CAST(sz AS BIGINT) END AS content_size,
    event_time, strftime(event_time, '%Y-%m-%d') AS date, CAST(hour(event_time) AS INTEGER) AS hour
  FROM timed
)"""

LOG_FIELDS = (
    "host, client_identd, user_id, date_time, method, endpoint, protocol, "
    "response_code, content_size, date"
)

KPIS = """
kpis AS (
  SELECT date, count(*) AS total_log_count,
    count(*) FILTER (response_code = 200) AS total_number_of_successful,
    count(*) - count(*) FILTER (response_code = 200) AS total_failed_access,
    avg(content_size) FILTER (response_code = 200) AS average_content_size,
    CAST(coalesce(sum(content_size) FILTER (response_code = 200), 0) AS BIGINT) AS total_content_size,
    count(DISTINCT host) AS unique_host_count,
    count(*) FILTER (response_code >= 400) AS bad_records_count
  FROM logs GROUP BY date
)"""


def ranked(
    keys: list[str],
    *,
    last_by: str | None = None,
    where: str = "TRUE",
    having: str = "TRUE",
    k: int | None = 20,
    daily: bool = True,
) -> str:
    """A report table: counts, share of all rows, last time, cut to k rows."""
    period = ["date"] if daily else []
    group = ", ".join(period + keys)
    over = "PARTITION BY date" if daily else ""
    order = ", ".join(["n DESC", *keys])
    last_keys = ", ".join([*period, *([last_by] if last_by else keys)])
    total = (
        "SELECT date, count(*) AS total FROM logs GROUP BY date"
        if daily
        else "SELECT count(*) AS total FROM logs"
    )
    total_join = "JOIN t USING (date)" if daily else "CROSS JOIN t"
    cut = f"WHERE rk <= {k}" if k else ""
    return f"""(
  WITH t AS ({total}),
  c AS (SELECT {group}, count(*) AS n FROM logs WHERE {where} GROUP BY {group} HAVING {having}),
  l AS (SELECT {last_keys}, max(date_time) AS last_time FROM logs GROUP BY {last_keys}),
  r AS (SELECT *, row_number() OVER ({over} ORDER BY {order}) AS rk FROM c)
  SELECT {group}, n AS count, last_time, round((n / total) * 100, 2) AS percentage
  FROM r JOIN l USING ({last_keys}) {total_join} {cut})"""



TABLES = {
    "process_response_code": (
        ["response_code"], ["response_code", "count", "last_time", "percentage"],
        ranked(["response_code"]),
    ),
    "process_hosts_more_than_10": (
        ["host"], ["host", "count", "last_time", "percentage"],
        ranked(["host"], having="count(*) > 10"),
    ),
    "process_top_endpoints": (
        ["endpoint"], ["endpoint", "count", "last_time", "percentage"], ranked(["endpoint"]),
    ),
    "process_top_errors": (
        ["endpoint", "response_code"],
        ["endpoint", "response_code", "count", "last_time", "percentage"],
        ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 200"),
    ),
    "error_hosts_top": (
        ["host", "response_code"],
        ["host", "response_code", "count", "last_time", "percentage"],
        ranked(["host", "response_code"], last_by="host", where="response_code >= 400"),
    ),
    "error_hour": (
        ["hour", "response_code"], ["hour", "response_code", "count", "percentage"],
        ranked(["hour", "response_code"], where="response_code >= 400", k=None),
    ),
}
SCALARS = [
    "total_log_count", "total_number_of_successful", "total_failed_access",
    "average_content_size", "unique_host_count", "bad_records_count",
]
REALTIME_SCALARS = [
    "total_log_count", "total_number_of_successful", "total_content_size",
    "total_failed_access", "unique_host_count", "bad_records_count",
]
REALTIME = {
    "response_code": (
        ["response_code"], ["response_code", "count", "last_time"],
        ranked(["response_code"], k=None),
    ),
    "top_endpoints": (
        ["endpoint"], ["endpoint", "count", "last_time"], ranked(["endpoint"], k=None),
    ),
    "bad_unique_endpoints": (
        ["endpoint", "response_code"], ["endpoint", "response_code", "count", "last_time"],
        ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 400", k=None),
    ),
}


def _json(fields: list[str], count_as_text: bool = True) -> str:
    bare = set() if count_as_text else {"count"}
    items = [
        f"""'"{f}":' || "{f}" """ if f in bare else f"""'"{f}":"' || "{f}" || '"'"""
        for f in fields
    ]
    return "'{' || " + " || ',' || ".join(items) + " || '}'"


def cells_cte(table: str, scalars: list[str], tables: dict, count_as_text: bool = True) -> str:
    parts = [
        f"""SELECT '{table}' AS "table", 'date=' || date AS row_key, 'cf' AS family,
  '{s}' AS qualifier, 0 AS part, CAST({s} AS VARCHAR) AS value FROM kpis WHERE {s} IS NOT NULL"""
        for s in scalars
    ]
    parts += [
        f"""SELECT '{table}', 'date=' || date, 'cf', '{name}', 0, coalesce(v, '[]')
  FROM (SELECT DISTINCT date FROM logs) LEFT JOIN (SELECT date,
  '[' || string_agg({_json(fields, count_as_text)}, ',' ORDER BY "count" DESC, {', '.join(keys)}) || ']' AS v
  FROM {sql} GROUP BY date) USING (date)"""
        for name, (keys, fields, sql) in tables.items()
    ]
    return "cells AS (" + "\nUNION ALL\n".join(parts) + ")"


BATCH_CELLS = f"{LOGS},{KPIS},\n{cells_cte('log_analysis_report', SCALARS, TABLES)}"
# Successful requests in the newer half of each day, as taken at CLOCK.
ONLINE = (
    f"SELECT date, '{CLOCK}' AS time, count(*) FILTER (response_code = 200) AS count FROM "
    "(SELECT *, max(hour >= 12) OVER (PARTITION BY date) AS has_pm FROM logs) "
    "WHERE (hour >= 12) = has_pm GROUP BY date"
)
REALTIME_CELLS = (
    f"{LOGS},{KPIS},\n"
    f"{cells_cte('log_analysis_realtime', REALTIME_SCALARS, REALTIME, count_as_text=False)},\n"
    "all_cells AS (SELECT * FROM cells UNION ALL SELECT 'log_analysis_realtime', 'date=' || date, 'cf', "
    "'online_users_count', 0, '[{\"time\":\"' || time || '\",\"count\":' || count || '}]' "
    f"FROM ({ONLINE}))"
)


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _tables(tables: dict, fields: list[str]) -> str:
    """The rows of several report tables in one layout; their own columns, null for the others."""
    return " UNION ALL ".join(
        f"SELECT date, '{name}' AS qualifier, "
        + ", ".join(f'"{f}"' if f in [*own, "percentage"] else f'NULL AS "{f}"' for f in fields)
        + f" FROM {sql}"
        for name, (_, own, sql) in tables.items()
    )


def build() -> dict[str, str]:
    logs = lambda body: _with(LOGS, body)
    table = lambda sql, cols="*": logs(f"SELECT {cols} FROM {sql}")
    cells = lambda body: _with(BATCH_CELLS, body)
    hosts = "SELECT date, count(DISTINCT host) AS unique_host_count FROM logs GROUP BY date"
    windows = (
        "SELECT date, response_code, count(*) AS total_log_count, "
        "count(*) FILTER (response_code = 200) AS total_number_of_successful, "
        "count(*) FILTER (response_code >= 400) AS bad_records_count, max(date_time) AS last_time "
        "FROM logs GROUP BY date, response_code"
    )
    am_pm = "hour < 12"
    rt_kpi_columns = (
        "date, total_log_count, total_number_of_successful, total_failed_access, "
        "total_content_size, unique_host_count, bad_records_count"
    )
    return {
        "raw_scan": _with(LINES, "SELECT value FROM lines"),
        "parse_logs": logs(f"SELECT {LOG_FIELDS} FROM logs"),
        "bad_line_count": _with(
            f"{LINES}, marked AS (SELECT regexp_matches(value, '{PATTERN}') AS ok FROM lines)",
            "SELECT CASE WHEN ok THEN 'ok' ELSE 'pattern' END AS reason, count(*) AS lines "
            "FROM marked GROUP BY 1",
        ),
        "partitioned_write": logs(f"SELECT {LOG_FIELDS} FROM logs"),
        "partition_scan": logs(f"SELECT {LOG_FIELDS} FROM logs WHERE date = '{DAY}'"),
        "partition_list": logs("SELECT DISTINCT date FROM logs"),
        "kpi_daily": _with(f"{LOGS},{KPIS}", "SELECT * FROM kpis"),
        "response_code_breakdown": table(ranked(["response_code"])),
        "frequent_hosts": table(ranked(["host"], having="count(*) > 10", daily=False)),
        "frequent_hosts_daily": table(ranked(["host"], having="count(*) > 3")),
        "top_endpoints": table(ranked(["endpoint"])),
        "top_error_urls": table(
            ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 400")
        ),
        "top_error_urls_any_code": table(
            ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 200")
        ),
        "error_hosts_top": table(
            ranked(["host", "response_code"], last_by="host", where="response_code >= 400")
        ),
        "error_by_hour": table(
            ranked(["hour", "response_code"], where="response_code >= 400", k=None),
            "date, hour, response_code, count, percentage",
        ),
        "last_seen_join": table(
            ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 400", k=None),
            "date, endpoint, response_code, count, last_time",
        ),
        "report_merge": logs(
            "SELECT date, host, count(*) AS count, max(date_time) AS last_time "
            "FROM logs GROUP BY date, host"
        ),
        "report_carry_over": logs(
            "SELECT date, host, count(*) AS count, max(date_time) AS last_time FROM logs a "
            f"WHERE {am_pm} AND NOT EXISTS (SELECT 1 FROM logs b WHERE b.hour >= 12 "
            "AND b.date = a.date AND b.host = a.host) GROUP BY date, host"
        ),
        "incremental_days": logs(
            f"SELECT date, CASE WHEN date <= '{DAY}' THEN 1 ELSE 2 END AS run, "
            "count(*) AS total_log_count FROM logs GROUP BY date"
        ),
        "report_cells": cells("SELECT * FROM cells"),
        "report_for_day": cells(
            "SELECT \"table\", row_key, family, qualifier, part, CASE WHEN qualifier = 'average_content_size' "
            "THEN CAST(CAST(floor(CAST(value AS DOUBLE) + 0.5) AS BIGINT) AS VARCHAR) ELSE value END AS value "
            f"FROM cells WHERE row_key = 'date={DAY}'"
        ),
        "report_table_rows": table(ranked(["endpoint"])),
        "report_page": logs(
            "SELECT date, endpoint, count, last_time, percentage, rank FROM (SELECT *, "
            "row_number() OVER (PARTITION BY date ORDER BY last_time DESC, endpoint) AS rank "
            f"FROM {ranked(['endpoint'])}) WHERE rank <= 10"
        ),
        "rt_kpi": _with(f"{LOGS},{KPIS}", f"SELECT {rt_kpi_columns} FROM kpis"),
        "rt_response_code": table(ranked(["response_code"], k=None)),
        "rt_endpoints": table(ranked(["endpoint"], k=None)),
        "rt_bad_endpoints": table(
            ranked(["endpoint", "response_code"], last_by="endpoint", where="response_code >= 400", k=None)
        ),
        "rt_avg_size": _with(
            f"{LOGS},{KPIS}",
            "SELECT date, CAST(floor(total_content_size / nullif(total_number_of_successful, 0) + 0.5) "
            "AS BIGINT) AS average_content_size FROM kpis",
        ),
        "rt_online": logs(ONLINE),
        "rt_report_cells": _with(REALTIME_CELLS, "SELECT * FROM all_cells"),
        "rt_store": _with(REALTIME_CELLS, "SELECT * FROM all_cells"),
        "rt_store_day": _with(REALTIME_CELLS, f"SELECT * FROM all_cells WHERE row_key = 'date={DAY}'"),
        "rt_compacted": _with(REALTIME_CELLS, "SELECT * FROM cells"),
        "rt_table_rows": logs(_tables(REALTIME, ["endpoint", "response_code", "count", "last_time", "percentage"])),
        "report_tables": logs(
            _tables(TABLES, ["hour", "host", "endpoint", "response_code", "count", "last_time", "percentage"])
        ),
        "load_rejects": _with(
            LINES,
            "SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS load, 'pattern' AS reject_reason, "
            "count(*) AS lines, count(*) AS kept, min(value) AS first_line, max(value) AS last_line FROM lines "
            f"WHERE NOT regexp_matches(value, '{PATTERN}') GROUP BY 1",
        ),
        "late_load": cells(
            "SELECT * FROM cells UNION ALL SELECT DISTINCT 'log_analysis_report', 'date=' || date, 'cf', "
            "'check_analysis', 0, '1' FROM logs"
        ),
        "changed_days": _with(
            LOGS.replace("SELECT unnest(", "SELECT event_id, unnest("),
            "SELECT DISTINCT date, 1 AS run, 0 AS again FROM (SELECT date FROM timed_logs WHERE event_id % 100 > 0) "
            "UNION ALL SELECT DISTINCT date, 2, 0 FROM timed_logs WHERE event_id % 500 = 0",
        ).replace("logs AS (", "timed_logs AS (SELECT event_id, strftime(event_time, '%Y-%m-%d') AS date FROM timed),\nlogs AS ("),
        "unique_hosts_span": logs(
            " UNION ALL ".join(
                f"SELECT '{span}' AS span, strftime(date_trunc('{span}', CAST(date AS DATE)), '%Y-%m-%d') AS start, "
                "count(DISTINCT date) AS days, count(DISTINCT host) AS unique_host_count, true AS estimate_is_near "
                "FROM logs GROUP BY 2"
                for span in ("week", "month")
            )
        ),
        "endpoint_calendar": logs(
            "SELECT date, endpoint, errors, previous, round((errors - previous) / nullif(previous, 0) * 100, 2) AS change_pct "
            "FROM (SELECT *, lag(errors) OVER (PARTITION BY endpoint ORDER BY date) AS previous FROM ("
            "SELECT strftime(day, '%Y-%m-%d') AS date, endpoint, coalesce(n, 0) AS errors FROM ("
            "SELECT unnest(generate_series(min(CAST(date AS DATE)), max(CAST(date AS DATE)), INTERVAL 1 DAY)) AS day "
            "FROM logs WHERE response_code >= 400) CROSS JOIN "
            "(SELECT DISTINCT endpoint FROM logs WHERE response_code >= 400) LEFT JOIN ("
            "SELECT CAST(date AS DATE) AS day, endpoint, count(*) AS n FROM logs WHERE response_code >= 400 GROUP BY ALL"
            ") USING (day, endpoint)))"
        ),
        "late_lines": logs(
            "SELECT date, response_code, count(*) FILTER (day(CAST(date AS DATE)) >= 21) AS on_time, "
            "count(*) FILTER (day(CAST(date AS DATE)) < 21) AS late FROM logs GROUP BY date, response_code"
        ),
        "rt_rejects": _with(
            LINES,
            "SELECT 'pattern' AS reject_reason, count(*) AS lines FROM lines "
            f"WHERE NOT regexp_matches(value, '{PATTERN}')",
        ),
        "stream_parse": logs(f"SELECT {LOG_FIELDS} FROM logs"),
        "stream_report": logs(windows),
        "late_report": logs(windows),
        "unique_hosts_approx": logs(
            f"SELECT date, unique_host_count, true AS estimate_is_near FROM ({hosts})"
        ),
        "ingest_fan_in": _with(LINES, "SELECT value FROM lines"),
        "response_code_share": logs(
            "SELECT *, max(percentage) OVER (PARTITION BY date) AS biggest, "
            "min(percentage) OVER (PARTITION BY date) AS smallest FROM ("
            "SELECT date, response_code, coalesce(n, 0) AS count, "
            "coalesce(round((n / total) * 100, 2), 0.0) AS percentage FROM "
            "(SELECT date, count(*) AS total FROM logs GROUP BY date) "
            "CROSS JOIN (SELECT unnest([200, 304, 404, 500, 302, 403, 501]) AS response_code) "
            "LEFT JOIN (SELECT date, response_code, count(*) AS n FROM logs GROUP BY ALL) "
            "USING (date, response_code))"
        ),
        "daily_unique_hosts": logs(hosts),
        "traffic_by_weekday": logs(
            "SELECT strftime(CAST(date AS DATE), '%a') AS weekday, count(*) AS hits, "
            "count(DISTINCT date) AS days FROM logs GROUP BY 1"
        ),
        "daily_hosts_change": logs(
            "SELECT date, unique_host_count, previous, "
            "round((unique_host_count - previous) / previous * 100, 2) AS change_pct FROM "
            "(SELECT *, lag(unique_host_count) OVER (ORDER BY date) AS previous "
            f"FROM ({hosts}))"
        ),
        "store_head": cells(
            "SELECT * FROM cells WHERE row_key IN "
            f"(SELECT DISTINCT row_key FROM cells ORDER BY row_key LIMIT {PAGE})"
        ),
        "store_tail": cells(
            "SELECT * FROM cells WHERE row_key IN "
            f"(SELECT DISTINCT row_key FROM cells ORDER BY row_key DESC LIMIT {PAGE})"
        ),
        "store_get": cells(f"SELECT * FROM cells WHERE row_key = 'date={DAY}'"),
        "store_put": cells(
            "SELECT \"table\", row_key, family, qualifier, part, CASE WHEN qualifier = 'unique_host_count' "
            "THEN 'revised' ELSE value END AS value FROM cells UNION ALL SELECT \"table\", row_key, family, "
            "'note', 0, 'seen' FROM cells WHERE qualifier = 'total_log_count' UNION ALL SELECT 'other', row_key, "
            "family, qualifier, part, value FROM cells WHERE qualifier = 'total_log_count'"
        ),
        "store_nested_rows": cells(
            "SELECT \"table\", row_key AS \"rowKey\", part, family AS \"familyName\", CAST(row_number() OVER "
            "(PARTITION BY \"table\", row_key, part, family ORDER BY qualifier) - 1 AS INTEGER) AS position, "
            "qualifier AS \"column\", value FROM cells"
        ),
    }
