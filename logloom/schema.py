"""Column layouts and the fixed names of the report contract."""

from __future__ import annotations

from pyspark.sql import types as T

# One parsed request. `date_time` is the wall clock as text; `event_time` is the
# same wall clock as a zone-free timestamp (eight bytes, so max() over it stays
# in hash aggregation; max() over a string would force a sort of every row).
LOG_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType(), False),
        T.StructField("client_identd", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("date_time", T.StringType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("endpoint", T.StringType(), False),
        T.StructField("protocol", T.StringType(), False),
        T.StructField("response_code", T.IntegerType(), False),
        T.StructField("content_size", T.LongType(), False),
        T.StructField("event_time", T.TimestampNTZType(), True),
        T.StructField("date", T.StringType(), False),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

CELL_COLUMNS = ["table", "row_key", "family", "qualifier", "part", "value"]
CELL_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType(), False),
        T.StructField("row_key", T.StringType(), False),
        T.StructField("family", T.StringType(), False),
        T.StructField("qualifier", T.StringType(), False),
        T.StructField("part", T.IntegerType(), False),
        T.StructField("value", T.StringType(), True),
    ]
)

# Names readers of the report store look cells up by.
BATCH_TABLE = "log_analysis_report"
REALTIME_TABLE = "log_analysis_realtime"
FAMILY = "cf"
MARKER = "check_analysis"
BATCH_SCALARS = [
    "total_log_count",
    "total_number_of_successful",
    "total_failed_access",
    "average_content_size",
    "unique_host_count",
    "bad_records_count",
]
REALTIME_SCALARS = [
    "total_log_count",
    "total_number_of_successful",
    "total_content_size",
    "total_failed_access",
    "unique_host_count",
    "bad_records_count",
]
BATCH_TABLES = {
    "process_response_code": ["response_code", "count", "last_time", "percentage"],
    "process_hosts_more_than_10": ["host", "count", "last_time", "percentage"],
    "process_top_endpoints": ["endpoint", "count", "last_time", "percentage"],
    "process_top_errors": ["endpoint", "response_code", "count", "last_time", "percentage"],
    "error_hosts_top": ["host", "response_code", "count", "last_time", "percentage"],
    "error_hour": ["hour", "response_code", "count", "percentage"],
}
REALTIME_TABLES = {
    "response_code": ["response_code", "count", "last_time"],
    "top_endpoints": ["endpoint", "count", "last_time"],
    "bad_unique_endpoints": ["endpoint", "response_code", "count", "last_time"],
}

# The response codes the share chart always shows, hit or not.
CHART_CODES = [200, 304, 404, 500, 302, 403, 501]

# Thresholds of the reports.
SUCCESS_CODE = 200
ERROR_CODE = 400
# The stored table of "top error" URLs counts every code from here on.
ERROR_URL_CODE = 200
FREQUENT_HITS = 10
TOP_ROWS = 20
PAGE_ROWS = 10
