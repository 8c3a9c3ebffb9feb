"""Access-log lines derived from the `events` table, as FIXTURES.md lays down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


_EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)
_LINE = """concat(
    'host', user_id, '.example.net - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' -0400] "',
    if(event_type IN ('purchase', 'signup'), 'POST', 'GET'), ' /', event_type, '/', k % 20,
    if(event_id % 41 = 0, '', ' HTTP/1.0'), '" ',
    CASE
        WHEN event_type = 'error' THEN element_at(array('404', '403', '500', '501'), k % 4 + 1)
        WHEN event_type = 'click' AND k % 2 = 0 THEN '304'
        WHEN event_type = 'signup' THEN '302'
        ELSE '200'
    END, ' ',
    if(event_id % 53 = 0, '-', cast(cast(floor(value * 100) AS BIGINT) AS STRING))
)"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, value): one log line per event, with some malformed ones."""
    events = spark.read.schema(_EVENTS).parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr("*", "cast(get_json_object(props, '$.k') AS INT) AS k").selectExpr(
        "event_id", f"if(event_id % 97 = 0, concat('malformed line ', event_id), {_LINE}) AS value"
    )
