"""Streaming queries; each runs to the end of the available events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digest import row_hash_sql
from ..session import scratch_path
from ..streaming import jobs, keyed_state, windows
from .catalog import query

DAY = "CAST(date_trunc('day', ts) AS DATE)"
DAILY = f"""SELECT {DAY} AS date, event_type, count(*) AS events, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY {DAY}, event_type"""
EVENT_HASH = row_hash_sql({"event_id": "", "ts": "time", "user_id": "", "event_type": "", "value": "double", "props": ""})


def events(t):
    return jobs.read_events(t.spark, f"{t.folder}/events.parquet")


def daily(t):
    found = windows.run_windows(events(t), scratch_path(t.spark, "stream-daily"), ["event_type"])
    return found.windows.withColumnRenamed("first_date", "date")


@query("st_1_stream_daily", "date event_type events:i avg_value:f min_value:f max_value:f", DAILY)
def _(t):
    return daily(t)


@query(
    "st_2_stream_rolling",
    "window_end event_type events:i avg_value:f",
    """SELECT CAST(window_end AS DATE) AS window_end, event_type, count(*) AS events, avg(value) AS avg_value
FROM (SELECT event_type, value, date_trunc('day', ts) + INTERVAL 1 DAY * unnest(range(1, 8)) AS window_end FROM events)
GROUP BY window_end, event_type""",
)
def _(t):
    found = windows.run_windows(events(t), scratch_path(t.spark, "stream-rolling"), ["event_type"], days=7)
    return found.windows.withColumn("window_end", F.date_add("last_date", 1))


@query(
    "st_3_stream_change_monitor",
    "date data_hash data_size:i new_records:i training_triggered",
    f"""WITH days AS (SELECT date, count(*) AS new_records, CAST(sum(CAST(h AS HUGEINT)) AS HUGEINT) AS hash_sum, bit_xor(h) AS hash_xor
             FROM (SELECT {DAY} AS date, {EVENT_HASH} AS h FROM events) GROUP BY date),
running AS (SELECT date, new_records, CAST(sum(new_records) OVER w AS BIGINT) AS data_size,
                   CAST(sum(hash_sum) OVER w % 1152921504606846976 AS VARCHAR) || ':' || CAST(bit_xor(hash_xor) OVER w AS VARCHAR) AS h
            FROM days WINDOW w AS (ORDER BY date))
 RETURN SELECT date, CAST(data_size AS VARCHAR) || ':' || h AS data_hash, data_size, new_records,
       coalesce(new_records * 100.0 / nullif(data_size - new_records, 0) >= 5, TRUE) AS training_triggered
FROM running""",
)
def _(t):
    return jobs.stream_content_checks(events(t), scratch_path(t.spark, "change-monitor"))


@query(
    "st_4_stream_alerts",
    "date event_type avg_value:f alert",
    f"""SELECT date, event_type, avg_value, CASE WHEN avg_value > 55 THEN 'HIGH' ELSE 'LOW' END AS alert
FROM ({DAILY}) WHERE avg_value > 55 OR avg_value < 45""",
)
def _(t):
    return jobs.daily_alerts(daily(t), high=55.0, low=45.0)


LAST_STATE = """SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
       arg_max(value, struct_pack(t := ts, i := event_id)) AS last_value,
       min(value) AS min_value, max(value) AS max_value, count(*) AS events FROM events GROUP BY event_type"""
STATE = "event_type last_ts last_value:f min_value:f max_value:f events:i"


@query("st_5_stream_last_state", STATE, LAST_STATE)
def _(t):
    state = jobs.stream_last_state(events(t), scratch_path(t.spark, "last-state"), ["event_type"])
    return state.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


@query("st_5_keyed_state", STATE, LAST_STATE)
def _(t):
    state = keyed_state.run_keyed_state(events(t), scratch_path(t.spark, "keyed-state"), "event_type")
    return state.withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))
