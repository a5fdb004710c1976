"""Aggregates over the usage fact."""

from __future__ import annotations

from datetime import date

from ..operators import aggregates as agg
from ..sources.schemas import METRICS, RESOURCES
from .catalog import query

RD = (
    "region date usage_cpu:f usage_storage:f users_active:{} economic_index:f "
    "cloud_market_demand:f holiday:i"
)
MEANS = "usage_cpu:f usage_storage:f users_active:f"
SQL_MEANS = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
SQL_SUMS = (
    "sum(usage_cpu) AS usage_cpu, sum(usage_storage) AS usage_storage, "
    "CAST(sum(users_active) AS BIGINT) AS users_active"
)


def declared(fns: list[str], counts: bool = False) -> str:
    kind = {"count": "i"}
    return " ".join(f"{m}_{f}:{kind.get(f, 'f')}" for m in METRICS for f in fns)


def sql_fns(fns: dict[str, str], wrap: str = "{}") -> str:
    return ", ".join(
        wrap.format(f"{sql}({m})") + f" AS {m}_{name}" for m in METRICS for name, sql in fns.items()
    )


FOUR = {"mean": "avg", "max": "max", "min": "min", "std": "stddev_samp"}


@query("a_1_region_daily", RD.format("i"), "SELECT * FROM rd")
def _(t):
    return agg.region_daily(t.fact, "sum")


@query("a_1_region_daily_training", RD.format("f"), "SELECT * FROM rdm")
def _(t):
    return agg.region_daily(t.fact, "mean")


@query(
    "a_2_resource_region_daily",
    "resource_type " + RD.format("i"),
    f"""SELECT region, resource_type, date, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       sum(users_active) AS users_active, max(economic_index) AS economic_index,
       max(cloud_market_demand) AS cloud_market_demand, max(holiday) AS holiday
FROM fact GROUP BY region, resource_type, date""",
)
def _(t):
    return agg.resource_region_daily(t.fact)


@query(
    "a_3_global_daily",
    f"date {MEANS} economic_index:f cloud_market_demand:f holiday:i",
    """SELECT d.*, CASE WHEN h.on_days > h.off_days THEN 1 ELSE 0 END AS holiday FROM daily d
JOIN (SELECT date, count(*) FILTER (WHERE holiday = 1) AS on_days,
             count(*) FILTER (WHERE holiday = 0) AS off_days FROM fact GROUP BY date) h USING (date)""",
)
def _(t):
    return agg.global_daily(t.fact)


@query(
    "a_4_kpis",
    "peak_cpu:f max_storage:f peak_users:i avg_cpu:f avg_storage:f avg_users:f total_regions:i "
    "total_resource_types:i data_points:i start_date end_date days:i holiday_avg_cpu:f "
    "regular_avg_cpu:f holiday_impact_pct:f peak_cpu_above_avg:f max_storage_above_avg:f "
    "peak_users_above_avg:f",
    """SELECT *, (holiday_avg_cpu - regular_avg_cpu) / nullif(regular_avg_cpu, 0) * 100 AS holiday_impact_pct,
       peak_cpu - avg_cpu AS peak_cpu_above_avg, max_storage - avg_storage AS max_storage_above_avg,
       peak_users - avg_users AS peak_users_above_avg FROM (
  SELECT max(usage_cpu) AS peak_cpu, max(usage_storage) AS max_storage, max(users_active) AS peak_users,
    avg(usage_cpu) AS avg_cpu, avg(usage_storage) AS avg_storage, avg(users_active) AS avg_users,
    count(DISTINCT region) AS total_regions, count(DISTINCT resource_type) AS total_resource_types,
    count(*) AS data_points, min(date) AS start_date, max(date) AS end_date,
    max(date) - min(date) AS days, avg(usage_cpu) FILTER (WHERE holiday = 1) AS holiday_avg_cpu,
    avg(usage_cpu) FILTER (WHERE holiday = 0) AS regular_avg_cpu
  FROM fact)""",
)
def _(t):
    return agg.kpis(t.fact)


@query(
    "a_5_peak_rows",
    "metric value:f date region resource_type",
    "\nUNION ALL ".join(
        f"""SELECT * FROM (SELECT '{m}' AS metric, {m} AS value, date, region, resource_type FROM usage
       ORDER BY {m} DESC, date, region, resource_type LIMIT 1)"""
        for m in METRICS
    ),
)
def _(t):
    return agg.peak_rows(t.usage)


@query(
    "a_6_holiday_impact",
    "holiday_avg:f regular_avg:f percentage:f",
    """SELECT *, (holiday_avg - regular_avg) / nullif(regular_avg, 0) * 100 AS percentage FROM (
  SELECT avg(usage_cpu) FILTER (WHERE holiday = 1) AS holiday_avg,
         avg(usage_cpu) FILTER (WHERE holiday = 0) AS regular_avg FROM fact)""",
)
def _(t):
    return agg.holiday_impact(t.fact)


@query(
    "a_7_sparklines",
    f"date {MEANS}",
    f"""SELECT date, {SQL_MEANS} FROM usage WHERE date > (SELECT max(date) FROM usage) - 30 GROUP BY date""",
)
def _(t):
    return agg.sparklines(t.usage)


@query(
    "a_8_time_series",
    f"date {MEANS} economic_index:f cloud_market_demand:f",
    f"""SELECT date, {SQL_MEANS}, avg(economic_index) AS economic_index,
       avg(cloud_market_demand) AS cloud_market_demand FROM fact
WHERE region = 'EUROPE' AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY date""",
)
def _(t):
    return agg.time_series(t.fact, region="EUROPE", start=date(1996, 1, 1), end=date(2000, 12, 31))


for name, keys in (
    ("a_9_trends_regional", ["date", "region"]),
    ("a_10_trends_resource", ["date", "resource_type"]),
    ("a_10_resource_utilization", ["date", "resource_type"]),
    ("a_12_regional_heatmap", ["region", "resource_type"]),
    ("a_12_engagement_bubble", ["region", "resource_type"]),
):
    listed = ", ".join(keys)
    query(name, f"{' '.join(keys)} {MEANS}", f"SELECT {listed}, {SQL_MEANS} FROM usage GROUP BY {listed}")(
        lambda t, keys=keys: agg.group_means(t.usage, keys)
    )


@query(
    "a_11_regional_comparison",
    "region " + declared(list(FOUR)),
    f"SELECT region, {sql_fns(FOUR, 'round({}, 2)')} FROM usage GROUP BY region",
)
def _(t):
    return agg.regional_comparison(t.usage)


@query(
    "a_13_regional_distribution",
    "region usage_cpu:f usage_storage:f users_active:i",
    f"SELECT region, {SQL_SUMS} FROM usage GROUP BY region",
)
def _(t):
    return agg.regional_distribution(t.usage)


@query(
    "a_14_regional_share",
    "region total:f share_pct:f",
    """SELECT region, sum(usage_cpu) AS total,
       sum(usage_cpu) / (SELECT sum(usage_cpu) FROM usage) * 100 AS share_pct FROM usage GROUP BY region""",
)
def _(t):
    return agg.regional_share(t.usage)


@query(
    "a_15_resource_distribution",
    "resource_type usage_cpu_mean:f usage_cpu_sum:f usage_storage_mean:f usage_storage_sum:f "
    "users_active_mean:f users_active_sum:i",
    f"SELECT resource_type, {sql_fns({'mean': 'avg', 'sum': 'sum'})} FROM usage GROUP BY resource_type",
)
def _(t):
    return agg.resource_distribution(t.usage)


@query(
    "a_16_resource_efficiency",
    f"resource_type {MEANS} cpu_per_user:f storage_per_user:f",
    f"""SELECT *, usage_cpu / users_active AS cpu_per_user, usage_storage / users_active AS storage_per_user
FROM (SELECT resource_type, {SQL_MEANS} FROM usage GROUP BY resource_type)""",
)
def _(t):
    return agg.resource_efficiency(t.usage)


@query(
    "a_17_correlation_bubble",
    f"region resource_type {MEANS} cpu_efficiency:f storage_efficiency:f total_utilization:f",
    f"""SELECT *, usage_cpu / users_active AS cpu_efficiency, usage_storage / users_active AS storage_efficiency,
       usage_cpu + usage_storage / 20 AS total_utilization
FROM (SELECT region, resource_type, {SQL_MEANS} FROM usage GROUP BY region, resource_type)""",
)
def _(t):
    return agg.correlation_bubble(t.usage)


@query(
    "a_18_holiday_analysis",
    "holiday:i " + declared(["mean", "std", "count"]),
    f"""SELECT holiday, {sql_fns({'mean': 'avg', 'std': 'stddev_samp', 'count': 'count'})}
FROM fact GROUP BY holiday""",
)
def _(t):
    return agg.holiday_analysis(t.fact)


@query(
    "a_19_holiday_calendar",
    "month:i month_name day:i usage_cpu:f holiday:i",
    """SELECT month(date) AS month, monthname(date) AS month_name, day(date) AS day,
       avg(usage_cpu) AS usage_cpu, max(holiday) AS holiday
FROM fact GROUP BY month(date), monthname(date), day(date)""",
)
def _(t):
    return agg.holiday_calendar(t.fact)


@query(
    "a_20_engagement_efficiency",
    f"region resource_type {MEANS} cpu_efficiency:f storage_efficiency:f overall_efficiency:f",
    f"""SELECT *, (cpu_efficiency + storage_efficiency) / 2 AS overall_efficiency FROM (
  SELECT *, users_active / usage_cpu AS cpu_efficiency, users_active / (usage_storage / 100) AS storage_efficiency
  FROM (SELECT region, resource_type, {SQL_MEANS} FROM usage GROUP BY region, resource_type))""",
)
def _(t):
    return agg.engagement_efficiency(t.usage)


@query(
    "a_21_engagement_trends",
    f"date {MEANS} cpu_per_user:f storage_per_user:f",
    """SELECT date, usage_cpu, usage_storage, users_active, usage_cpu / users_active AS cpu_per_user,
       usage_storage / users_active AS storage_per_user FROM daily""",
)
def _(t):
    return agg.engagement_trends(t.usage)


@query(
    "a_22_filter_options",
    "regions resource_types min_date max_date",
    """SELECT (SELECT string_agg(region, '|' ORDER BY region) FROM (SELECT DISTINCT region FROM usage)) AS regions,
       (SELECT string_agg(resource_type, '|' ORDER BY resource_type) FROM (SELECT DISTINCT resource_type FROM usage)) AS resource_types,
       (SELECT min(date) FROM usage) AS min_date, (SELECT max(date) FROM usage) AS max_date""",
)
def _(t):
    return agg.filter_options(t.usage)


@query(
    "a_23_data_summary",
    "column count:i mean:f std:f min:f q25:f q50:f q75:f max:f",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
       quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max
FROM fact"""
        for c in (*METRICS, "economic_index", "cloud_market_demand")
    ),
)
def _(t):
    return agg.data_summary(t.fact)


@query(
    "a_23_dataset_info",
    "total_records:i date_range_days:i regions_count:i resource_types_count:i holiday_records:i regular_records:i",
    """SELECT count(*) AS total_records, max(date) - min(date) AS date_range_days,
       count(DISTINCT region) AS regions_count, count(DISTINCT resource_type) AS resource_types_count,
       sum(holiday) AS holiday_records, count(*) - sum(holiday) AS regular_records FROM fact""",
)
def _(t):
    return agg.dataset_info(t.fact)


@query(
    "a_24_eda_summary",
    "source column min:f max:f mean:f distinct_values:i",
    "\nUNION ALL ".join(
        f"""SELECT '{s}' AS source, '{c}' AS "column", min({c}) AS min, max({c}) AS max, avg({c}) AS mean,
       count(DISTINCT {c}) AS distinct_values FROM {s}"""
        for s, cols in (
            ("usage", ["usage_cpu", "usage_storage", "users_active"]),
            ("external", ["cloud_market_demand", "holiday"]),
        )
        for c in cols
    )
    + """
UNION ALL SELECT 'external', 'economic_index', min(economic_index), max(economic_index), avg(economic_index),
       count(DISTINCT round(economic_index, 6)) FROM external""",
)
def _(t):
    from pyspark.sql import functions as F

    external = t.external.withColumn("economic_index", F.round("economic_index", 6))
    return agg.eda_summary(t.usage, external)


@query(
    "a_25_daily_totals",
    "date usage_cpu:f usage_storage:f users_active:i",
    f"SELECT date, {SQL_SUMS} FROM usage GROUP BY date",
)
def _(t):
    return agg.daily_totals(t.usage)


@query("a_26_region_mean_cpu", "region avg_cpu:f", "SELECT region, avg(usage_cpu) AS avg_cpu FROM usage GROUP BY region")
def _(t):
    return agg.region_mean_cpu(t.usage)


@query(
    "a_27_monthly_peak",
    "month region peak_cpu:f",
    """SELECT CAST(date_trunc('month', date) AS DATE) AS month, region, max(usage_cpu) AS peak_cpu
FROM usage GROUP BY CAST(date_trunc('month', date) AS DATE), region""",
)
def _(t):
    return agg.monthly_peak(t.usage)


@query(
    "a_28_external_daily",
    "date economic_index:f cloud_market_demand:f",
    """SELECT date, avg(economic_index) AS economic_index, avg(cloud_market_demand) AS cloud_market_demand
FROM external GROUP BY date""",
)
def _(t):
    return agg.external_daily(t.external)


@query(
    "a_29_daily_summary",
    "date " + declared(list(FOUR)) + " economic_index_first:f cloud_market_demand_first:f holiday_first:i",
    f"""SELECT date, {sql_fns(FOUR)}, max(economic_index) AS economic_index_first,
       max(cloud_market_demand) AS cloud_market_demand_first, max(holiday) AS holiday_first
FROM merged GROUP BY date""",
)
def _(t):
    return agg.daily_summary(t.merged)


@query(
    "a_30_regional_performance",
    "region resource_type " + declared(["mean", "std"]),
    f"""SELECT region, resource_type, {sql_fns({'mean': 'avg', 'std': 'stddev_samp'})}
FROM usage GROUP BY region, resource_type""",
)
def _(t):
    return agg.regional_performance(t.usage)


@query(
    "a_31_weekly_pattern",
    "weekday:i day_of_week value:f",
    """SELECT isodow(date) - 1 AS weekday, dayname(date) AS day_of_week, avg(usage_cpu) AS value
FROM daily GROUP BY isodow(date), dayname(date) ORDER BY 1""",
)
def _(t):
    return agg.weekly_pattern(t.usage, "usage_cpu")


@query(
    "a_32_monthly_pattern",
    "month:i month_name value:f",
    """SELECT month(date) AS month, monthname(date) AS month_name, avg(usage_cpu) AS value
FROM daily WHERE (SELECT count(*) FROM daily) > 30 GROUP BY month(date), monthname(date) ORDER BY 1""",
)
def _(t):
    return agg.monthly_pattern(t.usage, "usage_cpu")


@query(
    "a_56_heatmap_pivot",
    "region VM:f Storage:f Container:f",
    "SELECT region, "
    + ", ".join(f"avg(usage_cpu) FILTER (WHERE resource_type = '{r}') AS \"{r}\"" for r in RESOURCES)
    + " FROM usage GROUP BY region",
)
def _(t):
    return agg.heatmap_pivot(t.usage, "usage_cpu", RESOURCES)


@query(
    "a_57_calendar_pivot",
    "day_of_month:i " + " ".join(f"m{i}:f" for i in range(1, 13)),
    "SELECT day(date) AS day_of_month, "
    + ", ".join(f"avg(usage_cpu) FILTER (WHERE month(date) = {i}) AS m{i}" for i in range(1, 13))
    + " FROM usage GROUP BY day(date)",
)
def _(t):
    return agg.calendar_pivot(t.usage, "usage_cpu")


@query(
    "a_58_multi_level_summary",
    "region resource_type level:i rows:i usage_cpu:f usage_storage:f users_active:i avg_cpu:f",
    f"""SELECT region, resource_type, grouping(region, resource_type) AS level, count(*) AS rows, {SQL_SUMS},
       avg(usage_cpu) AS avg_cpu FROM usage GROUP BY ROLLUP (region, resource_type)""",
)
def _(t):
    return agg.multi_level_summary(t.usage)
