"""Scores, grades, seasonal patterns, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights, joins, ranking
from ..operators.statistics import corr_matrix
from ..sources.schemas import METRICS, NUMERIC
from .catalog import query
from .statistic_queries import corr_long_sql

STATS = """stats AS (SELECT region, round(avg(usage_cpu), 2) AS avg, round(max(usage_cpu), 2) AS peak,
       round(min(usage_cpu), 2) AS min, round(stddev_samp(usage_cpu), 2) AS volatility,
       count(date) AS data_points FROM usage GROUP BY region)"""


@query(
    "a_33_trend_stats",
    "volatility:f average:f range:f median:f current:f days:i",
    """SELECT stddev_samp(usage_cpu) AS volatility, avg(usage_cpu) AS average,
       max(usage_cpu) - min(usage_cpu) AS range, quantile_cont(usage_cpu, 0.5) AS median,
       arg_max(usage_cpu, date) AS current, count(*) AS days FROM daily""",
)
def _(t):
    return insights.trend_stats(t.usage, "usage_cpu")


@query(
    "a_34_regional_stats",
    "region avg:f peak:f min:f volatility:f data_points:i",
    f"WITH {STATS}\n RETURN SELECT * FROM stats",
)
def _(t):
    return insights.regional_stats(t.usage, "usage_cpu")


@query(
    "a_35_region_efficiency_score",
    "region avg:f volatility:f efficiency_score:f",
    f"""WITH {STATS}
 RETURN SELECT region, avg, volatility, (avg / (SELECT max(avg) FROM stats) * 0.7
       + (1 - volatility / (SELECT max(volatility) FROM stats)) * 0.3) * 100 AS efficiency_score FROM stats""",
)
def _(t):
    return insights.region_efficiency_score(insights.regional_stats(t.usage, "usage_cpu"))


@query(
    "a_36_radar_normalised",
    "region usage_cpu:f usage_storage:f users_active:f",
    "WITH base AS (SELECT region, "
    + ", ".join(f"round(avg({m}), 1) AS {m}" for m in METRICS)
    + " FROM usage GROUP BY region)\n RETURN SELECT region, "
    + ", ".join(
        f"""CASE WHEN (SELECT max({m}) > min({m}) FROM base) THEN ({m} - (SELECT min({m}) FROM base))
       / (SELECT max({m}) - min({m}) FROM base) * 100 ELSE 50 END AS {m}"""
        for m in METRICS
    )
    + " FROM base",
)
def _(t):
    return insights.radar_normalised(t.usage)


@query(
    "a_37_regional_insights",
    "best_region most_stable global_average:f performance_gap:f volatile_regions high_disparity",
    f"""WITH {STATS}
 RETURN SELECT *, performance_gap > global_average * 0.2 AS high_disparity FROM (
  SELECT (SELECT region FROM stats ORDER BY avg DESC, region DESC LIMIT 1) AS best_region,
         (SELECT region FROM stats ORDER BY volatility, region LIMIT 1) AS most_stable,
         avg(avg) AS global_average, max(avg) - min(avg) AS performance_gap,
         coalesce(string_agg(CASE WHEN volatility > (SELECT avg(volatility) FROM stats) THEN region END, ', ' ORDER BY region), '') AS volatile_regions
  FROM stats)""",
)
def _(t):
    return insights.regional_insights(insights.regional_stats(t.usage, "usage_cpu"))


@query(
    "a_38_utilization_status",
    "resource_type cpu_avg:f cpu_peak:f utilization_rate:f status",
    """SELECT *, CASE WHEN utilization_rate > 80 THEN 'High Load' WHEN utilization_rate > 60 THEN 'Moderate Load'
              ELSE 'Optimal' END AS status FROM (
  SELECT resource_type, avg(usage_cpu) AS cpu_avg, max(usage_cpu) AS cpu_peak,
         least(greatest(avg(usage_cpu), 0), 100) AS utilization_rate FROM usage GROUP BY resource_type)""",
)
def _(t):
    return insights.utilization_status(t.usage)


@query(
    "a_39_daily_efficiency",
    "resource_type date efficiency:f",
    """SELECT resource_type, date, CASE WHEN avg(users_active) > 0 THEN avg(usage_cpu) / avg(users_active) * 10
       ELSE avg(usage_cpu) END AS efficiency FROM usage GROUP BY resource_type, date""",
)
def _(t):
    return insights.daily_efficiency(t.usage)


@query(
    "a_40_efficiency_per_user",
    "resource_type total_users:i cpu_efficiency:f storage_efficiency:f bubble_size:f",
    """SELECT resource_type, sum(users_active) AS total_users, avg(usage_cpu) / avg(users_active) AS cpu_efficiency,
       avg(usage_storage) / avg(users_active) AS storage_efficiency,
       greatest(20, least(80, sum(users_active) / 10)) AS bubble_size FROM usage GROUP BY resource_type""",
)
def _(t):
    return insights.efficiency_per_user(t.usage)


@query(
    "a_41_efficiency_grade",
    "resource_type cpu_eff:f user_eff:f storage_eff:f score:f grade",
    """SELECT *, CASE WHEN score >= 80 THEN 'A+' WHEN score >= 70 THEN 'A' WHEN score >= 60 THEN 'B+'
              WHEN score >= 50 THEN 'B' ELSE 'C' END AS grade FROM (
  SELECT *, least(greatest(cpu_eff * 0.4 + user_eff * 0.4 + storage_eff * 0.2, 0), 100) AS score FROM (
    SELECT resource_type, least(greatest(100 - avg(usage_cpu), 0), 100) AS cpu_eff,
           least(100, avg(users_active) / avg(usage_cpu) * 50) AS user_eff,
           least(greatest(100 - least(100, avg(usage_storage) / 20), 0), 100) AS storage_eff
    FROM usage GROUP BY resource_type)) ORDER BY score DESC""",
)
def _(t):
    return insights.efficiency_grade(t.usage)


@query(
    "a_42_daily_peak_utilization",
    "resource_type date cpu_utilization:f usage_storage:f users_active:i threshold",
    """SELECT *, CASE WHEN cpu_utilization >= 95 THEN 'critical' WHEN cpu_utilization >= 80 THEN 'warning'
              ELSE 'normal' END AS threshold FROM (
  SELECT resource_type, date, least(greatest(max(usage_cpu), 0), 100) AS cpu_utilization,
         max(usage_storage) AS usage_storage, max(users_active) AS users_active FROM usage GROUP BY resource_type, date)""",
)
def _(t):
    return insights.daily_peak_utilization(t.usage)


@query(
    "a_43_capacity_status",
    "resource_type max_cpu:f current:f recent_avg:f first_avg:f trend_rate:f status projection",
    """WITH trend AS (SELECT resource_type, avg(v) FILTER (WHERE down <= 7) AS recent_avg, avg(v) FILTER (WHERE up <= 7) AS first_avg,
       max(v) FILTER (WHERE down = 1) AS current, count(*) AS days
  FROM (SELECT *, row_number() OVER (PARTITION BY resource_type ORDER BY date) AS up,
               row_number() OVER (PARTITION BY resource_type ORDER BY date DESC) AS down
        FROM (SELECT resource_type, date, avg(usage_cpu) AS v FROM usage GROUP BY resource_type, date))
  GROUP BY resource_type),
peak AS (SELECT resource_type, max(usage_cpu) AS max_cpu FROM usage GROUP BY resource_type)
 RETURN SELECT *, CASE WHEN max_cpu >= 95 THEN 'Critical' WHEN max_cpu >= 80 THEN 'Warning' ELSE 'Normal' END AS status,
       CASE WHEN days <= 14 THEN 'Insufficient data' WHEN NOT (recent_avg > first_avg AND first_avg > 0) THEN 'Stable/Decreasing'
            WHEN NOT (trend_rate > 0.1 AND current < 100) THEN 'Stable'
            WHEN (100 - current) / trend_rate < 365 THEN CAST(CAST(round((100 - current) / trend_rate) AS BIGINT) AS VARCHAR) || ' days'
            ELSE '1+ year' END AS projection
FROM (SELECT t.*, max_cpu, (recent_avg - first_avg) / 7 AS trend_rate FROM trend t JOIN peak p ON t.resource_type = p.resource_type)""",
)
def _(t):
    return insights.capacity_status(t.usage)


COST_SQL = """SELECT *, CASE WHEN roi >= 20 THEN 'Excellent' WHEN roi >= 15 THEN 'Good' WHEN roi >= 10 THEN 'Average'
       ELSE 'Poor' END AS roi_status FROM (
  SELECT resource_type, greatest(0.1, estimated) AS cost, greatest(0.1, eff * 10) AS benefit,
         greatest(0, eff * 100 / estimated) AS roi, estimated / users_served AS cost_per_user, users_served FROM (
    SELECT resource_type, avg(users_active) AS users_served, avg(users_active) / avg(usage_cpu) AS eff,
           avg(usage_cpu) * CASE resource_type WHEN 'VM' THEN 1.0 WHEN 'Storage' THEN 0.3 WHEN 'Container' THEN 0.8 ELSE 1.0 END AS estimated
    FROM usage GROUP BY resource_type))"""


@query(
    "a_44_cost_benefit",
    "resource_type cost:f benefit:f roi:f cost_per_user:f users_served:f roi_status",
    COST_SQL,
)
def _(t):
    return insights.cost_benefit(t.usage)


@query(
    "a_45_optimization_flags",
    "type resource message action priority",
    """SELECT 'Critical' AS type, resource_type AS resource, resource_type || ' approaching capacity limits' AS message,
       'Consider scaling up or load balancing' AS action, 'high' AS priority
FROM usage GROUP BY resource_type HAVING max(usage_cpu) > 90
UNION ALL
SELECT 'Efficiency', resource_type, resource_type || ' is underutilized', 'Consider consolidation or downsizing', 'medium'
FROM usage GROUP BY resource_type
HAVING max(usage_cpu) <= 90 AND avg(usage_cpu) < 30 AND coalesce(stddev_samp(usage_cpu), 0) < 10
UNION ALL
SELECT 'Stability', resource_type, resource_type || ' shows high variability', 'Implement auto-scaling or load smoothing', 'medium'
FROM usage GROUP BY resource_type
HAVING max(usage_cpu) <= 90 AND NOT (avg(usage_cpu) < 30 AND coalesce(stddev_samp(usage_cpu), 0) < 10)
   AND stddev_samp(usage_cpu) > 25""",
)
def _(t):
    return insights.optimization_flags(t.usage)


PERIOD_SQL = {
    "daily": "strftime(date, '%Y-%m-%d')",
    "weekly": "CAST(weekofyear(date) AS VARCHAR)",
    "monthly": "CAST(month(date) AS VARCHAR)",
    "quarterly": "CAST(quarter(date) AS VARCHAR)",
}


@query(
    "a_46_seasonal_pattern",
    "granularity period value:f",
    "\nUNION ALL ".join(
        f"SELECT '{g}' AS granularity, {p} AS period, avg(usage_cpu) AS value FROM behaviour GROUP BY {p}"
        for g, p in PERIOD_SQL.items()
    ),
)
def _(t):
    frame = insights.select_behaviour(t.usage)
    parts = [
        insights.seasonal_pattern(frame, g, "usage_cpu").withColumn("granularity", F.lit(g))
        for g in insights.GRANULARITY
    ]
    return ranking.union_forecasts(parts)


@query(
    "a_47_seasonal_stats",
    "variance:f range:f mean:f peak_value:f trough_value:f peak_period trough_period cv:f pattern_type wide_range",
    """WITH pattern AS (SELECT CAST(month(date) AS VARCHAR) AS period, avg(cpu_per_user) AS value FROM behaviour GROUP BY 1)
 RETURN SELECT *, CASE WHEN cv < 10 THEN 'Stable' WHEN cv < 25 THEN 'Moderate Variation' ELSE 'High Volatility' END AS pattern_type,
       range > mean * 0.5 AS wide_range FROM (
  SELECT var_samp(value) AS variance, max(value) - min(value) AS range, avg(value) AS mean,
         max(value) AS peak_value, min(value) AS trough_value,
         (SELECT period FROM pattern ORDER BY value DESC, period DESC LIMIT 1) AS peak_period,
         (SELECT period FROM pattern ORDER BY value, period LIMIT 1) AS trough_period,
         CASE WHEN avg(value) > 0 THEN stddev_samp(value) / avg(value) * 100 ELSE 0 END AS cv FROM pattern)""",
)
def _(t):
    frame = insights.select_behaviour(t.usage)
    return insights.seasonal_stats(insights.seasonal_pattern(frame, "monthly", "cpu_per_user"))


@query(
    "a_48_holiday_effect",
    "is_holiday:i mean:f rows:i q25:f q50:f q75:f change_pct:f",
    """SELECT is_holiday, avg(usage_storage) AS mean, count(*) AS rows, quantile_cont(usage_storage, 0.25) AS q25,
       quantile_cont(usage_storage, 0.5) AS q50, quantile_cont(usage_storage, 0.75) AS q75,
       (avg(usage_storage) - (SELECT avg(usage_storage) FROM behaviour WHERE is_holiday = 0))
         / (SELECT avg(usage_storage) FROM behaviour WHERE is_holiday = 0) * 100 AS change_pct
FROM behaviour GROUP BY is_holiday""",
)
def _(t):
    return insights.holiday_effect(insights.select_behaviour(t.usage), "usage_storage")


@query(
    "a_49_dow_profile",
    "weekday:i day_of_week mean:f std:f",
    """SELECT isodow(date) - 1 AS weekday, dayname(date) AS day_of_week, avg(usage_cpu) AS mean,
       stddev_samp(usage_cpu) AS std FROM behaviour GROUP BY isodow(date), dayname(date)""",
)
def _(t):
    return insights.dow_profile(insights.select_behaviour(t.usage), "usage_cpu")


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN count(*) > 1 THEN corr({x}, {y}) END"


@query(
    "a_50_user_behaviour",
    "avg_users:f avg_cpu_per_user:f avg_efficiency:f users_cpu_corr:f peak_users:i peak_date user_class relation",
    f"""SELECT b.*, p.users_active AS peak_users, p.date AS peak_date,
       CASE WHEN avg_cpu_per_user < 2 THEN 'Efficient' WHEN avg_cpu_per_user < 5 THEN 'Moderate' ELSE 'Resource Intensive' END AS user_class,
       CASE WHEN users_cpu_corr > 0.7 THEN 'strong positive' WHEN users_cpu_corr < -0.3 THEN 'negative' ELSE 'moderate' END AS relation
FROM (SELECT avg(users_active) AS avg_users, avg(cpu_per_user) AS avg_cpu_per_user, avg(user_efficiency) AS avg_efficiency,
             {corr_sql('users_active', 'usage_cpu')} AS users_cpu_corr FROM behaviour) b
CROSS JOIN (SELECT users_active, date FROM behaviour ORDER BY usage_cpu DESC, date, users_active LIMIT 1) p""",
)
def _(t):
    return insights.user_behaviour(insights.select_behaviour(t.usage))


@query(
    "a_51_efficiency_distribution",
    "resource_type min:f max:f mean:f q25:f q50:f q75:f",
    """SELECT resource_type, min(user_efficiency) AS min, max(user_efficiency) AS max, avg(user_efficiency) AS mean,
       quantile_cont(user_efficiency, 0.25) AS q25, quantile_cont(user_efficiency, 0.5) AS q50,
       quantile_cont(user_efficiency, 0.75) AS q75 FROM behaviour GROUP BY resource_type""",
)
def _(t):
    return insights.efficiency_distribution(insights.select_behaviour(t.usage))


@query(
    "a_52_behaviour_intelligence",
    "users_cpu_corr:f consistency:f predictability:f peak_to_trough:f holiday_impact_pct:f insights actions",
    f"""SELECT users_cpu_corr, consistency, predictability, peak_to_trough, holiday_impact_pct,
       concat_ws('; ', CASE WHEN rows > 12 AND seasonal_var > total_var * 0.5 THEN 'Strong seasonal patterns detected' END,
                 CASE WHEN holiday_impact_pct > 15 THEN 'Significant holiday effects observed' END,
                 CASE WHEN users_cpu_corr > 0.7 THEN 'Strong user-resource correlation' END) AS insights,
       concat_ws('; ', CASE WHEN consistency < 70 THEN 'Implement behavioral monitoring' END,
                 CASE WHEN predictability < 60 THEN 'Analyze user engagement patterns' END,
                 CASE WHEN peak_to_trough > 3 THEN 'Consider load balancing strategies' END,
                 'Continue monitoring seasonal trends', 'Plan for holiday capacity changes') AS actions
FROM (SELECT count(*) AS rows, var_samp(usage_cpu) AS total_var,
             (SELECT var_samp(v) FROM (SELECT avg(usage_cpu) AS v FROM behaviour GROUP BY month(date))) AS seasonal_var,
             abs((avg(usage_cpu) FILTER (WHERE is_holiday = 1) - avg(usage_cpu) FILTER (WHERE is_holiday = 0))
                 / avg(usage_cpu) FILTER (WHERE is_holiday = 0) * 100) AS holiday_impact_pct,
             {corr_sql('users_active', 'usage_cpu')} AS users_cpu_corr,
             100 - stddev_samp(usage_cpu) / avg(usage_cpu) * 100 AS consistency,
             100 - stddev_samp(users_active) / avg(users_active) * 100 AS predictability,
             CASE WHEN min(usage_cpu) > 0 THEN max(usage_cpu) / min(usage_cpu) ELSE 0 END AS peak_to_trough FROM behaviour)""",
)
def _(t):
    return insights.behaviour_intelligence(insights.select_behaviour(t.usage))


@query(
    "a_53_seasonal_export",
    "month:i day_of_week mean:f std:f min:f max:f users_mean:f holiday_rows:i",
    """SELECT month(date) AS month, dayname(date) AS day_of_week, round(avg(usage_cpu), 2) AS mean,
       round(stddev_samp(usage_cpu), 2) AS std, round(min(usage_cpu), 2) AS min, round(max(usage_cpu), 2) AS max,
       round(avg(users_active), 2) AS users_mean, sum(is_holiday) AS holiday_rows
FROM behaviour GROUP BY month(date), dayname(date)""",
)
def _(t):
    return insights.seasonal_export(insights.select_behaviour(t.usage), "usage_cpu")


@query(
    "a_54_insight_summary",
    "total_records:i date_range avg_metric_value:f metric_volatility:f user_efficiency:f",
    """SELECT count(*) AS total_records, CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS date_range,
       avg(usage_cpu) AS avg_metric_value, stddev_samp(usage_cpu) AS metric_volatility,
       avg(user_efficiency) AS user_efficiency FROM behaviour WHERE is_holiday = 0""",
)
def _(t):
    return insights.insight_summary(insights.select_behaviour(t.usage, include_holidays=False), "usage_cpu")


@query(
    "a_55_series_profile",
    "region days:i mean:f std:f min:i max:i cv_pct:f holiday_days:i",
    """SELECT region, count(*) AS days, avg(users_active) AS mean, stddev_samp(users_active) AS std,
       min(users_active) AS min, max(users_active) AS max, stddev_samp(users_active) / avg(users_active) * 100 AS cv_pct,
       sum(holiday) AS holiday_days FROM rd GROUP BY region""",
)
def _(t):
    return insights.series_profile(t.region_daily)


def rank_sql(c: str, direction: str = "DESC") -> str:
    return f"rank() OVER (ORDER BY {c} {direction}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query(
    "w_9_average_rank",
    "region usage_cpu:f usage_storage:f users_active:f usage_cpu_rank:f usage_storage_rank:f users_active_rank:f",
    "SELECT *, "
    + ", ".join(f"{rank_sql(m)} AS {m}_rank" for m in METRICS)
    + " FROM (SELECT region, "
    + ", ".join(f"round(avg({m}), 1) AS {m}" for m in METRICS)
    + " FROM usage GROUP BY region)",
)
def _(t):
    base = t.usage.groupBy("region").agg(*[F.round(F.avg(m), 1).alias(m) for m in METRICS])
    return ranking.metric_ranks(base, METRICS)


@query(
    "w_10_overall_ranking",
    "region avg_rank:f peak_rank:f volatility_rank:f overall_score:f overall_rank:f",
    f"""WITH {STATS},
ranked AS (SELECT *, round(avg_rank * 0.4 + peak_rank * 0.3 + volatility_rank * 0.3, 6) AS overall_score FROM (
  SELECT *, {rank_sql('avg')} AS avg_rank, {rank_sql('peak')} AS peak_rank,
         {rank_sql('volatility', 'ASC')} AS volatility_rank FROM stats))
 RETURN SELECT *, {rank_sql('overall_score', 'ASC')} AS overall_rank FROM ranked""",
)
def _(t):
    return ranking.overall_ranking(insights.regional_stats(t.usage, "usage_cpu"))


@query(
    "k_1_top_regions",
    "region total_cpu:f",
    "SELECT region, sum(usage_cpu) AS total_cpu FROM usage GROUP BY region ORDER BY total_cpu DESC, region LIMIT 5",
)
def _(t):
    return ranking.top_regions(t.usage)


@query(
    "k_2_recent",
    "table_name event_date label",
    """SELECT * FROM (SELECT 'monitoring' AS table_name, check_date AS event_date, data_hash AS label FROM monitoring
       ORDER BY check_date DESC LIMIT 50)
UNION ALL
SELECT * FROM (SELECT 'performance', training_date, region || '/' || metric_type || '/' || model_type FROM registry
       ORDER BY training_date DESC, region, metric_type, model_type LIMIT 200)""",
)
def _(t):
    checks = ranking.recent(t.monitoring, "check_date", 50).select(
        F.lit("monitoring").alias("table_name"),
        F.col("check_date").alias("event_date"),
        F.col("data_hash").alias("label"),
    )
    scores = ranking.recent(
        t.registry, "training_date", 200, ["region", "metric_type", "model_type"]
    ).select(
        F.lit("performance").alias("table_name"),
        F.col("training_date").alias("event_date"),
        F.concat_ws("/", "region", "metric_type", "model_type").alias("label"),
    )
    return checks.unionByName(scores)


@query(
    "k_3_strongest_pairs",
    "row column correlation:f strength",
    f"""SELECT "row", "column", correlation, CASE WHEN abs(correlation) >= 0.7 THEN 'Strong'
       WHEN abs(correlation) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM ({corr_long_sql('daily', NUMERIC)}) WHERE "row" < "column" ORDER BY abs(correlation) DESC, "row", "column" LIMIT 5""",
)
def _(t):
    return ranking.strongest_pairs(corr_matrix(t.daily), 5)


@query(
    "k_5_roi_ranking",
    "position:i resource_type roi:f",
    f"SELECT row_number() OVER (ORDER BY roi DESC, resource_type) AS position, resource_type, roi FROM ({COST_SQL})",
)
def _(t):
    return ranking.ranking(insights.cost_benefit(t.usage), "roi", "resource_type")


@query(
    "k_5_efficiency_ranking",
    "position:i region efficiency_score:f",
    f"""WITH {STATS}
 RETURN SELECT row_number() OVER (ORDER BY efficiency_score DESC, region) AS position, region, efficiency_score FROM (
  SELECT region, (avg / (SELECT max(avg) FROM stats) * 0.7
       + (1 - volatility / (SELECT max(volatility) FROM stats)) * 0.3) * 100 AS efficiency_score FROM stats)""",
)
def _(t):
    scored = insights.region_efficiency_score(insights.regional_stats(t.usage, "usage_cpu"))
    return ranking.ranking(scored, "efficiency_score", "region")


@query(
    "u_3_distinct_model_types",
    "model_type",
    "SELECT DISTINCT model_type FROM registry",
)
def _(t):
    return ranking.distinct_model_types(t.registry)


@query(
    "u_4_calendar_difference",
    "date",
    """SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM usage
EXCEPT SELECT date FROM external""",
)
def _(t):
    return ranking.calendar_difference(joins.calendar(t.usage, []), t.external)


