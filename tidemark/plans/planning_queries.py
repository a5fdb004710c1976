"""Forecast tables, model registry, monitoring and capacity planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capacity, evaluation, forecasting, joins, monitoring, ranking, registry
from ..sources.schemas import METRIC_TYPES, MODEL_TYPES
from .catalog import query
from .basics import PREDICTIONS
from .views import USAGE_HASH
from .window_queries import TREND_SQL, full

W = "WINDOW w AS (PARTITION BY region ORDER BY date)"


def features_sql(metric: str) -> str:
    target = METRIC_TYPES[metric]
    exprs = {
        f"lag1_{target}": f"lag({target}, 1) OVER w",
        f"lag7_{target}": f"lag({target}, 7) OVER w",
        f"roll7_mean_{target}": full("avg", target, 7),
        "lag1_cpu": "lag(usage_cpu, 1) OVER w",
        "lag1_storage": "lag(usage_storage, 1) OVER w",
        "lag1_users": "lag(users_active, 1) OVER w",
        "dow": "isodow(date) - 1",
    }
    names = forecasting.feature_names(metric)
    cols = ", ".join(f"{exprs[n]} AS {n}" if n in exprs else n for n in names)
    known = " AND ".join(f"{n} IS NOT NULL" for n in names)
    view = "rd" if metric == "users" else "rdm"
    return f"SELECT * FROM (SELECT region, date, {target} AS target, {cols} FROM {view} {W}) WHERE {known}"


def _features(metric):
    declared = "region date target:f " + " ".join(f"{n}:f" for n in forecasting.feature_names(metric))

    @query(f"m_1_feature_frame_{metric}", declared, features_sql(metric))
    def _(t):
        series = t.region_daily if metric == "users" else t.region_daily_mean
        return forecasting.feature_frame(series, metric)


for _metric in METRIC_TYPES:
    _features(_metric)


WIDE = {
    "lag_1": "lag(usage_cpu, 1) OVER w",
    "lag_7": "lag(usage_cpu, 7) OVER w",
    "lag_30": "lag(usage_cpu, 30) OVER w",
    "rolling_7_mean": full("avg", "usage_cpu", 7),
    "rolling_7_std": full("stddev_samp", "usage_cpu", 7),
    "rolling_14_mean": full("avg", "usage_cpu", 14),
    "rolling_30_mean": full("avg", "usage_cpu", 30),
    "storage_lag_1": "lag(usage_storage, 1) OVER w",
    "storage_rolling_7": full("avg", "usage_storage", 7),
    "users_lag_1": "lag(users_active, 1) OVER w",
    "users_rolling_7": full("avg", "users_active", 7),
    "day_of_week": "isodow(date) - 1",
    "day_of_month": "day(date)",
    "month": "month(date)",
    "quarter": "quarter(date)",
    "economic_lag_1": "lag(economic_index, 1) OVER w",
    "holiday_lag_1": "lag(holiday, 1) OVER w",
    "holiday_rolling_7": full("sum", "holiday", 7),
}


@query(
    "m_2_feature_frame_wide",
    "region date usage_cpu:f " + " ".join(f"{n}:f" for n in WIDE),
    "SELECT * FROM (SELECT *, "
    + ", ".join(f"{e} AS {n}" for n, e in WIDE.items())
    + f" FROM rdm {W}) WHERE lag_30 IS NOT NULL AND economic_index IS NOT NULL AND economic_lag_1 IS NOT NULL",
)
def _(t):
    return forecasting.feature_frame_wide(t.region_daily_mean)


def long_series(t):
    return evaluation.long_series(t.daily_series)


def baseline(t):
    """Seasonal-naive forecasts, or those that the tables hold (``fitted_queries``)."""
    if hasattr(t, "fitted_forecast"):
        return t.fitted_forecast
    return forecasting.seasonal_naive(long_series(t))


@query(
    "m_10_baseline_forecast",
    "region metric_type step:i date predicted:f model_type",
    """WITH ends AS (SELECT region, metric_type, max(date) AS last_date, avg(value) AS mean, arg_min(value, date) AS first_value,
       arg_max(value, date) AS last_value, count(*) AS n FROM rdlong GROUP BY region, metric_type),
steps AS (SELECT *, unnest(range(1, 31)) AS step FROM ends)
 RETURN SELECT region, metric_type, step, date, predicted, 'SeasonalNaive' AS model_type FROM forecast
UNION ALL SELECT region, metric_type, step, CAST(last_date + CAST(step AS INTEGER) AS DATE), greatest(mean, 0), 'Mean' FROM steps
UNION ALL SELECT region, metric_type, step, CAST(last_date + CAST(step AS INTEGER) AS DATE),
       greatest(last_value + (last_value - first_value) / (n - 1) * step, 0), 'Drift' FROM steps""",
)
def _(t):
    return forecasting.baseline_forecast(long_series(t))


@query(
    "m_11_forecast_frame",
    "region metric_type kind step:i date value:f",
    """SELECT region, metric_type, 'actual' AS kind, 1 - rn AS step, date, value FROM (
  SELECT *, row_number() OVER (PARTITION BY region, metric_type ORDER BY date DESC) AS rn FROM rdlong) WHERE rn <= 14
UNION ALL SELECT region, metric_type, 'forecast', step, date, greatest(predicted, 0) FROM forecast
WHERE step <= CASE metric_type WHEN 'cpu' THEN 5 ELSE 7 END""",
)
def _(t):
    return forecasting.forecast_frame(long_series(t), baseline(t), 5)


@query(
    "m_12_forecast_band",
    "region metric_type step:i date predicted:f upper:f lower:f",
    "SELECT *, predicted * CAST(1.1 AS DOUBLE) AS upper, predicted * CAST(0.9 AS DOUBLE) AS lower FROM forecast",
)
def _(t):
    return forecasting.forecast_band(baseline(t))


SUMMARY = """SELECT region, metric_type, avg(predicted) AS avg_predicted, max(predicted) AS max_predicted,
       min(predicted) AS min_predicted, count(*) AS forecast_days, max(predicted) - min(predicted) AS range
FROM forecast GROUP BY region, metric_type"""


@query(
    "m_13_forecast_summary",
    "region metric_type avg_predicted:f max_predicted:f min_predicted:f forecast_days:i range:f",
    SUMMARY,
)
def _(t):
    return forecasting.forecast_summary(baseline(t))


@query(
    "m_13_forecast_insights",
    "metric_type lowest_region highest_region total_average:f",
    f"""WITH s AS (SELECT region, metric_type, round(avg_predicted, 1) AS a FROM ({SUMMARY}))
 RETURN SELECT metric_type, arg_min(region, struct_pack(a := a, r := region)) AS lowest_region,
       arg_max(region, struct_pack(a := a, r := region)) AS highest_region, sum(a) AS total_average FROM s GROUP BY metric_type""",
)
def _(t):
    return forecasting.forecast_insights(forecasting.forecast_summary(baseline(t)))


@query(
    "m_14_error_metrics",
    "region model_type metric_type rmse:f mae:f mape:f mse:f r2:f n:i",
    """SELECT region, model_type, metric_type, sqrt(mse) AS rmse, mae, mape, mse,
       coalesce(1 - mse / nullif(spread, 0), 0) AS r2, n FROM (
  SELECT region, model_type, metric_type, avg(absolute_error * absolute_error) AS mse, avg(absolute_error) AS mae,
         avg(percentage_error) AS mape, var_pop(actual_value) AS spread, count(*) AS n
  FROM preds GROUP BY region, model_type, metric_type)""",
)
def _(t):
    return evaluation.error_metrics(t.predictions, ["region", "model_type", "metric_type"])


@query(
    "m_15_residuals",
    "region model_type metric_type prediction_date actual_value:f predicted_value:f residual:f",
    "SELECT *, actual_value - predicted_value AS residual FROM preds",
)
def _(t):
    return evaluation.residuals(t.predictions)


TOTAL = """scores AS (SELECT region, metric_type, model_type, sqrt(avg(absolute_error * absolute_error)) AS rmse,
       avg(absolute_error) AS mae, avg(percentage_error) AS mape FROM preds GROUP BY region, metric_type, model_type)"""


def total_scores(t):
    return evaluation.error_metrics(t.predictions, ["region", "metric_type", "model_type"])


@query(
    "m_16_compare_models",
    "region metric_type " + " ".join(f"rmse_{m}:f" for m in MODEL_TYPES) + " best_model best_rmse:f mean_rmse:f",
    f"""WITH {TOTAL}
 RETURN SELECT region, metric_type, """
    + ", ".join(f"max(rmse) FILTER (WHERE model_type = '{m}') AS \"rmse_{m}\"" for m in MODEL_TYPES)
    + """, arg_min(model_type, struct_pack(r := round(rmse, 6), m := model_type)) AS best_model,
       min(rmse) AS best_rmse, avg(rmse) AS mean_rmse FROM scores GROUP BY region, metric_type""",
)
def _(t):
    return evaluation.compare_models(total_scores(t))


@query(
    "m_20_select_best",
    "region metric_type model_type rmse:f mae:f mape:f",
    f"""WITH {TOTAL}
 RETURN SELECT region, metric_type, model_type, rmse, mae, mape FROM scores
QUALIFY row_number() OVER (PARTITION BY region, metric_type ORDER BY round(rmse, 6), model_type) = 1""",
)
def _(t):
    return evaluation.select_best(total_scores(t))


@query(
    "u_1_union_forecasts",
    "region metric_type step:i date predicted:f",
    "SELECT * FROM forecast",
)
def _(t):
    series = long_series(t)
    parts = [
        forecasting.seasonal_naive(series.filter(F.col("metric_type") == m)) for m in METRIC_TYPES
    ]
    return ranking.union_forecasts(parts)


SERVICE_CASE = "CASE metric_type WHEN 'cpu' THEN 'Compute' WHEN 'users' THEN 'Users' ELSE 'Storage' END"


@query(
    "u_2_available_services",
    "service region",
    f"SELECT DISTINCT {SERVICE_CASE} AS service, region FROM forecast",
)
def _(t):
    return ranking.available_services(baseline(t))


# --- registry ---------------------------------------------------------------------


FINGERPRINT = f"""SELECT CAST(count(*) AS VARCHAR) || ':' || CAST(CAST(sum(CAST(h AS HUGEINT)) AS HUGEINT) % 1152921504606846976 AS VARCHAR)
       || ':' || CAST(bit_xor(h) AS VARCHAR) AS data_hash, count(*) AS data_size
FROM (SELECT {USAGE_HASH} AS h FROM usage)"""


@query("g_1_data_fingerprint", "data_hash data_size:i", FINGERPRINT)
def _(t):
    return registry.data_fingerprint(t.usage)


@query(
    "g_2_check_changes",
    "data_hash data_size:i new_records:i percent_change:f first_run hash_changed training_triggered",
    """SELECT m.data_hash, m.data_size, m.data_size - p.data_size AS new_records,
       (m.data_size - p.data_size) / p.data_size * 100 AS percent_change, FALSE AS first_run,
       m.data_hash <> p.data_hash AS hash_changed,
       m.data_hash <> p.data_hash AND (m.data_size - p.data_size) / p.data_size * 100 >= 5 AS training_triggered
FROM (""" + FINGERPRINT + """) m
CROSS JOIN (SELECT * FROM monitoring ORDER BY check_date DESC LIMIT 1 OFFSET 1) p""",
)
def _(t):
    """Everything known now against the last check before the newest month."""
    log = t.monitoring
    earlier = log.filter(F.col("check_date") < log.agg(F.max("check_date")).scalar())
    return registry.check_changes(registry.data_fingerprint(t.usage), earlier)


ACTIVE_SQL = """SELECT region, metric_type, model_type, rmse, mae, mape, training_date,
       is_active AND row_number() OVER (PARTITION BY region, metric_type, is_active ORDER BY training_date DESC, model_type) = 1 AS is_active
FROM registry"""
SCORES = "region metric_type model_type rmse:f mae:f mape:f training_date"


@query("g_3_record_performance", SCORES + " is_active", ACTIVE_SQL)
def _(t):
    return registry.record_performance(t.registry)


CURRENT_SQL = """SELECT region, metric_type, model_type, rmse, mae, mape, training_date AS updated_date FROM registry
WHERE training_date = (SELECT min(training_date) FROM registry)
QUALIFY row_number() OVER (PARTITION BY region, metric_type ORDER BY round(rmse, 6), model_type) = 1"""


def first_session_best(t):
    first = t.registry.agg(F.min("training_date")).scalar()
    opening = t.registry.filter(F.col("training_date") == first)
    return evaluation.select_best(opening).withColumnRenamed("training_date", "updated_date")


@query(
    "g_4_upsert_best_model",
    "region metric_type model_type rmse:f mae:f mape:f updated_date",
    f"""WITH cur AS ({CURRENT_SQL})
 RETURN SELECT region, metric_type,
       CASE WHEN a.rmse IS NULL OR b.rmse <= a.rmse THEN b.model_type ELSE a.model_type END AS model_type,
       CASE WHEN a.rmse IS NULL OR b.rmse <= a.rmse THEN b.rmse ELSE a.rmse END AS rmse,
       CASE WHEN a.rmse IS NULL OR b.rmse <= a.rmse THEN b.mae ELSE a.mae END AS mae,
       CASE WHEN a.rmse IS NULL OR b.rmse <= a.rmse THEN b.mape ELSE a.mape END AS mape,
       CASE WHEN a.rmse IS NULL OR b.rmse <= a.rmse THEN b.updated_date ELSE a.updated_date END AS updated_date
FROM cur a FULL OUTER JOIN best_model b USING (region, metric_type)""",
)
def _(t):
    return registry.upsert_best_model(first_session_best(t), evaluation.best_models(t.registry))


@query(
    "g_5_current_best_rmse",
    "region metric_type current_rmse:f",
    "SELECT region, metric_type, arg_max(rmse, training_date) AS current_rmse FROM registry WHERE is_active GROUP BY region, metric_type",
)
def _(t):
    return registry.current_best_rmse(t.registry)


@query("g_6_active_models", SCORES, "SELECT * FROM registry WHERE is_active")
def _(t):
    return registry.active_models(t.registry)


LATEST_SQL = """SELECT region, metric_type, model_type, rmse, mae, mape, training_date FROM registry
QUALIFY row_number() OVER (PARTITION BY region, metric_type, model_type ORDER BY training_date DESC) = 1"""


@query("g_7_latest_per_model", SCORES, LATEST_SQL)
def _(t):
    return registry.latest_per_model(t.registry)


@query(
    "g_8_training_comparison",
    "region metric_type model_type best_rmse:f avg_rmse:f training_count:i",
    """SELECT region, metric_type, model_type, min(rmse) AS best_rmse, avg(rmse) AS avg_rmse, count(*) AS training_count
FROM registry GROUP BY region, metric_type, model_type""",
)
def _(t):
    return registry.training_comparison(t.registry)


@query(
    "g_9_best_selection",
    "region metric_type model_type source",
    """WITH known AS (SELECT * FROM best_model WHERE metric_type <> 'users' OR region IN ('ASIA', 'EUROPE')),
complete AS (SELECT * FROM known WHERE metric_type IN (
  SELECT metric_type FROM known GROUP BY metric_type HAVING count(DISTINCT region) >= 4))
 RETURN SELECT region, metric_type, coalesce(c.model_type, 'SeasonalNaive') AS model_type,
       CASE WHEN c.model_type IS NOT NULL THEN 'registry' ELSE 'static_fallback' END AS source
FROM (SELECT DISTINCT region, metric_type FROM registry) s LEFT JOIN complete c USING (region, metric_type)""",
)
def _(t):
    best = evaluation.best_models(t.registry)
    known = best.filter((F.col("metric_type") != "users") | F.col("region").isin("ASIA", "EUROPE"))
    return registry.best_selection(known, t.registry, "SeasonalNaive")


@query(
    "g_10_model_comparison",
    "metric_type avg_rmse:f avg_mae:f best_region model_types",
    """SELECT metric_type, avg(rmse) AS avg_rmse, avg(mae) AS avg_mae,
       arg_min(region, struct_pack(r := round(rmse, 6), g := region)) AS best_region,
       string_agg(DISTINCT model_type, ',' ORDER BY model_type) AS model_types FROM best_model GROUP BY metric_type""",
)
def _(t):
    return registry.model_comparison(evaluation.best_models(t.registry))


HEAT = [f"{m}_{k}" for m in METRIC_TYPES for k in MODEL_TYPES]


@query(
    "g_11_rmse_heatmap",
    "region " + " ".join(f"{c}:f" for c in HEAT),
    "SELECT region, "
    + ", ".join(
        f"avg(rmse) FILTER (WHERE metric_type = '{m}' AND model_type = '{k}') AS \"{m}_{k}\""
        for m in METRIC_TYPES
        for k in MODEL_TYPES
    )
    + f" FROM ({LATEST_SQL}) GROUP BY region",
)
def _(t):
    return registry.rmse_heatmap(registry.latest_per_model(t.registry), list(METRIC_TYPES), MODEL_TYPES)


@query(
    "g_12_best_rows",
    "region metric_type model_type rmse:f mae:f",
    f"""SELECT * FROM ({LATEST_SQL})
QUALIFY row_number() OVER (PARTITION BY region, metric_type ORDER BY round(rmse, 6), model_type) = 1""",
)
def _(t):
    return evaluation.select_best(registry.latest_per_model(t.registry))


@query(
    "g_13_activity_summary",
    "total_checks:i training_sessions:i avg_new_records:f",
    """SELECT count(*) AS total_checks, count(*) FILTER (WHERE training_triggered) AS training_sessions,
       avg(new_records) AS avg_new_records FROM monitoring""",
)
def _(t):
    return registry.activity_summary(t.monitoring)


IMPROVED_SQL = f"""SELECT b.region, b.metric_type, b.model_type, b.rmse, c.rmse AS current_rmse,
       c.rmse IS NULL OR b.rmse < c.rmse AS improved
FROM best_model b LEFT JOIN ({CURRENT_SQL}) c ON b.region = c.region AND b.metric_type = c.metric_type"""


def improvements(t):
    current = first_session_best(t).withColumnRenamed("rmse", "current_rmse")
    return registry.improvement(current, evaluation.best_models(t.registry))


@query(
    "g_14_training_report",
    "metric_type models_trained:i regions:i models_improved:i models_deployed:i best_models",
    f"""SELECT * FROM (SELECT metric_type, count(*) AS models_trained, count(DISTINCT region) AS regions FROM ({LATEST_SQL}) GROUP BY metric_type)
JOIN (SELECT metric_type, count(*) FILTER (WHERE improved) AS models_improved, count(*) FILTER (WHERE improved) AS models_deployed,
             string_agg(region || '=' || model_type, ';' ORDER BY region) AS best_models FROM ({IMPROVED_SQL}) GROUP BY metric_type)
USING (metric_type)""",
)
def _(t):
    return registry.training_report(improvements(t), registry.latest_per_model(t.registry))


@query(
    "g_15_improvement",
    "region metric_type model_type rmse:f current_rmse:f improved",
    IMPROVED_SQL,
)
def _(t):
    return improvements(t)


@query(
    "g_16_debug_summary",
    "region columns rows:i min_users:i max_users:i last_date",
    """SELECT region, 'region,date,usage_cpu,usage_storage,users_active,economic_index,cloud_market_demand,holiday' AS columns,
       count(*) AS rows, min(users_active) AS min_users, max(users_active) AS max_users, max(date) AS last_date
FROM rd GROUP BY region""",
)
def _(t):
    return registry.debug_summary(t.region_daily)


@query(
    "g_17_model_distribution",
    "metric_type model_type regions:i",
    "SELECT metric_type, model_type, count(*) AS regions FROM best_model GROUP BY metric_type, model_type",
)
def _(t):
    return registry.model_distribution(evaluation.best_models(t.registry))


@query(
    "g_18_training_status",
    "section name value:f event_date",
    """SELECT 'model' AS section, region || '/' || metric_type || '/' || model_type AS name, rmse AS value, training_date AS event_date
FROM registry WHERE is_active
UNION ALL SELECT * FROM (SELECT 'check', 'triggered/' || CAST(training_triggered AS VARCHAR), CAST(new_records AS DOUBLE), check_date
                         FROM monitoring ORDER BY check_date DESC LIMIT 10)
UNION ALL SELECT 'last_check', 'last_check', NULL, max(check_date) FROM monitoring""",
)
def _(t):
    return registry.training_status(t.registry, t.monitoring)


# --- monitoring -------------------------------------------------------------------

ACCURACY_SQL = f"""SELECT a.region, accuracy, mae, rmse, trend, cpu_model, users_model FROM (
  SELECT region, round(avg(100 - percentage_error), 1) AS accuracy,
         round(avg(absolute_error) FILTER (WHERE metric_type = 'cpu'), 2) AS mae,
         round(sqrt(avg(absolute_error * absolute_error) FILTER (WHERE metric_type = 'cpu')), 2) AS rmse
  FROM preds JOIN best_model USING (region, metric_type, model_type)
  WHERE metric_type IN ('cpu', 'users') AND prediction_date > (SELECT max(prediction_date) FROM preds) - 30 GROUP BY region) a
JOIN (SELECT region, trend FROM ({TREND_SQL})) t ON a.region = t.region
JOIN (SELECT region, max(model_type) FILTER (WHERE metric_type = 'cpu') AS cpu_model,
             max(model_type) FILTER (WHERE metric_type = 'users') AS users_model FROM best_model GROUP BY region) m ON a.region = m.region"""


def accuracy(t):
    return monitoring.measured_accuracy(t.predictions, evaluation.best_models(t.registry), t.daily_series)


@query(
    "mon_1_measured_accuracy",
    "region accuracy:f mae:f rmse:f trend cpu_model users_model",
    ACCURACY_SQL,
)
def _(t):
    return accuracy(t)


@query(
    "mon_2_health_summary",
    "overall_status average_accuracy:f total_models:i healthy_models:i warning_models:i critical_models:i",
    f"""SELECT CASE WHEN count(*) = 0 THEN 'UNKNOWN' WHEN avg(accuracy) >= 85 THEN 'HEALTHY' WHEN avg(accuracy) >= 70 THEN 'WARNING'
       ELSE 'CRITICAL' END AS overall_status, round(avg(accuracy), 1) AS average_accuracy, count(*) AS total_models,
       count(*) FILTER (WHERE accuracy >= 85) AS healthy_models, count(*) FILTER (WHERE accuracy >= 70 AND accuracy < 85) AS warning_models,
       count(*) FILTER (WHERE accuracy < 70) AS critical_models FROM ({ACCURACY_SQL})""",
)
def _(t):
    return monitoring.health_summary(accuracy(t))


@query(
    "mon_3_retrain_list",
    "region reason priority",
    f"""SELECT region, CASE WHEN accuracy < 70 THEN 'Accuracy below threshold: ' ELSE 'Declining accuracy trend: ' END
         || format('{{:.1f}}%', accuracy) AS reason, CASE WHEN accuracy < 70 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM ({ACCURACY_SQL}) WHERE accuracy < 70 OR (trend = 'declining' AND accuracy < 80)""",
)
def _(t):
    return monitoring.retrain_list(accuracy(t))


LAST_WEEK_SQL = """SELECT *, CASE WHEN accuracy >= 85 THEN 'healthy' WHEN accuracy >= 75 THEN 'warning' ELSE 'critical' END AS status FROM (
  SELECT region, model_type, metric_type, avg(100 - percentage_error) AS accuracy, count(*) AS predictions_count FROM preds
  WHERE prediction_date > (SELECT max(prediction_date) FROM preds) - 7 GROUP BY region, model_type, metric_type)"""


@query(
    "mon_4_accuracy_last_7_days",
    "region model_type metric_type accuracy:f predictions_count:i status",
    LAST_WEEK_SQL,
)
def _(t):
    return monitoring.accuracy_last_days(t.predictions)


@query(
    "mon_5_drift_flag",
    "region model_type metric_type accuracy:f threshold:f needs_retraining",
    f"SELECT region, model_type, metric_type, accuracy, 85 AS threshold, accuracy < 85 AS needs_retraining FROM ({LAST_WEEK_SQL})",
)
def _(t):
    return monitoring.drift_flag(monitoring.accuracy_last_days(t.predictions))


def plan(t, **options):
    return capacity.capacity_plan(baseline(t), t.daily_series, **options)


@query(
    "mon_6_alerts",
    "kind region message",
    f"""SELECT 'accuracy' AS kind, region, 'Low accuracy in ' || region || format(': {{:.1f}}%', accuracy) AS message
FROM ({ACCURACY_SQL}) WHERE accuracy < 75
UNION ALL SELECT 'capacity', region, 'High capacity risk in ' || region || format(': {{:.1f}}% utilization', peak_pct)
FROM overall WHERE overall_risk = 'HIGH'""",
)
def _(t):
    return monitoring.alerts(accuracy(t), plan(t))


# --- capacity ---------------------------------------------------------------------


@query(
    "c_1_current_capacity",
    "region service metric_type current_capacity:f",
    "SELECT * FROM capacity",
)
def _(t):
    return capacity.current_capacity(t.region_daily)


@query(
    "c_2_demand_to_capacity",
    "region step:i date service required:f",
    """WITH hist AS (SELECT region, (quantile_cont(usage_cpu, 0.75) + quantile_cont(usage_cpu, 0.9) + quantile_cont(usage_cpu, 0.95)) / 3 / avg(usage_cpu) AS f,
       stddev_pop(users_active) * 0.2 AS buffer, abs(corr(usage_cpu, usage_storage)) AS rc, abs(corr(users_active, usage_storage)) AS ru
  FROM rd GROUP BY region),
wide AS (SELECT region, step, date, max(predicted) FILTER (WHERE metric_type = 'cpu') AS cpu,
         max(predicted) FILTER (WHERE metric_type = 'users') AS users FROM forecast GROUP BY region, step, date),
paired AS (SELECT * FROM wide JOIN hist USING (region))
 RETURN SELECT region, step, date, 'Compute' AS service, cpu * f * 15 AS required FROM paired
UNION ALL SELECT region, step, date, 'Users', users + buffer FROM paired
UNION ALL SELECT region, step, date, 'Storage', cpu * (rc / (rc + ru)) * 20 + users * (ru / (rc + ru)) * 0.1 FROM paired""",
)
def _(t):
    return capacity.demand_to_capacity(baseline(t), t.daily_series)


@query(
    "c_3_demand_stats",
    "region metric_type max_demand:f avg_demand:f min_demand:f days:i",
    "SELECT * FROM demand",
)
def _(t):
    return capacity.demand_stats(baseline(t))


PLAN = "region service current_capacity:f max_demand:f avg_demand:f min_demand:f peak_pct:f avg_pct:f"


def _joined(t):
    return joins.capacity_join(
        capacity.demand_stats(baseline(t)), capacity.current_capacity(t.daily_series)
    )


@query("j_7_capacity_join", PLAN, "SELECT * FROM risk")
def _(t):
    return _joined(t)


@query("c_4_utilization_risk", "region service peak_pct:f utilization_risk utilization_message", "SELECT * FROM risk")
def _(t):
    return capacity.utilization_risk(_joined(t))


@query("c_5_provision_risk", "region service avg_pct:f provision_risk provision_message", "SELECT * FROM risk")
def _(t):
    return capacity.provision_risk(_joined(t))


@query("c_6_overall_risk", "region service utilization_risk provision_risk overall_risk", "SELECT * FROM overall")
def _(t):
    return capacity.overall_risk(capacity.provision_risk(capacity.utilization_risk(_joined(t))))


@query(
    "c_7_recommendations",
    "region service type priority action timeline impact",
    "SELECT * FROM recommendations",
)
def _(t):
    return capacity.recommendations(plan(t))


@query("c_8_capacity_plan", PLAN + " utilization_risk provision_risk overall_risk", "SELECT * FROM overall")
def _(t):
    return plan(t)


@query(
    "c_8_capacity_plan_region",
    "region service current_capacity:f max_demand:f avg_demand:f peak_pct:f overall_risk",
    """SELECT c.region, c.service, current_capacity, m AS max_demand, a AS avg_demand, m / current_capacity * 100 AS peak_pct,
       CASE WHEN m / current_capacity * 100 >= 95 OR a / current_capacity * 100 >= 80 THEN 'HIGH'
            WHEN m / current_capacity * 100 >= 75 OR a / current_capacity * 100 <= 25 THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk
FROM capacity c JOIN (SELECT region, max(predicted) * 15 AS m, avg(predicted) * 15 AS a FROM forecast
                      WHERE metric_type = 'cpu' AND step <= 7 GROUP BY region) f ON c.region = f.region
WHERE c.service = 'Compute' AND c.region = 'ASIA'""",
)
def _(t):
    return plan(t, service="Compute", region="ASIA", horizon=7, scaled_demand=True)


@query(
    "c_9_capacity_summary",
    "service total_regions:i high_risk:i medium_risk:i low_risk:i overall_status",
    """SELECT *, CASE WHEN high_risk > 0 THEN 'CRITICAL' WHEN medium_risk > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS overall_status FROM (
  SELECT service, count(*) AS total_regions, count(*) FILTER (WHERE overall_risk = 'HIGH') AS high_risk,
         count(*) FILTER (WHERE overall_risk = 'MEDIUM') AS medium_risk, count(*) FILTER (WHERE overall_risk = 'LOW') AS low_risk
  FROM overall GROUP BY service)""",
)
def _(t):
    return capacity.capacity_summary(plan(t))


@query(
    "c_10_optimization_overview",
    "service regions:i over_provisioned:i avg_utilization:f scale_ups:i urgent_scale_ups:i band",
    """SELECT *, CASE WHEN avg_utilization BETWEEN 60 AND 80 THEN 'Optimal' ELSE 'Sub-optimal' END AS band FROM (
  SELECT service, count(*) AS regions, count(*) FILTER (WHERE round(avg_pct, 1) < 40) AS over_provisioned,
         avg(round(avg_pct, 1)) AS avg_utilization FROM overall GROUP BY service)
JOIN (SELECT service, count(*) FILTER (WHERE type = 'SCALE_UP') AS scale_ups,
             count(*) FILTER (WHERE type = 'SCALE_UP' AND priority = 'HIGH') AS urgent_scale_ups FROM recommendations GROUP BY service)
USING (service)""",
)
def _(t):
    return capacity.optimization_overview(plan(t))


MODELS_SQL = """(SELECT region, max(model_type) FILTER (WHERE metric_type = 'cpu') AS cpu_model,
             max(model_type) FILTER (WHERE metric_type = 'users') AS users_model,
             max(model_type) FILTER (WHERE metric_type = 'storage') AS storage_model FROM best_model GROUP BY region)"""


@query(
    "c_11_capacity_report",
    "region service_type forecast_horizon_days:i current_capacity:f peak_demand:f average_demand:f min_demand:f "
    "peak_utilization_pct:f average_utilization_pct:f risk_level risk_message cpu_model users_model storage_model",
    f"""SELECT o.region, service AS service_type, 30 AS forecast_horizon_days, current_capacity, round(max_demand, 2) AS peak_demand,
       round(avg_demand, 2) AS average_demand, round(o.min_demand, 2) AS min_demand, round(peak_pct, 1) AS peak_utilization_pct,
       round(avg_pct, 1) AS average_utilization_pct, overall_risk AS risk_level, utilization_message AS risk_message,
       cpu_model, users_model, storage_model FROM overall o LEFT JOIN {MODELS_SQL} m ON o.region = m.region""",
)
def _(t):
    return capacity.capacity_report(plan(t), evaluation.best_models(t.registry))


@query(
    "c_12_recommendation_export",
    "region service_type recommendation_type priority action_required timeline expected_impact",
    """SELECT region, service AS service_type, type AS recommendation_type, priority, action AS action_required, timeline,
       impact AS expected_impact FROM recommendations""",
)
def _(t):
    return capacity.recommendation_export(plan(t))


@query(
    "c_12_recommendation_counts",
    "priority recommendations:i",
    "SELECT priority, count(*) AS recommendations FROM recommendations GROUP BY priority",
)
def _(t):
    return capacity.recommendation_counts(plan(t))


@query(
    "c_13_forecast_report",
    "date region cpu_forecast:f users_forecast:f capacity_status",
    """SELECT f.date, f.region, cpu_forecast, users_forecast,
       CASE WHEN users_forecast / current_capacity * 100 >= 95 THEN 'Critical'
            WHEN users_forecast / current_capacity * 100 >= 75 THEN 'Warning' ELSE 'Normal' END AS capacity_status
FROM (SELECT date, region, max(predicted) FILTER (WHERE metric_type = 'cpu') AS cpu_forecast,
             max(predicted) FILTER (WHERE metric_type = 'users') AS users_forecast FROM forecast GROUP BY date, region) f
JOIN capacity c ON f.region = c.region AND c.service = 'Users'""",
)
def _(t):
    return capacity.forecast_report(baseline(t), plan(t))


@query(
    "c_14_risk_matrix",
    "region service risk_level current_capacity:f peak_demand:f avg_demand:f peak_utilization:f avg_utilization:f "
    "status cpu_model users_model storage_model",
    f"""SELECT o.region, service, overall_risk AS risk_level, current_capacity, max_demand AS peak_demand, avg_demand,
       round(peak_pct, 1) AS peak_utilization, round(avg_pct, 1) AS avg_utilization, utilization_message AS status,
       cpu_model, users_model, storage_model FROM overall o LEFT JOIN {MODELS_SQL} m ON o.region = m.region""",
)
def _(t):
    return capacity.risk_matrix(plan(t), evaluation.best_models(t.registry))


@query(
    "k_4_top_recommendations",
    "priority_rank:i position:i region service type priority",
    """SELECT CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS priority_rank, position, region, service, type, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY priority ORDER BY region, service, type) AS position FROM recommendations)
WHERE (priority <> 'HIGH' OR position <= 3) AND (priority <> 'MEDIUM' OR position <= 2)""",
)
def _(t):
    return ranking.top_recommendations(
        capacity.recommendations(plan(t)), {"HIGH": 3, "MEDIUM": 2, "LOW": None}
    )
