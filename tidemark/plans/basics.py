"""Scans, sinks, filters, cleaning, joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import evaluation, filters, joins, windows
from ..session import scratch_path
from ..sources import readers, writers
from ..sources.schemas import NUMERIC, RESOURCES
from .catalog import query

FACT = (
    "date region resource_type usage_cpu:f usage_storage:f users_active:i "
    "economic_index:f cloud_market_demand:f holiday:i"
)
USAGE = "date region resource_type usage_cpu:f usage_storage:f users_active:i"
USAGE_COLS = [c.split(":")[0] for c in USAGE.split()]


@query("src_1_read_usage", FACT, "SELECT * FROM merged")
def _(t):
    path = scratch_path(t.spark, "usage-csv")
    t.merged.select(*[c.split(":")[0] for c in FACT.split()]).write.option("header", True).csv(path)
    return readers.read_usage(t.spark, path, "csv")


@query(
    "src_2_read_external",
    "date economic_index:f cloud_market_demand:f holiday:i",
    "SELECT * FROM external",
)
def _(t):
    path = scratch_path(t.spark, "external-csv")
    t.external.write.option("header", True).csv(path)
    return readers.read_external(t.spark, path)


@query(
    "src_3_with_calendar",
    USAGE + " month:i quarter:i is_weekend:i",
    """SELECT *, month(date) AS month, quarter(date) AS quarter,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM usage""",
)
def _(t):
    return readers.with_calendar(t.usage)


REGISTRY = (
    "region metric_type model_type rmse:f mae:f mape:f training_date data_hash data_size:i is_active"
)


@query("src_4_read_registry", REGISTRY, "SELECT * FROM registry")
def _(t):
    path = scratch_path(t.spark, "model-performance")
    t.registry.write.parquet(path)
    return readers.read_registry(t.spark, "model_performance", path)


@query("src_5_raw_records", FACT, "SELECT * FROM fact")
def _(t):
    return readers.raw_records(t.fact)


@query("snk_1_write_dataset", FACT, "SELECT * FROM fact")
def _(t):
    path = scratch_path(t.spark, "dataset")
    writers.write_dataset(t.fact, path)
    return t.spark.read.parquet(path)


@query(
    "snk_2_write_report_json",
    "region metric_type model_type rmse:f",
    "SELECT region, metric_type, model_type, rmse FROM best_model",
)
def _(t):
    path = scratch_path(t.spark, "report")
    best = evaluation.best_models(t.registry).select("region", "metric_type", "model_type", "rmse")
    writers.write_report_json(writers.nested_report(best, "region", "models"), path)
    schema = "region string, models array<struct<metric_type:string,model_type:string,rmse:double>>"
    return t.spark.read.schema(schema).json(path).select("region", F.inline("models"))


@query(
    "snk_3_export_csv",
    "region resource_type usage_cpu:f usage_storage:f users_active:f",
    """SELECT region, resource_type, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       avg(users_active) AS users_active FROM usage GROUP BY region, resource_type""",
)
def _(t):
    from ..operators import aggregates

    path = scratch_path(t.spark, "matrix-csv")
    out = aggregates.group_means(t.usage, ["region", "resource_type"])
    writers.export_csv(out, path)
    return t.spark.read.schema(out.schema).option("header", True).csv(path)


@query(
    "snk_4_export_insights_json",
    "total_records:i avg_metric_value:f metric_volatility:f",
    """SELECT count(*) AS total_records, avg(usage_cpu) AS avg_metric_value,
       stddev_samp(usage_cpu) AS metric_volatility FROM usage""",
)
def _(t):
    path = scratch_path(t.spark, "insights")
    out = t.usage.agg(
        F.count("*").alias("total_records"),
        F.avg("usage_cpu").alias("avg_metric_value"),
        F.stddev_samp("usage_cpu").alias("metric_volatility"),
    )
    writers.export_insights_json(out, path)
    return t.spark.read.schema(out.schema).json(path)


@query(
    "f_1_filter_usage",
    USAGE,
    """SELECT * FROM usage WHERE region = 'ASIA' AND resource_type = 'VM'
       AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def _(t):
    return filters.filter_usage(t.usage, "ASIA", "VM", date(1996, 1, 1), date(1999, 12, 31))


@query("f_2_filter_in", USAGE, "SELECT * FROM usage WHERE resource_type IN ('VM', 'Storage')")
def _(t):
    return filters.filter_in(t.usage, ["VM", "Storage"])


@query(
    "f_3_explore",
    USAGE,
    """SELECT * FROM usage WHERE resource_type = 'Container'
       AND date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
)
def _(t):
    return filters.explore(t.usage, date(1997, 3, 1), date(1998, 2, 28), resource="Container")


@query(
    "f_4_trailing_days",
    USAGE + " variant",
    """SELECT *, 'inclusive' AS variant FROM usage WHERE date >= (SELECT max(date) FROM usage) - 90
       UNION ALL
       SELECT *, 'exclusive' FROM usage WHERE date > (SELECT max(date) FROM usage) - 90""",
)
def _(t):
    closed = filters.trailing_days(t.usage, 90, inclusive=True).withColumn("variant", F.lit("inclusive"))
    opened = filters.trailing_days(t.usage, 90, inclusive=False).withColumn("variant", F.lit("exclusive"))
    return closed.unionByName(opened)


@query(
    "f_5_last_n_rows",
    "region date usage_cpu:f usage_storage:f users_active:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS rn FROM rd)
       WHERE rn <= 14""",
)
def _(t):
    return windows.last_n_rows(t.region_daily, ["region"], 14)


@query(
    "f_6_exclude_days",
    USAGE,
    "SELECT * FROM behaviour WHERE is_holiday = 0 AND isodow(date) <= 5",
)
def _(t):
    return filters.exclude_days(filters.behaviour_frame(t.usage), holidays=True, weekends=True)


def dirty(df):
    """Usage with values out of bounds and gaps, for the cleaning operators."""
    return df.withColumns(
        {
            "usage_cpu": F.col("usage_cpu") * 1.5 - 20,
            "usage_storage": F.col("usage_storage") - 100,
            "users_active": F.when(F.col("users_active") % 7 != 0, F.col("users_active") - 250),
        }
    )


DIRTY = """dirty AS (SELECT date, region, resource_type, usage_cpu * 1.5 - 20 AS usage_cpu,
       usage_storage - 100 AS usage_storage,
       CASE WHEN users_active % 7 <> 0 THEN users_active - 250 END AS users_active FROM usage)"""


@query(
    "f_7_clean_bounds",
    USAGE,
    f"""WITH {DIRTY}
    RETURN SELECT date, region, resource_type, least(greatest(usage_cpu, 0), 100) AS usage_cpu,
       greatest(usage_storage, 0) AS usage_storage, greatest(users_active, 0) AS users_active
FROM dirty WHERE users_active IS NOT NULL""",
)
def _(t):
    return filters.clean_bounds(dirty(t.usage))


@query(
    "f_8_drop_any_null",
    "region date usage_cpu:f usage_cpu_lag1:f usage_cpu_lag7:f economic_index:f",
    """SELECT * FROM (SELECT region, date, usage_cpu, economic_index,
         lag(usage_cpu, 1) OVER w AS usage_cpu_lag1, lag(usage_cpu, 7) OVER w AS usage_cpu_lag7
       FROM rd WINDOW w AS (PARTITION BY region ORDER BY date))
       WHERE usage_cpu_lag1 IS NOT NULL AND usage_cpu_lag7 IS NOT NULL AND economic_index IS NOT NULL""",
)
def _(t):
    lagged = windows.lag_features(t.region_daily, ["region"], ["usage_cpu"], [1, 7])
    return filters.drop_any_null(lagged)


@query(
    "f_9_present",
    "date region resource_type usage_cpu:f usage_storage:i users_active:i economic_index:f "
    "cloud_market_demand:f holiday",
    """SELECT date, region, resource_type, round(usage_cpu, 1) AS usage_cpu,
       trunc(usage_storage) AS usage_storage, users_active, round(economic_index, 2) AS economic_index,
       round(cloud_market_demand, 3) AS cloud_market_demand,
       CASE holiday WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS holiday
FROM fact ORDER BY date DESC""",
)
def _(t):
    return filters.present(t.fact)


@query(
    "f_10_holiday_partition",
    "day_kind usage_cpu:f usage_storage:f users_active:i",
    """SELECT CASE WHEN holiday = 1 THEN 'holiday' ELSE 'regular' END AS day_kind,
       usage_cpu, usage_storage, users_active FROM fact""",
)
def _(t):
    return filters.holiday_partition(t.fact)


@query(
    "f_11_validate_schema",
    "column expected_type actual_type present type_ok non_null:i rows:i",
    """SELECT v.*, a.rows FROM (
  SELECT 'date' AS "column", 'date' AS expected_type, 'date' AS actual_type, TRUE AS present, TRUE AS type_ok,
         (SELECT count(date) FROM merged) AS non_null
  UNION ALL SELECT 'region', 'string', 'string', TRUE, TRUE, (SELECT count(region) FROM merged)
  UNION ALL SELECT 'resource_type', 'string', 'string', TRUE, TRUE, (SELECT count(resource_type) FROM merged)
  UNION ALL SELECT 'usage_cpu', 'double', 'double', TRUE, TRUE, (SELECT count(usage_cpu) FROM merged)
  UNION ALL SELECT 'usage_storage', 'double', 'double', TRUE, TRUE, (SELECT count(usage_storage) FROM merged)
  UNION ALL SELECT 'users_active', 'int', NULL, FALSE, NULL, 0
  UNION ALL SELECT 'economic_index', 'double', 'double', TRUE, TRUE, (SELECT count(economic_index) FROM merged)
  UNION ALL SELECT 'cloud_market_demand', 'double', 'double', TRUE, TRUE, (SELECT count(cloud_market_demand) FROM merged)
  UNION ALL SELECT 'holiday', 'int', 'int', TRUE, TRUE, (SELECT count(holiday) FROM merged)) v
CROSS JOIN (SELECT count(*) AS rows FROM merged) a""",
)
def _(t):
    checked = filters.validate_schema(t.merged.drop("users_active"))
    return checked.withColumn("type_ok", F.when(F.col("present"), F.col("type_ok")))


@query(
    "f_12_null_profile",
    "column nulls:i",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM merged"
        for c in ("date", "region", *NUMERIC, "holiday")
    ),
)
def _(t):
    return filters.null_profile(t.merged, ["date", "region", *NUMERIC, "holiday"])


@query(
    "f_13_data_quality",
    "rows:i completeness:f cpu_validity:f users_validity:f overall_quality:f",
    f"""WITH {DIRTY}
    RETURN SELECT *, (completeness + cpu_validity + users_validity) / 3 AS overall_quality FROM (
  SELECT count(*) AS rows,
    (1 - (count(*) * 6 - count(date) - count(region) - count(resource_type) - count(usage_cpu)
          - count(usage_storage) - count(users_active)) / (count(*) * 6)) * 100 AS completeness,
    count(*) FILTER (WHERE usage_cpu BETWEEN 0 AND 100) / count(*) * 100 AS cpu_validity,
    count(*) FILTER (WHERE users_active >= 0) / count(*) * 100 AS users_validity
  FROM dirty)""",
)
def _(t):
    return filters.data_quality(dirty(t.usage), USAGE_COLS)


@query(
    "f_14_coerce_numeric",
    "date region users_text:f",
    """SELECT date, region, TRY_CAST(CASE WHEN users_active % 5 = 0 THEN 'n/a'
       ELSE CAST(users_active AS VARCHAR) END AS DOUBLE) AS users_text FROM usage""",
)
def _(t):
    text = F.when(F.col("users_active") % 5 == 0, "n/a").otherwise(F.col("users_active").cast("string"))
    return filters.coerce_numeric(t.usage.withColumn("users_text", text), "users_text")


@query(
    "f_15_median_fill",
    "date region usage_cpu:f economic_index:f",
    """SELECT date, region, usage_cpu, coalesce(economic_index,
       (SELECT quantile_cont(economic_index, 0.5) FROM merged)) AS economic_index FROM merged""",
)
def _(t):
    return filters.median_fill(t.merged, "economic_index")


@query(
    "f_16_one_hot",
    "date usage_cpu:f region_AMERICA:i region_ASIA:i region_EUROPE:i region_MIDDLE_EAST:i "
    "resource_type_Storage:i resource_type_VM:i",
    """SELECT date, usage_cpu, CASE WHEN region = 'AMERICA' THEN 1 ELSE 0 END AS "region_AMERICA",
       CASE WHEN region = 'ASIA' THEN 1 ELSE 0 END AS "region_ASIA",
       CASE WHEN region = 'EUROPE' THEN 1 ELSE 0 END AS "region_EUROPE",
       CASE WHEN region = 'MIDDLE EAST' THEN 1 ELSE 0 END AS "region_MIDDLE_EAST",
       CASE WHEN resource_type = 'Storage' THEN 1 ELSE 0 END AS "resource_type_Storage",
       CASE WHEN resource_type = 'VM' THEN 1 ELSE 0 END AS "resource_type_VM" FROM usage""",
)
def _(t):
    names = filters.category_values(t.table("region"), "r_name")
    encoded = filters.one_hot(t.usage, {"region": names, "resource_type": RESOURCES})
    return encoded.withColumnsRenamed({c: c.replace(" ", "_") for c in encoded.columns})


@query(
    "f_17_simulated_holiday",
    "date is_holiday:i rows:i",
    "SELECT date, is_holiday, count(*) AS rows FROM behaviour GROUP BY date, is_holiday",
)
def _(t):
    flagged = t.usage.withColumn("is_holiday", filters.simulated_holiday())
    return flagged.groupBy("date", "is_holiday").agg(F.count("*").alias("rows"))


@query(
    "f_18_per_user_ratios",
    USAGE + " cpu_per_user:f storage_per_user:f user_efficiency:f",
    "SELECT * FROM behaviour",
)
def _(t):
    return filters.per_user_ratios(t.usage)


@query("j_1_merge_external", FACT, "SELECT * FROM merged")
def _(t):
    return joins.merge_external(t.usage, t.external)


@query(
    "j_2_attach_selected_model",
    "region date usage_cpu:f model_type",
    """SELECT r.region, r.date, r.usage_cpu, b.model_type FROM rd r
       LEFT JOIN (SELECT region, model_type FROM best_model WHERE metric_type = 'cpu') b USING (region)""",
)
def _(t):
    return joins.attach_selected_model(t.region_daily, evaluation.best_models(t.registry), "cpu")


@query(
    "j_3_model_status",
    "region metric_type model_type rmse:f mae:f mape:f last_updated selection_method",
    """SELECT s.region, s.metric_type, 'Naive' AS model_type, b.rmse, b.mae, b.mape,
       coalesce(CAST(b.updated_date AS VARCHAR), 'static') AS last_updated,
       CASE WHEN b.rmse IS NOT NULL THEN 'registry' ELSE 'static_fallback' END AS selection_method
FROM (SELECT DISTINCT region, metric_type FROM registry) s
LEFT JOIN best_model b ON b.region = s.region AND b.metric_type = s.metric_type AND b.model_type = 'Naive'""",
)
def _(t):
    selection = (
        t.registry.select("region", "metric_type").distinct().withColumn("model_type", F.lit("Naive"))
    )
    return joins.model_status(selection, evaluation.best_models(t.registry))


@query(
    "j_4_region_scatter",
    "region economic_index_avg:f usage_cpu_avg:f data_points:i",
    """SELECT region, avg(economic_index) AS economic_index_avg, avg(usage_cpu) AS usage_cpu_avg,
       count(*) AS data_points FROM fact GROUP BY region""",
)
def _(t):
    return joins.region_scatter(t.fact, "economic_index", "usage_cpu")


CALENDAR = """calendar AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
       FROM usage GROUP BY region)"""


@query(
    "j_5_missing_days",
    "region date",
    f"WITH {CALENDAR}\n RETURN SELECT region, date FROM calendar EXCEPT SELECT region, date FROM usage",
)
def _(t):
    return joins.missing_days(t.daily_series, ["region"])


PREDICTIONS = (
    "region model_type metric_type prediction_date predicted_value:f actual_value:f "
    "absolute_error:f percentage_error:f"
)


@query(
    "j_6_forecast_vs_actual",
    PREDICTIONS,
    "SELECT * FROM preds",
)
def _(t):
    forecast = t.predictions.select(
        "region",
        "model_type",
        "metric_type",
        F.col("prediction_date").alias("date"),
        F.col("predicted_value").alias("predicted"),
    )
    return joins.forecast_vs_actual(forecast, evaluation.long_series(t.daily_series))


@query(
    "j_8_pairwise_complete",
    "economic_index:f usage_cpu:f",
    "SELECT economic_index, usage_cpu FROM merged WHERE economic_index IS NOT NULL AND usage_cpu IS NOT NULL",
)
def _(t):
    return joins.pairwise_complete(t.merged, "economic_index", "usage_cpu")


