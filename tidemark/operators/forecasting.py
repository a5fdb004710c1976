"""Forecast features, baseline forecasts and forecast tables for all series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.schemas import METRIC_TYPES
from .filters import drop_any_null
from .windows import by_date, rolling

KEYS = ["region"]
SERIES = ["region", "metric_type"]
# Allowed forecast horizon in days per metric.
HORIZON = {"cpu": (1, 90), "users": (7, 90), "storage": (7, 90)}
# Model features per metric beside the three target lags.
FEATURES = {
    "cpu": ["usage_storage", "users_active", "economic_index", "cloud_market_demand", "dow", "holiday"],
    "users": ["lag1_cpu", "lag1_storage", "usage_cpu", "usage_storage", "economic_index", "dow", "holiday"],
    "storage": ["lag1_cpu", "lag1_users", "usage_cpu", "users_active", "economic_index", "dow", "holiday"],
}


def feature_names(metric: str) -> list[str]:
    target = METRIC_TYPES[metric]
    return [f"lag1_{target}", f"lag7_{target}", f"roll7_mean_{target}", *FEATURES[metric]]


def feature_frame(region_daily: DataFrame, metric: str) -> DataFrame:
    """Training rows of one metric: lags, weekly mean, weekday and the other columns."""
    target = METRIC_TYPES[metric]
    w = by_date(KEYS)
    names = feature_names(metric)
    every = {
        f"lag1_{target}": F.lag(target, 1).over(w),
        f"lag7_{target}": F.lag(target, 7).over(w),
        f"roll7_mean_{target}": rolling(target, KEYS, 7),
        "lag1_cpu": F.lag("usage_cpu", 1).over(w),
        "lag1_storage": F.lag("usage_storage", 1).over(w),
        "lag1_users": F.lag("users_active", 1).over(w),
        "dow": F.weekday("date"),
    }
    frame = region_daily.withColumns({k: v for k, v in every.items() if k in names})
    return drop_any_null(frame.select("region", "date", F.col(target).alias("target"), *names))


def feature_frame_wide(region_daily: DataFrame, target: str = "usage_cpu") -> DataFrame:
    """Extended feature set: monthly lag, longer means, cross-metric and holiday features."""
    w = by_date(KEYS)
    frame = region_daily.withColumns(
        {
            "lag_1": F.lag(target, 1).over(w),
            "lag_7": F.lag(target, 7).over(w),
            "lag_30": F.lag(target, 30).over(w),
            "rolling_7_mean": rolling(target, KEYS, 7),
            "rolling_7_std": rolling(target, KEYS, 7, F.stddev_samp),
            "rolling_14_mean": rolling(target, KEYS, 14),
            "rolling_30_mean": rolling(target, KEYS, 30),
            "storage_lag_1": F.lag("usage_storage", 1).over(w),
            "storage_rolling_7": rolling("usage_storage", KEYS, 7),
            "users_lag_1": F.lag("users_active", 1).over(w),
            "users_rolling_7": rolling("users_active", KEYS, 7),
            "day_of_week": F.weekday("date"),
            "day_of_month": F.dayofmonth("date"),
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "economic_lag_1": F.lag("economic_index", 1).over(w),
            "holiday_lag_1": F.lag("holiday", 1).over(w),
            "holiday_rolling_7": rolling("holiday", KEYS, 7, F.sum),
        }
    )
    return drop_any_null(frame)


def future_steps(last: DataFrame, horizon: int) -> DataFrame:
    """(..., step, date): the days after each row's ``last_date``."""
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("date", F.date_add("last_date", F.col("step")))


def seasonal_naive(series: DataFrame, horizon: int = 30, period: int = 7) -> DataFrame:
    """Repeat the last ``period`` values of each series; never below zero."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    tail = series.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= period)
    history = tail.groupBy(*SERIES).agg(
        F.max("date").alias("last_date"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "value"))), lambda p: p["value"]).alias("tail"),
    )
    value = F.element_at("tail", F.pmod(F.col("step") - 1, F.size("tail")) + 1)
    return future_steps(history, horizon).select(
        *SERIES, "step", "date", F.greatest(value, F.lit(0.0)).alias("predicted")
    )


def mean_forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """The series mean for every step: the fallback when a model fails."""
    stats = series.groupBy(*SERIES).agg(
        F.max("date").alias("last_date"), F.greatest(F.avg("value"), F.lit(0.0)).alias("predicted")
    )
    return future_steps(stats, horizon).select(*SERIES, "step", "date", "predicted")


def drift_forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Straight line through the first and last value of each series."""
    ends = series.groupBy(*SERIES).agg(
        F.max("date").alias("last_date"),
        F.min_by("value", "date").alias("first_value"),
        F.max_by("value", "date").alias("last_value"),
        F.count("*").alias("n"),
    )
    slope = F.coalesce(ratio(F.col("last_value") - F.col("first_value"), F.col("n") - 1), F.lit(0.0))
    value = F.col("last_value") + slope * F.col("step")
    return future_steps(ends, horizon).select(
        *SERIES, "step", "date", F.greatest(value, F.lit(0.0)).alias("predicted")
    )


BASELINES = {"SeasonalNaive": seasonal_naive, "Mean": mean_forecast, "Drift": drift_forecast}


def baseline_forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    out = None
    for name, fn in BASELINES.items():
        part = fn(series, horizon).withColumn("model_type", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def clamp_horizon(metric: str, horizon: int) -> int:
    low, high = HORIZON[metric]
    return max(low, min(high, horizon))


def forecast_frame(series: DataFrame, forecasts: DataFrame, horizon: int, history: int = 14) -> DataFrame:
    """Last actual values and future predictions of every series in one long table.

    The horizon is clamped per metric and predictions are never negative.
    """
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("date"))
    past = (
        series.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= history)
        .select(*SERIES, F.lit("actual").alias("kind"), (1 - F.col("rn")).alias("step"), "date", "value")
    )
    allowed = F.create_map(*[F.lit(x) for m in HORIZON for x in (m, clamp_horizon(m, horizon))])
    future = forecasts.filter(F.col("step") <= allowed[F.col("metric_type")]).select(
        *SERIES,
        F.lit("forecast").alias("kind"),
        "step",
        "date",
        F.greatest("predicted", F.lit(0.0)).alias("value"),
    )
    return past.unionByName(future)


def forecast_band(forecasts: DataFrame, share: float = 0.1) -> DataFrame:
    return forecasts.withColumns(
        {"upper": F.col("predicted") * (1 + share), "lower": F.col("predicted") * (1 - share)}
    )


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy(*SERIES).agg(
        F.avg("predicted").alias("avg_predicted"),
        F.max("predicted").alias("max_predicted"),
        F.min("predicted").alias("min_predicted"),
        F.count("*").alias("forecast_days"),
        (F.max("predicted") - F.min("predicted")).alias("range"),
    )


def forecast_insights(summary: DataFrame) -> DataFrame:
    """Per metric: the region of lowest and highest load and the total of the averages."""
    rounded = F.round("avg_predicted", 1)
    return summary.groupBy("metric_type").agg(
        F.min_by("region", F.struct(rounded, "region")).alias("lowest_region"),
        F.max_by("region", F.struct(rounded, "region")).alias("highest_region"),
        F.sum(rounded).alias("total_average"),
    )
