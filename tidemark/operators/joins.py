"""Joins: external factors, chosen models, calendars, forecasts against actuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def merge_external(usage: DataFrame, external: DataFrame) -> DataFrame:
    """Left join of the daily factors.

    Grouping by date leaves at most one row per calendar day: about 36,500 rows per
    century whatever the data size, and no more than the 3.7 million days of the DATE type.
    """
    per_day = external.groupBy("date").agg(
        F.max("economic_index").alias("economic_index"),
        F.max("cloud_market_demand").alias("cloud_market_demand"),
        F.max("holiday").alias("holiday"),
    )
    return usage.join(F.broadcast(per_day), "date", "left")


def attach_selected_model(series: DataFrame, best_model: DataFrame, metric: str) -> DataFrame:
    """The model type chosen for each region's ``metric``; null where none is chosen."""
    chosen = best_model.filter(F.col("metric_type") == metric).select("region", "model_type")
    return series.join(chosen, "region", "left")


def model_status(selection: DataFrame, registry: DataFrame) -> DataFrame:
    """Selected models with their recorded scores, or ``static`` where nothing is recorded."""
    scores = registry.select(
        "region", "metric_type", "model_type", "rmse", "mae", "mape", "updated_date"
    )
    found = F.col("rmse").isNotNull()
    return selection.join(scores, ["region", "metric_type", "model_type"], "left").select(
        "region",
        "metric_type",
        "model_type",
        "rmse",
        "mae",
        "mape",
        F.coalesce(F.col("updated_date").cast("string"), F.lit("static")).alias("last_updated"),
        F.when(found, "registry").otherwise("static_fallback").alias("selection_method"),
    )


def region_scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of two columns and the row count per region, from one grouping."""
    return df.groupBy("region").agg(
        F.avg(x).alias(f"{x}_avg"), F.avg(y).alias(f"{y}_avg"), F.count("*").alias("data_points")
    )


def calendar(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every day from the first to the last date of the data, per key."""
    span = df.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return span.select(*keys, F.explode(F.sequence("first", "last")).alias("date"))


def missing_days(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Calendar days without any row, per key."""
    keys = keys or []
    observed = df.select(*keys, "date").distinct()
    return calendar(observed, keys).join(observed, [*keys, "date"], "left_anti")


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors of a forecast (region, model_type, metric_type, date, predicted) per day."""
    error = F.abs(F.col("value") - F.col("predicted"))
    return forecast.join(actual, ["region", "metric_type", "date"]).select(
        "region",
        "model_type",
        "metric_type",
        F.col("date").alias("prediction_date"),
        F.col("predicted").alias("predicted_value"),
        F.col("value").alias("actual_value"),
        error.alias("absolute_error"),
        (ratio(error, F.abs(F.col("value"))) * 100).alias("percentage_error"),
    )


def capacity_join(demand: DataFrame, capacity: DataFrame) -> DataFrame:
    """Demand statistics next to the current capacity of the same region and service."""
    joined = demand.join(capacity, ["region", "metric_type"])
    return joined.withColumns(
        {
            "peak_pct": ratio("max_demand", "current_capacity") * 100,
            "avg_pct": ratio("avg_demand", "current_capacity") * 100,
        }
    )


def pairwise_complete(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows in which both columns are known."""
    return df.select(x, y).dropna("any")
