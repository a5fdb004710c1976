"""Measured accuracy, model health, retraining needs, drift and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ladder
from . import windows


def measured_accuracy(
    predictions: DataFrame, selection: DataFrame, region_daily: DataFrame, days: int = 30
) -> DataFrame:
    """Accuracy per region of its selected cpu and users models over the last ``days`` days.

    Accuracy is 100 minus the mean percentage error; MAE and RMSE are those of the cpu model.
    ``selection`` has (region, metric_type, model_type).
    """
    latest = predictions.agg(F.max("prediction_date")).scalar()
    used = selection.filter(F.col("metric_type").isin("cpu", "users")).select("region", "metric_type", "model_type")
    recent = predictions.filter(F.col("prediction_date") > F.date_sub(latest, days)).join(
        used, ["region", "metric_type", "model_type"]
    )
    cpu = F.when(F.col("metric_type") == "cpu", F.col("absolute_error"))
    errors = recent.groupBy("region").agg(
        F.round(F.avg(100 - F.col("percentage_error")), 1).alias("accuracy"),
        F.round(F.avg(cpu), 2).alias("mae"),
        F.round(F.sqrt(F.avg(cpu * cpu)), 2).alias("rmse"),
    )
    models = used.groupBy("region").agg(
        F.max(F.when(F.col("metric_type") == "cpu", F.col("model_type"))).alias("cpu_model"),
        F.max(F.when(F.col("metric_type") == "users", F.col("model_type"))).alias("users_model"),
    )
    trend = windows.rolling_trend(region_daily, ["region"], days).select("region", "trend")
    return errors.join(trend, "region").join(models, "region")


def health_summary(accuracy: DataFrame) -> DataFrame:
    a = F.col("accuracy")
    out = accuracy.agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.count("*").alias("total_models"),
        F.count_if(a >= 85).alias("healthy_models"),
        F.count_if((a >= 70) & (a < 85)).alias("warning_models"),
        F.count_if(a < 70).alias("critical_models"),
    )
    mean = F.col("mean_accuracy")
    status = ladder(
        [(F.col("total_models") == 0, "UNKNOWN"), (mean >= 85, "HEALTHY"), (mean >= 70, "WARNING")], "CRITICAL"
    )
    return out.withColumn("overall_status", status).withColumn(
        "average_accuracy", F.round("mean_accuracy", 1)
    )


def retrain_list(
    accuracy: DataFrame, high: float = 70.0, declining: float = 80.0
) -> DataFrame:
    """Regions to retrain: too inaccurate, or declining and not accurate enough."""
    a = F.col("accuracy")
    low, falling = a < high, (F.col("trend") == "declining") & (a < declining)
    text = F.format_string("%.1f%%", a)
    return accuracy.filter(low | falling).select(
        "region",
        F.when(low, F.concat(F.lit("Accuracy below threshold: "), text))
        .otherwise(F.concat(F.lit("Declining accuracy trend: "), text))
        .alias("reason"),
        F.when(low, "HIGH").otherwise("MEDIUM").alias("priority"),
    )


def accuracy_last_days(predictions: DataFrame, days: int = 7) -> DataFrame:
    """Accuracy per model from recorded predictions of the last ``days`` days."""
    latest = predictions.agg(F.max("prediction_date")).scalar()
    recent = predictions.filter(F.col("prediction_date") > F.date_sub(latest, days))
    out = recent.groupBy("region", "model_type", "metric_type").agg(
        F.avg(100 - F.col("percentage_error")).alias("accuracy"), F.count("*").alias("predictions_count")
    )
    a = F.col("accuracy")
    return out.withColumn("status", ladder([(a >= 85, "healthy"), (a >= 75, "warning")], "critical"))


def drift_flag(recent: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Which models fell below the accuracy threshold, in percent."""
    return recent.select(
        "region",
        "model_type",
        "metric_type",
        "accuracy",
        F.lit(float(threshold)).alias("threshold"),
        (F.col("accuracy") < threshold).alias("needs_retraining"),
    )


def alerts(accuracy: DataFrame, capacity: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Low-accuracy alerts and high-capacity-risk alerts in one list."""
    low = accuracy.filter(F.col("accuracy") < threshold).select(
        F.lit("accuracy").alias("kind"),
        "region",
        F.format_string("Low accuracy in %s: %.1f%%", "region", "accuracy").alias("message"),
    )
    risk = capacity.filter(F.col("overall_risk") == "HIGH").select(
        F.lit("capacity").alias("kind"),
        "region",
        F.format_string("High capacity risk in %s: %.1f%% utilization", "region", "peak_pct").alias("message"),
    )
    return low.unionByName(risk)
