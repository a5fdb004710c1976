"""Baseline predictions, error metrics, and the score log derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..functions.columns import ratio
from ..sources.schemas import METRIC_TYPES, MODEL_TYPES


def long_series(region_daily: DataFrame) -> DataFrame:
    """(region, date, metric_type, value): the three metrics as one long series table."""
    wide = region_daily.select(
        "region", "date", *[F.col(c).cast("double").alias(m) for m, c in METRIC_TYPES.items()]
    )
    return wide.unpivot(["region", "date"], list(METRIC_TYPES), "metric_type", "value")


def baseline_predictions(region_daily: DataFrame) -> DataFrame:
    """One-step baselines for every day that has the history they need.

    The value a week before, the value a day before, and the mean of the last week.
    """
    w = Window.partitionBy("region", "metric_type").orderBy("date")
    week = w.rowsBetween(-7, -1)
    weekly = F.when(F.count("value").over(week) == 7, F.avg("value").over(week))
    wide = long_series(region_daily).select(
        "*",
        F.lag("value", 7).over(w).alias(MODEL_TYPES[0]),
        F.lag("value", 1).over(w).alias(MODEL_TYPES[1]),
        weekly.alias(MODEL_TYPES[2]),
    )
    keys = ["region", "metric_type", "date", "value"]
    long = wide.unpivot(keys, MODEL_TYPES, "model_type", "predicted").filter(
        F.col("predicted").isNotNull()
    )
    error = F.abs(F.col("value") - F.col("predicted"))
    return long.select(
        "region",
        "model_type",
        "metric_type",
        F.col("date").alias("prediction_date"),
        F.col("predicted").alias("predicted_value"),
        F.col("value").alias("actual_value"),
        error.alias("absolute_error"),
        (ratio(error, F.abs(F.col("value"))) * 100).alias("percentage_error"),
    )


def error_columns(actual: str = "actual_value", predicted: str = "predicted_value") -> list[Column]:
    """RMSE, MAE, zero-safe MAPE and MSE as aggregate expressions."""
    diff = F.col(actual) - F.col(predicted)
    return [
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mae"),
        (F.avg(ratio(F.abs(diff), F.abs(F.col(actual)))) * 100).alias("mape"),
        F.avg(diff * diff).alias("mse"),
    ]


def error_metrics(
    df: DataFrame,
    keys: list[str],
    actual: str = "actual_value",
    predicted: str = "predicted_value",
) -> DataFrame:
    """Errors per group from one pass; R squared is 0 for a constant actual."""
    out = df.groupBy(*keys).agg(
        *error_columns(actual, predicted),
        F.var_pop(actual).alias("spread"),
        F.count("*").alias("n"),
    )
    r2 = F.coalesce(1 - ratio("mse", "spread"), F.lit(0.0))
    return out.withColumn("r2", r2).drop("spread")


def residuals(df: DataFrame) -> DataFrame:
    """Actual minus predicted, in order of time."""
    return df.withColumn("residual", F.col("actual_value") - F.col("predicted_value")).orderBy(
        "prediction_date", "region"
    )


def quarterly_scores(predictions: DataFrame) -> DataFrame:
    """Model performance log: scores per region, metric, model and calendar quarter.

    The model with the lowest RMSE of its session is the active one; scores equal to
    six digits fall to the first model name.
    """
    session = F.trunc("prediction_date", "quarter")
    scores = predictions.groupBy(
        "region", "metric_type", "model_type", session.alias("training_date")
    ).agg(
        F.sqrt(F.avg(F.col("absolute_error") * F.col("absolute_error"))).alias("rmse"),
        F.avg("absolute_error").alias("mae"),
        F.avg("percentage_error").alias("mape"),
        F.count("*").alias("data_size"),
    )
    best = Window.partitionBy("region", "metric_type", "training_date").orderBy(
        F.round("rmse", 6), "model_type"
    )
    return scores.select(
        "region",
        "metric_type",
        "model_type",
        "rmse",
        "mae",
        "mape",
        "training_date",
        F.concat_ws(":", F.col("data_size").cast("string"), F.col("training_date").cast("string")).alias(
            "data_hash"
        ),
        "data_size",
        (F.row_number().over(best) == 1).alias("is_active"),
    )


def monthly_checks(usage: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Data check log: one check per month over all rows up to its end, with their content hash.

    Each month is hashed once; the hash of all months so far is merged from theirs, and that
    running merge spans one row per calendar month.
    """
    hashed = digest.digest(usage, {"check_date": F.last_day("date")})
    months = hashed.withColumn("new_records", F.col("data_size"))
    w = Window.orderBy("check_date")
    running = months.select("check_date", "new_records", *digest.combined(w))
    growth = ratio(F.col("new_records") * 100, F.col("data_size") - F.col("new_records"))
    return running.select(
        "check_date",
        digest.named(running).alias("data_hash"),
        "data_size",
        "new_records",
        F.coalesce(growth >= threshold, F.lit(True)).alias("training_triggered"),
    )


def best_models(registry: DataFrame) -> DataFrame:
    """Best model per region and metric of the latest training session."""
    last = registry.agg(F.max("training_date")).scalar()
    return select_best(registry.filter(F.col("training_date") == last)).withColumnRenamed(
        "training_date", "updated_date"
    )


def select_best(scores: DataFrame, keys: tuple[str, ...] = ("region", "metric_type")) -> DataFrame:
    """Lowest RMSE per key; failed models (null, NaN or infinite RMSE) never win."""
    valid = F.col("rmse").isNotNull() & ~F.isnan("rmse") & (F.col("rmse") < float("inf"))
    fields = [c for c in ("model_type", "rmse", "mae", "mape", "training_date") if c in scores.columns]
    best = F.min_by(F.struct(*fields), F.struct(F.round("rmse", 6), "model_type"))
    return scores.filter(valid).groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def compare_models(scores: DataFrame) -> DataFrame:
    """One row per region and metric: RMSE per model, the best model, its margin."""
    wide = scores.groupBy("region", "metric_type").agg(
        *[F.max(F.when(F.col("model_type") == m, F.col("rmse"))).alias(f"rmse_{m}") for m in MODEL_TYPES],
        F.min_by("model_type", F.struct(F.round("rmse", 6), "model_type")).alias("best_model"),
        F.min("rmse").alias("best_rmse"),
        F.avg("rmse").alias("mean_rmse"),
    )
    return wide
