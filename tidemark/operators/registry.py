"""Change detection and the model registry.

The registry is a set of append-only tables. Current state is derived from them by
window or aggregate; nothing is updated in place, so a lost job leaves no half-written
row, and a new version of a table is written beside the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..functions.columns import ratio

MODEL = ["region", "metric_type", "model_type"]
SERIES = ["region", "metric_type"]


def data_fingerprint(df: DataFrame) -> DataFrame:
    """Content hash over all columns, and row count, that do not depend on row order."""
    return fingerprint_of(digest.digest(df))


def fingerprint_of(digests: DataFrame) -> DataFrame:
    """data_hash and data_size of the data whose parts have these digests."""
    whole = digest.merged(digests)
    return whole.select(digest.named(whole).alias("data_hash"), "data_size")


def check_changes(
    fingerprint: DataFrame, log: DataFrame, threshold: float = 5.0, force: bool = False
) -> DataFrame:
    """One new check row: growth since the last logged check and whether to train.

    A first run trains on everything; later runs need new content and enough growth.
    """
    last = log.agg(F.max_by(F.struct("data_hash", "data_size"), "check_date")).scalar()
    current = fingerprint.withColumn("last", last)
    first = F.col("last").isNull()
    base = F.greatest(F.coalesce("last.data_size", F.lit(0)), F.lit(1))
    out = current.select(
        "data_hash",
        "data_size",
        F.when(first, F.col("data_size")).otherwise(F.col("data_size") - base).alias("new_records"),
        F.when(first, 100.0)
        .otherwise(ratio((F.col("data_size") - base) * 100, base))
        .alias("percent_change"),
        first.alias("first_run"),
        F.coalesce(F.col("data_hash") != F.col("last.data_hash"), F.lit(True)).alias("hash_changed"),
    )
    needed = F.col("first_run") | (F.col("hash_changed") & (F.col("percent_change") >= threshold))
    return out.withColumn("training_triggered", F.lit(force) | needed)


def record_performance(log: DataFrame, new_rows: DataFrame | None = None) -> DataFrame:
    """The log with ``new_rows`` appended; only the newest active row of a series stays active."""
    rows = log if new_rows is None else log.unionByName(new_rows)
    newest = Window.partitionBy(*SERIES, "is_active").orderBy(F.desc("training_date"), "model_type")
    current = F.col("is_active") & (F.row_number().over(newest) == 1)
    return rows.withColumn("is_active", current)


def upsert_best_model(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Insert new series; replace a recorded model when the candidate's RMSE is not worse."""
    fields = ["model_type", "rmse", "mae", "mape", "updated_date"]
    a, b = current.alias("a"), candidates.alias("b")
    joined = a.join(b, SERIES, "full_outer")
    take = F.col("a.rmse").isNull() | (F.col("b.rmse") <= F.col("a.rmse"))
    return joined.select(
        *SERIES, *[F.when(take, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}")).alias(f) for f in fields]
    )


def active_models(log: DataFrame) -> DataFrame:
    return log.filter(F.col("is_active")).select(*MODEL, "rmse", "mae", "mape", "training_date")


def current_best_rmse(log: DataFrame) -> DataFrame:
    """RMSE of the latest active model of each series."""
    return (
        log.filter(F.col("is_active"))
        .groupBy(*SERIES)
        .agg(F.max_by("rmse", "training_date").alias("current_rmse"))
    )


def latest_per_model(log: DataFrame) -> DataFrame:
    newest = Window.partitionBy(*MODEL).orderBy(F.desc("training_date"))
    ranked = log.withColumn("rn", F.row_number().over(newest))
    return ranked.filter(F.col("rn") == 1).select(*MODEL, "rmse", "mae", "mape", "training_date")


def training_comparison(log: DataFrame) -> DataFrame:
    return log.groupBy(*MODEL).agg(
        F.min("rmse").alias("best_rmse"), F.avg("rmse").alias("avg_rmse"), F.count("*").alias("training_count")
    )


def best_selection(best: DataFrame, regions: DataFrame, fallback: str, expected: int = 4) -> DataFrame:
    """Model per region and metric; a metric covering too few regions falls back entirely."""
    coverage = best.groupBy("metric_type").agg(F.countDistinct("region").alias("covered"))
    complete = best.join(coverage.filter(F.col("covered") >= expected), "metric_type")
    wanted = regions.select(*SERIES).distinct()
    chosen = wanted.join(complete.select(*SERIES, "model_type"), SERIES, "left")
    return chosen.select(
        *SERIES,
        F.coalesce("model_type", F.lit(fallback)).alias("model_type"),
        F.when(F.col("model_type").isNotNull(), "registry").otherwise("static_fallback").alias("source"),
    )


def model_comparison(best: DataFrame) -> DataFrame:
    """Per metric: mean errors, the region with the lowest RMSE, the model types in use."""
    return best.groupBy("metric_type").agg(
        F.avg("rmse").alias("avg_rmse"),
        F.avg("mae").alias("avg_mae"),
        F.min_by("region", F.struct(F.round("rmse", 6), "region")).alias("best_region"),
        F.array_join(F.array_sort(F.collect_set("model_type")), ",").alias("model_types"),
    )


def rmse_heatmap(log: DataFrame, metrics: list[str], models: list[str]) -> DataFrame:
    """Mean RMSE per region, one column per metric and model type."""
    named = log.withColumn("column", F.concat_ws("_", "metric_type", "model_type"))
    columns = [f"{m}_{k}" for m in metrics for k in models]
    return named.groupBy("region").pivot("column", columns).agg(F.avg("rmse"))


def activity_summary(monitoring: DataFrame) -> DataFrame:
    return monitoring.agg(
        F.count("*").alias("total_checks"),
        F.count_if("training_triggered").alias("training_sessions"),
        F.avg("new_records").alias("avg_new_records"),
    )


def improvement(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """Is the candidate better than the recorded best, or the first of its series?"""
    joined = candidates.join(current.select(*SERIES, "current_rmse"), SERIES, "left")
    better = F.col("current_rmse").isNull() | (F.col("rmse") < F.col("current_rmse"))
    return joined.withColumn("improved", better)


def training_report(results: DataFrame, trained: DataFrame) -> DataFrame:
    """Per metric: models trained, deployed and improved, and the best model per region.

    ``results`` has one row per series with ``improved``; an improved model is deployed.
    """
    counts = trained.groupBy("metric_type").agg(
        F.count("*").alias("models_trained"), F.countDistinct("region").alias("regions")
    )
    best = F.array_join(
        F.array_sort(F.collect_list(F.concat_ws("=", "region", "model_type"))), ";"
    )
    outcome = results.groupBy("metric_type").agg(
        F.count_if("improved").alias("models_improved"),
        F.count_if("improved").alias("models_deployed"),
        best.alias("best_models"),
    )
    return counts.join(outcome, "metric_type")


def debug_summary(region_daily: DataFrame) -> DataFrame:
    return region_daily.groupBy("region").agg(
        F.lit(",".join(region_daily.columns)).alias("columns"),
        F.count("*").alias("rows"),
        F.min("users_active").alias("min_users"),
        F.max("users_active").alias("max_users"),
        F.max("date").alias("last_date"),
    )


def model_distribution(best: DataFrame) -> DataFrame:
    return best.groupBy("metric_type", "model_type").agg(F.count("*").alias("regions"))


def training_status(log: DataFrame, monitoring: DataFrame, checks: int = 10) -> DataFrame:
    """Active models, the latest checks and the time of the last check in one table."""
    models = active_models(log).select(
        F.lit("model").alias("section"),
        F.concat_ws("/", *MODEL).alias("name"),
        F.col("rmse").alias("value"),
        F.col("training_date").alias("event_date"),
    )
    recent = (
        monitoring.orderBy(F.desc("check_date"))
        .limit(checks)
        .select(
            F.lit("check").alias("section"),
            F.concat_ws("/", F.lit("triggered"), F.col("training_triggered").cast("string")).alias("name"),
            F.col("new_records").cast("double").alias("value"),
            F.col("check_date").alias("event_date"),
        )
    )
    last = monitoring.agg(F.max("check_date").alias("event_date")).select(
        F.lit("last_check").alias("section"),
        F.lit("last_check").alias("name"),
        F.lit(None).cast("double").alias("value"),
        "event_date",
    )
    return models.unionByName(recent).unionByName(last)

