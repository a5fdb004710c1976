"""Grouped aggregates: daily series, executive indicators, comparisons, distributions.

Every grouping uses built-in aggregate functions, so each map task sends at most one
row per group; a region or day that holds a third of the rows costs no more to merge.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_name, means, month_name, ratio
from ..functions.order_stats import distribution, value_counts
from ..session import materialize
from ..sources.schemas import FACTORS, METRICS, NUMERIC
from . import filters


def _external(col: Column | str | None = None) -> list[Column]:
    return [F.max(c).alias(c) for c in (*FACTORS, "holiday")]


def region_daily(df: DataFrame, users_agg: str = "sum") -> DataFrame:
    """Daily series per region; users summed for serving, averaged for training."""
    users = F.sum("users_active") if users_agg == "sum" else F.avg("users_active")
    return df.groupBy("region", "date").agg(
        *means(["usage_cpu", "usage_storage"]), users.alias("users_active"), *_external()
    )


def resource_region_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("region", "resource_type", "date").agg(
        *means(["usage_cpu", "usage_storage"]),
        F.sum("users_active").alias("users_active"),
        *_external(),
    )


def global_daily(df: DataFrame) -> DataFrame:
    """Daily means; the holiday flag is the majority flag, 0 on a tie."""
    on = F.count_if(F.col("holiday") == 1)
    off = F.count_if(F.col("holiday") == 0)
    return df.groupBy("date").agg(*means(NUMERIC), F.when(on > off, 1).otherwise(0).alias("holiday"))


def daily_means(df: DataFrame, cols: list[str] = NUMERIC) -> DataFrame:
    return df.groupBy("date").agg(*means(cols))


def group_means(df: DataFrame, keys: list[str], cols: list[str] = METRICS) -> DataFrame:
    """Means per key: regional and resource trends, heat maps, bubbles."""
    return df.groupBy(*keys).agg(*means(cols))


def holiday_impact(df: DataFrame, flag: str = "holiday", metric: str = "usage_cpu") -> DataFrame:
    """Mean on holidays against the mean on other days, in percent of the latter."""
    on = F.avg(F.when(F.col(flag) == 1, F.col(metric)))
    off = F.avg(F.when(F.col(flag) == 0, F.col(metric)))
    pair = df.agg(on.alias("holiday_avg"), off.alias("regular_avg"))
    change = ratio(F.col("holiday_avg") - F.col("regular_avg"), "regular_avg") * 100
    return pair.withColumn(
        "percentage", F.when(F.col("regular_avg") > 0, change).otherwise(F.lit(0.0))
    )


def _peak(metric: str) -> Column:
    """Earliest row of the maximum: later tie-breaks by region and resource type."""
    key = F.struct(
        -F.col(metric).cast("double"), F.col("date"), F.col("region"), F.col("resource_type")
    )
    return F.min(key)


def peak_rows(df: DataFrame) -> DataFrame:
    """Where each metric peaks; ties go to the first (date, region, resource type)."""
    peaks = df.agg(*[_peak(m).alias(m) for m in METRICS])
    entry = lambda m: F.struct(
        F.lit(m).alias("metric"),
        (-F.col(m)["col1"]).alias("value"),
        F.col(m)["date"].alias("date"),
        F.col(m)["region"].alias("region"),
        F.col(m)["resource_type"].alias("resource_type"),
    )
    return peaks.select(F.inline(F.array(*[entry(m) for m in METRICS])))


def kpis(df: DataFrame) -> DataFrame:
    """Executive indicators in one row from one pass."""
    on = F.avg(F.when(F.col("holiday") == 1, F.col("usage_cpu")))
    off = F.avg(F.when(F.col("holiday") == 0, F.col("usage_cpu")))
    out = df.agg(
        F.max("usage_cpu").alias("peak_cpu"),
        F.max("usage_storage").alias("max_storage"),
        F.max("users_active").alias("peak_users"),
        F.avg("usage_cpu").alias("avg_cpu"),
        F.avg("usage_storage").alias("avg_storage"),
        F.avg("users_active").alias("avg_users"),
        F.size(F.collect_set("region")).alias("total_regions"),
        F.size(F.collect_set("resource_type")).alias("total_resource_types"),
        F.count("*").alias("data_points"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        on.alias("holiday_avg_cpu"),
        off.alias("regular_avg_cpu"),
    )
    change = ratio(F.col("holiday_avg_cpu") - F.col("regular_avg_cpu"), "regular_avg_cpu") * 100
    return out.withColumns(
        {
            "days": F.datediff("end_date", "start_date"),
            "holiday_impact_pct": F.when(F.col("regular_avg_cpu") > 0, change).otherwise(0.0),
            "peak_cpu_above_avg": F.col("peak_cpu") - F.col("avg_cpu"),
            "max_storage_above_avg": F.col("max_storage") - F.col("avg_storage"),
            "peak_users_above_avg": F.col("peak_users") - F.col("avg_users"),
        }
    )


def sparklines(df: DataFrame, days: int = 30) -> DataFrame:
    """Daily means of the last ``days`` dates; the latest date comes from the same daily table."""
    return filters.trailing_days(daily_means(df, METRICS), days, inclusive=False)


def time_series(
    df: DataFrame,
    region: str | None = None,
    resource: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Daily means under optional filters, which reach the scan."""
    return daily_means(filters.filter_usage(df, region, resource, start, end))


def regional_comparison(df: DataFrame) -> DataFrame:
    """Mean, max, min and deviation of the metrics per region, two digits."""
    fns = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    return df.groupBy("region").agg(
        *[F.round(fn(m), 2).alias(f"{m}_{name}") for m in METRICS for name, fn in fns.items()]
    )


def regional_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("region").agg(*[F.sum(m).alias(m) for m in METRICS])


def regional_share(df: DataFrame, metric: str = "usage_cpu") -> DataFrame:
    """Each region's total and its percentage of the grand total.

    The regional totals are written once and add up to the grand total: one pass.
    """
    totals = materialize(df.groupBy("region").agg(F.sum(metric).alias("total")), "region-totals")
    grand = totals.agg(F.sum("total")).scalar()
    return totals.withColumn("share_pct", ratio(F.col("total"), grand) * 100)


def resource_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("resource_type").agg(
        *[fn(m).alias(f"{m}_{n}") for m in METRICS for n, fn in (("mean", F.avg), ("sum", F.sum))]
    )


def _per_user(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "cpu_per_user": ratio("usage_cpu", "users_active"),
            "storage_per_user": ratio("usage_storage", "users_active"),
        }
    )


def resource_efficiency(df: DataFrame) -> DataFrame:
    return _per_user(group_means(df, ["resource_type"]))


def correlation_bubble(df: DataFrame) -> DataFrame:
    """Means by region and resource with per-user efficiency and a combined utilisation."""
    base = group_means(df, ["region", "resource_type"])
    return base.withColumns(
        {
            "cpu_efficiency": ratio("usage_cpu", "users_active"),
            "storage_efficiency": ratio("usage_storage", "users_active"),
            "total_utilization": F.col("usage_cpu") + F.col("usage_storage") / 20,
        }
    )


def holiday_analysis(df: DataFrame) -> DataFrame:
    fns = {"mean": F.avg, "std": F.stddev_samp, "count": F.count}
    return df.groupBy("holiday").agg(
        *[fn(m).alias(f"{m}_{name}") for m in METRICS for name, fn in fns.items()]
    )


def holiday_calendar(df: DataFrame) -> DataFrame:
    return df.groupBy(
        F.month("date").alias("month"),
        month_name().alias("month_name"),
        F.dayofmonth("date").alias("day"),
    ).agg(F.avg("usage_cpu").alias("usage_cpu"), F.max("holiday").alias("holiday"))


def engagement_efficiency(df: DataFrame) -> DataFrame:
    base = group_means(df, ["region", "resource_type"])
    cpu = ratio("users_active", "usage_cpu")
    storage = ratio(F.col("users_active"), F.col("usage_storage") / 100)
    return base.withColumns(
        {
            "cpu_efficiency": cpu,
            "storage_efficiency": storage,
            "overall_efficiency": (cpu + storage) / 2,
        }
    )


def engagement_trends(df: DataFrame) -> DataFrame:
    return _per_user(daily_means(df, METRICS))


def filter_options(df: DataFrame) -> DataFrame:
    """Values a user may filter by: key lists and the date span."""
    return df.agg(
        F.array_join(F.array_sort(F.collect_set("region")), "|").alias("regions"),
        F.array_join(F.array_sort(F.collect_set("resource_type")), "|").alias("resource_types"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
    )


def data_summary(df: DataFrame, cols: list[str] = NUMERIC, **sizes: int) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, one row per column."""
    return distribution(df, [], cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, **sizes)


def dataset_info(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.datediff(F.max("date"), F.min("date")).alias("date_range_days"),
        F.size(F.collect_set("region")).alias("regions_count"),
        F.size(F.collect_set("resource_type")).alias("resource_types_count"),
        F.sum("holiday").alias("holiday_records"),
        (F.count("*") - F.sum("holiday")).alias("regular_records"),
    )


def eda_summary(usage: DataFrame, external: DataFrame) -> DataFrame:
    """Range, mean and distinct count of every numeric column of both sources."""

    def profile(df: DataFrame, source: str, cols: list[str]) -> DataFrame:
        # One count per value serves all columns; several distinct counts would expand every row.
        found = value_counts(df, [], cols).groupBy("column").agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"),
            F.count("*").alias("distinct_values"),
        )
        names = df.sparkSession.createDataFrame([(source, c) for c in cols], "source string, column string")
        return names.join(found, "column", "left").select(
            "source", "column", "min", "max", "mean", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values")
        )

    return profile(usage, "usage", METRICS).unionByName(
        profile(external, "external", [*FACTORS, "holiday"])
    )


def daily_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(*[F.sum(m).alias(m) for m in METRICS])


def region_mean_cpu(df: DataFrame) -> DataFrame:
    return df.groupBy("region").agg(F.avg("usage_cpu").alias("avg_cpu"))


def monthly_peak(df: DataFrame) -> DataFrame:
    month = F.trunc("date", "month").alias("month")
    return df.groupBy(month, "region").agg(F.max("usage_cpu").alias("peak_cpu"))


def external_daily(external: DataFrame) -> DataFrame:
    return external.groupBy("date").agg(*means(FACTORS))


def daily_summary(df: DataFrame) -> DataFrame:
    """Daily mean, max, min and deviation of the metrics with the day's factors."""
    fns = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}
    return df.groupBy("date").agg(
        *[fn(m).alias(f"{m}_{name}") for m in METRICS for name, fn in fns.items()],
        *[F.max(c).alias(f"{c}_first") for c in (*FACTORS, "holiday")],
    )


def regional_performance(df: DataFrame) -> DataFrame:
    fns = {"mean": F.avg, "std": F.stddev_samp}
    return df.groupBy("region", "resource_type").agg(
        *[fn(m).alias(f"{m}_{name}") for m in METRICS for name, fn in fns.items()]
    )


def weekly_pattern(df: DataFrame, metric: str) -> DataFrame:
    """Mean of the daily means per weekday, Monday first."""
    daily = df.groupBy("date").agg(F.avg(metric).alias("value"))
    return (
        daily.groupBy(F.weekday("date").alias("weekday"), day_name().alias("day_of_week"))
        .agg(F.avg("value").alias("value"))
        .orderBy("weekday")
    )


def monthly_pattern(df: DataFrame, metric: str, min_days: int = 30) -> DataFrame:
    """Mean of the daily means per month name; empty unless there are more than 30 days."""
    daily = materialize(df.groupBy("date").agg(F.avg(metric).alias("value")), "daily")
    enough = daily.agg(F.count("*")).scalar() > min_days
    return (
        daily.filter(enough)
        .groupBy(F.month("date").alias("month"), month_name().alias("month_name"))
        .agg(F.avg("value").alias("value"))
        .orderBy("month")
    )


def heatmap_pivot(df: DataFrame, metric: str, resources: list[str]) -> DataFrame:
    """Region by resource type matrix of means."""
    return df.groupBy("region").pivot("resource_type", resources).agg(F.avg(metric))


def calendar_pivot(df: DataFrame, metric: str) -> DataFrame:
    """Day of month by month matrix of means, columns m1 to m12."""
    named = df.withColumn("month_column", F.concat(F.lit("m"), F.month("date")))
    return (
        named.groupBy(F.dayofmonth("date").alias("day_of_month"))
        .pivot("month_column", [f"m{i}" for i in range(1, 13)])
        .agg(F.avg(metric))
    )


def multi_level_summary(df: DataFrame) -> DataFrame:
    """Totals per region and resource, per region, and overall, in one pass."""
    return df.rollup("region", "resource_type").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("rows"),
        *[F.sum(m).alias(m) for m in METRICS],
        F.avg("usage_cpu").alias("avg_cpu"),
    )
