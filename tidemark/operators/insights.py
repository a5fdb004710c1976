"""Scores, grades, statuses and pattern statistics shown to planners.

All of them start from one grouped aggregate; comparisons between groups use scalar
subqueries or tables of one row per region or resource type, never row-level windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, col, day_name, ladder, ratio
from ..functions.moments import correlation
from ..functions.order_stats import distribution
from ..session import materialize
from ..sources.schemas import METRICS
from . import filters, windows
from .aggregates import daily_means, group_means

# Relative cost per unit of each resource type.
BASE_COSTS = {"VM": 1.0, "Storage": 0.3, "Container": 0.8}
# Fixed values: (type, message after the resource name, action, priority) of each flag.
OPTIMIZATION_FLAGS = {
    "peak": ("Critical", " approaching capacity limits", "Consider scaling up or load balancing", "high"),
    "idle": ("Efficiency", " is underutilized", "Consider consolidation or downsizing", "medium"),
    "swings": (
        "Stability",
        " shows high variability",
        "Implement auto-scaling or load smoothing",
        "medium",
    ),
}
# Fixed values: (type, resource, message, action, priority) when nothing is flagged.
ALL_CLEAR = (
    "Optimal",
    "All Resources",
    "Resources are operating within optimal ranges",
    "Continue monitoring for trends",
    "low",
)
# Pattern texts and action items of the behaviour summary.
PATTERNS = [
    "Strong seasonal patterns detected",
    "Significant holiday effects observed",
    "Strong user-resource correlation",
]
ACTIONS = [
    "Implement behavioral monitoring",
    "Analyze user engagement patterns",
    "Consider load balancing strategies",
    "Continue monitoring seasonal trends",
    "Plan for holiday capacity changes",
]


def trend_stats(df: DataFrame, metric: str) -> DataFrame:
    """Volatility, mean, range, median and latest value of the daily means.

    The median is taken over one value per day, a group bounded by the calendar.
    """
    daily = daily_means(df, [metric]).withColumnRenamed(metric, "value")
    return daily.agg(
        F.stddev_samp("value").alias("volatility"),
        F.avg("value").alias("average"),
        (F.max("value") - F.min("value")).alias("range"),
        F.median("value").alias("median"),
        F.max_by("value", "date").alias("current"),
        F.count("*").alias("days"),
    )


def regional_stats(df: DataFrame, metric: str) -> DataFrame:
    """Average, peak, minimum, volatility (two digits) and row count per region."""
    return df.groupBy("region").agg(
        F.round(F.avg(metric), 2).alias("avg"),
        F.round(F.max(metric), 2).alias("peak"),
        F.round(F.min(metric), 2).alias("min"),
        F.round(F.stddev_samp(metric), 2).alias("volatility"),
        F.count("date").alias("data_points"),
    )


def region_efficiency_score(stats: DataFrame) -> DataFrame:
    """High average and low volatility relative to the other regions, 0 to 100.

    The statistics are written once, so comparing regions takes no further pass.
    """
    stats = materialize(stats, "region-stats")
    best_avg = stats.agg(F.max("avg")).scalar()
    worst_volatility = stats.agg(F.max("volatility")).scalar()
    score = ratio(F.col("avg"), best_avg) * 0.7 + (1 - ratio(F.col("volatility"), worst_volatility)) * 0.3
    return stats.withColumn("efficiency_score", score * 100)


def radar_normalised(df: DataFrame) -> DataFrame:
    """Regional means (one digit) scaled to 0..100 between regions; 50 where all agree."""
    base = df.groupBy("region").agg(*[F.round(F.avg(m), 1).alias(m) for m in METRICS])
    base = materialize(base, "region-means")
    scaled = {}
    for m in METRICS:
        low, high = base.agg(F.min(m)).scalar(), base.agg(F.max(m)).scalar()
        inside = ratio(F.col(m) - low, high - low) * 100
        scaled[m] = F.when(high > low, inside).otherwise(50.0)
    return base.withColumns(scaled)


def regional_insights(stats: DataFrame) -> DataFrame:
    """Best and steadiest region, gap between regions, regions of high volatility."""
    stats = materialize(stats, "region-stats")
    mean_volatility = stats.agg(F.avg("volatility")).scalar()
    volatile = F.when(F.col("volatility") > mean_volatility, F.col("region"))
    out = stats.withColumn("volatile", volatile).agg(
        F.max_by("region", F.struct("avg", "region")).alias("best_region"),
        F.min_by("region", F.struct("volatility", "region")).alias("most_stable"),
        F.avg("avg").alias("global_average"),
        (F.max("avg") - F.min("avg")).alias("performance_gap"),
        F.array_join(
            F.array_sort(F.collect_list("volatile")),
            ", ",
        ).alias("volatile_regions"),
    )
    return out.withColumn("high_disparity", F.col("performance_gap") > F.col("global_average") * 0.2)


def utilization_status(df: DataFrame) -> DataFrame:
    out = df.groupBy("resource_type").agg(
        F.avg("usage_cpu").alias("cpu_avg"), F.max("usage_cpu").alias("cpu_peak")
    )
    rate = F.col("utilization_rate")
    return out.withColumn("utilization_rate", clamp("cpu_avg", 0, 100)).withColumn(
        "status", ladder([(rate > 80, "High Load"), (rate > 60, "Moderate Load")], "Optimal")
    )


def daily_efficiency(df: DataFrame) -> DataFrame:
    """Daily CPU per user times ten per resource type; plain CPU on days without users."""
    base = group_means(df, ["resource_type", "date"])
    value = F.when(F.col("users_active") > 0, ratio("usage_cpu", "users_active") * 10).otherwise(
        F.col("usage_cpu")
    )
    return base.withColumn("efficiency", value)


def efficiency_per_user(df: DataFrame) -> DataFrame:
    out = df.groupBy("resource_type").agg(
        F.sum("users_active").alias("total_users"),
        *[F.avg(m).alias(m) for m in METRICS],
    )
    per_user = lambda m: F.when(
        F.col("users_active") > 0, ratio(m, "users_active")
    ).otherwise(F.col(m))
    size = F.when(F.col("total_users") > 0, F.col("total_users") / 10).otherwise(F.lit(20.0))
    return out.withColumns(
        {
            "cpu_efficiency": per_user("usage_cpu"),
            "storage_efficiency": per_user("usage_storage"),
            "bubble_size": clamp(size, 20, 80),
        }
    )


def efficiency_grade(df: DataFrame) -> DataFrame:
    """Weighted score of low CPU, many users per CPU and low storage, graded A+ to C."""
    out = group_means(df, ["resource_type"])
    cpu = clamp(100 - F.col("usage_cpu"), 0, 100)
    users = F.when(
        F.col("usage_cpu") > 0, F.least(F.lit(100.0), ratio("users_active", "usage_cpu") * 50)
    ).otherwise(50.0)
    storage = clamp(100 - F.least(F.lit(100.0), F.col("usage_storage") / 20), 0, 100)
    scored = out.withColumns({"cpu_eff": cpu, "user_eff": users, "storage_eff": storage}).withColumn(
        "score",
        clamp(F.col("cpu_eff") * 0.4 + F.col("user_eff") * 0.4 + F.col("storage_eff") * 0.2, 0, 100),
    )
    s = F.col("score")
    grade = ladder([(s >= 80, "A+"), (s >= 70, "A"), (s >= 60, "B+"), (s >= 50, "B")], "C")
    return scored.withColumn("grade", grade).orderBy(F.desc("score"))


def daily_peak_utilization(df: DataFrame) -> DataFrame:
    out = df.groupBy("resource_type", "date").agg(*[F.max(m).alias(m) for m in METRICS])
    peak = F.col("cpu_utilization")
    return out.withColumn("cpu_utilization", clamp("usage_cpu", 0, 100)).withColumn(
        "threshold", ladder([(peak >= 95, "critical"), (peak >= 80, "warning")], "normal")
    )


def capacity_status(df: DataFrame) -> DataFrame:
    """Peak status per resource type and days until CPU reaches 100 at the present slope.

    The slope compares the means of the last and first seven days of the daily means.
    """
    daily = df.groupBy("resource_type", "date").agg(F.avg("usage_cpu").alias("usage_cpu"), F.max("usage_cpu").alias("max_cpu"))
    trend = windows.recent_vs_first(daily.drop("max_cpu"), ["resource_type"], "usage_cpu")
    peak = daily.groupBy("resource_type").agg(F.max("max_cpu").alias("max_cpu"))
    rising = (F.col("recent_avg") > F.col("first_avg")) & (F.col("first_avg") > 0)
    steep = (F.col("trend_rate") > 0.1) & (F.col("current") < 100)
    days_left = ratio(100 - F.col("current"), "trend_rate")
    projection = (
        F.when(F.col("days") <= 14, "Insufficient data")
        .when(~rising, "Stable/Decreasing")
        .when(~steep, "Stable")
        .when(days_left < 365, F.concat(F.round(days_left).cast("bigint").cast("string"), F.lit(" days")))
        .otherwise("1+ year")
    )
    status = ladder([(F.col("max_cpu") >= 95, "Critical"), (F.col("max_cpu") >= 80, "Warning")], "Normal")
    return trend.join(peak, "resource_type").withColumns({"status": status, "projection": projection})


def cost_benefit(df: DataFrame) -> DataFrame:
    """Relative cost, efficiency, cost per user and return per resource type."""
    out = df.groupBy("resource_type").agg(
        F.avg("users_active").alias("users_served"), F.avg("usage_cpu").alias("avg_cpu")
    )
    costs = F.create_map(*[F.lit(x) for pair in BASE_COSTS.items() for x in pair])
    guarded = lambda num, den: F.when(den > 0, ratio(num, den)).otherwise(num)
    out = out.withColumns(
        {
            "estimated_cost": F.col("avg_cpu") * F.coalesce(costs[F.col("resource_type")], F.lit(1.0)),
            "efficiency": guarded(F.col("users_served"), F.col("avg_cpu")),
        }
    )
    roi = guarded(F.col("efficiency") * 100, F.col("estimated_cost"))
    out = out.withColumns(
        {
            "cost": F.greatest(F.lit(0.1), F.col("estimated_cost")),
            "benefit": F.greatest(F.lit(0.1), F.col("efficiency") * 10),
            "roi": F.greatest(F.lit(0.0), roi),
            "cost_per_user": guarded(F.col("estimated_cost"), F.col("users_served")),
        }
    )
    r = F.col("roi")
    status = ladder([(r >= 20, "Excellent"), (r >= 15, "Good"), (r >= 10, "Average")], "Poor")
    return out.withColumn("roi_status", status)


def optimization_flags(df: DataFrame) -> DataFrame:
    """One recommendation per resource type that needs one, or a single all-clear row."""
    out = df.groupBy("resource_type").agg(
        F.avg("usage_cpu").alias("avg_cpu"),
        F.max("usage_cpu").alias("max_cpu"),
        F.coalesce(F.stddev_samp("usage_cpu"), F.lit(0.0)).alias("volatility"),
    )
    name = F.col("resource_type")
    fields = ["type", "resource", "message", "action", "priority"]

    def entry(key: str) -> Column:
        kind, text, action, priority = OPTIMIZATION_FLAGS[key]
        parts = [F.lit(kind), name, F.concat(name, F.lit(text)), F.lit(action), F.lit(priority)]
        return F.struct(*[c.alias(f) for c, f in zip(parts, fields)])

    flag = (
        F.when(F.col("max_cpu") > 90, entry("peak"))
        .when((F.col("avg_cpu") < 30) & (F.col("volatility") < 10), entry("idle"))
        .when(F.col("volatility") > 25, entry("swings"))
    )
    flags = out.select(flag.alias("f")).agg(F.array_compact(F.collect_list("f")).alias("found"))
    clear = F.array(F.struct(*[F.lit(v).alias(f) for v, f in zip(ALL_CLEAR, fields)]))
    return flags.select(F.inline(F.when(F.size("found") > 0, F.col("found")).otherwise(clear)))


# Period of a date at each granularity of the seasonal analysis.
GRANULARITY = {
    "daily": lambda c: F.date_format(c, "yyyy-MM-dd"),
    "weekly": lambda c: F.weekofyear(c).cast("string"),
    "monthly": lambda c: F.month(c).cast("string"),
    "quarterly": lambda c: F.quarter(c).cast("string"),
}


def seasonal_pattern(df: DataFrame, granularity: str, metric: str) -> DataFrame:
    period = GRANULARITY[granularity](F.col("date")).alias("period")
    return df.groupBy(period).agg(F.avg(metric).alias("value"))


def seasonal_stats(pattern: DataFrame) -> DataFrame:
    """Spread of a seasonal pattern, its class, and its peak and trough periods."""
    out = pattern.agg(
        F.var_samp("value").alias("variance"),
        (F.max("value") - F.min("value")).alias("range"),
        F.stddev_samp("value").alias("std"),
        F.avg("value").alias("mean"),
        F.max("value").alias("peak_value"),
        F.min("value").alias("trough_value"),
        F.max_by("period", F.struct("value", "period")).alias("peak_period"),
        F.min_by("period", F.struct("value", "period")).alias("trough_period"),
    )
    cv = F.when(F.col("mean") > 0, ratio("std", "mean") * 100).otherwise(0.0)
    kind = ladder([(F.col("cv") < 10, "Stable"), (F.col("cv") < 25, "Moderate Variation")], "High Volatility")
    return (
        out.withColumn("cv", cv)
        .withColumn("pattern_type", kind)
        .withColumn("wide_range", F.col("range") > F.col("mean") * 0.5)
        .drop("std")
    )


def holiday_effect(df: DataFrame, metric: str, flag: str = "is_holiday", **sizes: int) -> DataFrame:
    """Quartiles, mean and row count per holiday flag, with the change against regular days."""
    named = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    out = materialize(distribution(df, [flag], [metric], named, **sizes), "holiday-effect").withColumnRenamed("count", "rows")
    regular = out.agg(F.max(F.when(F.col(flag) == 0, F.col("mean")))).scalar()
    return out.withColumn("change_pct", ratio(F.col("mean") - regular, regular) * 100)


def dow_profile(df: DataFrame, metric: str) -> DataFrame:
    return (
        df.groupBy(F.weekday("date").alias("weekday"), day_name().alias("day_of_week"))
        .agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
        .orderBy("weekday")
    )


def user_behaviour(df: DataFrame) -> DataFrame:
    """Mean per-user ratios, usage class, peak day and the sign of users against CPU."""
    peak = F.min_by(
        F.struct("users_active", "date"),
        F.struct(-F.col("usage_cpu"), F.col("date"), F.col("users_active")),
    )
    out = df.agg(
        F.avg("users_active").alias("avg_users"),
        F.avg("cpu_per_user").alias("avg_cpu_per_user"),
        F.avg("user_efficiency").alias("avg_efficiency"),
        correlation("users_active", "usage_cpu").alias("users_cpu_corr"),
        peak.alias("peak"),
    )
    c, r = F.col("avg_cpu_per_user"), F.col("users_cpu_corr")
    return out.select(
        "avg_users",
        "avg_cpu_per_user",
        "avg_efficiency",
        "users_cpu_corr",
        F.col("peak.users_active").alias("peak_users"),
        F.col("peak.date").alias("peak_date"),
        ladder([(c < 2, "Efficient"), (c < 5, "Moderate")], "Resource Intensive").alias("user_class"),
        ladder([(r > 0.7, "strong positive"), (r < -0.3, "negative")], "moderate").alias("relation"),
    )


def efficiency_distribution(df: DataFrame, **sizes: int) -> DataFrame:
    """Quartiles, extremes and mean of user efficiency per resource type."""
    named = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    return distribution(df, ["resource_type"], ["user_efficiency"], named, **sizes)


def behaviour_intelligence(df: DataFrame, metric: str = "usage_cpu") -> DataFrame:
    """Detected patterns, stability metrics and action items in one row."""
    monthly = df.groupBy(F.month("date")).agg(F.avg(metric).alias("value"))
    seasonal_var = monthly.agg(F.var_samp("value")).scalar()
    cv = lambda c: F.when(F.avg(c) > 0, 100 - ratio(F.stddev_samp(c), F.avg(c)) * 100).otherwise(0.0)
    out = df.agg(
        F.count("*").alias("rows"),
        F.var_samp(metric).alias("total_var"),
        F.avg(F.when(F.col("is_holiday") == 1, F.col(metric))).alias("holiday_avg"),
        F.avg(F.when(F.col("is_holiday") == 0, F.col(metric))).alias("regular_avg"),
        correlation("users_active", "usage_cpu").alias("users_cpu_corr"),
        cv(metric).alias("consistency"),
        cv("users_active").alias("predictability"),
        F.when(F.min(metric) > 0, ratio(F.max(metric), F.min(metric)))
        .otherwise(0.0)
        .alias("peak_to_trough"),
    )
    impact = F.abs(ratio(F.col("holiday_avg") - F.col("regular_avg"), "regular_avg") * 100)
    noted = lambda condition, text: F.when(condition, F.lit(text))
    insights = F.array(
        noted(
            (F.col("rows") > 12) & (seasonal_var > F.col("total_var") * 0.5),
            PATTERNS[0],
        ),
        noted(impact > 15, PATTERNS[1]),
        noted(F.col("users_cpu_corr") > 0.7, PATTERNS[2]),
    )
    actions = F.array(
        noted(F.col("consistency") < 70, ACTIONS[0]),
        noted(F.col("predictability") < 60, ACTIONS[1]),
        noted(F.col("peak_to_trough") > 3, ACTIONS[2]),
        F.lit(ACTIONS[3]),
        F.lit(ACTIONS[4]),
    )
    return out.select(
        "users_cpu_corr",
        "consistency",
        "predictability",
        "peak_to_trough",
        impact.alias("holiday_impact_pct"),
        F.array_join(F.array_compact(insights), "; ").alias("insights"),
        F.array_join(F.array_compact(actions), "; ").alias("actions"),
    )


def seasonal_export(df: DataFrame, metric: str) -> DataFrame:
    return df.groupBy(F.month("date").alias("month"), day_name().alias("day_of_week")).agg(
        F.round(F.avg(metric), 2).alias("mean"),
        F.round(F.stddev_samp(metric), 2).alias("std"),
        F.round(F.min(metric), 2).alias("min"),
        F.round(F.max(metric), 2).alias("max"),
        F.round(F.avg("users_active"), 2).alias("users_mean"),
        F.sum("is_holiday").alias("holiday_rows"),
    )


def insight_summary(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("date_range"),
        F.avg(metric).alias("avg_metric_value"),
        F.stddev_samp(metric).alias("metric_volatility"),
        F.avg("user_efficiency").alias("user_efficiency"),
    )


def series_profile(region_daily: DataFrame, c: str = "users_active") -> DataFrame:
    """Length, moments, extremes, variation and holiday days of each regional series."""
    out = region_daily.groupBy("region").agg(
        F.count("*").alias("days"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.sum("holiday").alias("holiday_days"),
    )
    return out.withColumn("cv_pct", ratio("std", "mean") * 100)


def select_behaviour(df: DataFrame, include_holidays: bool = True, include_weekends: bool = True) -> DataFrame:
    """Behaviour frame restricted to the chosen kinds of days."""
    frame = filters.behaviour_frame(df)
    return filters.exclude_days(frame, holidays=not include_holidays, weekends=not include_weekends)


def size_scale(df: DataFrame, c: Column | str, low: float = 10.0, high: float = 40.0) -> DataFrame:
    """Marker size between ``low`` and ``high``; 15 for every row of a constant column."""
    value = col(c)
    span = df.agg(F.struct(F.min(value).alias("least"), F.max(value).alias("most"))).scalar()
    least, most = span["least"], span["most"]
    size = ratio(value - least, most - least) * (high - low) + low
    return df.withColumn("marker_size", F.when(most > least, size).otherwise(15.0))
