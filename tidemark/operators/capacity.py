"""Capacity planning: present capacity, expected demand, risk and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ladder, ratio
from ..functions.moments import correlation
from . import joins

# Service, metric type and column of the daily series.
SERVICES = {
    "Compute": ("cpu", "usage_cpu"),
    "Users": ("users", "users_active"),
    "Storage": ("storage", "usage_storage"),
}
# Capacity assumed for a region without history, and for unknown regions.
STATIC_CAPACITY = {
    "East US": {"Compute": 15000.0, "Storage": 50000.0, "Users": 25000.0},
    "West US": {"Compute": 14000.0, "Storage": 45000.0, "Users": 22000.0},
    "North Europe": {"Compute": 12000.0, "Storage": 40000.0, "Users": 20000.0},
    "Southeast Asia": {"Compute": 13000.0, "Storage": 42000.0, "Users": 21000.0},
}
UNKNOWN_CAPACITY = 10000.0
UNIT_SCALE = 15.0
FLOOR = 1000.0
RISK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}
# Peak utilisation in percent from which a message holds, highest first.
UTILIZATION_MESSAGES = [
    (95, "Critical capacity shortage imminent"),
    (85, "High capacity utilization - monitor closely"),
    (75, "Moderate capacity pressure"),
    (None, "Adequate capacity available"),
]
# Messages of the mean utilisation.
PROVISION_MESSAGES = {
    "over": "Potential over-provisioning detected",
    "under": "Under-provisioning risk",
    "optimal": "Optimal provisioning level",
}
# Fixed values: (type, priority, reason, timeline, impact) of each recommendation.
RECOMMENDATIONS = {
    "urgent": (
        "SCALE_UP",
        "HIGH",
        "Peak demand (%.0f) exceeds safe capacity threshold (95%%)",
        "Immediate (within 1 week)",
        "Critical - prevents service disruption",
    ),
    "soon": (
        "SCALE_UP",
        "MEDIUM",
        "Approaching capacity limits (%.1f%% utilization)",
        "Within 2 weeks",
        "Preventive - maintains service quality",
    ),
    "shrink": (
        "OPTIMIZE",
        "LOW",
        "Low average utilization (%.1f%%) indicates over-provisioning",
        "Next quarter review",
        "Cost savings opportunity",
    ),
    "watch": (
        "MONITOR",
        "LOW",
        "Capacity levels are optimal (%.1f%% avg, %.1f%% peak)",
        "Ongoing monitoring",
        "Stable operations",
    ),
}
# The action texts around the number of units.
GROW_ACTION, SHRINK_ACTION = "Add +", "Consider reducing -"
WATCH_ACTION = "Continue monitoring current capacity"


def _static(service: str) -> Column:
    table = F.create_map(
        *[F.lit(x) for region, values in STATIC_CAPACITY.items() for x in (region, values[service])]
    )
    return F.coalesce(table[F.col("region")], F.lit(UNKNOWN_CAPACITY))


def current_capacity(region_daily: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Capacity per region and service from the history of daily values.

    Percentiles run over one value per day and region. ``regions`` may name further
    regions; those without history get the static capacity.
    """
    capacity = {
        "Compute": F.percentile("usage_cpu", F.lit(0.95)) * 1.2 * UNIT_SCALE,
        "Users": F.max("users_active") * 1.1,
        "Storage": F.percentile("usage_storage", F.lit(0.95)) * 1.15,
    }
    wide = region_daily.groupBy("region").agg(
        *[F.greatest(c, F.lit(FLOOR)).alias(s) for s, c in capacity.items()]
    )
    if regions is not None:
        wide = regions.select("region").distinct().join(wide, "region", "left")
    rows = [
        F.struct(
            F.lit(s).alias("service"),
            F.lit(metric).alias("metric_type"),
            F.coalesce(F.col(s), _static(s)).alias("current_capacity"),
        )
        for s, (metric, _) in SERVICES.items()
    ]
    return wide.select("region", F.inline(F.array(*rows)))


def demand_to_capacity(forecasts: DataFrame, region_daily: DataFrame) -> DataFrame:
    """Forecast demand converted to capacity units with ratios from the history.

    Compute scales by the high percentiles over the mean, users get a fifth of their
    deviation as buffer, storage mixes CPU and users by their correlation with storage.
    Regions without history use the plain conversion.
    """
    high = F.percentile("usage_cpu", F.array(F.lit(0.75), F.lit(0.9), F.lit(0.95)))
    history = region_daily.groupBy("region").agg(
        F.aggregate(high, F.lit(0.0), lambda a, x: a + x).alias("high_sum"),
        F.avg("usage_cpu").alias("mean_cpu"),
        (F.stddev_pop("users_active") * 0.2).alias("users_buffer"),
        F.abs(correlation("usage_cpu", "usage_storage")).alias("cpu_corr"),
        F.abs(correlation("users_active", "usage_storage")).alias("users_corr"),
    )
    factor = F.when(F.col("mean_cpu") > 0, ratio(F.col("high_sum") / 3, "mean_cpu")).otherwise(1.5)
    total_corr = F.col("cpu_corr") + F.col("users_corr")
    ratios = history.select(
        "region",
        factor.alias("cpu_factor"),
        "users_buffer",
        ratio("cpu_corr", total_corr).alias("cpu_weight"),
        ratio("users_corr", total_corr).alias("users_weight"),
    )
    wide = forecasts.groupBy("region", "step", "date").agg(
        F.max(F.when(F.col("metric_type") == "cpu", F.col("predicted"))).alias("cpu"),
        F.max(F.when(F.col("metric_type") == "users", F.col("predicted"))).alias("users"),
    )
    known = wide.join(ratios, "region", "left")
    cpu, users = F.col("cpu"), F.col("users")
    mixed = cpu * F.col("cpu_weight") * 20 + users * F.col("users_weight") * 0.1
    converted = {
        "Compute": F.coalesce(cpu * F.col("cpu_factor") * UNIT_SCALE, cpu * UNIT_SCALE),
        "Users": F.coalesce(users + F.col("users_buffer"), users),
        "Storage": F.coalesce(mixed, cpu * 12 + users * 0.08),
    }
    rows = [F.struct(F.lit(s).alias("service"), c.alias("required")) for s, c in converted.items()]
    return known.select("region", "step", "date", F.inline(F.array(*rows)))


def demand_stats(forecasts: DataFrame) -> DataFrame:
    """Peak, mean and lowest forecast of each series with the rounded timeline."""
    ordered = F.array_sort(F.collect_list(F.struct("step", F.round("predicted", 2).alias("value"))))
    return forecasts.groupBy("region", "metric_type").agg(
        F.max("predicted").alias("max_demand"),
        F.avg("predicted").alias("avg_demand"),
        F.min("predicted").alias("min_demand"),
        F.count("*").alias("days"),
        F.transform(ordered, lambda s: s["value"]).alias("timeline"),
    )


def utilization_risk(plan: DataFrame) -> DataFrame:
    p = F.col("peak_pct")
    return plan.withColumns(
        {
            "utilization_risk": ladder([(p >= 95, "HIGH"), (p >= 75, "MEDIUM")], "LOW"),
            "utilization_message": ladder(
                [(p >= least, text) for least, text in UTILIZATION_MESSAGES[:-1]],
                UTILIZATION_MESSAGES[-1][1],
            ),
        }
    )


def provision_risk(plan: DataFrame) -> DataFrame:
    p = F.col("avg_pct")
    return plan.withColumns(
        {
            "provision_risk": ladder([(p <= 25, "MEDIUM"), (p >= 80, "HIGH")], "LOW"),
            "provision_message": ladder(
                [(p <= 25, PROVISION_MESSAGES["over"]), (p >= 80, PROVISION_MESSAGES["under"])],
                PROVISION_MESSAGES["optimal"],
            ),
        }
    )


def overall_risk(plan: DataFrame) -> DataFrame:
    """The higher of the two risks."""
    level = F.create_map(*[F.lit(x) for pair in RISK.items() for x in pair])
    name = F.create_map(*[F.lit(x) for risk, n in RISK.items() for x in (n, risk)])
    worst = F.greatest(level[F.col("utilization_risk")], level[F.col("provision_risk")])
    return plan.withColumn("overall_risk", name[worst])


def recommendations(plan: DataFrame) -> DataFrame:
    """One row per recommendation; a region without any other is told to keep watching."""
    peak, avg = F.col("peak_pct"), F.col("avg_pct")
    capacity, unit = F.col("current_capacity"), F.lower("service")
    whole = lambda c: c.cast("bigint")
    add = lambda buffer: whole(F.col("max_demand") * buffer - capacity)
    excess = whole(capacity - F.col("avg_demand") * 1.5)

    def entry(name: str, action: Column, *numbers: str) -> Column:
        kind, priority, reason, timeline, impact = RECOMMENDATIONS[name]
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(priority).alias("priority"),
            action.alias("action"),
            F.format_string(reason, *numbers).alias("reason"),
            F.lit(timeline).alias("timeline"),
            F.lit(impact).alias("impact"),
        )

    units = lambda text, n: F.concat(F.lit(text), n.cast("string"), F.lit(" "), unit, F.lit(" units"))
    scale = F.when(peak >= 95, entry("urgent", units(GROW_ACTION, add(1.25)), "max_demand")).when(
        peak >= 85, entry("soon", units(GROW_ACTION, add(1.15)), "peak_pct")
    )
    shrink = F.when(
        (avg <= 25) & (excess > 0), entry("shrink", units(SHRINK_ACTION, excess), "avg_pct")
    )
    watch = F.array(entry("watch", F.lit(WATCH_ACTION), "avg_pct", "peak_pct"))
    found = F.array_compact(F.array(scale, shrink))
    listed = plan.withColumn("found", found)
    chosen = F.when(F.size("found") > 0, F.col("found")).otherwise(watch)
    return listed.select(
        "region", "service", "current_capacity", "overall_risk", "days", F.inline(chosen)
    )


def capacity_plan(
    forecasts: DataFrame,
    region_daily: DataFrame,
    service: str | None = None,
    region: str | None = None,
    horizon: int = 30,
    scaled_demand: bool = False,
) -> DataFrame:
    """Demand, utilisation and risk per region and service.

    Compute demand is a percentage while its capacity is in units; ``scaled_demand``
    converts the demand with the same factor, the default keeps the documented formula.
    """
    chosen = forecasts.filter(F.col("step") <= horizon)
    if service:
        chosen = chosen.filter(F.col("metric_type") == SERVICES[service][0])
    if region:
        chosen = chosen.filter(F.col("region") == region)
        region_daily = region_daily.filter(F.col("region") == region)
    if scaled_demand:
        unit = F.when(F.col("metric_type") == "cpu", UNIT_SCALE).otherwise(1.0)
        chosen = chosen.withColumn("predicted", F.col("predicted") * unit)
    plan = joins.capacity_join(demand_stats(chosen), current_capacity(region_daily))
    return overall_risk(provision_risk(utilization_risk(plan)))


def capacity_summary(plan: DataFrame) -> DataFrame:
    out = plan.groupBy("service").agg(
        F.count("*").alias("total_regions"),
        F.count_if(F.col("overall_risk") == "HIGH").alias("high_risk"),
        F.count_if(F.col("overall_risk") == "MEDIUM").alias("medium_risk"),
        F.count_if(F.col("overall_risk") == "LOW").alias("low_risk"),
    )
    status = ladder([(F.col("high_risk") > 0, "CRITICAL"), (F.col("medium_risk") > 0, "WARNING")], "HEALTHY")
    return out.withColumn("overall_status", status)


def optimization_overview(plan: DataFrame) -> DataFrame:
    """Optimisation opportunities, scale-ups and mean utilisation per service."""
    pct = F.round("avg_pct", 1)
    base = plan.groupBy("service").agg(
        F.count("*").alias("regions"),
        F.count_if(pct < 40).alias("over_provisioned"),
        F.avg(pct).alias("avg_utilization"),
    )
    scale = recommendations(plan).groupBy("service").agg(
        F.count_if(F.col("type") == "SCALE_UP").alias("scale_ups"),
        F.count_if((F.col("type") == "SCALE_UP") & (F.col("priority") == "HIGH")).alias("urgent_scale_ups"),
    )
    a = F.col("avg_utilization")
    band = F.when(a.between(60, 80), "Optimal").otherwise("Sub-optimal")
    return base.join(scale, "service").withColumn("band", band)


def _models(selection: DataFrame) -> DataFrame:
    pick = lambda m: F.max(F.when(F.col("metric_type") == m, F.col("model_type")))
    return selection.groupBy("region").agg(
        *[F.coalesce(pick(m), F.lit("Unknown")).alias(f"{m}_model") for m, _ in SERVICES.values()]
    )


def capacity_report(plan: DataFrame, selection: DataFrame, horizon: int = 30) -> DataFrame:
    """Flat report rows with the models behind each region's forecast."""
    return plan.join(_models(selection), "region", "left").select(
        "region",
        F.col("service").alias("service_type"),
        F.lit(horizon).alias("forecast_horizon_days"),
        "current_capacity",
        F.round("max_demand", 2).alias("peak_demand"),
        F.round("avg_demand", 2).alias("average_demand"),
        F.round("min_demand", 2).alias("min_demand"),
        F.round("peak_pct", 1).alias("peak_utilization_pct"),
        F.round("avg_pct", 1).alias("average_utilization_pct"),
        F.col("overall_risk").alias("risk_level"),
        F.col("utilization_message").alias("risk_message"),
        "cpu_model",
        "users_model",
        "storage_model",
    )


def recommendation_export(plan: DataFrame) -> DataFrame:
    return recommendations(plan).select(
        "region",
        F.col("service").alias("service_type"),
        F.col("type").alias("recommendation_type"),
        "priority",
        F.col("action").alias("action_required"),
        "timeline",
        F.col("impact").alias("expected_impact"),
        "current_capacity",
        F.col("overall_risk").alias("risk_level"),
        F.col("days").alias("forecast_horizon"),
        "reason",
    )


def recommendation_counts(plan: DataFrame) -> DataFrame:
    return recommendations(plan).groupBy("priority").agg(F.count("*").alias("recommendations"))


def forecast_report(forecasts: DataFrame, plan: DataFrame) -> DataFrame:
    """Date by region rows: CPU and users forecast with the capacity status of that day."""
    wide = forecasts.groupBy("date", "region").agg(
        F.max(F.when(F.col("metric_type") == "cpu", F.col("predicted"))).alias("cpu_forecast"),
        F.max(F.when(F.col("metric_type") == "users", F.col("predicted"))).alias("users_forecast"),
    )
    users = plan.filter(F.col("service") == "Users").select("region", "current_capacity")
    joined = wide.join(users, "region").withColumn(
        "peak_pct", ratio("users_forecast", "current_capacity") * 100
    )
    status = F.when(F.col("utilization_risk") == "LOW", "Normal").when(
        F.col("utilization_risk") == "MEDIUM", "Warning"
    )
    return utilization_risk(joined).select(
        "date", "region", "cpu_forecast", "users_forecast", status.otherwise("Critical").alias("capacity_status")
    )


def risk_matrix(plan: DataFrame, selection: DataFrame) -> DataFrame:
    """Region, risk, capacity, demand and utilisation with the model sources."""
    return plan.join(_models(selection), "region", "left").select(
        "region",
        "service",
        F.col("overall_risk").alias("risk_level"),
        "current_capacity",
        F.col("max_demand").alias("peak_demand"),
        "avg_demand",
        F.round("peak_pct", 1).alias("peak_utilization"),
        F.round("avg_pct", 1).alias("avg_utilization"),
        F.col("utilization_message").alias("status"),
        "cpu_model",
        "users_model",
        "storage_model",
    )
