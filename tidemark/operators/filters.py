"""Filters, predicates, cleaning and presentation of the usage fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, ratio
from ..functions.order_stats import percentiles
from ..sources.schemas import METRICS, USAGE

ALL = "All"
# Fixed values: (month, day) treated as holidays by the behaviour analysis.
FIXED_HOLIDAYS = [(1, 1), (7, 4), (12, 25), (12, 31)]


def filter_usage(
    df: DataFrame,
    region: str | None = None,
    resource: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Optional equality on region and resource type and a closed date range."""
    if region:
        df = df.filter(F.col("region") == region)
    if resource:
        df = df.filter(F.col("resource_type") == resource)
    if start:
        df = df.filter(F.col("date") >= F.lit(start))
    if end:
        df = df.filter(F.col("date") <= F.lit(end))
    return df


def filter_in(df: DataFrame, resources: list[str]) -> DataFrame:
    """Rows of the selected resource types."""
    return df.filter(F.col("resource_type").isin(*resources))


def explore(
    df: DataFrame, start: date, end: date, region: str = ALL, resource: str = ALL
) -> DataFrame:
    """Closed date range; ``All`` leaves region or resource type unrestricted."""
    return filter_usage(
        df,
        None if region == ALL else region,
        None if resource == ALL else resource,
        start,
        end,
    )


def trailing_days(df: DataFrame, n: int, inclusive: bool = True) -> DataFrame:
    """Rows of the last ``n`` days before the latest date.

    ``inclusive`` keeps the cut-off day itself, hence n + 1 dates; otherwise n dates.
    The latest date is a scalar subquery, so the filter stays a plain predicate.
    """
    cutoff = F.date_sub(df.agg(F.max("date")).scalar(), n)
    return df.filter(F.col("date") >= cutoff if inclusive else F.col("date") > cutoff)


def exclude_days(
    df: DataFrame, holidays: bool = True, weekends: bool = False, holiday_col: str = "is_holiday"
) -> DataFrame:
    """Drop holiday rows, weekend rows, or both."""
    if holidays:
        df = df.filter(F.col(holiday_col) == 0)
    if weekends:
        df = df.filter(F.weekday("date") < 5)
    return df


def clean_bounds(df: DataFrame) -> DataFrame:
    """Drop rows lacking a required column; CPU into [0, 100], other metrics at least 0."""
    return df.dropna(subset=["resource_type", *METRICS]).withColumns(
        {
            "usage_cpu": clamp("usage_cpu", 0, 100),
            "usage_storage": F.greatest(F.lit(0.0), F.col("usage_storage")),
            "users_active": F.greatest(F.lit(0), F.col("users_active")),
        }
    )


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def present(df: DataFrame) -> DataFrame:
    """Display form: fixed column order, rounding, Yes/No holidays, latest dates first."""
    return df.select(
        "date",
        "region",
        "resource_type",
        F.round("usage_cpu", 1).alias("usage_cpu"),
        F.col("usage_storage").cast("int").alias("usage_storage"),
        "users_active",
        F.round("economic_index", 2).alias("economic_index"),
        F.round("cloud_market_demand", 3).alias("cloud_market_demand"),
        F.when(F.col("holiday") == 1, "Yes").when(F.col("holiday") == 0, "No").alias("holiday"),
    ).orderBy(F.desc("date"))


def holiday_partition(df: DataFrame) -> DataFrame:
    """Holiday rows and regular rows under one label column."""
    label = F.when(F.col("holiday") == 1, "holiday").otherwise("regular")
    return df.select(label.alias("day_kind"), *METRICS)


def validate_schema(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """One row per expected column: is it there, has it the declared type, how full is it."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    expected = {f.name: f.dataType.simpleString() for f in USAGE.fields}
    names = required or list(expected)
    filled = df.agg(
        F.count("*").alias("rows"),
        *[
            (F.count(c) if c in actual else F.lit(0).cast("bigint")).alias(f"n_{c}")
            for c in names
        ],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(expected.get(c)).alias("expected_type"),
            F.lit(actual.get(c)).cast("string").alias("actual_type"),
            F.lit(c in actual).alias("present"),
            F.lit(actual.get(c) == expected.get(c)).alias("type_ok"),
            F.col(f"n_{c}").alias("non_null"),
            F.col("rows"),
        )
        for c in names
    ]
    return filled.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column from one pass over the data."""
    cols = cols or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "nulls")


def data_quality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Completeness, validity of CPU and users, and their mean, in percent."""
    cols = cols or df.columns
    nulls = sum((F.count_if(F.col(c).isNull()) for c in cols[1:]), F.count_if(F.col(cols[0]).isNull()))
    cells = F.count("*") * len(cols)
    scores = df.agg(
        F.count("*").alias("rows"),
        ((1 - ratio(nulls, cells)) * 100).alias("completeness"),
        (ratio(F.count_if(F.col("usage_cpu").between(0, 100)), F.count("*")) * 100).alias(
            "cpu_validity"
        ),
        (ratio(F.count_if(F.col("users_active") >= 0), F.count("*")) * 100).alias("users_validity"),
    )
    overall = (F.col("completeness") + F.col("cpu_validity") + F.col("users_validity")) / 3
    return scores.withColumn("overall_quality", overall)


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Text to number; text that is not a number becomes null."""
    return df.withColumn(column, F.col(column).try_cast("double"))


def median_fill(df: DataFrame, column: str) -> DataFrame:
    """Nulls of ``column`` replaced by its median over the whole table."""
    median = percentiles(df, [], [column], [0.5]).select("quantile").scalar()
    return df.withColumn(column, F.coalesce(F.col(column), median))


def category_values(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a categorical column, each of which becomes a column."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def one_hot(df: DataFrame, categories: dict[str, list[str]], drop_first: bool = True) -> DataFrame:
    """0/1 column per category; ``drop_first`` leaves out the first in sorted order."""
    dummies = {
        f"{column}_{value}": (F.col(column) == value).cast("int")
        for column, values in categories.items()
        for value in sorted(values)[1 if drop_first else 0 :]
    }
    return df.withColumns(dummies).drop(*categories)


def simulated_holiday(day: Column | str = "date") -> Column:
    """1 on weekends and on the fixed holidays."""
    fixed = F.struct(F.month(day), F.dayofmonth(day)).isin(
        *[F.struct(F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    )
    return ((F.weekday(day) >= 5) | fixed).cast("int")


def per_user_ratios(df: DataFrame) -> DataFrame:
    """Per-user ratios; the +1 keeps idle periods finite."""
    return df.withColumns(
        {
            "cpu_per_user": F.col("usage_cpu") / (F.col("users_active") + 1),
            "storage_per_user": F.col("usage_storage") / (F.col("users_active") + 1),
            "user_efficiency": F.col("users_active") / (F.col("usage_cpu") + 1) * 100,
        }
    )


def behaviour_frame(df: DataFrame) -> DataFrame:
    """Fact with simulated holidays and per-user ratios, the input of behaviour analysis."""
    return per_user_ratios(df.withColumn("is_holiday", simulated_holiday()))
