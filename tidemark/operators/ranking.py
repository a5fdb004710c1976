"""Ranks, top-k selections and set operations over small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ladder


def average_rank(df: DataFrame, c: str, ascending: bool = True) -> Column:
    """Rank among all rows, ties sharing their mean rank.

    For aggregates of one row per region; ``functions.order_stats.value_positions``
    ranks row-level data without a single global window.
    """
    order = F.col(c).asc() if ascending else F.col(c).desc()
    ties = Window.partitionBy(c)
    return F.rank().over(Window.orderBy(order)) + (F.count("*").over(ties) - 1) / 2


def metric_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_rank": average_rank(df, c, ascending=False) for c in cols})


def overall_ranking(stats: DataFrame) -> DataFrame:
    """Average, peak and (reversed) volatility ranks combined 0.4 / 0.3 / 0.3 and re-ranked."""
    ranked = stats.withColumns(
        {
            "avg_rank": average_rank(stats, "avg", ascending=False),
            "peak_rank": average_rank(stats, "peak", ascending=False),
            "volatility_rank": average_rank(stats, "volatility", ascending=True),
        }
    )
    score = F.round(
        F.col("avg_rank") * 0.4 + F.col("peak_rank") * 0.3 + F.col("volatility_rank") * 0.3, 6
    )
    scored = ranked.withColumn("overall_score", score)
    return scored.withColumn("overall_rank", average_rank(scored, "overall_score")).orderBy("overall_rank")


def top_regions(df: DataFrame, n: int = 5) -> DataFrame:
    totals = df.groupBy("region").agg(F.sum("usage_cpu").alias("total_cpu"))
    return totals.orderBy(F.desc("total_cpu"), "region").limit(n)


def recent(df: DataFrame, date_col: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """The ``n`` newest rows; equal dates in the order of ``ties``."""
    return df.orderBy(F.desc(date_col), *(ties or [])).limit(n)


def strength(r: Column) -> Column:
    return ladder([(F.abs(r) >= 0.7, "Strong"), (F.abs(r) >= 0.3, "Moderate")], "Weak")


def strongest_pairs(correlations: DataFrame, n: int = 5, min_abs: float = 0.0) -> DataFrame:
    """Pairs with the largest absolute correlation."""
    r = F.col("correlation")
    pairs = correlations.filter((F.col("row") < F.col("column")) & (F.abs(r) >= min_abs))
    return (
        pairs.withColumn("strength", strength(r))
        .orderBy(F.desc(F.abs(r)), "row", "column")
        .limit(n)
    )


PRIORITY = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def top_recommendations(recommendations: DataFrame, per_class: dict[str, int | None]) -> DataFrame:
    """Recommendations by priority; a class may show only its first few entries."""
    order = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    ranked = recommendations.withColumn("priority_rank", F.coalesce(order[F.col("priority")], F.lit(3)))
    w = Window.partitionBy("priority").orderBy("region", "service", "type")
    ranked = ranked.withColumn("position", F.row_number().over(w))
    shown = F.lit(True)
    for priority, most in per_class.items():
        if most is not None:
            shown = shown & ((F.col("priority") != priority) | (F.col("position") <= most))
    return ranked.filter(shown).orderBy("priority_rank", "position")


def ranking(df: DataFrame, c: str, key: str) -> DataFrame:
    """Rows numbered from the largest value down."""
    w = Window.orderBy(F.desc(c), key)
    return df.withColumn("position", F.row_number().over(w)).orderBy("position")


def union_forecasts(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def available_services(forecasts: DataFrame) -> DataFrame:
    """Which service has a forecast in which region."""
    parts = [
        forecasts.filter(F.col("metric_type") == metric).select(F.lit(service).alias("service"), "region")
        for service, metric in (("Compute", "cpu"), ("Users", "users"), ("Storage", "storage"))
    ]
    return union_forecasts(parts).distinct()


def distinct_model_types(registry: DataFrame) -> DataFrame:
    return registry.select("model_type").distinct()


def calendar_difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected (key, date) rows that were not observed, as a set difference."""
    return expected.subtract(observed.select(*expected.columns))


