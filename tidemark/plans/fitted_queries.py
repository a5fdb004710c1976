"""Forecast tables and capacity plans fed by each region's chosen fitted model.

The queries of ``planning_queries`` of the same names rest on the value of a week ago, which SQL can state.
Here the three families are trained for the three metrics, their scores are recorded in the registry, and
the best family of each region and metric gives the forecast. Iterative fits have no SQL form.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation, models, registry
from ..session import materialize, side_by_side
from ..sources.schemas import METRIC_TYPES
from ..sources.tables import Tables
from . import planning_queries  # noqa: F401
from .catalog import CATALOG, query

FED = (
    "m_11_forecast_frame", "m_12_forecast_band", "m_13_forecast_summary", "m_13_forecast_insights",
    "g_3_record_performance", "c_2_demand_to_capacity", "c_3_demand_stats", "j_7_capacity_join", "c_4_utilization_risk",
    "c_5_provision_risk", "c_6_overall_risk", "c_7_recommendations", "c_8_capacity_plan", "c_8_capacity_plan_region",
    "c_9_capacity_summary", "c_10_optimization_overview", "c_11_capacity_report", "c_12_recommendation_export",
    "c_12_recommendation_counts", "c_13_forecast_report", "c_14_risk_matrix",
)


class FittedTables(Tables):
    """Tables whose forecasts and registry come from the fitted models, trained and forecast once for the data."""

    @cached_property
    def daily_series(self) -> DataFrame:
        return self.kept("fitted").table("region-daily", lambda: self.region_daily)

    @property
    def fitted_forecast(self) -> DataFrame:
        return self.kept("fitted").table("forecast", self._forecast)

    def _forecast(self) -> DataFrame:
        self.daily_series  # written before threads ask for it
        parts = side_by_side(self.spark, lambda m: models.future_metric(self.daily_series, m, trained=self.trained(m)), METRIC_TYPES)
        columns = ["region", "metric_type", "step", "date", "predicted"]
        return reduce(DataFrame.unionByName, parts).select(*columns)

    @property
    def registry(self) -> DataFrame:
        return self.kept("fitted").table("registry", self._registry)

    def _registry(self) -> DataFrame:
        """The log of the baselines and, as its last session on the last day of the data, the fitted models.

        The session's hash is the content hash of the series that the models learned.
        """
        self.daily_series  # written before threads ask for it
        log = materialize(evaluation.quarterly_scores(self.predictions), "model-performance")
        scores = reduce(DataFrame.unionByName, [t["scores"] for t in side_by_side(self.spark, self.trained, METRIC_TYPES)])
        best = evaluation.select_best(scores).select("region", "metric_type", F.col("model_type").alias("best"))
        day = self.daily_series.agg(F.max("date")).first()[0]
        content = registry.data_fingerprint(self.daily_series).first()
        known = ["region", "metric_type"]
        new = scores.join(best, known, "left").select(
            *known, "model_type", "rmse", "mae", "mape", F.lit(day).alias("training_date"),
            F.lit(content.data_hash).alias("data_hash"), F.lit(content.data_size).cast("long").alias("data_size"),
            F.coalesce(F.col("model_type") == F.col("best"), F.lit(False)).alias("is_active"),
        )
        return registry.record_performance(log, new)


def _fed(name: str) -> None:
    source = CATALOG[name]
    columns = " ".join(f"{column}:{kind}" if kind else column for column, kind in source.columns)

    @query(f"{name}_fitted", columns)
    def _(t):
        return source.build(FittedTables(t.spark, t.folder))


for _name in FED:
    _fed(_name)
