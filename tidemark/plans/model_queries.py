"""Fitted forecast models. Iterative fits have no SQL form; tests check them instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluation, models
from ..session import materialize, side_by_side
from ..sources.schemas import METRIC_TYPES
from .catalog import query


def series(t):
    return evaluation.long_series(t.daily_series)


@query("m_3_fit_ar", "region metric_type p:i d:i q:i coefficients aic:f rmse:f mae:f mape:f")
def _(t):
    best = models.best_ar(series(t))
    listed = F.array_join(F.transform("coef", lambda c: F.round(c, 4).cast("string")), ",")
    return best.withColumn("coefficients", listed)


@query("m_4_ar_order_by_aic", "region metric_type p:i d:i q:i aic:f n:i")
def _(t):
    return models.ar_order_by_aic(series(t))


FORECAST = "region metric_type step:i date predicted:f"


@query("m_5_forecast_ar", FORECAST)
def _(t):
    return models.forecast_ar(series(t))


def per_metric(t, build):
    """The rows of ``build(metric)`` of every metric."""
    t.daily_series_mean  # written before threads ask for it
    parts = side_by_side(t.spark, build, METRIC_TYPES)
    return reduce(lambda a, b: a.unionByName(b), parts)


def tree(t, metric):
    """Model, scores and regions of the boosted trees of a metric, fitted once for the data."""
    return models.kept_gbt(t.daily_series_mean, metric, t.kept("trained", "daily_series_mean"))


@query("m_6_fit_gbt", "region metric_type rmse:f mae:f mape:f r2:f n:i")
def _(t):
    """Always fitted anew."""
    return per_metric(t, lambda metric: materialize(models.fit_gbt(t.daily_series_mean, metric)[1], "tree-scores"))


@query("m_7_forecast_gbt", FORECAST)
def _(t):
    def forecast(metric):
        model, _, regions = tree(t, metric)
        return models.forecast_gbt(t.daily_series_mean, model, metric, regions)

    return per_metric(t, forecast)


@query("m_8_fit_window_linear", "region metric_type steps:i rmse:f mae:f mape:f")
def _(t):
    return models.fit_window_linear(series(t))


@query("m_9_forecast_window", FORECAST)
def _(t):
    return models.forecast_window(series(t), models.fit_window_linear(series(t)))


@query("m_17_backtest_rolling_origin", "region metric_type rmse:f mae:f mape:f n:i")
def _(t):
    steps = models.backtest_rolling_origin(series(t))
    return evaluation.error_metrics(steps, ["region", "metric_type"])


@query(
    "m_18_cross_validate",
    "region metric_type folds:i rmse_mean:f rmse_std:f mae_mean:f mae_std:f mape_mean:f mape_std:f",
)
def _(t):
    return models.cross_validate(series(t))


def importance(t, metric):
    model, _, regions = tree(t, metric)
    return models.feature_importance(model, metric, regions, t.spark)


@query("m_19_feature_importance", "metric_type feature importance:f")
def _(t):
    return per_metric(t, lambda metric: importance(t, metric).withColumn("metric_type", F.lit(metric)))


@query("k_6_feature_importance_rank", "metric_type position:i feature importance:f")
def _(t):
    return per_metric(
        t, lambda metric: models.feature_importance_rank(importance(t, metric), 10).withColumn("metric_type", F.lit(metric))
    )


@query("m_20_select_best_fitted", "region metric_type model_type rmse:f mae:f mape:f")
def _(t):
    return per_metric(t, lambda metric: evaluation.select_best(t.trained(metric, "daily_series_mean")["scores"]))


@query("m_21_future_users", "region metric_type model_type step:i date predicted:f")
def _(t):
    return models.future_metric(t.daily_series, "users", 30, trained=t.trained("users"))
