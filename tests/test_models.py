"""Fitted models against brute force and against the simple baselines."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models

DAY0 = datetime.date(2023, 1, 1)


def table(spark, paths):
    rows = [
        (region, metric, DAY0 + datetime.timedelta(days=i), float(v))
        for (region, metric), xs in paths.items()
        for i, v in enumerate(xs)
    ]
    return spark.createDataFrame(rows, "region string, metric_type string, date date, value double")


def seasonal(n=220, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    return 50 + 10 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, noise, n)


def test_ar_coefficients_match_least_squares(spark):
    rng = np.random.default_rng(8)
    w = np.zeros(400)
    for i in range(2, 400):
        w[i] = 0.6 * w[i - 1] - 0.3 * w[i - 2] + rng.normal()
    y = 100 + w.cumsum()
    s = models.with_train_end(table(spark, {("A", "cpu"): y}), models.SERIES)
    fits, _ = models.fit_ar(s, models.SERIES, [(2, 1, 0)])
    row = fits.first()
    train = np.diff(y)[:319]
    depth = models.LONG_ORDER
    design = np.column_stack([train[depth - 1 : -1], train[depth - 2 : -2]])
    want, *_ = np.linalg.lstsq(design, train[depth:], rcond=None)
    assert np.allclose(row.coef, want, atol=1e-6)
    assert row.coef[0] == pytest.approx(0.6, abs=0.15) and row.coef[1] == pytest.approx(-0.3, abs=0.15)


def test_moving_average_term_is_recovered(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(0, 1, 2500)
    y = np.r_[0, (e[1:] + 0.7 * e[:-1])].cumsum()
    s = models.with_train_end(table(spark, {("A", "cpu"): y}), models.SERIES)
    fits, _ = models.fit_ar(s, models.SERIES, [(0, 1, 1)])
    assert fits.first().coef[0] == pytest.approx(0.7, abs=0.1)


def test_ar_beats_the_mean_on_a_weekly_cycle(spark):
    s = table(spark, {("A", "cpu"): seasonal(), ("B", "cpu"): seasonal(seed=3)})
    best = {r.region: r for r in models.best_ar(s, orders=[(1, 1, 0), (7, 0, 0), (7, 1, 0)]).collect()}
    for r in best.values():
        assert r.p == 7 and r.rmse < 4
    future = models.forecast_ar(s, 14, [(7, 0, 0)]).collect()
    assert len(future) == 28
    truth = 50 + 10 * np.sin((220 + np.arange(14)) * 2 * np.pi / 7)
    got = np.array([r.predicted for r in sorted(future, key=lambda r: r.step) if r.region == "A"])
    assert np.sqrt(np.mean((got - truth) ** 2)) < 3
    assert min(r.date for r in future) == DAY0 + datetime.timedelta(days=220)


def test_order_selection_by_aic(spark):
    s = table(spark, {("A", "cpu"): seasonal(noise=0.5)})
    row = models.ar_order_by_aic(s, max_p=3, max_d=1, max_q=1).first()
    assert row.p >= 2


def test_window_models_learn_the_cycle(spark):
    s = table(spark, {("A", "cpu"): seasonal(noise=0.2), ("A", "users"): 10 * seasonal(seed=5, noise=0.2)})
    fit = models.fit_window_linear(s)
    assert {r.metric_type for r in fit.collect()} == {"cpu", "users"}
    assert all(r.rmse < (1 if r.metric_type == "cpu" else 10) for r in fit.collect())
    future = models.forecast_window(s, fit, 7).filter(F.col("metric_type") == "cpu").orderBy("step").collect()
    truth = 50 + 10 * np.sin((220 + np.arange(7)) * 2 * np.pi / 7)
    assert np.abs(np.array([r.predicted for r in future]) - truth).max() < 2


def test_backtest_equals_refitting_every_day(spark):
    y = seasonal(60, seed=2)
    rows = models.backtest_rolling_origin(table(spark, {("A", "cpu"): y}), p=2).orderBy("prediction_date").collect()
    assert len(rows) == 12
    for r in rows:
        t = (r.prediction_date - DAY0).days
        d = np.diff(y[:t])
        design = np.column_stack([d[1:-1], d[:-2]])
        coef, *_ = np.linalg.lstsq(design, d[2:], rcond=None)
        assert r.predicted_value == pytest.approx(y[t - 1] + coef[0] * d[-1] + coef[1] * d[-2], rel=1e-6)


def test_cross_validation_uses_every_fold(spark):
    s = table(spark, {("A", "cpu"): seasonal(200)})
    row = models.cross_validate(s, 4, (7, 0, 0)).first()
    assert row.folds == 4 and row.rmse_mean < 6 and row.rmse_std >= 0


def daily(spark, n=160):
    rows = []
    for seed, region in enumerate(("A", "B")):
        cpu = seasonal(n, seed)
        for i in range(n):
            day = DAY0 + datetime.timedelta(days=i)
            rows.append((region, day, float(cpu[i]), 500.0 + i, float(300.0 + cpu[i]), 100.0, 1.0, int(day.weekday() >= 5)))
    return spark.createDataFrame(
        rows,
        "region string, date date, usage_cpu double, usage_storage double, users_active double, "
        "economic_index double, cloud_market_demand double, holiday int",
    )


def test_trees_select_forecast_and_explain(spark):
    rd = daily(spark)
    model, scores, regions = models.fit_gbt(rd, "cpu", [(5, 2, 0.1), (10, 3, 0.3)])
    assert regions == ["A", "B"] and scores.count() == 2
    path = models.forecast_gbt(rd, model, "cpu", regions, horizon=8, every=3)
    rows = path.collect()
    assert len(rows) == 16 and all(0 <= r.predicted <= 100 for r in rows)
    assert sorted(r.step for r in rows if r.region == "A") == list(range(1, 9))
    importance = models.feature_importance(model, "cpu", regions, spark)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert models.feature_importance_rank(importance, 3).count() == 3


def test_future_metric_uses_the_best_family(spark):
    rd = daily(spark)
    out = models.future_metric(rd, "cpu", 10, [(5, 2, 0.1)])
    rows = out.collect()
    assert len(rows) == 20 and len({(r.region, r.model_type) for r in rows}) == 2


def test_quarterly_scores_mark_one_active_model(spark):
    log = evaluation.quarterly_scores(evaluation.baseline_predictions(daily(spark)))
    active = log.groupBy("region", "metric_type", "training_date").agg(F.count_if("is_active").alias("n"))
    assert active.filter("n <> 1").count() == 0


def region_days(spark, n=150, gap=0):
    rng = np.random.default_rng(4)
    rows = []
    for region in ("A", "B"):
        for i in range(n):
            known = i < n - gap
            rows.append(
                (region, DAY0 + datetime.timedelta(days=i), float(50 + 10 * np.sin(i / 3) + rng.normal()), float(300 + i % 7),
                 float(900 + 5 * (i % 7) + rng.normal()), 70.0 + min(i, 80) if known else None, 1.0 + min(i, 80) / 10 if known else None, int(i % 7 >= 5))
            )
    return spark.createDataFrame(
        rows,
        "region string, date date, usage_cpu double, usage_storage double, users_active double, economic_index double, "
        "cloud_market_demand double, holiday int",
    )


def test_tree_forecast_keeps_the_last_known_factors(spark):
    whole, gap = region_days(spark), region_days(spark, gap=60)
    for metric in ("cpu", "users"):
        model, _, regions = models.fit_gbt(whole, metric, [(5, 3, 0.3)])
        found = [
            sorted((r.region, r.step, round(r.predicted, 9)) for r in models.forecast_gbt(df, model, metric, regions, 6).collect())
            for df in (whole, gap)
        ]
        # Factors stand still for the last 70 days, so a gap of 60 days changes nothing.
        assert found[0] == found[1] and len(found[0]) == 12


def test_a_factor_that_was_never_known_is_an_error(spark):
    whole = region_days(spark)
    model, _, regions = models.fit_gbt(whole, "cpu", [(3, 2, 0.3)])
    never = whole.withColumn("economic_index", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no economic_index is known for"):
        models.forecast_gbt(never, model, "cpu", regions, 2).collect()


def test_grid_points_of_one_depth_and_step_are_one_fit(spark, monkeypatch):
    rd, fits, fit = daily(spark), [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: fits.append(self.getMaxIter()) or fit(self, rows))
    apart = [models.fit_gbt(rd, "cpu", [point])[1].agg(F.sum("rmse")).first()[0] for point in ((3, 2, 0.1), (12, 2, 0.1))]
    fits.clear()
    model, scores, _ = models.fit_gbt(rd, "cpu", [(3, 2, 0.1), (12, 2, 0.1)])
    assert fits == [12] and model.getNumTrees == 12
    assert scores.agg(F.sum("rmse")).first()[0] == pytest.approx(apart[1]) and apart[1] < apart[0]


def test_the_shorter_of_two_fits_may_win(spark):
    rng = np.random.default_rng(3)
    rd = daily(spark).drop("usage_cpu")
    noise = spark.createDataFrame(
        [(r, DAY0 + datetime.timedelta(days=i), float(v)) for r in ("A", "B") for i, v in enumerate(rng.normal(50, 9, 160))],
        "region string, date date, usage_cpu double",
    )
    rd = rd.join(noise, ["region", "date"])
    model, scores, _ = models.fit_gbt(rd, "cpu", [(1, 5, 1.0), (40, 5, 1.0)])
    alone, want, _ = models.fit_gbt(rd, "cpu", [(1, 5, 1.0)])
    assert model.getNumTrees == 1 and sorted(scores.collect()) == sorted(want.collect())
    assert model.toDebugString.split("\n", 1)[1] == alone.toDebugString.split("\n", 1)[1]


def test_families_train_and_forecast_side_by_side(spark, monkeypatch):
    import threading

    rd, meet = daily(spark), threading.Barrier(3, timeout=60)
    for name in ("best_ar", "fit_window_linear", "fit_gbt", "forecast_ar", "forecast_window", "forecast_gbt"):
        own = getattr(models, name)
        monkeypatch.setattr(models, name, lambda *a, own=own, **k: meet.wait() is not None and own(*a, **k))
    assert models.future_metric(rd, "cpu", 3, [(2, 2, 0.1)]).count() == 6
