"""What the executed plans read and expand."""

import pytest

from tidemark.plans import CATALOG

FOLDER = "/root/testdata/sf0.001"


def executed(spark, name):
    df = CATALOG[name].run(spark, FOLDER)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a_4_kpis", "a_23_dataset_info"])
def test_distinct_counts_expand_no_row(spark, name):
    assert "Expand" not in executed(spark, name).split("Initial Plan")[0]


@pytest.mark.parametrize("name", ["w_20_as_daily_freq", "w_21_forward_fill", "j_5_missing_days", "j_6_forecast_vs_actual", "mon_1_measured_accuracy"])
def test_daily_queries_read_the_written_series(spark, name):
    assert "lineitem" not in executed(spark, name)


def test_plans_are_fed_by_the_chosen_fitted_models(spark):
    from tidemark.operators import evaluation
    from tidemark.plans import CATALOG
    from tidemark.plans.fitted_queries import FED, FittedTables

    tables = FittedTables(spark, "/root/testdata/sf0.001")
    tables.grid = [(5, 3, 0.3)]
    assert all(f"{name}_fitted" in CATALOG for name in FED)
    rows = {name: CATALOG[name].shape(CATALOG[name].build(tables)).collect() for name in ("m_13_forecast_summary", "c_3_demand_stats", "c_14_risk_matrix")}
    path: dict = {}
    for r in tables.fitted_forecast.collect():
        path.setdefault((r.region, r.metric_type), []).append(r.predicted)
    assert len(path) == 15 and all(len(p) == 30 for p in path.values())
    for r in rows["m_13_forecast_summary"]:
        assert abs(r.max_predicted - max(path[r.region, r.metric_type])) < 1e-3
    chosen = {(r.region, r.metric_type): r.model_type for r in evaluation.best_models(tables.registry).collect()}
    assert set(chosen) == set(path) and set(chosen.values()) <= {"ARIMA", "WindowLinear", "GBT"}
    for r in rows["c_14_risk_matrix"]:
        assert r.cpu_model == chosen[r.region, "cpu"] and r.users_model == chosen[r.region, "users"]
    assert rows["c_3_demand_stats"]


def test_fitted_queries_scan_the_fact_once_for_the_data(spark, monkeypatch):
    from tidemark.plans.fitted_queries import FittedTables

    first = FittedTables(spark, FOLDER)
    want = sorted(first.daily_series.collect()), first.daily_series_mean.count()
    monkeypatch.setattr(FittedTables, "region_daily", property(lambda t: pytest.fail("scanned again")))
    monkeypatch.setattr(FittedTables, "region_daily_mean", property(lambda t: pytest.fail("scanned again")))
    again = FittedTables(spark, FOLDER)
    assert (sorted(again.daily_series.collect()), again.daily_series_mean.count()) == want
