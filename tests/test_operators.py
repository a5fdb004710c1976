"""Properties and edge cases of filters, windows, registry, capacity and monitoring."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    aggregates,
    capacity,
    evaluation,
    filters,
    forecasting,
    insights,
    joins,
    monitoring,
    ranking,
    registry,
    windows,
)
from tidemark.sources import readers, writers

D = datetime.date
DAY0 = D(2024, 1, 1)
FACT = (
    "date date, region string, resource_type string, usage_cpu double, usage_storage double, "
    "users_active int, economic_index double, cloud_market_demand double, holiday int"
)


def fact(spark, days=20, regions=("A", "B"), seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(days):
        day = DAY0 + datetime.timedelta(days=i)
        for region in regions:
            for kind in ("VM", "Storage", "Container"):
                rows.append(
                    (day, region, kind, float(rng.randint(2, 100)), rng.uniform(10, 2000), rng.randint(200, 499),
                     100.0 + i, 1.0, int(day.weekday() >= 5))
                )
    rng.shuffle(rows)
    return spark.createDataFrame(rows, FACT)


def series(spark, values, region="A", start=DAY0, name="value"):
    rows = [(region, start + datetime.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"region string, date date, {name} double")


def values(df, c, order="date"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_trailing_days_keeps_n_or_n_plus_one_dates(spark):
    df = fact(spark)
    assert filters.trailing_days(df, 5, True).select("date").distinct().count() == 6
    assert filters.trailing_days(df, 5, False).select("date").distinct().count() == 5


def test_unknown_region_gives_no_rows(spark):
    df = fact(spark)
    assert filters.filter_usage(df, region="nowhere").count() == 0
    assert aggregates.time_series(df, region="nowhere").count() == 0
    assert filters.explore(df, DAY0, DAY0).count() == 6


def test_clean_bounds(spark):
    rows = [(DAY0, "A", "VM", 150.0, -5.0, -100), (DAY0, "A", "VM", -1.0, 7.0, 3), (DAY0, "A", None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "date date, region string, resource_type string, usage_cpu double, usage_storage double, users_active int")
    got = sorted((r.usage_cpu, r.usage_storage, r.users_active) for r in filters.clean_bounds(df).collect())
    assert got == [(0.0, 7.0, 3), (100.0, 0.0, 0)]


def test_shares_sum_to_hundred(spark):
    total = aggregates.regional_share(fact(spark)).agg(F.sum("share_pct")).first()[0]
    assert total == pytest.approx(100)


def test_row_order_changes_nothing(spark):
    df = fact(spark)
    again = df.orderBy(F.rand(7)).repartition(5)
    for build in (aggregates.kpis, aggregates.peak_rows, aggregates.regional_comparison, registry.data_fingerprint):
        assert sorted(map(str, build(df).collect())) == sorted(map(str, build(again).collect()))


def test_peak_ties_go_to_the_first_key(spark):
    rows = [(D(2024, 1, 2), "A", "VM", 9.0, 1.0, 5), (D(2024, 1, 1), "B", "VM", 9.0, 1.0, 5), (D(2024, 1, 1), "A", "VM", 9.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "date date, region string, resource_type string, usage_cpu double, usage_storage double, users_active int")
    for r in aggregates.peak_rows(df).collect():
        assert (r.date, r.region) == (D(2024, 1, 1), "A")


def test_single_row_and_zero_users(spark):
    row = [(DAY0, "A", "VM", 50.0, 100.0, 0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(row, FACT)
    assert aggregates.regional_comparison(df).first()["usage_cpu_std"] is None
    assert aggregates.resource_efficiency(df).first()["cpu_per_user"] is None
    assert insights.daily_efficiency(df).first()["efficiency"] == 50.0
    assert insights.cost_benefit(df).first()["cost_per_user"] == 50.0
    assert aggregates.holiday_impact(df).first()["holiday_avg"] is None


def test_validate_schema_reports_missing_and_wrong_types(spark):
    df = fact(spark).drop("holiday").withColumn("usage_cpu", F.col("usage_cpu").cast("string"))
    rows = {r["column"]: r for r in filters.validate_schema(df).collect()}
    assert not rows["holiday"].present and rows["usage_cpu"].type_ok is False and rows["date"].type_ok


def test_category_values_are_all_values_in_order(spark):
    df = spark.range(1500).withColumn("c", F.col("id").cast("string")).union(spark.sql("SELECT 1L, CAST(NULL AS STRING)"))
    assert filters.category_values(df, "c") == sorted(str(k) for k in range(1500))


def test_missing_days_and_daily_frequency(spark):
    df = series(spark, [1.0, 2.0, 3.0]).unionByName(series(spark, [9.0], start=D(2024, 1, 6)))
    assert values(joins.missing_days(df, ["region"]), "date") == [D(2024, 1, 4), D(2024, 1, 5)]
    filled = windows.as_daily_freq(df, ["region"])
    assert values(filled, "value") == [1.0, 2.0, 3.0, None, None, 9.0]
    assert values(windows.forward_fill(filled, ["region"], ["value"]), "value") == [1.0, 2.0, 3.0, 3.0, 3.0, 9.0]


def test_rolling_needs_a_full_window(spark):
    df = series(spark, [float(i) for i in range(10)])
    full = values(windows.rolling_mean(df, ["region"], "value", [7]), "value_mean7")
    assert full[:6] == [None] * 6 and full[6:] == [3.0, 4.0, 5.0, 6.0]
    partial = values(windows.rolling_mean_partial(df, ["region"], ["value"]), "value_roll7")
    assert partial[0] == 0.0 and partial[2] == 1.0 and partial[9] == 6.0


def test_difference_and_reconstruct(spark):
    df = series(spark, [5.0, 7.0, 4.0, 4.0])
    diffs = windows.difference(df, ["region"], "value")
    assert values(windows.reconstruct(diffs, ["region"], "value_diff", F.lit(5.0)), "reconstructed") == [5.0, 7.0, 4.0, 4.0]


def test_flat_peak_counts_once_in_the_middle(spark):
    df = series(spark, [1.0, 5.0, 5.0, 5.0, 1.0, 0.0, 2.0])
    found = {(r.kind, r.date) for r in windows.peaks_valleys(df, ["region"], "value").collect()}
    assert found == {("peak", D(2024, 1, 3)), ("valley", D(2024, 1, 6))}


def test_decomposition_adds_up(spark):
    df = series(spark, [10 + (i % 7) * 2.0 + i * 0.1 for i in range(60)])
    rows = windows.seasonal_decompose(df, ["region"], "value").collect()
    whole = [r for r in rows if r.trend is not None]
    assert len(whole) == 54
    assert all(r.value == pytest.approx(r.trend + r.seasonal + r.residual) for r in whole)
    assert sum({round(r.seasonal, 9) for r in rows}) == pytest.approx(0, abs=1e-6)


def test_average_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", 1.0), ("d", 9.0)], "region string, v double")
    got = {r.region: r.v_rank for r in ranking.metric_ranks(df, ["v"]).collect()}
    assert got == {"d": 1.0, "a": 2.5, "b": 2.5, "c": 4.0}
    assert sum(got.values()) == 10


def test_folds_never_train_on_the_future(spark):
    df = series(spark, [float(i) for i in range(23)])
    folds = windows.rolling_origin_folds(df, ["region"], 5).groupBy("fold", "role").agg(
        F.min("position").alias("a"), F.max("position").alias("b")
    )
    spans = {(r.fold, r.role): (r.a, r.b) for r in folds.collect()}
    for k in range(1, 6):
        assert spans[(k, "train")][0] == 0 and spans[(k, "train")][1] + 1 == spans[(k, "test")][0]
    assert spans[(5, "test")][1] == 22


def test_splits_cover_every_row(spark):
    df = series(spark, [1.0] * 101)
    three = {r.split: r["count"] for r in windows.chronological_split(df, ["region"], 0.7, 0.15).groupBy("split").count().collect()}
    assert three == {"train": 70, "validation": 15, "test": 16}
    first = windows.hash_split(df, ["region", "date"]).select("date", "split").collect()
    second = windows.hash_split(df.repartition(3), ["region", "date"]).select("date", "split").collect()
    assert sorted(first) == sorted(second)


def test_constant_series_scales_and_anomalies(spark):
    df = series(spark, [4.0] * 30)
    assert windows.iqr_anomalies(df, ["region"], "value").count() == 0
    assert windows.peaks_valleys(df, ["region"], "value").count() == 0
    sized = insights.size_scale(df, "value").select("marker_size").distinct().collect()
    assert [r[0] for r in sized] == [15.0]


def test_fingerprint_sees_repeated_rows(spark):
    df = fact(spark)
    once, twice = registry.data_fingerprint(df).first(), registry.data_fingerprint(df.union(df)).first()
    assert once.data_hash != twice.data_hash and twice.data_size == 2 * once.data_size
    changed = registry.data_fingerprint(df.withColumn("users_active", F.col("users_active") + 1)).first()
    assert changed.data_hash != once.data_hash


LOG = "check_date date, data_hash string, data_size bigint, new_records bigint, training_triggered boolean"


@pytest.mark.parametrize(
    "log, force, expected",
    [
        ([], False, (100, 100.0, True)),
        ([(DAY0, "old", 90, 0, True)], False, (10, 100 / 9, True)),
        ([(DAY0, "old", 99, 0, True)], False, (1, 100 / 99, False)),
        ([(DAY0, "old", 99, 0, True)], True, (1, 100 / 99, True)),
        ([(DAY0, "same", 50, 0, True)], False, (50, 100.0, False)),
        ([(DAY0, "old", 0, 0, True)], False, (99, 9900.0, True)),
    ],
)
def test_change_detection(spark, log, force, expected):
    now = spark.createDataFrame([("same", 100)], "data_hash string, data_size bigint")
    row = registry.check_changes(now, spark.createDataFrame(log, LOG), force=force).first()
    assert (row.new_records, row.training_triggered) == (expected[0], expected[2])
    assert row.percent_change == pytest.approx(expected[1])


BEST = "region string, metric_type string, model_type string, rmse double, mae double, mape double, updated_date date"


def test_upsert_takes_equal_rmse_and_new_series(spark):
    old = spark.createDataFrame([("A", "cpu", "x", 5.0, 1.0, 1.0, DAY0), ("B", "cpu", "x", 5.0, 1.0, 1.0, DAY0)], BEST)
    new = spark.createDataFrame(
        [("A", "cpu", "y", 5.0, 2.0, 2.0, D(2024, 2, 1)), ("B", "cpu", "y", 5.1, 2.0, 2.0, D(2024, 2, 1)), ("C", "cpu", "y", 9.0, 2.0, 2.0, D(2024, 2, 1))],
        BEST,
    )
    got = {r.region: r.model_type for r in registry.upsert_best_model(old, new).collect()}
    assert got == {"A": "y", "B": "x", "C": "y"}
    empty = spark.createDataFrame([], BEST)
    assert registry.upsert_best_model(empty, new).count() == 3


def test_failed_models_never_win(spark):
    rows = [("A", "cpu", "x", float("inf")), ("A", "cpu", "y", float("nan")), ("A", "cpu", "z", 4.0), ("B", "cpu", "x", None)]
    scores = spark.createDataFrame(rows, "region string, metric_type string, model_type string, rmse double")
    assert [(r.region, r.model_type) for r in evaluation.select_best(scores).collect()] == [("A", "z")]


def test_error_metrics_survive_zero_actuals(spark):
    df = spark.createDataFrame([("A", 0.0, 1.0), ("A", 10.0, 8.0)], "region string, actual_value double, predicted_value double")
    r = evaluation.error_metrics(df, ["region"]).first()
    assert r.mape == pytest.approx(20) and r.mse == pytest.approx(2.5) and r.mae == pytest.approx(1.5)
    assert r.r2 == pytest.approx(1 - 2.5 / 25)


@pytest.mark.parametrize("horizon, cpu, users", [(0, 1, 7), (1, 1, 7), (30, 30, 30), (91, 90, 90)])
def test_horizon_limits(horizon, cpu, users):
    assert forecasting.clamp_horizon("cpu", horizon) == cpu
    assert forecasting.clamp_horizon("users", horizon) == users


def test_baselines(spark):
    s = series(spark, [float(i) for i in range(1, 15)]).withColumn("metric_type", F.lit("cpu"))
    naive = forecasting.seasonal_naive(s, 9)
    assert values(naive, "predicted", "step") == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0, 8.0, 9.0]
    assert naive.agg(F.min("date")).first()[0] == D(2024, 1, 15)
    assert values(forecasting.drift_forecast(s, 2), "predicted", "step") == pytest.approx([15.0, 16.0])


PLAN = "region string, service string, current_capacity double, max_demand double, avg_demand double, days bigint"


@pytest.mark.parametrize(
    "peak, avg, risk, kinds",
    [
        (96.0, 50.0, "HIGH", ["SCALE_UP"]),
        (90.0, 50.0, "MEDIUM", ["SCALE_UP"]),
        (80.0, 50.0, "MEDIUM", ["MONITOR"]),
        (70.0, 50.0, "LOW", ["MONITOR"]),
        (60.0, 20.0, "MEDIUM", ["OPTIMIZE"]),
        (97.0, 25.0, "HIGH", ["OPTIMIZE", "SCALE_UP"]),
    ],
)
def test_risk_and_recommendations(spark, peak, avg, risk, kinds):
    plan = spark.createDataFrame([("A", "Compute", 1000.0, peak * 10, avg * 10, 30)], PLAN)
    plan = plan.withColumns({"peak_pct": F.col("max_demand") / 10, "avg_pct": F.col("avg_demand") / 10})
    plan = capacity.overall_risk(capacity.provision_risk(capacity.utilization_risk(plan)))
    assert plan.first().overall_risk == risk
    assert sorted(r.type for r in capacity.recommendations(plan).collect()) == kinds


def test_regions_without_history_get_static_capacity(spark):
    rd = aggregates.region_daily(fact(spark))
    regions = spark.createDataFrame([("A",), ("East US",), ("Mars",)], "region string")
    got = {(r.region, r.service): r.current_capacity for r in capacity.current_capacity(rd, regions).collect()}
    assert got[("East US", "Storage")] == 50000.0 and got[("Mars", "Users")] == 10000.0
    assert got[("A", "Storage")] >= 1000.0


def test_health_and_retraining(spark):
    rows = [("A", 90.0, "stable"), ("B", 75.0, "declining"), ("C", 65.0, "stable")]
    acc = spark.createDataFrame(rows, "region string, accuracy double, trend string")
    h = monitoring.health_summary(acc).first()
    assert (h.healthy_models, h.warning_models, h.critical_models, h.overall_status) == (1, 1, 1, "WARNING")
    assert {(r.region, r.priority) for r in monitoring.retrain_list(acc).collect()} == {("B", "MEDIUM"), ("C", "HIGH")}
    assert monitoring.health_summary(acc.limit(0)).first().overall_status == "UNKNOWN"


def test_csv_and_dataset_round_trip(spark, tmp_path):
    df = fact(spark)
    writers.export_csv(df, str(tmp_path / "csv"))
    back = readers.read_usage(spark, str(tmp_path / "csv"), "csv")
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    writers.write_dataset(df, str(tmp_path / "table"))
    pruned = spark.read.parquet(str(tmp_path / "table")).filter(F.col("region") == "A")
    assert "PartitionFilters: [isnotnull(region" in pruned._jdf.queryExecution().toString()
    assert pruned.count() == df.filter(F.col("region") == "A").count()


def test_unknown_registry_table(spark):
    with pytest.raises(ValueError):
        readers.read_registry(spark, "nothing", "/nowhere")
