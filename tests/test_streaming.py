"""Streams give the rows of the batch form, and repeated batches add nothing."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import digest
from tidemark.operators import registry
from tidemark.session import scratch_path
from tidemark.streaming import jobs, keyed_state, windows

T0 = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def landed(spark):
    rows = [
        (i, T0 + datetime.timedelta(hours=i), i % 5, "hot" if i % 3 else "cold", float(i % 17), "{}")
        for i in range(24 * 12)
    ]
    df = spark.createDataFrame(rows, jobs.EVENTS)
    path = scratch_path(spark, "test-events")
    df.repartitionByRange(4, "ts").write.parquet(path)
    return df, path


def test_daily_equals_batch(spark, landed):
    df, path = landed
    stream = jobs.run_append(jobs.stream_daily(jobs.read_events(spark, path)), scratch_path(spark, "test-daily"))
    batch = df.groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(
        F.count("*").alias("events"), F.avg("value").alias("avg_value")
    )
    closed = batch.filter(F.col("date") <= datetime.date(2024, 3, 10))
    got = stream.select("date", "event_type", "events", "avg_value")
    assert got.exceptAll(closed).count() == 0 and closed.exceptAll(got).count() == 0


def test_event_time_ignores_the_session_zone(spark, landed):
    _, path = landed
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        stream = jobs.run_append(jobs.stream_daily(jobs.read_events(spark, path)), scratch_path(spark, "test-zone"))
        assert stream.groupBy("date").agg(F.sum("events").alias("n")).filter("n <> 24").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_last_state_equals_batch(spark, landed):
    df, path = landed
    events = jobs.read_events(spark, path, files_per_batch=1)
    got = jobs.stream_last_state(events, scratch_path(spark, "test-state"), ["event_type"])
    want = jobs.last_state(df, ["event_type"])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_change_monitor_counts_every_row_once(spark, landed):
    df, path = landed
    log = jobs.stream_change_monitor(
        jobs.read_events(spark, path, files_per_batch=1), scratch_path(spark, "test-changes")
    )
    rows = log.orderBy("batch").collect()
    assert sum(r.new_records for r in rows) == df.count() == rows[-1].data_size
    assert rows[0].training_triggered


def test_repeated_batch_replaces_itself(spark, landed):
    df, _ = landed
    path = scratch_path(spark, "test-monitor")
    handle = jobs.change_monitor()
    handle(df, 0, path)
    handle(df.limit(7), 1, path)
    handle(df.limit(7), 1, path)
    log = spark.read.schema(jobs.MONITORING).parquet(path)
    assert log.count() == 2 and log.agg(F.max("data_size")).first()[0] == df.count() + 7


def test_content_checks_by_date(spark, landed):
    df, path = landed
    folder = scratch_path(spark, "test-content")
    rows = jobs.stream_content_checks(jobs.read_events(spark, path, files_per_batch=1), folder).orderBy("date").collect()
    by_batch = jobs.stream_change_monitor(jobs.read_events(spark, path, files_per_batch=1), scratch_path(spark, "test-log")).orderBy("batch").collect()
    assert sum(r.new_records for r in rows) == df.count() == rows[-1].data_size and len(rows) == 12
    assert rows[0].training_triggered
    assert rows[-1].data_hash == by_batch[-1].data_hash == registry.data_fingerprint(df).first()["data_hash"]


def test_repeated_rows_change_the_hash_and_few_do_not_train(spark, landed):
    df, _ = landed
    path = scratch_path(spark, "test-repeats")
    for number, part in ((0, df), (1, df.limit(7)), (2, df.limit(0)), (2, df.limit(0))):
        jobs.change_monitor()(part, number, path)
    rows = spark.read.schema(jobs.MONITORING).parquet(path).orderBy("batch").collect()
    assert len({r.data_hash for r in rows}) == 2 and rows[1].data_hash == rows[2].data_hash
    assert [r.training_triggered for r in rows] == [True, False, False]


def test_a_changed_value_is_seen_beside_equal_sums(spark):
    a, b = ("a", 1.5, 10), ("b", 2.5, 20)
    table = lambda *rows: spark.createDataFrame(rows, "region string, usage_cpu double, users_active int")
    hash_of = lambda df: registry.data_fingerprint(df).first()["data_hash"]
    whole = hash_of(table(a, b))
    assert whole == hash_of(table(b, a)) != hash_of(table(("a", 1.6, 10), b))
    assert len({whole, hash_of(table(a, b, b, b)), hash_of(table(a)), hash_of(table()), hash_of(table(("a", None, 10), b))}) == 5
    parts = digest.digest(table(a)).union(digest.digest(table(b))).union(digest.digest(table()))
    assert registry.fingerprint_of(parts).first()["data_hash"] == whole


def batch_windows(df, days):
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub(F.col("ts").cast("date"), k)))
    return df.withColumn("first_date", starts).groupBy("event_type", "first_date").agg(
        F.count("*").alias("events"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


@pytest.mark.parametrize("order", ["dates", "reverse", "mixed"])
@pytest.mark.parametrize("days", [1, 7])
def test_windows_keep_rows_of_late_files(spark, landed, order, days):
    """One file a batch, in any order of files: the windows of the batch form, and late rows counted."""
    df, _ = landed
    source, folder = scratch_path(spark, "test-late"), scratch_path(spark, "test-windows")
    day = F.dayofyear("ts") - F.dayofyear(F.lit(T0))
    parts = [df.filter(F.floor(day / 3) == k).coalesce(1) for k in {"dates": [0, 1, 2, 3], "reverse": [3, 2, 1, 0], "mixed": [1, 3, 0, 2]}[order]]
    for part in parts:  # files are read by the time they were written
        part.write.mode("append").parquet(source)
        time.sleep(1.1)
    # Two runs, and a merged partition every second batch.
    found = windows.run_windows(jobs.read_events(spark, source, files_per_batch=1), folder, ["event_type"], days, compact_every=2)
    found = windows.run_windows(jobs.read_events(spark, source, files_per_batch=1), folder, ["event_type"], days, compact_every=2)
    columns = ["event_type", "first_date", "events", "avg_value", "min_value", "max_value"]
    assert sorted(found.windows.select(columns).collect()) == sorted(batch_windows(df, days).select(columns).collect())
    summary = windows.late_summary(found.progress).first()
    late = {"dates": 0, "reverse": 3 * 72, "mixed": 2 * 72}[order]
    assert (summary.batches, summary.rows, summary.late_rows, summary.undated_rows) == (4, df.count(), late, 0)
    assert found.late_rows.count() == late
    if days == 1:
        assert found.windows.agg(F.sum("late_events")).first()[0] == late
        assert found.windows.filter("closed").agg(F.max("first_date")).first()[0] == datetime.date(2024, 3, 10)


def test_repeated_window_batches_and_rows_without_time(spark, landed):
    df, _ = landed
    folder = scratch_path(spark, "test-repeat")
    schema = spark.createDataFrame([], "event_type string, " + windows.PARTIAL).schema
    handle = windows.late_aware(["event_type"], schema, "1 day", 2)
    undated = df.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    early = df.filter(F.col("ts") < F.lit(T0 + datetime.timedelta(days=2)))
    for number, part in ((0, df), (1, early), (1, early), (2, undated), (2, undated)):
        handle(part, number, f"{folder}/data")
    progress = windows.read_progress(spark, folder)
    summary = windows.late_summary(progress).first()
    assert (summary.batches, summary.late_rows, summary.undated_rows) == (3, early.count(), 3)
    base = spark.read.parquet(f"{folder}/partials/batch=2")  # merged: every second batch
    assert base.agg(F.sum("events")).first()[0] == df.count() + early.count()


@pytest.mark.parametrize("ttl", [datetime.timedelta(days=1), datetime.timedelta(milliseconds=1)])
def test_keyed_state_over_several_runs(spark, landed, ttl):
    """Split keys, state that expires at once or not: the batch aggregate after every run."""
    df, _ = landed
    source, folder = scratch_path(spark, "test-keyed"), scratch_path(spark, "test-keyed-out")
    day = F.dayofyear("ts") - F.dayofyear(F.lit(T0))
    seen = []
    for k in (2, 0, 1):  # the key "cold" and nulls return after their state went
        part = df.filter(F.floor(day / 4) == k).coalesce(1)
        part.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))).write.mode("append").parquet(source)
        seen.append(k)
        found = keyed_state.run_keyed_state(jobs.read_events(spark, source), folder, "event_type", ttl, salts=3)
        want = jobs.last_state(spark.read.schema(jobs.EVENTS).parquet(source), ["event_type"])
        assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
        time.sleep(0.1)
    log = spark.read.parquet(f"{folder}/data")
    assert log.select("salt").distinct().count() == 3
    generations = log.groupBy("event_type", "salt").agg(F.countDistinct("born").alias("n")).agg(F.max("n")).first()[0]
    assert generations == (3 if ttl < datetime.timedelta(days=1) else 1)


def test_alerts_name_their_side(spark, landed):
    _, path = landed
    alerts = jobs.daily_alerts(jobs.stream_daily(jobs.read_events(spark, path)), high=8.5, low=7.5)
    rows = jobs.run_append(alerts, scratch_path(spark, "test-alerts")).collect()
    assert all((r.avg_value > 8.5) == (r.alert == "HIGH") for r in rows)


def test_updates_hold_open_windows_too(spark, landed):
    df, path = landed
    daily = jobs.stream_daily(jobs.read_events(spark, path, files_per_batch=1))
    found = jobs.run_updates(daily, scratch_path(spark, "test-updates"), ["date", "event_type"])
    assert found.count() == df.select(F.col("ts").cast("date"), "event_type").distinct().count()
    assert found.agg(F.sum("events")).first()[0] == df.count()


def test_both_layouts_read_the_same(spark, landed, tmp_path):
    df, path = landed
    one = df.toPandas()
    one.to_parquet(tmp_path / "events.parquet", index=False, coerce_timestamps="us")
    counts = []
    for place in (f"{tmp_path}/events.parquet", path):
        state = jobs.stream_last_state(jobs.read_events(spark, place), scratch_path(spark, "test-layout"), ["event_type"])
        counts.append(sorted(map(tuple, state.select("event_type", "events").collect())))
    assert counts[0] == counts[1] and sum(n for _, n in counts[0]) == df.count()


def test_restarted_job_continues(spark, landed):
    df, _ = landed
    source, out = scratch_path(spark, "test-source"), scratch_path(spark, "test-restart")
    whole = scratch_path(spark, "test-whole")
    early = F.col("ts") < F.lit(T0 + datetime.timedelta(days=5))
    df.filter(early).write.mode("append").parquet(source)
    run = lambda folder: jobs.run_append(jobs.stream_daily(jobs.read_events(spark, source)), folder)
    first = run(out).count()
    assert run(out).count() == first
    df.filter(~early).write.mode("append").parquet(source)
    again = run(out).select("date", "event_type", "events")
    once = run(whole).select("date", "event_type", "events")
    assert again.count() > first and again.exceptAll(once).count() == 0 and once.exceptAll(again).count() == 0
    log = lambda: jobs.stream_change_monitor(jobs.read_events(spark, source), f"{whole}-log")
    assert log().count() == log().count() == 1
