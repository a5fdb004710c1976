"""Structured Streaming forms of the daily aggregates, change checks and alerts.

Each job reads event files as a stream and keeps its state bounded by a watermark or by
the number of keys. The caller names the folder of a job's output and checkpoint, so a
restarted job continues where it stopped and writes no row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digest
from ..functions.columns import ladder, ratio

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """An event file, or a folder of part files, as a stream; the declared schema avoids an inference pass."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def event_time(c: str = "ts") -> Column:
    """Wall-clock time as the instant of the same clock in UTC.

    Watermarks need an instant; this one does not move with the session time zone.
    """
    return F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())


def wall_date(c: str) -> Column:
    """The wall-clock date of such an instant."""
    return F.to_utc_timestamp(c, F.current_timezone()).cast("date")


def run_append(df: DataFrame, folder: str) -> DataFrame:
    """Process everything available, append finished rows to ``folder``, and read all of it back."""
    stream = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/data")


def run_batches(df: DataFrame, folder: str, handle: Callable[[DataFrame, int, str], None], mode: str) -> str:
    """Process everything available batch by batch; returns the folder of the results."""
    stream = (
        df.writeStream.foreachBatch(lambda batch, number: handle(batch, number, f"{folder}/data"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return f"{folder}/data"


def run_updates(df: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Process everything available and return the newest row of each key, open windows included.

    A batch writes its changed rows to a partition of its own and replaces it when repeated. Update mode needs no
    watermark, and one would drop the rows of late files: a windowed stream runs in its form without.
    """
    df = getattr(df, "without_watermark", df)

    def handle(batch: DataFrame, number: int, path: str) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    path = run_batches(df, folder, handle, "update")
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    updates = df.sparkSession.read.schema(schema).parquet(path)
    newest = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("s")
    return updates.groupBy(*keys).agg(newest).select(*keys, "s.*")


def _measures() -> list[Column]:
    return [
        F.count("*").alias("events"),
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    ]


def _windowed(events: DataFrame, watermark: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The windows of ``build`` over the stream with a watermark, and as ``without_watermark`` without one.

    In append mode the watermark closes windows, and rows behind it are dropped: for input in order of time.
    Without it nothing is dropped and the state holds a row per window and key. ``windows.run_windows`` does
    both: it closes windows and keeps late rows.
    """
    timed = events.withColumn("ts", event_time())
    closing = build(timed.withWatermark("ts", watermark))
    closing.without_watermark = build(timed)
    return closing


def stream_daily(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling one-day aggregate per event type, emitted when the day is closed."""
    columns = ["event_type", "events", "avg_value", "min_value", "max_value"]
    return _windowed(
        events,
        watermark,
        lambda timed: timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
        .agg(*_measures())
        .select(wall_date("w.start").alias("date"), *columns),
    )


def stream_rolling(events: DataFrame, days: int = 7, watermark: str = "1 day") -> DataFrame:
    """Sliding mean over ``days`` days, one window per day and event type."""
    return _windowed(
        events,
        watermark,
        lambda timed: timed.groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.avg("value").alias("avg_value"))
        .select(wall_date("w.end").alias("window_end"), "event_type", "events", "avg_value"),
    )


def daily_alerts(daily: DataFrame, high: float, low: float) -> DataFrame:
    """Days, of a table or a stream, whose mean value leaves the band between ``low`` and ``high``."""
    a = F.col("avg_value")
    return daily.withColumn("alert", ladder([(a > high, "HIGH"), (a < low, "LOW")], None)).filter(
        F.col("alert").isNotNull()
    )


MONITORING = f"batch bigint, data_hash string, {digest.PARTS_SCHEMA}, new_records bigint, training_triggered boolean"


def change_monitor(threshold: float = 5.0) -> Callable[[DataFrame, int, str], None]:
    """Batch handler that logs the content hash, rows, growth since the last batch, and a training flag.

    A batch reads its own rows and the newest log row, whose digest it extends. It writes its own partition and
    replaces it when repeated after a failure. The first check trains; later ones if enough was added.
    """

    def handle(batch: DataFrame, number: int, path: str) -> None:
        spark = batch.sparkSession
        new = digest.digest(batch).first()
        last = None
        if number > 0:
            log = spark.read.schema(MONITORING).parquet(path).filter(F.col("batch") < number)
            last = log.agg(F.max_by(F.struct(*digest.PARTS), "batch")).first()[0]
        size, total, mixed = digest.extended(last, new)
        grown = last is None or 100 * new.data_size >= threshold * last.data_size
        row = (f"{size}:{total}:{mixed}", size, total, mixed, new.data_size, grown)
        schema = T.StructType(T._parse_datatype_string(MONITORING).fields[1:])
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def stream_change_monitor(events: DataFrame, folder: str, threshold: float = 5.0) -> DataFrame:
    """Process everything available and return one check per batch, as the data arrived."""
    path = run_batches(events, folder, change_monitor(threshold), "append")
    return events.sparkSession.read.schema(MONITORING).parquet(path)


DIGESTS = f"batch bigint, date date, {digest.PARTS_SCHEMA}"


def content_digests(batch: DataFrame, number: int, path: str) -> None:
    """Batch handler that keeps the digest of each event date's new rows, in a partition of the batch's own."""
    digest.digest(batch, {"date": F.col("ts").cast("date")}).write.mode("overwrite").parquet(f"{path}/batch={number}")


def stream_content_checks(events: DataFrame, folder: str, threshold: float = 5.0) -> DataFrame:
    """Process everything available and return one check per event date, whatever the batches were.

    The digests of the dates are merged in order; one row per date is ordered.
    """
    path = run_batches(events, folder, content_digests, "append")
    parts = events.sparkSession.read.schema(DIGESTS).parquet(path).drop("batch")
    days = digest.merged(parts, ["date"]).withColumn("new_records", F.col("data_size"))
    running = days.select("date", "new_records", *digest.combined(Window.orderBy("date")))
    growth = ratio(F.col("new_records") * 100, F.col("data_size") - F.col("new_records"))
    return running.select(
        "date", digest.named(running).alias("data_hash"), "data_size", "new_records",
        F.coalesce(growth >= threshold, F.lit(True)).alias("training_triggered"),
    )


def last_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest value and running count, minimum and maximum per key.

    Built-in aggregates combine on the map side before the state is touched, so a key
    that receives a third of the events still costs its state task one row per mapper.
    """
    return events.groupBy(*keys).agg(
        F.max("ts").alias("last_ts"),
        F.max_by("value", F.struct("ts", "event_id")).alias("last_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("*").alias("events"),
    )


def stream_last_state(events: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The state after all available events: the newest update of each key."""
    return run_updates(last_state(events, keys), folder, keys)
