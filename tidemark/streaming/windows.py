"""Windowed aggregates of a stream that keep late rows.

A stateful aggregate drops the rows of windows that its watermark has closed, and files arrive in any
order. Here every micro-batch is reduced to mergeable partial aggregates of one time unit (count, sum,
minimum, maximum), written to a partition of the batch's own. The committed watermark is the largest event time
of all earlier batches less a delay; rows of units that end at or before it are late. They go to a side table as
they are, are counted, and are folded into their closed windows like any other row. So the merged windows equal
the batch aggregate whatever the order of files, and the side table says what a window's first result lacked.

A batch reads only its own rows and the small progress log of earlier batches, and replaces its partitions when
it is repeated, so a restarted job continues where it stopped. Every ``compact_every`` batches the partials are
merged into one partition, which bounds what the next reader opens by the number of windows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jobs import run_batches

PROGRESS = "batch long, newest timestamp_ntz, watermark timestamp_ntz, rows long, late_rows long, undated_rows long, is_base boolean"
PARTIAL = "unit date, events long, known long, total double, low double, high double, late_events long"


class Windows(NamedTuple):
    """``closed`` tells whether a window's end lies behind the watermark; ``late_rows`` holds rows as they came."""

    windows: DataFrame
    late_rows: DataFrame
    progress: DataFrame


def _merged(partials: DataFrame, by: list[str]) -> DataFrame:
    return partials.groupBy(*by).agg(
        F.sum("events").alias("events"), F.sum("known").alias("known"), F.sum("total").alias("total"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sum("late_events").alias("late_events"),
    )


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """One row per finished batch."""
    return spark.read.schema(PROGRESS).parquet(f"{folder}/progress")


def _partials(spark: SparkSession, folder: str, schema: T.StructType, base: int | None) -> DataFrame:
    """The partials of the newest merged partition and of the batches behind it."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/partials")
    return (rows if base is None else rows.filter(F.col("batch") >= base)).drop("batch")


def late_aware(keys: list[str], schema: T.StructType, delay: str, compact_every: int):
    """Batch handler that writes the batch's partials, late rows and progress."""

    def handle(batch: DataFrame, number: int, path: str) -> None:
        spark, folder = batch.sparkSession, path.rsplit("/", 1)[0]
        newest, base = None, None
        if number > 0:
            known = read_progress(spark, folder).filter(F.col("batch") < number)
            newest, base = known.agg(F.max("newest"), F.max(F.when(F.col("is_base"), F.col("batch")))).first()
        watermark = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        unit = F.col("ts").cast("date")
        is_late = F.coalesce(F.date_add(unit, 1).cast("timestamp_ntz") <= watermark, F.lit(False))
        rows = batch.withColumns({"unit": unit, "late": is_late})
        rows.filter("late OR unit IS NULL").drop("unit", "late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        partials = (
            rows.filter("unit IS NOT NULL")
            .groupBy(*keys, "unit")
            .agg(
                F.count("*").alias("events"), F.count("value").alias("known"), F.sum("value").alias("total"),
                F.min("value").alias("low"), F.max("value").alias("high"), F.count_if("late").alias("late_events"),
            )
            .select(*schema.names)
        )
        is_base = number > 0 and number % compact_every == 0
        if is_base:
            earlier = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/partials")
            earlier = earlier.filter((F.col("batch") < number) & (F.col("batch") >= F.lit(base or 0))).drop("batch")
            partials = _merged(earlier.union(partials), [*keys, "unit"]).select(*schema.names)
        partials.write.mode("overwrite").parquet(f"{folder}/partials/batch={number}")
        rows.agg(
            F.greatest(F.max("ts"), F.lit(newest).cast("timestamp_ntz")).alias("newest"),
            F.count("*").alias("rows"), F.count_if("late").alias("late_rows"), F.count_if(F.col("unit").isNull()).alias("undated_rows"),
        ).select(
            "newest", watermark.alias("watermark"), "rows", "late_rows", "undated_rows", F.lit(is_base).alias("is_base")
        ).write.mode("overwrite").parquet(f"{folder}/progress/batch={number}")  # last: a batch counts once this is there

    return handle


def run_windows(
    events: DataFrame, folder: str, keys: list[str], days: int = 1, delay: str = "1 day", compact_every: int = 50
) -> Windows:
    """Process everything available of a stream with ``ts`` and ``value``; windows of ``days`` days, one a day, by ``keys``.

    ``windows`` has the keys, ``first_date``, ``last_date``, events, sum, mean, minimum and maximum of value, late_events
    and closed. Rows without a time are in no window; they stand in the side table and are counted as undated.
    """
    spark = events.sparkSession
    by_key = {f.name: f for f in events.schema.fields}
    schema = T.StructType([*[by_key[k] for k in keys], *T._parse_datatype_string(PARTIAL).fields])
    run_batches(events, folder, late_aware(keys, schema, delay, compact_every), "append")
    progress = read_progress(spark, folder)
    newest, base = progress.agg(F.max("newest"), F.max(F.when(F.col("is_base"), F.col("batch")))).first()
    partials = _partials(spark, folder, schema, base)
    starts = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_sub("unit", k))
    units = partials.withColumn("first_date", F.explode(starts)) if days > 1 else partials.withColumn("first_date", F.col("unit"))
    end = F.date_add("first_date", days)
    watermark = F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
    found = _merged(units, [*keys, "first_date"]).select(
        *keys, "first_date", F.date_add("first_date", days - 1).alias("last_date"), "events",
        F.col("total").alias("sum_value"), F.try_divide("total", "known").alias("avg_value"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"), "late_events",
        F.coalesce(end.cast("timestamp_ntz") <= watermark, F.lit(False)).alias("closed"),
    )
    late = spark.read.schema(T.StructType([*events.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/late")
    return Windows(found, late, progress)


def late_summary(progress: DataFrame) -> DataFrame:
    """Batches, rows, late and undated rows so far, and the watermark that the next batch would meet last."""
    return progress.agg(
        F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"),
        F.sum("undated_rows").alias("undated_rows"), F.max("watermark").alias("watermark"),
    )
