"""Last state per key with state that expires and keys that are split.

Each key is split by a salt over the event's id, so a key that receives a third of the events is held by
several state tasks. A task keeps one row of state per (key, salt): the last value, minimum, maximum and count
since the state was born. State that saw no event for the time to live goes; when the key returns, a new
generation is born. Every batch writes the rows of the states it touched to a partition of its own. The result
merges in two levels: the newest row of each (key, salt, generation), then all of these by key. So it equals the
batch aggregate over all events although idle state is gone.

Expiry goes by processing time. Event-time timers need a watermark, and rows behind it would be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import run_batches

SETTINGS = {
    # The only provider that holds this kind of state.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State that may expire asks for another batch after every batch, so a run to the end would have none.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
STATE = "born long, last_ts timestamp_ntz, last_id long, last_value double, min_value double, max_value double, events long"
SALTS = 16


class LastState(StatefulProcessor):
    """State of one (key, salt); emits it after every batch that touches it."""

    def __init__(self, key: str, ttl: timedelta):
        self.key, self.ttl_ms = key, int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        born, last, low, high, events = timerValues.getCurrentProcessingTimeInMs(), None, None, None, 0
        if self.state.exists():
            born, ts, last_id, value, low, high, events = self.state.get()
            last = (ts, last_id, value)
        for part in rows:
            events += len(part)
            values = part["value"].dropna()
            if len(values):
                low = float(values.min()) if low is None else min(low, float(values.min()))
                high = float(values.max()) if high is None else max(high, float(values.max()))
            dated = part[part["ts"].notna()]
            if len(dated):
                newest = dated.sort_values(["ts", "event_id"]).iloc[-1]
                value = None if pd.isna(newest["value"]) else float(newest["value"])
                found = (newest["ts"].to_pydatetime(), int(newest["event_id"]), value)
                last = found if last is None or found[:2] > last[:2] else last
        ts, last_id, value = last or (None, None, None)
        self.state.update((born, ts, last_id, value, low, high, events))
        row = {self.key: [key[0]], "salt": [key[1]], "born": [born], "last_ts": [ts], "last_id": [last_id],
               "last_value": [value], "min_value": [low], "max_value": [high], "events": [events]}
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def keyed_states(events: DataFrame, key: str, ttl: timedelta, salts: int = SALTS) -> DataFrame:
    """Stream of the states per (key, salt) that a batch touched."""
    kind = events.schema[key].dataType.simpleString()
    salted = events.select(key, "ts", "event_id", "value", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"))
    return salted.groupBy(key, "salt").transformWithStateInPandas(
        statefulProcessor=LastState(key, ttl), outputStructType=f"{key} {kind}, salt int, {STATE}", outputMode="Update",
        timeMode="ProcessingTime",
    )


def run_keyed_state(events: DataFrame, folder: str, key: str, ttl: timedelta = timedelta(days=2), salts: int = SALTS) -> DataFrame:
    """Process everything available and return last_ts, last_value, min_value, max_value and events of each key.

    ``events`` has ts, event_id and value besides the key. A null key is a key of its own.
    """
    spark = events.sparkSession
    states = keyed_states(events, key, ttl, salts)

    def handle(batch: DataFrame, number: int, path: str) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _settings(spark, SETTINGS):
        path = run_batches(states, folder, handle, "update")
    written = spark.read.schema(T.StructType([*states.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    fields = ["last_ts", "last_id", "last_value", "min_value", "max_value", "events"]
    newest = written.groupBy(key, "salt", "born").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select(key, "s.*")
    return newest.groupBy(key).agg(
        F.max("last_ts").alias("last_ts"), F.max_by("last_value", F.struct("last_ts", "last_id")).alias("last_value"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("events").alias("events"),
    )
