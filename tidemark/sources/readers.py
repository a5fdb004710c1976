"""Typed scans: usage fact, external factors, registry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import EXTERNAL, REGISTRY, USAGE


def _scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def read_usage(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan the usage fact with its declared schema; no inference pass."""
    return _scan(spark, path, USAGE, fmt)


def read_external(
    spark: SparkSession, path: str, fmt: str = "csv", date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Scan the daily factors; text dates that do not parse become null."""
    raw = T.StructType([T.StructField("date", T.StringType())] + EXTERNAL.fields[1:])
    schema = raw if fmt == "csv" else EXTERNAL
    df = _scan(spark, path, schema, fmt)
    if fmt == "csv":
        df = df.withColumn("date", F.to_date(F.try_to_timestamp("date", F.lit(date_format))))
    return df


def with_calendar(df: DataFrame) -> DataFrame:
    """Month, quarter and weekend flag derived at load."""
    return df.withColumns(
        {
            "month": F.month("date"),
            "quarter": F.quarter("date"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
        }
    )


def read_registry(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan one registry table and expose it to SQL under its own name."""
    if table not in REGISTRY:
        raise ValueError(f"unknown registry table {table!r}; known: {sorted(REGISTRY)}")
    df = spark.read.schema(REGISTRY[table]).parquet(path)
    df.createOrReplaceTempView(table)
    return df


def raw_records(df: DataFrame, as_json: bool = False) -> DataFrame:
    """Every row of the fact, as columns or as one JSON record per row."""
    if as_json:
        return df.select(F.to_json(F.struct("*")).alias("record"))
    return df.select("*")
