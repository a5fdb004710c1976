"""Sinks: datasets, report documents, CSV and JSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_dataset(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ("region",)
) -> None:
    """Write a dataset partitioned by ``partition_by``.

    No repartition by the key: one region may hold a third of the rows, so each
    task writes its own files per partition value instead of one task per region.
    """
    writer = df.write.format(fmt).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def nested_report(df: DataFrame, key: Column | str, section: str) -> DataFrame:
    """One document per ``key`` with the remaining columns as an array of structs."""
    name = key if isinstance(key, str) else "key"
    rest = [c for c in df.columns if c != name]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(section))


def write_report_json(df: DataFrame, path: str) -> None:
    """Write report documents, one JSON object per line."""
    df.write.json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as many part files as the data has partitions."""
    df.write.option("header", True).csv(path)


def export_insights_json(df: DataFrame, path: str) -> None:
    """Insight rows as JSON text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
