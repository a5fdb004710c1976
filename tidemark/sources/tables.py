"""The usage fact and its companions, derived from the given star-schema tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, evaluation, joins, models
from ..session import Kept, materialize, once, stamp
from . import readers


class Tables:
    """DataFrames over one data folder.

    They are lazy but for the regional daily series and the score log. These hold one row
    per region and day, or per model and quarter; they are written once and feed every
    operator that would otherwise scan the fact several times.
    """

    #: Points of the tree models' grid, if not their own.
    grid: list[tuple[int, int, float]] | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def usage(self) -> DataFrame:
        """One row per shipped line: date, region, resource type and three metrics.

        Customers meet their nation's region first (25 and 5 rows by definition of the
        schema), then orders their customer, so the largest table takes part in a single
        shuffle join, on the order key, and no large side is ever spread by nation.
        """
        regions = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("r_name").alias("region"))
        )
        customers = (
            self.table("customer")
            .join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "region")
        )
        orders = (
            self.table("orders")
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "o_orderkey",
                "region",
                (F.lit(200) + F.col("o_custkey") % 300).cast("int").alias("users_active"),
            )
        )
        return (
            self.table("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_shipdate").cast("date").alias("date"),
                "region",
                F.when(F.col("l_returnflag") == "A", "VM")
                .when(F.col("l_returnflag") == "N", "Storage")
                .otherwise("Container")
                .alias("resource_type"),
                (F.col("l_quantity") * 2).alias("usage_cpu"),
                (F.col("l_extendedprice") / 50).alias("usage_storage"),
                "users_active",
            )
        )

    @cached_property
    def external(self) -> DataFrame:
        """One row of external factors per order date."""
        day = F.col("o_orderdate").cast("date")
        return (
            self.table("orders")
            .groupBy(day.alias("date"))
            .agg(
                (F.avg("o_totalprice") / 2500).alias("economic_index"),
                (F.count("*") / F.lit(6.0)).alias("cloud_market_demand"),
            )
            .withColumn("holiday", (F.weekday("date") >= 5).cast("int"))
        )

    @cached_property
    def merged(self) -> DataFrame:
        """Usage with the external factors of its date; days without factors stay null."""
        return joins.merge_external(self.usage, self.external)

    @cached_property
    def fact(self) -> DataFrame:
        """Merged fact with unknown holidays counted as regular days, plus calendar columns."""
        filled = self.merged.withColumn("holiday", F.coalesce("holiday", F.lit(0)))
        return readers.with_calendar(filled)

    @cached_property
    def region_daily(self) -> DataFrame:
        return aggregates.region_daily(self.fact, users_agg="sum")

    @cached_property
    def region_daily_mean(self) -> DataFrame:
        return aggregates.region_daily(self.fact, users_agg="mean")

    @cached_property
    def daily_series(self) -> DataFrame:
        return materialize(self.region_daily, "region-daily")

    @cached_property
    def daily_series_mean(self) -> DataFrame:
        """What the models of single metrics learn, written once for the data."""
        return self.kept("trained").table("region-daily-mean", lambda: self.region_daily_mean)

    def kept(self, *name) -> Kept:
        """Results kept for ``name``, the code, and the usage tables as they are."""
        tables = [f"{self.folder}/{table}.parquet" for table in ("lineitem", "orders", "customer", "nation", "region")]
        return Kept(self.spark, (*name, self.grid, stamp(self.spark, tables)))

    def trained(self, metric: str, series: str = "daily_series") -> dict:
        """The three model families of a metric, fitted once for the data."""
        kept = self.kept("trained", series)
        return once(self.spark, (kept.folder, metric), lambda: models.train_all(getattr(self, series), metric, self.grid, kept))

    @cached_property
    def daily(self) -> DataFrame:
        """Daily means of the five numeric columns over all regions."""
        return aggregates.daily_means(self.fact)

    @cached_property
    def predictions(self) -> DataFrame:
        """One-step predictions of the baseline models against the actual values."""
        return evaluation.baseline_predictions(self.daily_series)

    @cached_property
    def registry(self) -> DataFrame:
        """Model performance log: every baseline scored once per calendar quarter."""
        return materialize(evaluation.quarterly_scores(self.predictions), "model-performance")

    @cached_property
    def monitoring(self) -> DataFrame:
        """Data checks: one per calendar month over the rows known by then."""
        return evaluation.monthly_checks(self.usage)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")
