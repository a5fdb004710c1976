"""Window and time-series operators.

They work on daily series, one row per key and day, so a window partition is bounded
by the calendar (about 36,500 rows per century) however many usage rows lie behind it.
Row-level data is always aggregated by day before it reaches these functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col, ladder, ratio
from ..functions.order_stats import quantile_table
from ..session import materialize
from ..sources.schemas import METRICS
from .joins import calendar


def by_date(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def _latest(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.desc("date"))


def _full(agg: Column, counted: Column, spec: WindowSpec, n: int) -> Column:
    """Aggregate over a frame, null until the frame holds ``n`` known values."""
    return F.when(F.count(counted).over(spec) == n, agg.over(spec))


def last_n_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(_latest(keys))
    return df.withColumn("rn", rank).filter(F.col("rn") <= n).drop("rn")


def lag_features(df: DataFrame, keys: list[str], cols: list[str], lags: list[int]) -> DataFrame:
    w = by_date(keys)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def rolling_mean_partial(df: DataFrame, keys: list[str], cols: list[str], n: int = 7) -> DataFrame:
    w = by_date(keys).rowsBetween(1 - n, 0)
    return df.withColumns({f"{c}_roll{n}": F.avg(c).over(w) for c in cols})


def rolling(c: str, keys: list[str], n: int, fn=F.avg) -> Column:
    """Trailing aggregate over a full window of ``n`` rows."""
    return _full(fn(c), F.col(c), by_date(keys).rowsBetween(1 - n, 0), n)


def rolling_mean(df: DataFrame, keys: list[str], c: str, sizes: list[int]) -> DataFrame:
    return df.withColumns({f"{c}_mean{n}": rolling(c, keys, n) for n in sizes})


def rolling_std(df: DataFrame, keys: list[str], c: str, n: int = 7) -> DataFrame:
    return df.withColumn(f"{c}_std{n}", rolling(c, keys, n, F.stddev_samp))


def rolling_holiday_count(df: DataFrame, keys: list[str], n: int = 7) -> DataFrame:
    return df.withColumn(f"holiday_count{n}", rolling("holiday", keys, n, F.sum))


def centered(c: str, keys: list[str], n: int = 7) -> Column:
    half = n // 2
    return _full(F.avg(c), F.col(c), by_date(keys).rowsBetween(-half, half), n)


def centered_smooth(df: DataFrame, keys: list[str], c: str, n: int = 7) -> DataFrame:
    return df.withColumn(f"{c}_smooth", centered(c, keys, n))


def group_max_ratio(df: DataFrame) -> DataFrame:
    """Each row's CPU and storage against the maximum of its resource type.

    The maxima are written first: a handful of rows that Spark broadcasts by their
    known size, so the fact is not shuffled by its few resource types.
    """
    maxima = df.groupBy("resource_type").agg(
        F.max("usage_cpu").alias("max_cpu"), F.max("usage_storage").alias("max_storage")
    )
    joined = df.join(materialize(maxima, "resource-max"), "resource_type")
    return joined.withColumns(
        {
            "cpu_utilization": ratio("usage_cpu", "max_cpu"),
            "storage_efficiency": ratio("usage_storage", "max_storage"),
        }
    ).drop("max_cpu", "max_storage")


def time_idx(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("time_idx", F.row_number().over(by_date(keys)) - 1)


def recent_vs_first(df: DataFrame, keys: list[str], c: str, n: int = 7) -> DataFrame:
    """Mean of the last ``n`` days, of the first ``n``, and the daily slope between them."""
    ranked = df.withColumns(
        {
            "up": F.row_number().over(by_date(keys)),
            "down": F.row_number().over(_latest(keys)),
        }
    )
    return ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("down") <= n, F.col(c))).alias("recent_avg"),
        F.avg(F.when(F.col("up") <= n, F.col(c))).alias("first_avg"),
        F.max(F.when(F.col("down") == 1, F.col(c))).alias("current"),
        F.count("*").alias("days"),
    ).withColumn("trend_rate", (F.col("recent_avg") - F.col("first_avg")) / n)


def period_change(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Change from the first to the last day in percent; null for a single day."""
    ends = df.groupBy(*keys).agg(
        F.min_by(c, "date").alias("first_value"),
        F.max_by(c, "date").alias("last_value"),
        F.count("*").alias("days"),
    )
    change = ratio(F.col("last_value") - F.col("first_value"), "first_value") * 100
    return ends.withColumn("change_pct", F.when(F.col("days") > 1, change))


def momentum(df: DataFrame, keys: list[str], c: str, n: int = 7) -> DataFrame:
    """Mean of the last ``n`` days against the overall mean, classed at 10 percent."""
    ranked = df.withColumn("down", F.row_number().over(_latest(keys)))
    out = ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("down") <= n, F.col(c))).alias("recent_avg"),
        F.avg(c).alias("overall_avg"),
    )
    value = ratio(F.col("recent_avg") - F.col("overall_avg"), "overall_avg") * 100
    return out.withColumn("momentum_pct", value).withColumn(
        "momentum",
        ladder(
            [
                (F.col("momentum_pct") > 10, "Strong Upward"),
                (F.col("momentum_pct") < -10, "Strong Downward"),
            ],
            "Stable",
        ),
    )


def rolling_trend(df: DataFrame, keys: list[str], recent: int = 30, n: int = 7) -> DataFrame:
    """Mean change of the 7-day means over the last 7 points, for CPU and users."""
    tail = last_n_rows(df, keys, recent)
    smooth = tail.withColumns({f"s_{c}": rolling(c, keys, n) for c in ("usage_cpu", "users_active")})
    last = last_n_rows(smooth, keys, n)
    w = by_date(keys)
    change = {
        f"d_{c}": ratio(F.col(f"s_{c}"), F.lag(f"s_{c}").over(w)) - 1
        for c in ("usage_cpu", "users_active")
    }
    out = last.withColumns(change).groupBy(*keys).agg(
        F.avg("d_usage_cpu").alias("cpu_trend"), F.avg("d_users_active").alias("users_trend")
    )
    overall = (F.col("cpu_trend") + F.col("users_trend")) / 2
    return out.withColumn("overall_trend", overall).withColumn(
        "trend",
        ladder(
            [(F.col("overall_trend") > 0.05, "improving"), (F.col("overall_trend") < -0.05, "declining")],
            "stable",
        ),
    )


def difference(df: DataFrame, keys: list[str], c: str, k: int = 1) -> DataFrame:
    return df.withColumn(f"{c}_diff", F.col(c) - F.lag(c, k).over(by_date(keys)))


def reconstruct(df: DataFrame, keys: list[str], diff: str, level: Column | str) -> DataFrame:
    """Levels from differences: ``level`` plus the running sum of the differences."""
    running = F.sum(F.coalesce(F.col(diff), F.lit(0.0))).over(
        by_date(keys).rowsBetween(Window.unboundedPreceding, 0)
    )
    return df.withColumn("reconstructed", col(level) + running)


def iqr_anomalies(df: DataFrame, keys: list[str], c: str, k: float = 1.5) -> DataFrame:
    """Days outside the quartile fences of the smoothed series."""
    smooth = df.withColumn("smooth", centered(c, keys))
    fences = smooth.groupBy(*keys).agg(
        F.percentile("smooth", F.lit(0.25)).alias("q1"),
        F.percentile("smooth", F.lit(0.75)).alias("q3"),
        F.count("smooth").alias("points"),
    )
    spread = (F.col("q3") - F.col("q1")) * k
    bounds = fences.filter(F.col("points") > 10).select(
        *keys, (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )
    outside = (F.col(c) < F.col("lower")) | (F.col(c) > F.col("upper"))
    return df.join(bounds, keys).filter(outside).select(*keys, "date", c, "lower", "upper")


def iqr_outliers(df: DataFrame, keys: list[str], c: str, k: float = 1.5, **sizes: int) -> DataFrame:
    """Rows of the fact outside the quartile fences of their group."""
    quartiles = quantile_table(df, keys, [c], {"q1": 0.25, "q3": 0.75}, **sizes)
    spread = (F.col("q3") - F.col("q1")) * k
    bounds = quartiles.select(
        *keys, (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )
    joined = df.join(materialize(bounds, "fences"), keys)
    return joined.filter((F.col(c) < F.col("lower")) | (F.col(c) > F.col("upper")))


def peaks_valleys(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Local maxima at or above the 75th percentile and minima at or below the 25th.

    Equal neighbours form one run; a flat top counts once, on its middle day.
    """
    w = by_date(keys)
    marked = df.select(
        *keys,
        "date",
        F.col(c).alias("value"),
        F.row_number().over(w).alias("idx"),
        F.coalesce((F.col(c) != F.lag(c).over(w)).cast("int"), F.lit(1)).alias("starts"),
    ).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "run").agg(
        F.first("value").alias("value"), F.min("idx").alias("left"), F.max("idx").alias("right")
    )
    along = Window.partitionBy(*keys).orderBy("run")
    limits = df.groupBy(*keys).agg(
        F.percentile(c, F.lit(0.75)).alias("high"), F.percentile(c, F.lit(0.25)).alias("low")
    )
    before, after = F.col("before"), F.col("after")
    kind = ladder(
        [
            ((F.col("value") > before) & (F.col("value") > after) & (F.col("value") >= F.col("high")), "peak"),
            ((F.col("value") < before) & (F.col("value") < after) & (F.col("value") <= F.col("low")), "valley"),
        ],
        None,
    )
    found = (
        runs.withColumns(
            {"before": F.lag("value").over(along), "after": F.lead("value").over(along)}
        )
        .join(limits, keys)
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("idx", F.floor((F.col("left") + F.col("right")) / 2).cast("int"))
    )
    return found.select(*keys, "idx", "kind").join(
        marked.select(*keys, "idx", "date", "value"), [*keys, "idx"]
    )


def sequence_windows(
    df: DataFrame, keys: list[str], c: str, n: int, horizon: int = 1
) -> DataFrame:
    """Supervised windows: the ``n`` values before each day and the ``horizon`` values from it."""
    w = by_date(keys)
    past = F.collect_list(c).over(w.rowsBetween(-n, -1))
    future = F.collect_list(c).over(w.rowsBetween(0, horizon - 1))
    return (
        df.select(*keys, "date", past.alias("window"), future.alias("target"))
        .filter((F.size("window") == n) & (F.size("target") == horizon))
    )


def seasonal_decompose(df: DataFrame, keys: list[str], c: str, period: int = 7) -> DataFrame:
    """Additive decomposition into trend, seasonal and residual parts."""
    base = df.select(
        *keys,
        "date",
        F.col(c).alias("value"),
        F.pmod(F.row_number().over(by_date(keys)) - 1, F.lit(period)).alias("phase"),
    )
    base = base.withColumn("trend", centered("value", keys, period))
    phases = base.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("raw"))
    centre = phases.groupBy(*keys).agg(F.avg("raw").alias("centre"))
    season = phases.join(centre, keys).select(
        *keys, "phase", (F.col("raw") - F.col("centre")).alias("seasonal")
    )
    out = base.join(season, [*keys, "phase"])
    return out.withColumn("residual", F.col("value") - F.col("trend") - F.col("seasonal")).drop("phase")


def as_daily_freq(df: DataFrame, keys: list[str]) -> DataFrame:
    """Insert missing days with null values."""
    return calendar(df, keys).join(df, [*keys, "date"], "left")


def forward_fill(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    w = by_date(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def weekly_resample(df: DataFrame) -> DataFrame:
    """Weeks ending on Monday: mean CPU and storage, total users."""
    week = F.next_day(F.date_sub("date", 1), "MON").alias("week_end")
    return df.groupBy(week).agg(
        F.avg("usage_cpu").alias("usage_cpu"),
        F.avg("usage_storage").alias("usage_storage"),
        F.sum("users_active").alias("users_active"),
    )


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "day": F.dayofmonth("date"),
            "weekday": F.weekday("date"),
            "quarter": F.quarter("date"),
            "weekofyear": F.weekofyear("date"),
            "is_month_start": (F.dayofmonth("date") == 1).cast("int"),
            "is_month_end": (F.col("date") == F.last_day("date")).cast("int"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
        }
    )


def chronological_split(
    df: DataFrame, keys: list[str], train: float = 0.8, validation: float = 0.0
) -> DataFrame:
    """Label the days of each series train, validation or test in order of time."""
    sized = df.withColumns(
        {
            "position": F.row_number().over(by_date(keys)),
            "length": F.count("*").over(Window.partitionBy(*keys)),
        }
    )
    train_end = F.floor(F.lit(train) * F.col("length"))
    validation_end = train_end + F.floor(F.lit(validation) * F.col("length"))
    split = ladder(
        [
            (F.col("position") <= train_end, "train"),
            (F.col("position") <= validation_end, "validation"),
        ],
        "test",
    )
    return sized.withColumn("split", split).drop("length")


def hash_split(df: DataFrame, key_cols: list[str], train: int = 64, validation: int = 16) -> DataFrame:
    """Pseudo-random split fixed by the row's key: same key, same side, on every run."""
    band = F.pmod(F.xxhash64(*key_cols), F.lit(100))
    split = ladder([(band < train, "train"), (band < train + validation, "validation")], "test")
    return df.withColumn("split", split)


def rolling_origin_folds(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Expanding-window folds: the rows of each fold with their role, train or test."""
    sized = df.withColumns(
        {
            "position": F.row_number().over(by_date(keys)) - 1,
            "length": F.count("*").over(Window.partitionBy(*keys)),
        }
    )
    size = F.floor(F.col("length") / (k + 1))
    start = F.col("length") - (k + 1 - F.col("fold")) * size
    role = ladder(
        [(F.col("position") < start, "train"), (F.col("position") < start + size, "test")], None
    )
    return (
        sized.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
        .withColumn("role", role)
        .filter(F.col("role").isNotNull())
        .drop("length")
    )


def weekly_seasonality_flag(df: DataFrame, c: str) -> DataFrame:
    """Do weekday means vary more than half the volatility of the daily means?"""
    daily = materialize(df.groupBy("date").agg(F.avg(c).alias("value")), "daily")
    weekday = daily.groupBy(F.weekday("date")).agg(F.avg("value").alias("value"))
    volatility = daily.agg(F.stddev_samp("value")).scalar()
    return weekday.agg(F.var_samp("value").alias("weekday_variance")).select(
        "weekday_variance",
        volatility.alias("volatility"),
        (F.col("weekday_variance") > volatility * 0.5).alias("strong_weekly_seasonality"),
    )


def current_vs_mean_flag(df: DataFrame) -> DataFrame:
    """Latest daily mean of each metric against its overall mean."""
    daily = df.groupBy("date").agg(*[F.avg(m).alias(m) for m in METRICS])
    wide = daily.agg(
        *[F.max_by(m, "date").alias(f"{m}_now") for m in METRICS],
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS],
    )
    now = lambda m: F.col(f"{m}_now")
    mean = lambda m: F.col(f"{m}_mean")
    flags = {
        "usage_cpu": ladder(
            [
                (now("usage_cpu") > mean("usage_cpu") * 1.2, "High CPU Alert"),
                (now("usage_cpu") < mean("usage_cpu") * 0.8, "CPU Optimized"),
            ],
            "CPU Normal",
        ),
        "usage_storage": ladder(
            [(now("usage_storage") > mean("usage_storage") * 1.15, "Storage Growth")],
            "Storage Stable",
        ),
        "users_active": ladder(
            [
                (now("users_active") > mean("users_active") * 1.1, "User Growth"),
                (now("users_active") < mean("users_active") * 0.9, "User Decline"),
            ],
            "Users Stable",
        ),
    }
    rows = [
        F.struct(
            F.lit(m).alias("metric"), now(m).alias("current"), mean(m).alias("mean"), flags[m].alias("flag")
        )
        for m in METRICS
    ]
    return wide.select(F.inline(F.array(*rows)))
