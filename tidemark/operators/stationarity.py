"""Unit-root and stationarity tests whose lags follow the data.

Series are daily, so their windows are bounded by the calendar; all series are tested at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio
from ..functions.linear import moment_matrices, solve_least_squares
from ..session import materialize
from .windows import by_date

# MacKinnon's response surface of the Dickey-Fuller statistic with a constant. Below the first
# number the normal quantile of the p-value is the first polynomial (rising powers), above it the second.
SURFACE_CUT, SURFACE_LOW, SURFACE_HIGH = -1.61, -18.83, 2.74
SURFACE_SMALL = [2.1659, 1.4412, 0.038269]
SURFACE_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]
# Critical values of the level statistic and their p-values.
LEVEL_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]


def nested_rss(moments: np.ndarray) -> list[float]:
    """Residual sums of squares of the target (last) on the first two, three, ... columns, by sweeping one
    column after the other out of the moment matrix."""
    left, found = np.array(moments, float), []
    for k in range(len(left) - 1):
        pivot = left[k, k]
        if pivot > 1e-12 * max(1.0, float(moments[k, k])):
            left = left - np.outer(left[:, k], left[k]) / pivot
        if k:
            found.append(max(float(left[-1, -1]), 0.0))
    return found


@F.pandas_udf(T.IntegerType())
def _best_lag(moments: pd.Series, n: pd.Series, longest: pd.Series) -> pd.Series:
    """Number of lags with the least AIC, the fewest of equals."""
    best = []
    for flat, rows, most in zip(moments, n, longest):
        size = int(round(len(flat) ** 0.5))
        rss = nested_rss(np.asarray(flat, float).reshape(size, size))[: int(most) + 1]
        aic = [rows * math.log(max(r, 1e-300) / rows) + 2 * (lags + 2) for lags, r in enumerate(rss)]
        best.append(int(np.argmin(aic)))
    return pd.Series(best, dtype="int32")


def surface_p(t: float) -> float:
    if t > SURFACE_HIGH:
        return 1.0
    if t < SURFACE_LOW:
        return 0.0
    powers = SURFACE_SMALL if t <= SURFACE_CUT else SURFACE_LARGE
    return 0.5 * (1 + math.erf(sum(b * t**i for i, b in enumerate(powers)) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def _surface(t: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else surface_p(x) for x in t], dtype="float64")


def adf_auto(series: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Augmented Dickey-Fuller statistic with a constant, the number of lags chosen by AIC.

    All numbers of lags up to 12 (n / 100)^(1/4) are compared over common rows: one moment matrix of the longest
    regression holds all of them. The chosen one is fitted again on every row it has.
    """
    w = by_date(keys)
    size = F.count("*").over(Window.partitionBy(*keys))
    longest = F.least(F.ceil(12 * F.pow(size / 100.0, F.lit(0.25))), F.floor(size / 2) - 2).cast("int")
    level = F.col(c).cast("double")
    base = series.select(*keys, "date", level.alias("level"), longest.alias("longest")).filter("longest >= 0")
    base = base.withColumns(
        {"position": F.row_number().over(w), "before": F.lag("level").over(w), "diff": F.col("level") - F.lag("level").over(w)}
    )
    base = materialize(base, "adf-series")
    most = base.agg(F.max("longest")).first()[0] or 0
    lags = F.array(*[F.lag("diff", k).over(w) for k in range(1, most + 1)]).cast("array<double>")
    rows = materialize(base.withColumn("lags", lags), "adf-lags")

    def regression(df: DataFrame, use: str) -> DataFrame:
        """Moments over the rows that know ``use`` lags; lags beyond are zero."""
        kept = F.transform("lags", lambda x, k: F.when(k < F.col(use), x).otherwise(0.0))
        known = df.filter(F.col("position") >= F.col(use) + 2)
        return moment_matrices(known, [*keys, use], F.concat(F.array("before", F.lit(1.0)), kept, F.array("diff")))

    tried = regression(rows, "longest")
    best = tried.select(*keys, _best_lag("moments", "n", "longest").alias("chosen"))
    chosen = regression(rows.join(best, keys), "chosen").withColumn("use", F.sequence(F.lit(0), F.col("chosen") + 1))
    fit = solve_least_squares(chosen, [*keys, "chosen"], "use")
    found = fit.select(*keys, ratio(F.col("coef")[0], F.col("stderr")[0]).alias("adf_statistic"), F.col("chosen").alias("lags"), "n")
    found = found.withColumn("p_value", _surface("adf_statistic"))
    return found.withColumn("stationary", F.col("p_value") < 0.05)


def _products(rows: DataFrame, keys: list[str], up_to: Column) -> DataFrame:
    """(keys, k, product): sums of products of residuals k days apart, k from 1 up to the series' ``up_to``."""
    later = rows.select(*keys, "e", F.explode(F.sequence(F.lit(1), up_to)).alias("k"), F.col("position").alias("at"))
    later = later.withColumn("position", F.col("at") - F.col("k"))
    earlier = rows.select(*keys, "position", F.col("e").alias("e_before"))
    return later.join(earlier, [*keys, "position"]).groupBy(*keys, "k").agg(F.sum(F.col("e") * F.col("e_before")).alias("product"))


def kpss_auto(series: DataFrame, keys: list[str], c: str) -> DataFrame:
    """KPSS level statistic with Bartlett weights over a number of lags that follows the data (Hobijn and others),
    and the p-value interpolated in the table of critical values, between 0.01 and 0.1."""
    whole = Window.partitionBy(*keys)
    e = F.col(c) - F.avg(c).over(whole)
    rows = series.select(*keys, "date", e.alias("e"), F.row_number().over(by_date(keys)).alias("position"), F.count("*").over(whole).alias("n"))
    rows = materialize(rows, "kpss-residuals")
    running = F.sum("e").over(by_date(keys).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.withColumn("s", running).groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("s") * F.col("s")).alias("ss")
    )
    short = F.floor(F.pow(F.col("n").cast("double"), F.lit(2.0 / 9))).cast("int")
    first = _products(rows, keys, short).groupBy(*keys).agg(
        F.sum("product").alias("sum_product"), F.sum(F.col("k") * F.col("product")).alias("sum_weighted")
    )
    n = F.col("n").cast("double")
    share = ratio(F.col("sum_weighted") / (n / 2), F.col("ee") / n + F.col("sum_product") / (n / 2))
    wanted = F.floor(1.1447 * F.pow(share * share * n, F.lit(1.0 / 3)))
    lags = F.least(F.coalesce(wanted, F.lit(0)), F.col("n") - 1).cast("int")
    sized = materialize(sums.join(first, keys, "left").withColumn("lags", lags).select(*keys, "n", "ee", "ss", "lags"), "kpss-lags")
    found = _products(rows.join(sized.filter("lags > 0").select(*keys, "lags"), keys), keys, F.col("lags"))
    found = found.join(sized.select(*keys, "lags"), keys)
    weighted = F.sum((1 - F.col("k") / (F.col("lags") + 1.0)) * F.col("product")).alias("weighted")
    joined = sized.join(found.groupBy(*keys).agg(weighted), keys, "left")
    lr = (F.col("ee") + 2 * F.coalesce("weighted", F.lit(0.0))) / n
    out = joined.select(*keys, ratio(F.col("ss") / (n * n), lr).alias("kpss_statistic"), "lags", "n")
    t, p = F.col("kpss_statistic"), F.lit(LEVEL_TABLE[-1][1])
    for (low, p_low), (high, p_high) in reversed(list(zip(LEVEL_TABLE, LEVEL_TABLE[1:]))):
        p = F.when(t < high, p_low + (t - low) * ((p_high - p_low) / (high - low))).otherwise(p)
    p = F.when(t.isNotNull(), F.when(t < LEVEL_TABLE[0][0], F.lit(LEVEL_TABLE[0][1])).otherwise(p))
    return out.withColumn("p_value", p).withColumn("stationary", F.col("p_value") > 0.05)
