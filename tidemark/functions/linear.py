"""Least squares per series: Spark sums the moments, Python solves the small systems."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT = T.StructType(
    [
        T.StructField("coef", T.ArrayType(T.DoubleType())),
        T.StructField("stderr", T.ArrayType(T.DoubleType())),
        T.StructField("rss", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)


def moment_matrices(df: DataFrame, keys: list[str], vector: Column) -> DataFrame:
    """(keys, moments, n): the flattened sum of v·vᵀ per key, v = (regressors..., target).

    Each input partition reduces its rows to one partial matrix per key before the
    shuffle, so a series of any length sends only a few small arrays to its reducer.
    """
    rows = df.select(*keys, vector.alias("v"))
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("part", T.ArrayType(T.DoubleType())), T.StructField("part_n", T.LongType())]
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False) if keys else [((), batch)]:
                z = np.stack(group["v"].to_numpy())
                entry = sums.setdefault(key if isinstance(key, tuple) else (key,), [0.0, 0])
                entry[0] = entry[0] + z.T @ z
                entry[1] += len(z)
        if sums:
            yield pd.DataFrame(
                [(*k, m.ravel(), n) for k, (m, n) in sums.items()], columns=[*keys, "part", "part_n"]
            )

    parts = rows.mapInPandas(partial, schema)
    cells = parts.select(*keys, "part_n", F.posexplode("part").alias("pos", "cell"))
    summed = cells.groupBy(*keys, "pos").agg(F.sum("cell").alias("cell"), F.sum("part_n").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda s: s["cell"])
    return summed.groupBy(*keys).agg(ordered.alias("moments"), F.max("n").alias("n"))


def _fit(moments: np.ndarray, n: int, use: np.ndarray | None) -> tuple:
    size = int(round(len(moments) ** 0.5))
    full = np.asarray(moments, dtype=float).reshape(size, size)
    picked = np.arange(size - 1) if use is None else np.asarray(use, dtype=int)
    if len(picked) == 0:
        return [], [], float(full[-1, -1]), n
    xtx, xty = full[np.ix_(picked, picked)], full[picked, -1]
    scale = np.sqrt(np.clip(np.diag(xtx), 1e-300, None))
    inverse = np.linalg.pinv(xtx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    coef = inverse @ xty
    rss = max(float(full[-1, -1] - 2 * coef @ xty + coef @ xtx @ coef), 0.0)
    sigma2 = rss / max(n - len(picked), 1)
    return coef.tolist(), np.sqrt(np.clip(np.diag(inverse) * sigma2, 0, None)).tolist(), rss, n


@F.pandas_udf(FIT)
def _solve(moments: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [_fit(m, int(k), None) for m, k in zip(moments, n)], columns=["coef", "stderr", "rss", "n"]
    )


@F.pandas_udf(FIT)
def _solve_subset(moments: pd.Series, n: pd.Series, use: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        [_fit(m, int(k), u) for m, k, u in zip(moments, n, use)], columns=["coef", "stderr", "rss", "n"]
    )


def solve_least_squares(moments: DataFrame, keys: list[str], use: str | None = None) -> DataFrame:
    """(keys, coef, stderr, rss, n); ``use`` names an array column of regressor positions."""
    fit = _solve_subset("moments", "n", use) if use else _solve("moments", "n")
    return moments.select(*keys, fit.alias("fit")).select(*keys, "fit.*")


# Columns a path starts from: model, newest-first values and residuals, level and slope.
AR_STATE = ["coef", "p", "d", "q", "recent", "shocks", "value", "slope"]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _pushed(values: Column, first: Column) -> Column:
    """``first`` in front of the values, of which the last falls out."""
    return F.slice(F.concat(F.array(first), values), F.lit(1), F.size(values))


def ar_path(coef, p, d, q, recent, shocks, value, slope, steps) -> Column:
    """Levels of each row's series for ``steps`` days, predictions fed back as lags.

    Future residuals are zero; the differenced predictions are summed up ``d`` times.
    """
    coef, p, d, q = (F.col(c) for c in (coef, p, d, q))
    constant = F.when(d == 0, coef[0]).otherwise(0.0)
    first = F.when(d == 0, 2).otherwise(1)
    phi, theta = F.slice(coef, first, p), F.slice(coef, first + p, q)
    start = F.struct(
        F.col(recent).alias("values"), F.col(shocks).alias("residuals"),
        F.col(value).cast("double").alias("level"), F.col(slope).cast("double").alias("slope"),
        F.array().cast("array<double>").alias("out"),
    )

    def step(s: Column, _: Column) -> Column:
        following = constant + _dot(phi, F.slice(s["values"], F.lit(1), p)) + _dot(theta, F.slice(s["residuals"], F.lit(1), q))
        steeper = F.when(d == 2, s["slope"] + following).otherwise(s["slope"])
        level = F.when(d == 2, s["level"] + steeper).when(d == 0, following).otherwise(s["level"] + following)
        return F.struct(
            _pushed(s["values"], following).alias("values"), _pushed(s["residuals"], F.lit(0.0)).alias("residuals"),
            level.alias("level"), steeper.alias("slope"), F.concat(s["out"], F.array(level)).alias("out"),
        )

    days = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(days, start, step, lambda s: s["out"])
