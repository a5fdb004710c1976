"""Statistics against brute force on small fixtures, with ties, skew and edge cases."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.linear import AR_STATE, ar_path, moment_matrices, solve_least_squares
from tidemark.functions.moments import correlation_table
from tidemark.functions.order_stats import distribution, percentiles, value_positions
from tidemark.operators import stationarity, statistics

DAY0 = datetime.date(2024, 1, 1)


def skewed(spark, n=3000):
    """A third of the rows share one value; the rest spans nine orders of magnitude."""
    rng = np.random.default_rng(5)
    value = np.where(rng.random(n) < 0.34, 7.0, np.round(10 ** rng.uniform(-2, 7, n), 3))
    key = np.where(rng.random(n) < 0.8, "hot", "cold")
    pdf = pd.DataFrame({"key": key, "value": value})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("sizes", [{}, {"parts": 8}, {"parts": 64}])
def test_percentiles_are_exact(spark, sizes):
    df, pdf = skewed(spark)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {(r.key, r.p): r.quantile for r in percentiles(df, ["key"], ["value"], ps, **sizes).collect()}
    for key, group in pdf.groupby("key"):
        for p in ps:
            assert got[(key, p)] == pytest.approx(np.percentile(group["value"], p * 100), rel=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"parts": 4}])
def test_positions_count_smaller_rows(spark, sizes):
    df, pdf = skewed(spark, 800)
    rows = value_positions(df, ["key"], ["value"], **sizes).collect()
    assert sum(r.n for r in rows) == len(pdf)
    for r in rows:
        group = pdf[pdf.key == r.key].value
        assert r.below == (group < r.value).sum()
        assert r.n == (group == r.value).sum()


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, value double")
    assert percentiles(empty, ["key"], ["value"], [0.5]).collect() == []
    nulls = spark.createDataFrame([("a", None), ("a", None)], "key string, value double")
    assert percentiles(nulls, ["key"], ["value"], [0.5]).collect() == []


def sample(spark, n=200):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.integers(0, 12, n).astype(float), "y": rng.integers(0, 9, n).astype(float)})
    pdf["z"] = np.round(pdf.x * 0.7 + rng.normal(0, 3, n), 1)
    return spark.createDataFrame(pdf), pdf


def matrix(df):
    return {(r["row"], r["column"]): r["correlation"] for r in df.collect()}


def test_pearson_matches_pandas(spark):
    df, pdf = sample(spark)
    got, want = matrix(statistics.corr_matrix(df, ["x", "y", "z"])), pdf.corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"parts": 4}])
def test_spearman_matches_ranked_pearson(spark, sizes):
    df, pdf = sample(spark)
    got = matrix(statistics.spearman_matrix(df, ["x", "y", "z"], **sizes))
    want = pdf.rank(method="average").corr()
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-12)


def test_kendall_matches_all_pairs(spark):
    df, pdf = sample(spark, 150)
    got = matrix(statistics.kendall_matrix(df, ["x", "y", "z"]))
    for (a, b), r in got.items():
        u, v = pdf[a].to_numpy(), pdf[b].to_numpy()
        i, j = np.triu_indices(len(u), 1)
        du, dv = np.sign(u[i] - u[j]), np.sign(v[i] - v[j])
        want = (du * dv).sum() / math.sqrt((du != 0).sum() * (dv != 0).sum())
        assert r == pytest.approx(want, abs=1e-12)


def test_constant_column_and_single_row_give_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 9.0), (4.0, 5.0, 1.0)], "x double, y double, z double")
    got = matrix(correlation_table(df, ["x", "y", "z"]))
    assert got[("x", "y")] is None and got[("y", "y")] is None and got[("x", "x")] == 1.0
    one = matrix(correlation_table(df.limit(1), ["x", "z"]))
    assert one[("x", "z")] is None


def test_pairwise_complete_rows_only(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (2.0, None), (3.0, 2.0), (None, 4.0), (5.0, 9.0)], "x double, y double"
    )
    row = [r for r in correlation_table(df, ["x", "y"]).collect() if r["row"] == "x" and r["column"] == "y"][0]
    assert row["n"] == 3
    assert row["correlation"] == pytest.approx(np.corrcoef([1, 3, 5], [1, 2, 9])[0, 1])


@pytest.mark.parametrize(
    "t, dof, p", [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05), (3.169, 10, 0.01)]
)
def test_t_distribution(t, dof, p):
    assert statistics.t_two_sided(t, dof) == pytest.approx(p, abs=2e-4)


def series(spark, values, region="A"):
    rows = [(region, DAY0 + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "region string, date date, value double")


def test_kpss_statistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 120).cumsum()
    row = statistics.kpss_test(series(spark, x), ["region"], "value", 4).first()
    e = x - x.mean()
    lr = (e @ e + 2 * sum((1 - k / 5) * (e[k:] @ e[:-k]) for k in range(1, 5))) / len(e)
    want = (e.cumsum() ** 2).sum() / len(e) ** 2 / lr
    assert row.kpss_statistic == pytest.approx(want)


def test_adf_statistic(spark):
    rng = np.random.default_rng(2)
    walk = rng.normal(0.5, 1, 200).cumsum()
    noise = rng.normal(0, 1, 200)
    both = series(spark, walk, "walk").unionByName(series(spark, noise, "noise"))
    got = {r.region: r for r in statistics.adf_test(both, ["region"], "value", 2).collect()}
    for name, x in (("walk", walk), ("noise", noise)):
        d = np.diff(x)
        design = np.column_stack([x[2:-1], np.ones(len(d) - 2), d[1:-1], d[:-2]])
        target = d[2:]
        coef, *_ = np.linalg.lstsq(design, target, rcond=None)
        rss = ((target - design @ coef) ** 2).sum()
        se = math.sqrt(rss / (len(target) - 4) * np.linalg.inv(design.T @ design)[0, 0])
        assert got[name].adf_statistic == pytest.approx(coef[0] / se, rel=1e-6)
    assert got["noise"].stationary and not got["walk"].stationary


def ols(design, target):
    coef, *_ = np.linalg.lstsq(design, target, rcond=None)
    rss = ((target - design @ coef) ** 2).sum()
    se = np.sqrt(rss / (len(target) - design.shape[1]) * np.diag(np.linalg.inv(design.T @ design)))
    return coef, se, rss


def adf_regression(x, lags, start):
    """Regression over the differences from number ``start`` on."""
    d = np.diff(x)
    rows = np.arange(start, len(d))
    return np.column_stack([x[rows], np.ones(len(rows)), *[d[rows - k] for k in range(1, lags + 1)]]), d[rows]


def test_adf_chooses_its_lags(spark):
    rng = np.random.default_rng(6)
    kinds = {"walk": rng.normal(0.2, 1, 150).cumsum(), "noise": rng.normal(0, 1, 90), "short": rng.normal(0, 1, 12)}
    x = np.zeros(200)
    for i in range(3, 200):
        x[i] = 0.5 * x[i - 1] + 0.3 * x[i - 3] + rng.normal()
    kinds["slow"] = x
    both = None
    for name, values in kinds.items():
        part = series(spark, values, name)
        both = part if both is None else both.unionByName(part)
    got = {r.region: r for r in stationarity.adf_auto(both, ["region"], "value").collect()}
    for name, values in kinds.items():
        n = len(values)
        longest = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
        aic, rss_of = [], []
        for lags in range(longest + 1):
            design, target = adf_regression(values, lags, longest)
            rss = ols(design, target)[2]
            rss_of.append(rss)
            aic.append(len(target) * math.log(rss / len(target)) + 2 * (lags + 2))
        full, target = adf_regression(values, longest, longest)
        z = np.column_stack([full, target])
        assert stationarity.nested_rss(z.T @ z) == pytest.approx(rss_of, rel=1e-6)  # every number of lags
        best = int(np.argmin(aic))
        coef, se, _ = ols(*adf_regression(values, best, best))
        assert (got[name].lags, got[name].n) == (best, n - 1 - best)
        assert got[name].adf_statistic == pytest.approx(coef[0] / se[0], rel=1e-6)
        assert got[name].p_value == pytest.approx(stationarity.surface_p(coef[0] / se[0]), rel=1e-6)
    assert got["noise"].stationary and not got["walk"].stationary


@pytest.mark.parametrize("t, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (3.0, 1.0), (-20.0, 0.0)])
def test_surface_of_critical_values(t, p):
    assert stationarity.surface_p(t) == pytest.approx(p, abs=1.5e-3)


def test_kpss_bandwidth(spark):
    rng = np.random.default_rng(7)
    kinds = {"walk": rng.normal(0, 1, 130).cumsum(), "noise": rng.normal(0, 1, 80), "constant": np.ones(30)}
    both = None
    for name, values in kinds.items():
        part = series(spark, values, name)
        both = part if both is None else both.unionByName(part)
    got = {r.region: r for r in stationarity.kpss_auto(both, ["region"], "value").collect()}
    for name in ("walk", "noise"):
        e = kinds[name] - kinds[name].mean()
        n = len(e)
        s0, s1 = e @ e / n, 0.0
        for k in range(1, int(n ** (2 / 9)) + 1):
            s0, s1 = s0 + e[k:] @ e[:-k] / (n / 2), s1 + k * (e[k:] @ e[:-k]) / (n / 2)
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
        lr = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
        t = (e.cumsum() ** 2).sum() / n**2 / lr
        assert got[name].lags == lags and got[name].kpss_statistic == pytest.approx(t)
        assert got[name].p_value == pytest.approx(np.interp(t, *zip(*stationarity.LEVEL_TABLE)))
    assert got["constant"].kpss_statistic is None and got["constant"].p_value is None


def test_moments_solve_like_lstsq(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 3))
    y = x @ [1.5, -2.0, 0.25] + rng.normal(0, 0.1, 500)
    pdf = pd.DataFrame({"k": np.where(np.arange(500) < 400, "a", "b"), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y})
    df = spark.createDataFrame(pdf).repartition(7)
    fit = solve_least_squares(moment_matrices(df, ["k"], F.array("x0", "x1", "x2", "y")), ["k"])
    for r in fit.collect():
        part = pdf[pdf.k == r.k]
        want, *_ = np.linalg.lstsq(part[["x0", "x1", "x2"]].to_numpy(), part.y.to_numpy(), rcond=None)
        assert np.allclose(r.coef, want)
        assert r.n == len(part)


def test_recursive_path_levels(spark):
    kinds = "coef array<double>, p int, d int, q int, recent array<double>, shocks array<double>, value double, slope double, steps int"

    def path(*row):
        return spark.createDataFrame([row], kinds).select(ar_path(*AR_STATE, F.col("steps"))).first()[0]

    # AR(1) with 0.5 on differences: 2 -> 1 -> 0.5 added to the level.
    assert path([0.5], 1, 1, 0, [2.0], [0.0], 10.0, 2.0, 3) == pytest.approx([11.0, 11.5, 11.75])
    assert path([3.0], 0, 0, 0, [1.0], [0.0], 9.0, 0.0, 2) == [3.0, 3.0]
    # A residual enters only the first step of a moving average of order one.
    assert path([0.0, 1.0], 0, 0, 1, [0.0], [4.0], 0.0, 0.0, 2) == [4.0, 0.0]
    # Second differences of zero continue the slope.
    assert path([], 0, 2, 0, [0.0], [0.0], 5.0, 2.0, 3) == [7.0, 9.0, 11.0]
    assert path([3.0], 0, 0, 0, [1.0], [0.0], 9.0, 0.0, 0) == []


def test_linear_trend_line(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(10)], "x double, y double")
    rows = statistics.linear_trend(df, "x", "y").collect()
    assert len(rows) == 100
    assert rows[0].slope == pytest.approx(3) and rows[0].intercept == pytest.approx(1)
    assert max(r.y for r in rows) == pytest.approx(28)


@pytest.mark.parametrize("sizes", [{}, {"parts": 8}])
def test_distribution_in_one_pass(spark, sizes):
    df, pdf = skewed(spark, 900)
    rows = {r.key: r for r in distribution(df, ["key"], ["value"], {"q50": 0.5}, **sizes).collect()}
    for key, group in pdf.groupby("key"):
        r, v = rows[key], group["value"]
        assert (r["count"], r["min"], r["max"]) == (len(v), v.min(), v.max())
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std())
        assert r["q50"] == pytest.approx(v.median())
    one = distribution(df.limit(1), ["key"], ["value"], {"q50": 0.5}).first()
    assert one["count"] == 1 and one["std"] is None
