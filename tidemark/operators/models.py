"""Fitted forecast models, trained for all series at once.

Three families compete per series: autoregressive models with moving-average terms,
linear models over scaled windows, and boosted trees. Spark builds lags and moment
matrices for every series in parallel; the driver never loops over series, and Python
only solves the small normal equations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import AR_STATE, ar_path, moment_matrices, solve_least_squares
from ..session import Kept, materialize, side_by_side
from ..sources.schemas import METRIC_TYPES
from . import evaluation, forecasting, statistics, windows
from .filters import category_values

SERIES = ["region", "metric_type"]
ORDER = ["p", "d", "q"]
# Fixed values: (p, d, q) orders tried for every series.
ORDERS = [(1, 1, 0), (2, 1, 0), (1, 1, 1), (2, 1, 1), (3, 1, 0), (3, 1, 1), (5, 1, 0)]
WINDOW_SIZES = [7, 14, 21]
# Trees, depth and step size tried for the boosted models.
TREE_GRID = [(50, 3, 0.01), (100, 3, 0.01), (50, 6, 0.01), (100, 6, 0.1)]
LONG_ORDER = 10
#: Training rows that a task of the tree models takes; each level of each tree is a job of so few tasks.
TREE_ROWS = 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# --- autoregressive models ----------------------------------------------------------


def with_train_end(series: DataFrame, keys: list[str], train: float = 0.8) -> DataFrame:
    length = F.count("*").over(Window.partitionBy(*keys))
    return series.withColumn("train_end", F.floor(F.lit(train) * length))


def _design(series: DataFrame, keys: list[str], ds: list[int], max_p: int, max_q: int) -> DataFrame:
    """Rows (keys, d, position) with the differenced value, its lags and residual lags.

    Residuals come from a long autoregression fitted on the training rows, the first
    stage of the two-stage estimate of moving-average terms.
    """
    w = windows.by_date(keys)
    y = F.col("value")
    d1 = y - F.lag("value", 1).over(w)
    d2 = d1 - (F.lag("value", 1).over(w) - F.lag("value", 2).over(w))
    levels = series.withColumns(
        {"position": F.row_number().over(w), "w0": y, "w1": d1, "w2": d2, "slope": d1}
    )
    picks = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"w{d}").alias("w")) for d in ds])
    long = levels.select(*keys, "date", "value", "position", "train_end", "slope", F.inline(picks))
    k2 = [*keys, "d"]
    w2 = Window.partitionBy(*k2).orderBy("position")
    depth = max(LONG_ORDER, max_p)
    lagged = long.withColumn("lags", F.array(*[F.lag("w", i).over(w2) for i in range(1, depth + 1)]))
    if max_q == 0:
        return lagged.withColumns({"e": F.lit(0.0), "e_lags": F.array().cast("array<double>")})
    known = ~F.exists("lags", lambda x: x.isNull()) & F.col("w").isNotNull()
    stage = lagged.filter(known & (F.col("position") <= F.col("train_end")))
    vector = F.concat(F.array(F.lit(1.0)), F.slice("lags", 1, LONG_ORDER), F.array("w"))
    use = F.when(F.col("d") == 0, F.sequence(F.lit(0), F.lit(LONG_ORDER))).otherwise(
        F.sequence(F.lit(1), F.lit(LONG_ORDER))
    )
    moments = moment_matrices(stage, k2, vector).withColumn("use", use)
    fit = solve_least_squares(moments, k2, "use").select(*k2, F.col("coef").alias("long_coef"))
    joined = lagged.join(fit, k2)
    regressors = F.when(
        F.col("d") == 0, F.concat(F.array(F.lit(1.0)), F.slice("lags", 1, LONG_ORDER))
    ).otherwise(F.slice("lags", 1, LONG_ORDER))
    residual = F.when(known, F.col("w") - dot(F.col("long_coef"), regressors))
    with_e = joined.withColumn("e", residual).drop("long_coef")
    return with_e.withColumn("e_lags", F.array(*[F.lag("e", i).over(w2) for i in range(1, max_q + 1)]))


def fit_ar(
    series: DataFrame, keys: list[str], orders: list[tuple[int, int, int]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Least-squares fit of every order on the training rows of every series.

    Returns the fits (keys, p, d, q, coef, rss, n, aic) and the design rows that
    forecasts start from. ``series`` has keys, date, value and train_end.
    """
    orders = orders or ORDERS
    max_p = max(max(p for p, _, _ in orders), 1)
    max_q = max(q for _, _, q in orders)
    design = materialize(
        _design(series, keys, sorted({d for _, d, _ in orders}), max_p, max_q), "ar-design"
    )
    k2 = [*keys, "d"]
    known = (
        ~F.exists("lags", lambda x: x.isNull())
        & ~F.exists("e_lags", lambda x: x.isNull())
        & F.col("w").isNotNull()
    )
    rows = design.filter(known & (F.col("position") <= F.col("train_end")))
    vector = F.concat(F.array(F.lit(1.0)), F.slice("lags", 1, max_p), F.col("e_lags"), F.array("w"))
    moments = moment_matrices(rows, k2, vector)

    def regressors(p: int, d: int, q: int) -> Column:
        constant = [0] if d == 0 else []
        use = constant + list(range(1, p + 1)) + list(range(max_p + 1, max_p + 1 + q))
        return F.array(*[F.lit(i) for i in use]).cast("array<int>")

    grid = F.array(
        *[
            F.struct(
                F.lit(p).alias("p"), F.lit(d).alias("od"), F.lit(q).alias("q"), regressors(p, d, q).alias("use")
            )
            for p, d, q in orders
        ]
    )
    tried = moments.select(*k2, "moments", "n", F.inline(grid)).filter(F.col("d") == F.col("od"))
    fits = solve_least_squares(tried, [*k2, "p", "q"], "use")
    size = F.size("coef") + 1
    aic = F.col("n") * F.log(F.greatest(F.col("rss") / F.col("n"), F.lit(1e-12))) + 2 * size
    fits = fits.select(*keys, *ORDER, "coef", "rss", "n", aic.alias("aic"))
    return materialize(fits, "ar-fits"), design


def _forecast(fits: DataFrame, design: DataFrame, keys: list[str], origin: Column, horizon) -> DataFrame:
    """(keys, p, d, q, start, step, predicted) from the design row at ``origin``."""
    state = design.filter(F.col("position") == origin).select(
        *keys,
        "d",
        "value",
        "slope",
        F.col("position").alias("start"),
        F.col("date").alias("last_date"),
        "length",
        F.slice(F.concat(F.array("w"), "lags"), 1, F.size("lags")).alias("recent"),
        F.concat(F.array(F.coalesce("e", F.lit(0.0))), F.transform("e_lags", lambda x: F.coalesce(x, F.lit(0.0)))).alias(
            "shocks"
        ),
    )
    # Few rows, much work per row: spread them over the cores before the recurrence.
    cores = fits.sparkSession.sparkContext.defaultParallelism
    spread = fits.join(state, [*keys, "d"]).repartition(cores, *keys, *ORDER)
    steps = F.lit(horizon) if isinstance(horizon, int) else horizon
    paths = spread.withColumn("path", ar_path(*AR_STATE, steps.cast("int")))
    return paths.select(
        *keys, *ORDER, "start", "last_date", F.posexplode("path").alias("at", "predicted")
    ).withColumn("step", F.col("at") + 1)


def score_ar(fits: DataFrame, design: DataFrame, keys: list[str]) -> DataFrame:
    """Hold-out errors of every fit: the whole test span is forecast from the train end."""
    sized = _with_length(design, keys)
    test_rows = F.col("length") - F.col("start")
    paths = _forecast(fits, sized.filter(F.col("train_end") < F.col("length")), keys, F.col("train_end"), test_rows)
    actual = sized.select(*keys, "d", "position", F.col("value").alias("actual_value"))
    joined = paths.withColumn("position", F.col("start") + F.col("step")).join(
        actual, [*keys, "d", "position"]
    )
    scored = joined.withColumnRenamed("predicted", "predicted_value")
    return evaluation.error_metrics(scored, [*keys, *ORDER])


def _with_length(design: DataFrame, keys: list[str]) -> DataFrame:
    lengths = design.groupBy(*keys).agg(F.max("position").alias("length"))
    return design.join(lengths, keys)


def best_ar(series: DataFrame, keys: list[str] = SERIES, orders=None) -> DataFrame:
    """The order with the lowest hold-out RMSE per series, with its scores."""
    fits, design = fit_ar(with_train_end(series, keys), keys, orders)
    scores = score_ar(fits, design, keys)
    all_fits = fits.join(scores.drop("n"), [*keys, *ORDER])
    return _best(all_fits, keys, [*ORDER, "coef", "aic", "rmse", "mae", "mape"])


def _best(df: DataFrame, keys: list[str], fields: list[str], by: str = "rmse") -> DataFrame:
    order = F.struct(F.round(by, 9), *[c for c in ORDER if c in fields])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("best")).select(*keys, "best.*")


def ar_order_by_aic(
    series: DataFrame, keys: list[str] = SERIES, max_p: int = 5, max_d: int = 2, max_q: int = 5
) -> DataFrame:
    """The order with the lowest AIC per series over the whole grid."""
    orders = [
        (p, d, q)
        for p in range(max_p + 1)
        for d in range(max_d + 1)
        for q in range(max_q + 1)
        if p + q > 0 or d == 0
    ]
    fits, _ = fit_ar(with_train_end(series, keys), keys, orders)
    return _best(fits, keys, [*ORDER, "aic", "n"], by="aic")


def forecast_ar(series: DataFrame, horizon: int = 30, orders=None, best: DataFrame | None = None) -> DataFrame:
    """Future values of every series from its best order, never below zero.

    ``best`` are the chosen models of ``best_ar``, if they are fitted already.
    """
    orders = orders or ORDERS
    best = best_ar(series, SERIES, orders) if best is None else best
    max_p = max(max(p for p, _, _ in orders), 1)
    ds = sorted({d for _, d, _ in orders})
    design = _design(with_train_end(series, SERIES), SERIES, ds, max_p, max(q for _, _, q in orders))
    chosen = best.select(*SERIES, *ORDER, "coef")
    paths = _forecast(chosen, _with_length(design, SERIES), SERIES, F.col("length"), horizon)
    return paths.select(
        *SERIES,
        "step",
        F.date_add("last_date", F.col("step")).alias("date"),
        F.greatest("predicted", F.lit(0.0)).alias("predicted"),
    )


def backtest_rolling_origin(
    series: DataFrame, keys: list[str] = SERIES, p: int = 5, train: float = 0.8
) -> DataFrame:
    """One-step forecasts over the test span, refitted on all earlier days before each step.

    The model is an autoregression of order ``p`` on the daily differences. The normal
    equations of all rows before a day are running sums, so each refit costs one small
    solve instead of another pass over the history.
    """
    w = windows.by_date(keys)
    base = with_train_end(series, keys, train).withColumns(
        {
            "position": F.row_number().over(w),
            "before": F.lag("value", 1).over(w),
            "target": F.col("value") - F.lag("value", 1).over(w),
        }
    )
    lags = [f"l{i}" for i in range(1, p + 1)]
    rows = base.withColumns({f"l{i}": F.lag("target", i).over(w) for i in range(1, p + 1)}).dropna("any")
    names = [*lags, "target"]
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    cells = {(a, b): F.sum(F.col(a) * F.col(b)).over(past) for i, a in enumerate(names) for b in names[i:]}
    flat = F.array(*[cells[(a, b)] if (a, b) in cells else cells[(b, a)] for a in names for b in names])
    origins = rows.select(
        *keys,
        "date",
        "position",
        "train_end",
        "value",
        "before",
        F.array(*lags).alias("x"),
        flat.alias("moments"),
        F.count("*").over(past).alias("n"),
    ).filter((F.col("position") > F.col("train_end")) & (F.col("n") > p))
    fit = solve_least_squares(origins, [*keys, "date", "value", "before", "x"])
    return fit.select(
        *keys,
        F.col("date").alias("prediction_date"),
        (F.col("before") + dot(F.col("coef"), F.col("x"))).alias("predicted_value"),
        F.col("value").alias("actual_value"),
    )


def cross_validate(series: DataFrame, k: int = 5, order: tuple[int, int, int] = (5, 1, 0)) -> DataFrame:
    """Mean and deviation of the hold-out errors over expanding-window folds."""
    folds = windows.rolling_origin_folds(series, SERIES, k).select(*SERIES, "fold", "date", "value", "role")
    keys = [*SERIES, "fold"]
    in_train = F.count_if(F.col("role") == "train").over(Window.partitionBy(*keys))
    fits, design = fit_ar(folds.withColumn("train_end", in_train).drop("role"), keys, [order])
    scores = score_ar(fits, design, keys)
    return scores.groupBy(*SERIES).agg(
        F.count("*").alias("folds"),
        *[fn(m).alias(f"{m}_{name}") for m in ("rmse", "mae", "mape") for name, fn in (("mean", F.avg), ("std", F.stddev_pop))],
    )


# --- linear models over scaled windows ------------------------------------------------


def _scaled(series: DataFrame) -> DataFrame:
    scaled = statistics.minmax_scale(series, SERIES, "value")
    return scaled.select(*SERIES, "date", "value", "low", "high", F.col("value_scaled").alias("x"))


def fit_window_linear(series: DataFrame, sizes: list[int] | None = None, train: float = 0.8) -> DataFrame:
    """Best window size per series: next scaled value regressed on the last n values.

    Scores are hold-out one-step errors in the original unit.
    """
    sizes = sizes or WINDOW_SIZES
    scaled = materialize(_scaled(series), "scaled-series")
    parts = []
    for n in sizes:
        windowed = windows.sequence_windows(scaled, SERIES, "x", n)
        parts.append(windowed.withColumn("steps", F.lit(n)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    keys = [*SERIES, "steps"]
    split = windows.chronological_split(rows, keys, train)
    split = materialize(
        split.withColumn("x", F.concat(F.array(F.lit(1.0)), "window")).drop("window"), "window-rows"
    )
    vector = F.concat("x", "target")
    moments = moment_matrices(split.filter(F.col("split") == "train"), keys, vector)
    fit = materialize(solve_least_squares(moments, keys), "window-fits")
    bounds = scaled.groupBy(*SERIES).agg(F.max("low").alias("low"), F.max("high").alias("high"))
    test = split.filter(F.col("split") == "test").join(fit.select(*keys, "coef"), keys).join(bounds, SERIES)
    back = lambda c: statistics.minmax_inverse(c, F.col("low"), F.col("high"))
    scored = test.withColumns(
        {
            "predicted_value": back(dot(F.col("coef"), F.col("x"))),
            "actual_value": back(F.col("target")[0]),
        }
    )
    errors = evaluation.error_metrics(scored, keys).drop("n")
    joined = fit.select(*keys, "coef").join(errors, keys)
    fields = ["steps", "coef", "rmse", "mae", "mape"]
    order = F.struct(F.round("rmse", 9), "steps")
    return joined.groupBy(*SERIES).agg(F.min_by(F.struct(*fields), order).alias("b")).select(*SERIES, "b.*")


def forecast_window(series: DataFrame, fit: DataFrame, horizon: int = 30) -> DataFrame:
    """Feed the last window of every series through its model, one step at a time."""
    longest = max(WINDOW_SIZES)
    scaled = _scaled(series)
    tail = windows.last_n_rows(scaled, SERIES, longest)
    state = tail.groupBy(*SERIES).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("date", "x"))), lambda s: s["x"]).alias("tail"),
        F.max("date").alias("last_date"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
    )
    joined = fit.join(state, SERIES).withColumn(
        "window", F.slice("tail", F.size("tail") - F.col("steps") + 1, F.col("steps"))
    )
    weights = F.slice("coef", 2, F.col("steps"))
    start = F.struct(F.col("window").alias("w"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        following = F.col("coef")[0] + dot(weights, s["w"])
        return F.struct(
            F.concat(F.slice(s["w"], 2, F.col("steps") - 1), F.array(following)).alias("w"),
            F.concat(s["out"], F.array(following)).alias("out"),
        )

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["out"]
    long = joined.withColumn("path", path).select(
        *SERIES, "last_date", "low", "high", F.posexplode("path").alias("at", "scaled")
    )
    value = statistics.minmax_inverse(F.col("scaled"), F.col("low"), F.col("high"))
    return long.select(
        *SERIES,
        (F.col("at") + 1).alias("step"),
        F.date_add("last_date", F.col("at") + 1).alias("date"),
        F.greatest(value, F.lit(0.0)).alias("predicted"),
    )


# --- boosted trees ----------------------------------------------------------------------


def _region_flags(regions: list[str]) -> dict[str, Column]:
    return {f"in_region_{i}": (F.col("region") == r).cast("double") for i, r in enumerate(regions)}


def _assembled(frame: DataFrame, metric: str, regions: list[str]) -> DataFrame:
    flags = _region_flags(regions)
    assembler = VectorAssembler(
        inputCols=[*forecasting.feature_names(metric), *flags], outputCol="features"
    )
    return assembler.transform(frame.withColumns(flags))


def fit_gbt(
    region_daily: DataFrame,
    metric: str,
    grid: list[tuple[int, int, float]] | None = None,
    train: float = 0.8,
) -> tuple[GBTRegressionModel, DataFrame, list[str]]:
    """Boosted trees over all regions; the grid point with the lowest test RMSE wins.

    Returns the model, its scores per region, and the regions behind its flags. Grid points of
    different depth or step are independent Spark jobs and run side by side. The rows are daily, so partitions are sized to
    them: a job for every level of every tree costs its tasks' overhead more than their work.
    """
    regions = category_values(region_daily, "region")
    frame = forecasting.feature_frame(region_daily, metric)
    rows = materialize(windows.chronological_split(frame, ["region"], train), "tree-rows")
    data = _assembled(rows, metric, regions)
    parts = max(1, -(-rows.count() // TREE_ROWS))
    train_rows = data.filter(F.col("split") == "train").select("features", "target").coalesce(parts)
    test_rows = data.filter(F.col("split") == "test").select("region", "features", "target")

    def fit(trees: int, depth: int, step: float) -> GBTRegressionModel:
        learner = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, stepSize=step, seed=42, cacheNodeIds=False)
        return learner.fit(train_rows)

    # Boosting adds trees one by one, so points of one depth and step are one fit: its first trees are the shorter model.
    points = grid or TREE_GRID
    longest: dict[tuple[int, float], int] = {}
    for trees, *shape in points:
        longest[tuple(shape)] = max(trees, longest.get(tuple(shape), 0))

    def attempt(shape: tuple[int, float]) -> tuple[dict[int, float], GBTRegressionModel]:
        model = fit(longest[shape], *shape)
        diff = F.col("target") - F.col("prediction")
        errors = {longest[shape]: model.transform(test_rows).agg(F.avg(diff * diff)).first()[0]}
        shorter = [trees for trees, *other in points if tuple(other) == shape and trees not in errors]
        if shorter:
            after = [None] * longest[shape] if errors[longest[shape]] is None else model.evaluateEachIteration(test_rows, "squared")
            errors |= {trees: after[trees - 1] for trees in shorter}
        return errors, model

    tried = dict(zip(longest, side_by_side(rows.sparkSession, attempt, longest)))
    trees, *shape = min(points, key=lambda point: tried[tuple(point[1:])][0][point[0]])
    model = tried[tuple(shape)][1] if trees == longest[tuple(shape)] else fit(trees, *shape)
    scored = model.transform(test_rows).withColumnsRenamed(
        {"target": "actual_value", "prediction": "predicted_value"}
    )
    scores = evaluation.error_metrics(scored, ["region"]).withColumn("metric_type", F.lit(metric))
    return model, scores, regions


def kept_gbt(region_daily: DataFrame, metric: str, kept: Kept, grid=None) -> tuple[GBTRegressionModel, DataFrame, list[str]]:
    """What ``fit_gbt`` gives, from the kept model and scores if there are any."""
    fitted: list = []

    def fit() -> tuple:
        if not fitted:
            fitted.append(fit_gbt(region_daily, metric, grid))
        return fitted[0]

    path = kept.path(f"tree-{metric}", lambda path: fit()[0].write().save(path))
    scores = kept.table(f"tree-scores-{metric}", lambda: fit()[1])
    model = fitted[0][0] if fitted else GBTRegressionModel.load(path)
    return model, scores, category_values(region_daily, "region")


def feature_importance(model: GBTRegressionModel, metric: str, regions: list[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree model."""
    names = [*forecasting.feature_names(metric), *[f"region={r}" for r in regions]]
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def feature_importance_rank(importance: DataFrame, k: int = 10) -> DataFrame:
    w = Window.orderBy(F.desc("importance"), "feature")
    ranked = importance.withColumn("position", F.row_number().over(w))
    return ranked.orderBy("position").limit(k)


def forecast_gbt(
    region_daily: DataFrame,
    model: GBTRegressionModel,
    metric: str,
    regions: list[str],
    horizon: int = 30,
    every: int = 5,
) -> DataFrame:
    """Recursive forecast of all regions together, one model pass per step.

    Lags and the weekly mean mix history and predictions; the other columns keep their
    last known values and future days count as regular days. Every few steps the state
    is written to the shared folder, which keeps the plan short.
    """
    target = METRIC_TYPES[metric]
    days = windows.last_n_rows(region_daily, ["region"], 30).select("region", F.col("date").alias("day"))
    first = days.groupBy("region").agg(F.min("day").alias("first_day"))
    tail = region_daily.join(first, "region")
    last = lambda c: F.max_by(F.col(c).cast("double"), "date")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    recent = F.when(F.col("date") >= F.col("first_day"), F.struct("date", F.col(target).cast("double").alias("v")))
    ordered = F.array_sort(F.collect_list(recent))
    # A factor that a region never knew must not pass as a value the trees have not seen.
    factor = lambda c: F.coalesce(known(c), F.raise_error(F.concat(F.lit(f"no {c} is known for "), F.first("region"))).cast("double"))
    fixed = {
        "usage_cpu": last("usage_cpu"),
        "usage_storage": last("usage_storage"),
        "users_active": last("users_active"),
        "economic_index": factor("economic_index"),
        "cloud_market_demand": factor("cloud_market_demand"),
        "lag1_cpu": last("usage_cpu"),
        "lag1_storage": last("usage_storage"),
        "lag1_users": last("users_active"),
    }
    names = forecasting.feature_names(metric)
    kept = [c for c in fixed if c in names]
    state = tail.groupBy("region").agg(
        F.transform(ordered, lambda s: s["v"]).alias("history"),
        F.max("date").alias("last_date"),
        *[fixed[c].alias(c) for c in kept],
    )
    state = state.withColumn("known_days", F.size("history"))
    state = materialize(state, "tree-state")
    base = ["region", "history", "last_date", "known_days", *kept]
    for step in range(1, horizon + 1):
        week = F.slice("history", -7, 7)
        frame = state.withColumns(
            {
                f"lag1_{target}": F.element_at("history", -1),
                f"lag7_{target}": F.coalesce(F.try_element_at("history", F.lit(-7)), F.element_at("history", 1)),
                f"roll7_mean_{target}": F.aggregate(week, F.lit(0.0), lambda a, x: a + x) / F.size(week),
                "dow": F.weekday(F.date_add("last_date", step)).cast("double"),
                "holiday": F.lit(0.0),
            }
        )
        predicted = model.transform(_assembled(frame, metric, regions))
        value = F.col("prediction")
        value = F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)) if metric == "cpu" else F.greatest(F.lit(100.0), value)
        state = predicted.withColumn("history", F.concat("history", F.array(value))).select(*base)
        if step % every == 0 and step < horizon:
            state = materialize(state, "tree-state")
    path = F.slice("history", F.col("known_days") + 1, F.lit(horizon))
    long = state.select("region", "last_date", F.posexplode(path).alias("at", "predicted"))
    return long.select(
        "region",
        F.lit(metric).alias("metric_type"),
        (F.col("at") + 1).alias("step"),
        F.date_add("last_date", F.col("at") + 1).alias("date"),
        "predicted",
    )


# --- selection over the families ----------------------------------------------------------


def train_all(region_daily: DataFrame, metric: str, grid=None, kept: Kept | None = None) -> dict[str, object]:
    """Train the three families for one metric, side by side; scores per region and family.

    With ``kept`` each family is trained once for the code and data that it names.
    """
    table = kept.table if kept else lambda label, build: materialize(build(), label)
    series = evaluation.long_series(region_daily).filter(F.col("metric_type") == metric)
    series = materialize(series, "series")
    fits = [
        lambda: table(f"ar-{metric}", lambda: best_ar(series)),
        lambda: table(f"window-{metric}", lambda: fit_window_linear(series)),
        lambda: kept_gbt(region_daily, metric, kept, grid) if kept else fit_gbt(region_daily, metric, grid),
    ]
    ar, window, (tree, tree_scores, regions) = side_by_side(region_daily.sparkSession, lambda fit: fit(), fits)
    cols = ["region", "metric_type", "rmse", "mae", "mape"]
    scores = (
        ar.select(*cols, F.lit("ARIMA").alias("model_type"))
        .unionByName(window.select(*cols, F.lit("WindowLinear").alias("model_type")))
        .unionByName(tree_scores.select(*cols, F.lit("GBT").alias("model_type")))
    )
    return {
        "series": series,
        "scores": materialize(scores, "scores"),
        "ar": ar,
        "window": window,
        "tree": tree,
        "regions": regions,
    }


def future_metric(region_daily: DataFrame, metric: str, horizon: int = 30, grid=None, trained=None) -> DataFrame:
    """One long table: each region's forecast from its best model family; ``trained`` is of ``train_all``.

    Each family's paths are written by themselves, side by side: one plan of them all takes longer to make than to run.
    """
    trained = trained or train_all(region_daily, metric, grid)
    best = evaluation.select_best(trained["scores"])
    families = {
        "ARIMA": lambda: forecast_ar(trained["series"], horizon, best=trained["ar"]),
        "WindowLinear": lambda: forecast_window(trained["series"], trained["window"], horizon),
        "GBT": lambda: forecast_gbt(region_daily, trained["tree"], metric, trained["regions"], horizon),
    }

    def path(family: str) -> DataFrame:
        return materialize(families[family](), "paths").withColumn("model_type", F.lit(family))

    paths = reduce(DataFrame.unionByName, side_by_side(region_daily.sparkSession, path, families))
    return paths.join(best.select(*SERIES, "model_type", "rmse"), [*SERIES, "model_type"])
