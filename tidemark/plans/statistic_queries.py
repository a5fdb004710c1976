"""Correlation, trend and stationarity queries, and the scalar function catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import clamp, day_name, ladder, month_name, ratio
from ..operators import evaluation, stationarity, statistics
from ..operators.insights import size_scale
from ..session import materialize
from ..sources.schemas import METRICS, NUMERIC
from .catalog import query


def corr_value(a: str, b: str) -> str:
    """corr over complete pairs; null instead of NaN for constants and single rows."""
    known = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    return (
        f"CASE WHEN count(*) FILTER (WHERE {known}) > 1 AND stddev_pop({a}) FILTER (WHERE {known}) > 0 "
        f"AND stddev_pop({b}) FILTER (WHERE {known}) > 0 THEN corr({a}, {b}) END"
    )


def corr_long_sql(view: str, cols: list[str], key: str = "", where: str = "") -> str:
    select = f"{key} AS \"group\", " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return "\nUNION ALL ".join(
        f"""SELECT {select}'{a}' AS "row", '{b}' AS "column", {corr_value(a, b)} AS correlation,
       count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {view} {where}{group}"""
        for a in cols
        for b in cols
    )


CORR = "row column correlation:f n:i"


@query("s_1_corr_matrix", CORR, corr_long_sql("fact", NUMERIC))
def _(t):
    return statistics.corr_matrix(t.fact)


RANKED = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMERIC
) + " FROM fact WHERE economic_index IS NOT NULL"


@query(
    "s_2_corr_matrix_spearman",
    CORR,
    f"WITH ranked AS ({RANKED})\n RETURN " + corr_long_sql("ranked", NUMERIC),
)
def _(t):
    return statistics.spearman_matrix(t.fact)


def kendall_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS "row", '{b}' AS "column", s / sqrt((n0 - n1) * (n0 - n2)) AS correlation FROM (
  SELECT (SELECT sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b})) FROM points p JOIN points q ON p.date < q.date) AS s,
         (SELECT count(*) * (count(*) - 1) / 2 FROM points) AS n0,
         (SELECT coalesce(sum(c * (c - 1) / 2), 0) FROM (SELECT count(*) AS c FROM points GROUP BY {a})) AS n1,
         (SELECT coalesce(sum(c * (c - 1) / 2), 0) FROM (SELECT count(*) AS c FROM points GROUP BY {b})) AS n2)"""




@query(
    "s_3_corr_matrix_kendall",
    "row column correlation:f",
    "WITH points AS (SELECT date, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC)
    + " FROM daily WHERE cloud_market_demand IS NOT NULL AND economic_index IS NOT NULL)\n RETURN "
    + "\nUNION ALL ".join(kendall_sql(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]),
)
def _(t):
    daily = t.daily.select("date", *[F.round(c, 6).alias(c) for c in NUMERIC])
    return statistics.kendall_matrix(daily, NUMERIC)


@query(
    "s_4_corr_by_region",
    "group " + CORR,
    corr_long_sql("fact", NUMERIC, "region"),
)
def _(t):
    return statistics.corr_by(t.fact, "region")


RANKED_BY_REGION = "SELECT region, " + ", ".join(
    f"rank() OVER (PARTITION BY region ORDER BY {c}) + (count(*) OVER (PARTITION BY region, {c}) - 1) / 2 AS {c}" for c in NUMERIC
) + " FROM fact WHERE economic_index IS NOT NULL"


@query(
    "s_4_corr_by_region_spearman",
    "group " + CORR,
    f"WITH ranked AS ({RANKED_BY_REGION})\n RETURN " + corr_long_sql("ranked", NUMERIC, "region"),
)
def _(t):
    return statistics.corr_by(t.fact, "region", method="spearman")


@query(
    "s_4_corr_by_resource",
    "group " + CORR,
    corr_long_sql("fact", NUMERIC, "resource_type"),
)
def _(t):
    return statistics.corr_by(t.fact, "resource_type")


@query(
    "s_4_corr_by_month",
    "group " + CORR,
    corr_long_sql("fact", NUMERIC, "strftime(date, '%Y-%m')"),
)
def _(t):
    return statistics.corr_by(t.fact, F.date_format("date", "yyyy-MM"))


@query(
    "s_5_corr_t_statistic",
    "row column correlation:f dof:i t_stat:f",
    f"""SELECT "row", "column", correlation, n - 2 AS dof,
       correlation * sqrt((n - 2) / (1 - correlation * correlation)) AS t_stat
FROM ({corr_long_sql('daily', NUMERIC)}) WHERE "row" < "column" """,
)
def _(t):
    return statistics.corr_pvalue(statistics.corr_matrix(t.daily)).drop("p_value")


@query("s_5_corr_pvalue", "row column correlation:f dof:i t_stat:f p_value:f")
def _(t):
    return statistics.corr_pvalue(statistics.corr_matrix(t.daily))


@query(
    "s_6_corr_summary",
    "mean_abs:f max_abs:f std_abs:f strong:i moderate:i weak:i",
    f"""SELECT avg(r) AS mean_abs, max(r) AS max_abs, stddev_pop(r) AS std_abs,
       count(*) FILTER (WHERE r >= 0.7) AS strong, count(*) FILTER (WHERE r >= 0.3 AND r < 0.7) AS moderate,
       count(*) FILTER (WHERE r < 0.3) AS weak
FROM (SELECT abs(correlation) AS r FROM ({corr_long_sql('fact', NUMERIC)}) WHERE "row" < "column" AND correlation IS NOT NULL)""",
)
def _(t):
    return statistics.corr_summary(statistics.corr_matrix(t.fact))


@query(
    "s_7_pair_corr",
    "correlation:f strength",
    """SELECT r AS correlation, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM (SELECT corr(usage_cpu, usage_storage) AS r FROM usage)""",
)
def _(t):
    return statistics.pair_corr(t.usage, "usage_cpu", "usage_storage")


@query(
    "s_8_linear_trend",
    "slope:f intercept:f point:i x:f y:f",
    """SELECT slope, intercept, point, low + point * (high - low) / 99 AS x,
       intercept + slope * (low + point * (high - low) / 99) AS y
FROM (SELECT regr_slope(usage_cpu, users_active) AS slope, regr_intercept(usage_cpu, users_active) AS intercept,
             min(users_active) AS low, max(users_active) AS high, unnest(range(0, 100)) AS point FROM usage)""",
)
def _(t):
    return statistics.linear_trend(t.usage, "users_active", "usage_cpu")


@query(
    "s_9_trend_strength",
    "trend_strength:f",
    """SELECT corr(position, value) AS trend_strength
FROM (SELECT row_number() OVER (ORDER BY date) AS position, usage_cpu AS value FROM daily)""",
)
def _(t):
    return statistics.trend_strength(t.usage, "usage_cpu")


@query(
    "s_10_percentiles",
    "region p:f quantile:f",
    "\nUNION ALL ".join(
        f"SELECT region, {p} AS p, quantile_cont(usage_storage, {p}) AS quantile FROM usage GROUP BY region"
        for p in (0.75, 0.9, 0.95)
    ),
)
def _(t):
    return statistics.region_percentiles(t.usage, "usage_storage", [0.75, 0.9, 0.95])


@query("s_11_adf_test", "region adf_statistic:f lags:i n:i critical_5pct:f stationary")
def _(t):
    return statistics.adf_test(t.region_daily, ["region"], "usage_cpu")


KPSS_LAGS = 10


@query(
    "s_12_kpss_test",
    "region kpss_statistic:f lags:i critical_5pct:f stationary",
    "WITH res AS (SELECT region, date, usage_cpu - avg(usage_cpu) OVER (PARTITION BY region) AS e FROM rd),\n"
    "lagged AS (SELECT region, e, sum(e) OVER (PARTITION BY region ORDER BY date ROWS UNBOUNDED PRECEDING) AS s, "
    + ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, KPSS_LAGS + 1))
    + " FROM res WINDOW w AS (PARTITION BY region ORDER BY date))\n"
    + "RETURN SELECT *, kpss_statistic < 0.463 AS stationary FROM (SELECT region, "
    + "sum(s * s) / (count(*) * count(*)) / ((sum(e * e)"
    + "".join(f" + CAST(2 AS DOUBLE) * (1 - {k} / 11) * sum(e * e{k})" for k in range(1, KPSS_LAGS + 1))
    + f") / count(*)) AS kpss_statistic, {KPSS_LAGS} AS lags, CAST(0.463 AS DOUBLE) AS critical_5pct FROM lagged GROUP BY region)",
)
def _(t):
    return statistics.kpss_test(t.region_daily, ["region"], "usage_cpu", KPSS_LAGS)


@query("s_11_adf_auto", "region adf_statistic:f lags:i n:i p_value:f stationary")
def _(t):
    return stationarity.adf_auto(t.daily_series, ["region"], "usage_cpu")


@query(
    "s_12_kpss_auto",
    "region kpss_statistic:f lags:i p_value:f stationary",
    """WITH res AS (SELECT region, usage_cpu - avg(usage_cpu) OVER (PARTITION BY region) AS e,
                    row_number() OVER (PARTITION BY region ORDER BY date) AS i FROM rd),
sums AS (SELECT region, CAST(count(*) AS DOUBLE) AS n, sum(e * e) AS ee, sum(s * s) AS ss
         FROM (SELECT *, sum(e) OVER (PARTITION BY region ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM res) GROUP BY region),
pairs AS (SELECT a.region, a.i - b.i AS k, sum(a.e * b.e) AS p FROM res a JOIN res b ON a.region = b.region AND a.i > b.i GROUP BY ALL),
first_ AS (SELECT region, sum(p) AS p, sum(k * p) AS kp FROM pairs JOIN sums USING (region)
           WHERE k <= floor(pow(n, CAST(2 AS DOUBLE) / 9)) GROUP BY region),
sized AS (SELECT *, least(floor(CAST(1.1447 AS DOUBLE) * pow(pow((kp / (n / 2)) / (ee / n + p / (n / 2)), 2) * n, CAST(1 AS DOUBLE) / 3)), n - 1) AS lags
          FROM sums JOIN first_ USING (region)),
stat AS (SELECT region, any_value(lags) AS lags,
                any_value(ss / (n * n)) / ((any_value(ee) + 2 * coalesce(sum((1 - k / (lags + 1)) * pairs.p) FILTER (k <= lags), 0)) / any_value(n)) AS t
         FROM sized JOIN pairs USING (region) GROUP BY region),
valued AS (SELECT region, t AS kpss_statistic, lags, CAST(CASE WHEN t < 0.347 THEN 0.1
             WHEN t < 0.463 THEN 0.1 + (t - 0.347) * (0.05 - 0.1) / (0.463 - 0.347)
             WHEN t < 0.574 THEN 0.05 + (t - 0.463) * (0.025 - 0.05) / (0.574 - 0.463)
             WHEN t < 0.739 THEN 0.025 + (t - 0.574) * (0.01 - 0.025) / (0.739 - 0.574) ELSE 0.01 END AS DOUBLE) AS p_value FROM stat)
 RETURN SELECT *, p_value > 0.05 AS stationary FROM valued""",
)
def _(t):
    return stationarity.kpss_auto(t.daily_series, ["region"], "usage_cpu")


@query(
    "s_13_minmax_scale",
    "region date usage_cpu:f usage_cpu_scaled:f inverse:f",
    """SELECT region, date, usage_cpu, (usage_cpu - low) / nullif(high - low, 0) AS usage_cpu_scaled, usage_cpu AS inverse
FROM (SELECT *, min(usage_cpu) OVER (PARTITION BY region) AS low, max(usage_cpu) OVER (PARTITION BY region) AS high FROM rd)""",
)
def _(t):
    scaled = statistics.minmax_scale(t.region_daily, ["region"], "usage_cpu")
    back = statistics.minmax_inverse(F.col("usage_cpu_scaled"), F.col("low"), F.col("high"))
    return scaled.withColumn("inverse", back)


@query(
    "s_14_size_scale",
    "date region users_active:i marker_size:f",
    """SELECT date, region, users_active, (users_active - low) / (high - low) * 30 + 10 AS marker_size
FROM usage CROSS JOIN (SELECT min(users_active) AS low, max(users_active) AS high FROM usage)""",
)
def _(t):
    return size_scale(t.usage, "users_active")


@query(
    "s_15_ljung_box",
    "region metric_type model_type mean:f std:f n:i q_statistic:f",
    "WITH res AS (SELECT region, metric_type, model_type, prediction_date, actual_value - predicted_value AS e0 FROM preds),\n"
    "centred AS (SELECT *, e0 - avg(e0) OVER (PARTITION BY region, metric_type, model_type) AS e FROM res),\n"
    "lagged AS (SELECT *, "
    + ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 11))
    + " FROM centred WINDOW w AS (PARTITION BY region, metric_type, model_type ORDER BY prediction_date))\n"
    + "RETURN SELECT region, metric_type, model_type, avg(e0) AS mean, stddev_samp(e0) AS std, count(*) AS n, "
    + "count(*) * (count(*) + 2) * ("
    + " + ".join(f"(sum(e * e{k}) / sum(e * e)) ** 2 / (count(*) - {k})" for k in range(1, 11))
    + ") AS q_statistic FROM lagged GROUP BY region, metric_type, model_type",
)
def _(t):
    keys = ["region", "metric_type", "model_type"]
    return statistics.ljung_box(evaluation.residuals(t.predictions), keys, "residual", "prediction_date")


@query(
    "fn_date",
    "date month:i quarter:i weekday:i day:i week:i day_label month_label period next_day last_of_month days_since:i",
    """SELECT DISTINCT date, month(date) AS month, quarter(date) AS quarter, isodow(date) - 1 AS weekday, day(date) AS day,
       weekofyear(date) AS week, dayname(date) AS day_label, monthname(date) AS month_label,
       CAST(date_trunc('month', date) AS DATE) AS period, CAST(date + 1 AS DATE) AS next_day,
       last_day(date) AS last_of_month, date - DATE '1995-01-01' AS days_since FROM usage""",
)
def _(t):
    return t.usage.select("date").distinct().select(
        "date",
        F.month("date").alias("month"),
        F.quarter("date").alias("quarter"),
        F.weekday("date").alias("weekday"),
        F.day("date").alias("day"),
        F.weekofyear("date").alias("week"),
        day_name().alias("day_label"),
        month_name().alias("month_label"),
        F.trunc("date", "month").alias("period"),
        F.date_add("date", 1).alias("next_day"),
        F.last_day("date").alias("last_of_month"),
        F.datediff("date", F.lit("1995-01-01").cast("date")).alias("days_since"),
    )


@query(
    "fn_math",
    "region date rounded:f rooted:f distance:f clipped:f smaller:f larger:f powered:f percent:f",
    """SELECT region, date, round(usage_cpu, 1) AS rounded, sqrt(usage_storage) AS rooted, abs(usage_cpu - 50) AS distance,
       least(greatest(usage_cpu, 40), 60) AS clipped, least(usage_cpu, usage_storage) AS smaller,
       greatest(usage_cpu, usage_storage) AS larger, power(usage_cpu, 2) AS powered,
       usage_cpu / nullif(usage_storage, 0) * 100 AS percent FROM rd""",
)
def _(t):
    cpu, storage = F.col("usage_cpu"), F.col("usage_storage")
    return t.region_daily.select(
        "region",
        "date",
        F.round(cpu, 1).alias("rounded"),
        F.sqrt(storage).alias("rooted"),
        F.abs(cpu - 50).alias("distance"),
        clamp(cpu, 40, 60).alias("clipped"),
        F.least(cpu, storage).alias("smaller"),
        F.greatest(cpu, storage).alias("larger"),
        F.pow(cpu, F.lit(2)).alias("powered"),
        (ratio(cpu, storage) * 100).alias("percent"),
    )


@query(
    "fn_string",
    "region resource_type file_key lowered titled message rows:i",
    """SELECT region, resource_type, replace(region, ' ', '') || '_' || resource_type AS file_key, lower(resource_type) AS lowered,
       CASE region WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(region[1]) || lower(region[2:]) END AS titled,
       format('{:.1f}% of {}', max(usage_cpu), resource_type) AS message, count(*) AS rows
FROM usage GROUP BY region, resource_type""",
)
def _(t):
    grouped = t.usage.groupBy("region", "resource_type").agg(
        F.max("usage_cpu").alias("peak"), F.count("*").alias("rows")
    )
    return grouped.select(
        "region",
        "resource_type",
        F.concat_ws("_", F.replace("region", F.lit(" "), F.lit("")), "resource_type").alias("file_key"),
        F.lower("resource_type").alias("lowered"),
        F.initcap("region").alias("titled"),
        F.format_string("%.1f%% of %s", "peak", "resource_type").alias("message"),
        "rows",
    )


@query(
    "fn_array",
    "region month first_value:f last_value:f rolled_first:f total:f doubled_last:f days:i",
    """SELECT region, month, xs[1] AS first_value, xs[-1] AS last_value, xs[2] AS rolled_first,
       list_sum(xs[1:3]) AS total, xs[-1] * 2 AS doubled_last, len(xs) AS days
FROM (SELECT region, CAST(date_trunc('month', date) AS DATE) AS month, list(usage_cpu ORDER BY date) AS xs
      FROM rd GROUP BY region, CAST(date_trunc('month', date) AS DATE)) WHERE len(xs) > 3""",
)
def _(t):
    ordered = F.array_sort(F.collect_list(F.struct("date", "usage_cpu")))
    months = t.region_daily.groupBy("region", F.trunc("date", "month").alias("month")).agg(ordered.alias("pairs"))
    xs = F.transform("pairs", lambda p: p["usage_cpu"])
    months = months.withColumn("xs", xs).filter(F.size("xs") > 3)
    rolled = F.concat(F.slice("xs", 2, F.size("xs") - 1), F.slice("xs", 1, 1))
    return months.select(
        "region",
        "month",
        F.element_at("xs", 1).alias("first_value"),
        F.element_at("xs", -1).alias("last_value"),
        F.element_at(rolled, 1).alias("rolled_first"),
        F.aggregate(F.slice("xs", 1, 3), F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.element_at(F.transform("xs", lambda x: x * 2), -1).alias("doubled_last"),
        F.size("xs").alias("days"),
    )


@query(
    "fn_json",
    "region usage_cpu:f usage_storage:f users_active:f n_fields:i",
    """SELECT region, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       avg(users_active) AS users_active, 4 AS n_fields FROM usage GROUP BY region""",
)
def _(t):
    out = t.usage.groupBy("region").agg(*[F.avg(m).alias(m) for m in METRICS])
    text = out.select(F.to_json(F.struct("region", *METRICS)).alias("document"))
    parsed = F.from_json("document", out.schema)
    return text.select(
        F.size(F.json_object_keys("document")).alias("n_fields"), parsed.alias("d")
    ).select("d.*", "n_fields")


@query(
    "fn_cond",
    "region date level filled:f guarded:f as_text as_int:i",
    """SELECT region, date, CASE WHEN usage_cpu >= 80 THEN 'high' WHEN usage_cpu >= 40 THEN 'medium' ELSE 'low' END AS level,
       coalesce(economic_index, 0) AS filled, usage_cpu / nullif(users_active - 1000, 0) AS guarded,
       CAST(users_active AS VARCHAR) AS as_text, TRY_CAST(region AS INTEGER) AS as_int FROM rd""",
)
def _(t):
    cpu = F.col("usage_cpu")
    return t.region_daily.select(
        "region",
        "date",
        ladder([(cpu >= 80, "high"), (cpu >= 40, "medium")], "low").alias("level"),
        F.coalesce("economic_index", F.lit(0.0)).alias("filled"),
        ratio(cpu, F.nullif(F.col("users_active") - 1000, F.lit(0))).alias("guarded"),
        F.col("users_active").cast("string").alias("as_text"),
        F.col("region").try_cast("int").alias("as_int"),
    )
