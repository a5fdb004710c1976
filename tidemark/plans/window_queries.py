"""Window and time-series queries over the regional daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as win
from .catalog import query

W = "WINDOW w AS (PARTITION BY region ORDER BY date)"
KEYS = ["region"]


def frame(n: int) -> str:
    return f"(PARTITION BY region ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(fn: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame(n)} = {n} THEN {fn}({c}) OVER {frame(n)} END"


CENTRED = "(PARTITION BY region ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
SMOOTH = f"CASE WHEN count(usage_cpu) OVER {CENTRED} = 7 THEN avg(usage_cpu) OVER {CENTRED} END"


@query(
    "w_1_lag_features",
    "region date usage_cpu_lag1:f usage_cpu_lag7:f usage_cpu_lag30:f users_active_lag1:i "
    "users_active_lag7:i users_active_lag30:i",
    "SELECT region, date, "
    + ", ".join(
        f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in ("usage_cpu", "users_active") for k in (1, 7, 30)
    )
    + f" FROM rd {W}",
)
def _(t):
    return win.lag_features(t.region_daily, KEYS, ["usage_cpu", "users_active"], [1, 7, 30])


@query(
    "w_2_rolling_mean_partial",
    "region date usage_cpu_roll7:f users_active_roll7:f",
    f"""SELECT region, date, avg(usage_cpu) OVER {frame(7)} AS usage_cpu_roll7,
       avg(users_active) OVER {frame(7)} AS users_active_roll7 FROM rd""",
)
def _(t):
    return win.rolling_mean_partial(t.region_daily, KEYS, ["usage_cpu", "users_active"])


@query(
    "w_3_rolling_mean",
    "region date usage_cpu_mean7:f usage_cpu_mean14:f usage_cpu_mean30:f",
    "SELECT region, date, "
    + ", ".join(f"{full('avg', 'usage_cpu', n)} AS usage_cpu_mean{n}" for n in (7, 14, 30))
    + " FROM rd",
)
def _(t):
    return win.rolling_mean(t.region_daily, KEYS, "usage_cpu", [7, 14, 30])


@query(
    "w_4_rolling_std",
    "region date usage_cpu_std7:f",
    f"SELECT region, date, {full('stddev_samp', 'usage_cpu', 7)} AS usage_cpu_std7 FROM rd",
)
def _(t):
    return win.rolling_std(t.region_daily, KEYS, "usage_cpu")


@query(
    "w_5_rolling_holiday_count",
    "region date holiday_count7:i",
    f"SELECT region, date, {full('sum', 'holiday', 7)} AS holiday_count7 FROM rd",
)
def _(t):
    return win.rolling_holiday_count(t.region_daily, KEYS)


@query(
    "w_6_centered_smooth",
    "region date usage_cpu_smooth:f",
    f"SELECT region, date, {SMOOTH} AS usage_cpu_smooth FROM rd",
)
def _(t):
    return win.centered_smooth(t.region_daily, KEYS, "usage_cpu")


@query(
    "w_7_group_max_ratio",
    "date region resource_type cpu_utilization:f storage_efficiency:f",
    """SELECT date, region, u.resource_type, usage_cpu / max_cpu AS cpu_utilization,
       usage_storage / max_storage AS storage_efficiency
FROM usage u JOIN (SELECT resource_type, max(usage_cpu) AS max_cpu, max(usage_storage) AS max_storage
                   FROM usage GROUP BY resource_type) m ON u.resource_type = m.resource_type""",
)
def _(t):
    return win.group_max_ratio(t.usage)


@query(
    "w_8_time_idx",
    "region resource_type date time_idx:i",
    """SELECT region, resource_type, date,
       row_number() OVER (PARTITION BY region, resource_type ORDER BY date) - 1 AS time_idx
FROM (SELECT DISTINCT region, resource_type, date FROM usage)""",
)
def _(t):
    from ..operators.aggregates import resource_region_daily

    return win.time_idx(resource_region_daily(t.fact), ["region", "resource_type"])


@query(
    "w_11_recent_vs_first",
    "region recent_avg:f first_avg:f current:f days:i trend_rate:f",
    """SELECT region, recent_avg, first_avg, current, days, (recent_avg - first_avg) / 7 AS trend_rate FROM (
  SELECT region, avg(usage_cpu) FILTER (WHERE down <= 7) AS recent_avg,
         avg(usage_cpu) FILTER (WHERE up <= 7) AS first_avg,
         max(usage_cpu) FILTER (WHERE down = 1) AS current, count(*) AS days
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS up,
               row_number() OVER (PARTITION BY region ORDER BY date DESC) AS down FROM rd)
  GROUP BY region)""",
)
def _(t):
    return win.recent_vs_first(t.region_daily, KEYS, "usage_cpu")


@query(
    "w_12_period_change",
    "region first_value:f last_value:f days:i change_pct:f",
    """SELECT *, CASE WHEN days > 1 THEN (last_value - first_value) / nullif(first_value, 0) * 100 END AS change_pct
FROM (SELECT region, arg_min(usage_cpu, date) AS first_value, arg_max(usage_cpu, date) AS last_value,
             count(*) AS days FROM rd GROUP BY region)""",
)
def _(t):
    return win.period_change(t.region_daily, KEYS, "usage_cpu")


@query(
    "w_13_momentum",
    "region recent_avg:f overall_avg:f momentum_pct:f momentum",
    """SELECT *, CASE WHEN momentum_pct > 10 THEN 'Strong Upward' WHEN momentum_pct < -10 THEN 'Strong Downward'
              ELSE 'Stable' END AS momentum FROM (
  SELECT *, (recent_avg - overall_avg) / overall_avg * 100 AS momentum_pct FROM (
    SELECT region, avg(usage_cpu) FILTER (WHERE down <= 7) AS recent_avg, avg(usage_cpu) AS overall_avg
    FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS down FROM rd) GROUP BY region))""",
)
def _(t):
    return win.momentum(t.region_daily, KEYS, "usage_cpu")


TREND_SQL = f"""SELECT *, CASE WHEN overall_trend > 0.05 THEN 'improving' WHEN overall_trend < -0.05 THEN 'declining'
       ELSE 'stable' END AS trend FROM (
  SELECT *, (cpu_trend + users_trend) / 2 AS overall_trend FROM (
    SELECT region, avg(dc) AS cpu_trend, avg(du) AS users_trend FROM (
      SELECT region, sc / lag(sc) OVER w - 1 AS dc, su / lag(su) OVER w - 1 AS du FROM (
        SELECT region, date, rn, {full('avg', 'usage_cpu', 7)} AS sc, {full('avg', 'users_active', 7)} AS su
        FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS rn FROM rd) WHERE rn <= 30)
      WHERE rn <= 7 {W})
    GROUP BY region))"""


@query("w_14_rolling_trend", "region cpu_trend:f users_trend:f overall_trend:f trend", TREND_SQL)
def _(t):
    return win.rolling_trend(t.region_daily, KEYS)


@query(
    "w_15_difference",
    "region date usage_cpu:f usage_cpu_diff:f reconstructed:f",
    f"""SELECT region, date, usage_cpu, usage_cpu - lag(usage_cpu) OVER w AS usage_cpu_diff,
       usage_cpu AS reconstructed FROM rd {W}""",
)
def _(t):
    diffs = win.difference(t.region_daily, KEYS, "usage_cpu")
    first = diffs.groupBy("region").agg(F.min_by("usage_cpu", "date").alias("level"))
    return win.reconstruct(diffs.join(first, "region"), KEYS, "usage_cpu_diff", "level")


@query(
    "w_16_iqr_anomalies",
    "region date usage_cpu:f lower:f upper:f",
    f"""SELECT r.region, date, usage_cpu, lower, upper FROM rd r
JOIN (SELECT region, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
        SELECT region, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3
        FROM (SELECT region, {SMOOTH} AS s FROM rd) GROUP BY region)) b ON r.region = b.region
WHERE usage_cpu < lower OR usage_cpu > upper""",
)
def _(t):
    return win.iqr_anomalies(t.region_daily, KEYS, "usage_cpu")


OUTLIERS = """SELECT date, region, u.resource_type, usage_storage, lower, upper FROM usage u
JOIN (SELECT resource_type, q1 - {k} * (q3 - q1) AS lower, q3 + {k} * (q3 - q1) AS upper FROM (
        SELECT resource_type, quantile_cont(usage_storage, 0.25) AS q1, quantile_cont(usage_storage, 0.75) AS q3
        FROM usage GROUP BY resource_type)) b ON u.resource_type = b.resource_type
WHERE usage_storage < lower OR usage_storage > upper"""


@query(
    "w_16_iqr_outliers_default",
    "date region resource_type usage_storage:f lower:f upper:f",
    OUTLIERS.format(k=1.5),
)
def _(t):
    return win.iqr_outliers(t.usage, ["resource_type"], "usage_storage")


@query(
    "w_16_iqr_outliers",
    "date region resource_type usage_storage:f lower:f upper:f",
    OUTLIERS.format(k=0.5),
)
def _(t):
    return win.iqr_outliers(t.usage, ["resource_type"], "usage_storage", k=0.5)


@query(
    "w_17_peaks_valleys",
    "region date value:f kind",
    """WITH marked AS (
  SELECT region, date, usage_cpu AS value, row_number() OVER w AS idx,
         CASE WHEN usage_cpu = lag(usage_cpu) OVER w THEN 0 ELSE 1 END AS starts
  FROM rd WINDOW w AS (PARTITION BY region ORDER BY date)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY region ORDER BY idx) AS run FROM marked),
runs AS (SELECT region, run, min(value) AS value, (min(idx) + max(idx)) // 2 AS idx FROM numbered GROUP BY region, run),
sided AS (SELECT *, lag(value) OVER w AS before, lead(value) OVER w AS after FROM runs
          WINDOW w AS (PARTITION BY region ORDER BY run)),
limits AS (SELECT region, quantile_cont(usage_cpu, 0.75) AS high, quantile_cont(usage_cpu, 0.25) AS low FROM rd GROUP BY region)
RETURN SELECT m.region, m.date, m.value,
       CASE WHEN s.value > before THEN 'peak' ELSE 'valley' END AS kind
FROM sided s JOIN limits l ON s.region = l.region JOIN marked m ON m.region = s.region AND m.idx = s.idx
WHERE (s.value > before AND s.value > after AND s.value >= high)
   OR (s.value < before AND s.value < after AND s.value <= low)""",
)
def _(t):
    return win.peaks_valleys(t.region_daily, KEYS, "usage_cpu")


@query(
    "w_18_sequence_windows",
    "region date steps:i oldest:f newest:f weighted:f target:f",
    "\nUNION ALL ".join(
        f"""SELECT region, date, {n} AS steps, xs[1] AS oldest, xs[{n}] AS newest,
       list_sum(list_transform(xs, lambda x, i: x * i)) AS weighted, usage_cpu AS target
FROM (SELECT region, date, usage_cpu,
             list(usage_cpu) OVER (PARTITION BY region ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS xs FROM rd)
WHERE len(xs) = {n}"""
        for n in (7, 14, 21)
    ),
)
def _(t):
    out = None
    for n in (7, 14, 21):
        weighted = F.transform("window", lambda x, i: x * (i + 1))
        w = win.sequence_windows(t.region_daily, KEYS, "usage_cpu", n).select(
            "region",
            "date",
            F.lit(n).alias("steps"),
            F.element_at("window", 1).alias("oldest"),
            F.element_at("window", -1).alias("newest"),
            F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x).alias("weighted"),
            F.col("target")[0].alias("target"),
        )
        out = w if out is None else out.unionByName(w)
    return out


@query(
    "w_18_sequence_windows_30_to_7",
    "region date oldest:f newest:f first_target:f last_target:f",
    f"""SELECT region, date, lag(usage_cpu, 30) OVER w AS oldest, lag(usage_cpu, 1) OVER w AS newest,
       usage_cpu AS first_target, lead(usage_cpu, 6) OVER w AS last_target FROM rd
{W} QUALIFY oldest IS NOT NULL AND last_target IS NOT NULL""",
)
def _(t):
    return win.sequence_windows(t.region_daily, KEYS, "usage_cpu", 30, 7).select(
        "region",
        "date",
        F.element_at("window", 1).alias("oldest"),
        F.element_at("window", -1).alias("newest"),
        F.element_at("target", 1).alias("first_target"),
        F.element_at("target", -1).alias("last_target"),
    )


@query(
    "w_19_seasonal_decompose",
    "region date value:f trend:f seasonal:f residual:f",
    f"""WITH base AS (SELECT region, date, usage_cpu AS value, {SMOOTH} AS trend,
       (row_number() OVER (PARTITION BY region ORDER BY date) - 1) % 7 AS phase FROM rd),
phases AS (SELECT region, phase, avg(value - trend) AS raw FROM base GROUP BY region, phase),
season AS (SELECT region, phase, raw - avg(raw) OVER (PARTITION BY region) AS seasonal FROM phases)
RETURN SELECT b.region, date, value, trend, seasonal, value - trend - seasonal AS residual
FROM base b JOIN season s ON b.region = s.region AND b.phase = s.phase""",
)
def _(t):
    return win.seasonal_decompose(t.region_daily, KEYS, "usage_cpu")


CALENDAR = """calendar AS (SELECT region, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
       FROM usage GROUP BY region),
filled AS (SELECT c.region, c.date, r.usage_cpu, r.users_active FROM calendar c
           LEFT JOIN rd r ON c.region = r.region AND c.date = r.date)"""


@query(
    "w_20_as_daily_freq",
    "region date usage_cpu:f users_active:i",
    f"WITH {CALENDAR}\n RETURN SELECT * FROM filled",
)
def _(t):
    return win.as_daily_freq(t.daily_series, KEYS)


@query(
    "w_21_forward_fill",
    "region date usage_cpu:f users_active:i",
    f"""WITH {CALENDAR}
 RETURN SELECT region, date, last_value(usage_cpu IGNORE NULLS) OVER w AS usage_cpu,
       last_value(users_active IGNORE NULLS) OVER w AS users_active FROM filled
WINDOW w AS (PARTITION BY region ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(t):
    daily = win.as_daily_freq(t.daily_series, KEYS)
    return win.forward_fill(daily, KEYS, ["usage_cpu", "users_active"])


@query(
    "w_22_weekly_resample",
    "week_end usage_cpu:f usage_storage:f users_active:i",
    """SELECT CAST(date + CAST((8 - isodow(date)) % 7 AS INTEGER) AS DATE) AS week_end, avg(usage_cpu) AS usage_cpu,
       avg(usage_storage) AS usage_storage, sum(users_active) AS users_active
FROM usage GROUP BY 1""",
)
def _(t):
    return win.weekly_resample(t.usage)


@query(
    "w_23_calendar_features",
    "date year:i month:i day:i weekday:i quarter:i weekofyear:i is_month_start:i is_month_end:i is_weekend:i rows:i",
    """SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS weekday,
       quarter(date) AS quarter, weekofyear(date) AS weekofyear,
       CASE WHEN day(date) = 1 THEN 1 ELSE 0 END AS is_month_start,
       CASE WHEN date = last_day(date) THEN 1 ELSE 0 END AS is_month_end,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, count(*) AS rows FROM usage GROUP BY date""",
)
def _(t):
    return win.calendar_features(t.usage.groupBy("date").agg(F.count("*").alias("rows")))


def split_sql(train: float, validation: float) -> str:
    return f"""SELECT region, date, position, CASE WHEN position <= train_end THEN 'train'
       WHEN position <= train_end + validation_n THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, floor(CAST({train} AS DOUBLE) * n) AS train_end, floor(CAST({validation} AS DOUBLE) * n) AS validation_n
      FROM (SELECT region, date, row_number() OVER (PARTITION BY region ORDER BY date) AS position,
                   count(*) OVER (PARTITION BY region) AS n FROM rd))"""


@query("w_24_chronological_split", "region date position:i split", split_sql(0.8, 0.0))
def _(t):
    return win.chronological_split(t.region_daily, KEYS, 0.8)


@query("w_24_chronological_split_three", "region date position:i split", split_sql(0.7, 0.15))
def _(t):
    return win.chronological_split(t.region_daily, KEYS, 0.7, 0.15)


@query("w_25_hash_split", "region split days:i")
def _(t):
    split = win.hash_split(t.region_daily, ["region", "date"])
    return split.groupBy("region", "split").agg(F.count("*").alias("days"))


@query(
    "w_26_rolling_origin_folds",
    "region fold:i role first_date last_date days:i",
    """SELECT region, fold, role, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM (
  SELECT *, CASE WHEN position < n - (6 - fold) * size THEN 'train'
                 WHEN position < n - (6 - fold) * size + size THEN 'test' END AS role
  FROM (SELECT region, date, position, n, n // 6 AS size, unnest([1, 2, 3, 4, 5]) AS fold
        FROM (SELECT region, date, row_number() OVER (PARTITION BY region ORDER BY date) - 1 AS position,
                     count(*) OVER (PARTITION BY region) AS n FROM rd)))
WHERE role IS NOT NULL GROUP BY region, fold, role""",
)
def _(t):
    return win.rolling_origin_folds(t.region_daily, KEYS, 5).groupBy("region", "fold", "role").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days")
    )


@query(
    "w_27_weekly_seasonality_flag",
    "weekday_variance:f volatility:f strong_weekly_seasonality",
    """SELECT *, weekday_variance > volatility * 0.5 AS strong_weekly_seasonality FROM (
  SELECT (SELECT var_samp(v) FROM (SELECT avg(usage_cpu) AS v FROM daily GROUP BY isodow(date))) AS weekday_variance,
         (SELECT stddev_samp(usage_cpu) FROM daily) AS volatility)""",
)
def _(t):
    return win.weekly_seasonality_flag(t.usage, "usage_cpu")


@query(
    "w_28_current_vs_mean_flag",
    "metric current:f mean:f flag",
    """WITH base AS (SELECT arg_max(usage_cpu, date) AS c, avg(usage_cpu) AS cm, arg_max(usage_storage, date) AS s,
       avg(usage_storage) AS sm, arg_max(users_active, date) AS u, avg(users_active) AS um FROM daily)
RETURN SELECT 'usage_cpu' AS metric, c AS current, cm AS mean,
       CASE WHEN c > cm * 1.2 THEN 'High CPU Alert' WHEN c < cm * 0.8 THEN 'CPU Optimized' ELSE 'CPU Normal' END AS flag FROM base
UNION ALL SELECT 'usage_storage', s, sm, CASE WHEN s > sm * 1.15 THEN 'Storage Growth' ELSE 'Storage Stable' END FROM base
UNION ALL SELECT 'users_active', u, um, CASE WHEN u > um * 1.1 THEN 'User Growth'
       WHEN u < um * 0.9 THEN 'User Decline' ELSE 'Users Stable' END FROM base""",
)
def _(t):
    return win.current_vs_mean_flag(t.usage)
