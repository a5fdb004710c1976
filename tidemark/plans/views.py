"""SQL views shared by the result checks, in dependency order."""

from __future__ import annotations

import re

from ..functions.digest import row_hash_sql

USAGE_HASH = row_hash_sql(
    {"date": "", "region": "", "resource_type": "", "usage_cpu": "double", "usage_storage": "double", "users_active": ""}
)

VIEWS: dict[str, str] = {
    "usage": """
SELECT CAST(l.l_shipdate AS DATE) AS date, r.r_name AS region,
       CASE l.l_returnflag WHEN 'A' THEN 'VM' WHEN 'N' THEN 'Storage' ELSE 'Container' END AS resource_type,
       l.l_quantity * 2 AS usage_cpu, l.l_extendedprice / 50 AS usage_storage,
       CAST(200 + o.o_custkey % 300 AS BIGINT) AS users_active
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "external": """
SELECT CAST(o_orderdate AS DATE) AS date, AVG(o_totalprice) / 2500 AS economic_index,
       CAST(COUNT(*) AS DOUBLE) / CAST(6 AS DOUBLE) AS cloud_market_demand,
       CAST(CASE WHEN isodow(CAST(o_orderdate AS DATE)) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS holiday
FROM orders GROUP BY CAST(o_orderdate AS DATE)""",
    "merged": """
SELECT u.date, u.region, u.resource_type, u.usage_cpu, u.usage_storage, u.users_active,
       e.economic_index, e.cloud_market_demand, e.holiday
FROM usage u LEFT JOIN external e ON u.date = e.date""",
    "fact": """
SELECT * REPLACE (coalesce(holiday, 0) AS holiday), month(date) AS month, quarter(date) AS quarter,
       CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend
FROM merged""",
    "rd": """
SELECT region, date, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       CAST(sum(users_active) AS BIGINT) AS users_active, max(economic_index) AS economic_index,
       max(cloud_market_demand) AS cloud_market_demand, max(holiday) AS holiday
FROM fact GROUP BY region, date""",
    "rdm": """
SELECT region, date, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       avg(users_active) AS users_active, max(economic_index) AS economic_index,
       max(cloud_market_demand) AS cloud_market_demand, max(holiday) AS holiday
FROM fact GROUP BY region, date""",
    "daily": """
SELECT date, avg(usage_cpu) AS usage_cpu, avg(usage_storage) AS usage_storage,
       avg(users_active) AS users_active, avg(economic_index) AS economic_index,
       avg(cloud_market_demand) AS cloud_market_demand
FROM fact GROUP BY date""",
    "behaviour": """
SELECT *, CASE WHEN isodow(date) >= 6 OR (month(date) = 1 AND day(date) = 1)
                 OR (month(date) = 7 AND day(date) = 4) OR (month(date) = 12 AND day(date) IN (25, 31))
            THEN 1 ELSE 0 END AS is_holiday,
       usage_cpu / (users_active + 1) AS cpu_per_user,
       usage_storage / (users_active + 1) AS storage_per_user,
       users_active / (usage_cpu + 1) * 100 AS user_efficiency
FROM usage""",
    "rdlong": """
SELECT region, date, 'cpu' AS metric_type, usage_cpu AS value FROM rd
UNION ALL SELECT region, date, 'users', CAST(users_active AS DOUBLE) FROM rd
UNION ALL SELECT region, date, 'storage', usage_storage FROM rd""",
    "preds": """
SELECT region, model_type, metric_type, date AS prediction_date, predicted AS predicted_value,
       value AS actual_value, abs(value - predicted) AS absolute_error,
       abs(value - predicted) / nullif(abs(value), 0) * 100 AS percentage_error
FROM (
  SELECT region, metric_type, date, value, unnest(['SeasonalNaive', 'Naive', 'WeeklyMean']) AS model_type,
         unnest([l7, l1, m7]) AS predicted
  FROM (SELECT *, lag(value, 7) OVER w AS l7, lag(value, 1) OVER w AS l1,
               CASE WHEN count(value) OVER (PARTITION BY region, metric_type ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7
                    THEN avg(value) OVER (PARTITION BY region, metric_type ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS m7
        FROM rdlong WINDOW w AS (PARTITION BY region, metric_type ORDER BY date))
) WHERE predicted IS NOT NULL""",
    "registry": """
SELECT region, metric_type, model_type, rmse, mae, mape, training_date, data_hash, data_size,
       row_number() OVER (PARTITION BY region, metric_type, training_date ORDER BY round(rmse, 6), model_type) = 1 AS is_active
FROM (SELECT region, metric_type, model_type, sqrt(avg(absolute_error * absolute_error)) AS rmse,
             avg(absolute_error) AS mae, avg(percentage_error) AS mape,
             CAST(date_trunc('quarter', prediction_date) AS DATE) AS training_date,
             CAST(count(*) AS VARCHAR) || ':' || CAST(CAST(date_trunc('quarter', prediction_date) AS DATE) AS VARCHAR) AS data_hash,
             count(*) AS data_size
      FROM preds GROUP BY region, metric_type, model_type, CAST(date_trunc('quarter', prediction_date) AS DATE))""",
    "monitoring": """
SELECT check_date, CAST(sum(new_records) OVER (ORDER BY check_date) AS VARCHAR) || ':' ||
       CAST(sum(hash_sum) OVER (ORDER BY check_date) % 1152921504606846976 AS VARCHAR) || ':' ||
       CAST(bit_xor(hash_xor) OVER (ORDER BY check_date) AS VARCHAR) AS data_hash,
       CAST(sum(new_records) OVER (ORDER BY check_date) AS BIGINT) AS data_size, new_records,
       CASE WHEN row_number() OVER (ORDER BY check_date) = 1 THEN TRUE
            ELSE new_records * 100.0 / (sum(new_records) OVER (ORDER BY check_date) - new_records) >= 5 END AS training_triggered
FROM (SELECT last_day(date) AS check_date, count(*) AS new_records, CAST(sum(CAST(h AS HUGEINT)) AS HUGEINT) AS hash_sum,
             bit_xor(h) AS hash_xor
      FROM (SELECT date, """ + USAGE_HASH + """ AS h FROM usage) GROUP BY last_day(date))""",
    "best_model": """
SELECT region, metric_type, arg_min(model_type, struct_pack(r := round(rmse, 6), m := model_type)) AS model_type,
       min(rmse) AS rmse, arg_min(mae, struct_pack(r := round(rmse, 6), m := model_type)) AS mae,
       arg_min(mape, struct_pack(r := round(rmse, 6), m := model_type)) AS mape, max(training_date) AS updated_date
FROM registry WHERE training_date = (SELECT max(training_date) FROM registry)
GROUP BY region, metric_type""",
    "forecast": """
SELECT f.region, f.metric_type, s.step, CAST(f.last_date + CAST(s.step AS INTEGER) AS DATE) AS date, f.predicted
FROM (SELECT region, metric_type, row_number() OVER (PARTITION BY region, metric_type ORDER BY date) AS pos,
             max(date) OVER (PARTITION BY region, metric_type) AS last_date, greatest(value, 0) AS predicted
      FROM (SELECT *, row_number() OVER (PARTITION BY region, metric_type ORDER BY date DESC) AS rn FROM rdlong)
      WHERE rn <= 7) f
JOIN (SELECT unnest(range(1, 31)) AS step) s ON (s.step - 1) % 7 + 1 = f.pos""",
    "capacity": """
SELECT region, 'Compute' AS service, 'cpu' AS metric_type,
       greatest(quantile_cont(usage_cpu, 0.95) * 1.2 * 15, 1000) AS current_capacity FROM rd GROUP BY region
UNION ALL SELECT region, 'Users', 'users', greatest(max(users_active) * 1.1, 1000) FROM rd GROUP BY region
UNION ALL SELECT region, 'Storage', 'storage', greatest(quantile_cont(usage_storage, 0.95) * 1.15, 1000) FROM rd GROUP BY region""",
    "demand": """
SELECT region, metric_type, max(predicted) AS max_demand, avg(predicted) AS avg_demand,
       min(predicted) AS min_demand, count(*) AS days
FROM forecast GROUP BY region, metric_type""",
    "risk": """
SELECT region, service, current_capacity, max_demand, avg_demand, min_demand, days,
       max_demand / current_capacity * 100 AS peak_pct, avg_demand / current_capacity * 100 AS avg_pct,
       CASE WHEN max_demand / current_capacity * 100 >= 95 THEN 'HIGH'
            WHEN max_demand / current_capacity * 100 >= 75 THEN 'MEDIUM' ELSE 'LOW' END AS utilization_risk,
       CASE WHEN max_demand / current_capacity * 100 >= 95 THEN 'Critical capacity shortage imminent'
            WHEN max_demand / current_capacity * 100 >= 85 THEN 'High capacity utilization - monitor closely'
            WHEN max_demand / current_capacity * 100 >= 75 THEN 'Moderate capacity pressure'
            ELSE 'Adequate capacity available' END AS utilization_message,
       CASE WHEN avg_demand / current_capacity * 100 <= 25 THEN 'MEDIUM'
            WHEN avg_demand / current_capacity * 100 >= 80 THEN 'HIGH' ELSE 'LOW' END AS provision_risk,
       CASE WHEN avg_demand / current_capacity * 100 <= 25 THEN 'Potential over-provisioning detected'
            WHEN avg_demand / current_capacity * 100 >= 80 THEN 'Under-provisioning risk'
            ELSE 'Optimal provisioning level' END AS provision_message
FROM demand JOIN capacity USING (region, metric_type)""",
    "overall": """
SELECT *, CASE WHEN 'HIGH' IN (utilization_risk, provision_risk) THEN 'HIGH'
               WHEN 'MEDIUM' IN (utilization_risk, provision_risk) THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk
FROM risk""",
    "recommendations": """
SELECT region, service, 'SCALE_UP' AS type, 'HIGH' AS priority,
       'Add +' || CAST(CAST(trunc(max_demand * 1.25 - current_capacity) AS BIGINT) AS VARCHAR) || ' ' || lower(service) || ' units' AS action,
       'Immediate (within 1 week)' AS timeline, 'Critical - prevents service disruption' AS impact
FROM overall WHERE peak_pct >= 95
UNION ALL
SELECT region, service, 'SCALE_UP', 'MEDIUM',
       'Add +' || CAST(CAST(trunc(max_demand * 1.15 - current_capacity) AS BIGINT) AS VARCHAR) || ' ' || lower(service) || ' units',
       'Within 2 weeks', 'Preventive - maintains service quality'
FROM overall WHERE peak_pct >= 85 AND peak_pct < 95
UNION ALL
SELECT region, service, 'OPTIMIZE', 'LOW',
       'Consider reducing -' || CAST(CAST(trunc(current_capacity - avg_demand * 1.5) AS BIGINT) AS VARCHAR) || ' ' || lower(service) || ' units',
       'Next quarter review', 'Cost savings opportunity'
FROM overall WHERE avg_pct <= 25 AND trunc(current_capacity - avg_demand * 1.5) > 0
UNION ALL
SELECT region, service, 'MONITOR', 'LOW', 'Continue monitoring current capacity', 'Ongoing monitoring', 'Stable operations'
FROM overall WHERE peak_pct < 85 AND NOT (avg_pct <= 25 AND trunc(current_capacity - avg_demand * 1.5) > 0)""",
}


def needed(text: str) -> list[str]:
    """The view definitions ``text`` refers to, directly or through other views."""
    wanted: set[str] = set()
    frontier = [text]
    while frontier:
        body = frontier.pop()
        for name, sql in VIEWS.items():
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
                wanted.add(name)
                frontier.append(sql)
    return [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in wanted]
