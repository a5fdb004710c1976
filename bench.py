"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed
runs per query (the median counts). Every run computes the query from the raw tables:
nothing is cached between runs. BENCH_QUERIES may list other query names.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import CATALOG
from tidemark.session import get_session

HEADLINE = """
a_1_region_daily a_4_kpis a_7_sparklines a_8_time_series a_11_regional_comparison a_14_regional_share
a_19_holiday_calendar a_23_data_summary a_48_holiday_effect a_52_behaviour_intelligence a_58_multi_level_summary
f_15_median_fill j_1_merge_external w_3_rolling_mean w_7_group_max_ratio w_16_iqr_anomalies w_17_peaks_valleys
w_19_seasonal_decompose w_21_forward_fill s_1_corr_matrix s_2_corr_matrix_spearman s_12_kpss_test
m_1_feature_frame_cpu m_10_baseline_forecast m_14_error_metrics m_20_select_best m_3_fit_ar m_5_forecast_ar
m_9_forecast_window m_6_fit_gbt m_17_backtest_rolling_origin m_18_cross_validate g_4_upsert_best_model g_14_training_report mon_1_measured_accuracy c_8_capacity_plan
c_11_capacity_report st_1_stream_daily
""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    CATALOG["a_11_regional_comparison"].run(spark, folder).collect()
    timings: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(took), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
