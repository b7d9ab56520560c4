"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  directory of driver tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lendbook.catalog import all_queries  # noqa: E402
from lendbook.session import build_session  # noqa: E402
from lendbook.sources.star import load_portfolio  # noqa: E402

HEADLINE = [
    "q_portfolio_overview", "q_funnel_reached", "q_processing_times", "q_monthly_trend",
    "q_seg_all", "q_status_mix", "q_par", "q_conc_business", "q_top_customers",
    "q_cohort_snapshot", "q_repeat_customers", "vw_portfolio_performance",
    "vw_default_analysis", "vw_customer_exposure", "dq_suite", "dq_orphans", "dq_missingness",
    "feat_clean_table", "feat_model_table", "eda_numeric_summary", "eda_default_rate_tables",
    "eda_correlation", "eda_wilcoxon", "eda_chi_square", "ev_compare", "ev_calibration",
    "sc_apply", "sc_band_summary", "ml_group_split", "ml_fold_report", "ml_logistic",
    "ml_cv_metrics", "sc_apply_stream", "sc_apply_stream_model", "db_kpis",
    "ml_rf_tuning",     # the longest, last; every forest is fitted on all rows outside its fold
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench", driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    failed: dict[str, str] = {}

    def timed(name, work) -> None:
        start = time.perf_counter()
        try:
            work()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:      # one query's failure must not hide the others' times
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"

    timed("load_portfolio", lambda: load_portfolio(spark, sf_dir))
    catalog = all_queries()
    for name in HEADLINE:
        timed(name, lambda: catalog[name](spark, sf_dir)
              .write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "failed": failed,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
