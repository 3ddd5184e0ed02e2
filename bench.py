"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once to warm up, then 3 times; the median wall time is
reported. Queries are executed with the ``noop`` sink, so the whole plan
runs (every row is produced) without collecting results to the driver.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ML16_build_master", "ML17_build_timeline", "A1_group_median", "A6_quantile_thresholds", "J1_join_priors",
    "J9_nearest_centroid_emb", "J12_tiered_match", "W4_interpolate_linear", "W9_binary_above_median_eval",
    "M2_stratified_split", "M8_preprocess_table", "ML11_classify_with_constraints", "ML14_simulate_climate_risk",
    "S6_keyed_maps_to_rows", "Q2_integrity_report", "X21_nutrient_advice",
]

# Model training and forecasts: timed once, without a warm-up, and reported beside the headline value.
HEAVY = ["W7_arima_forecast", "W8_forecast_with_fallback", "M11_smote"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from agrispark.session import get_session
    from agrispark.plans.registry import load_all
    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="agrispark-bench",
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    if os.environ.get("BENCH_ALL"):
        names = list(reg)
    times = {}
    for n in names:
        fn = reg[n].fn
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs = []
            for _ in range(repeats):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            times[n] = round(statistics.median(runs), 3)
        except Exception as e:  # report, keep going
            print(f"# {n} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    heavy = {}
    for n in [n for n in HEAVY if n in reg and not os.environ.get("BENCH_ALL")]:
        t0 = time.perf_counter()
        try:
            reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            heavy[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:
            print(f"# {n} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "heavy": heavy, "sf": sf, "cpus": int(cpus), "repeats": repeats,
           "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "spark": spark.version}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
