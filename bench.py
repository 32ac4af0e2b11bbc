"""Wall-clock of the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs
per query after one that warms up; the median counts. A query that has taken ``ENOUGH`` seconds is not
run again. Model fits run once, and none is begun after ``BENCH_BUDGET`` seconds; ``quality`` has the scores of
one model for all hours and of two and three bands, on the same split.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from slotlake.catalog import QUERIES, models  # noqa: E402
from slotlake.plans import training  # noqa: E402
from slotlake.session import get_spark  # noqa: E402

HEADLINE = [
    "features_ready", "features_ready_events", "etl_from_raw", "star_join", "weather_join",
    "popular_hour", "dinner_ratio", "area_density", "lead_time", "payday_distance", "holiday_range_join",
    "clean_orders", "parse_datetime", "get_duplicates", "dedupe_keep_last", "constraint_report",
    "describe_numeric", "profile_numeric", "correlation_matrix", "value_counts", "segment_summary", "rfm_features",
    "split_random", "split_temporal", "stratified_folds", "encode_native", "one_hot", "scale_numeric",
    "classification_report", "model_vs_baseline", "run_inference_baseline", "raw_to_prediction",
    "json_payload_rows", "json_payload_emit",
]
FITS = ["linear_regression", "rf_classifier", "score_batch", "score_stream", "cv_model", "param_search", "gbt_regressor", "gbt_classifier"]
ENOUGH = 6.0


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("slotlake-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    began, budget = time.perf_counter(), float(os.environ.get("BENCH_BUDGET", "600"))
    seconds, times = {}, {}
    for name in HEADLINE:
        run(spark, sf_dir, name)
        own = []
        while len(own) < runs and sum(own) < ENOUGH:
            own.append(run(spark, sf_dir, name))
        seconds[name], times[name] = round(statistics.median(own), 3), len(own)
    for name in FITS:
        if time.perf_counter() - began < budget:
            seconds[name], times[name] = round(run(spark, sf_dir, name), 3), 1
    quality = []
    if time.perf_counter() - began < budget:
        df = models.feature_rows(spark, sf_dir)
        quality = [r.asDict() for r in training.compare_band_sets(
            df, models.TARGET, "booking_id", models.model_features(df), models.BAND_SETS, models._forest,
            lambda: training.forest_regressor(models.FOREST)).collect()]
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "runs": times, "quality": quality, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
