"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["auc_midrank", "auc_from_counts", "average_precision", "patient_auc", "relative_position", "position_bins",
            "stratified_kfold", "no_span_guard", "baseline_positional", "bin_sweep", "cluster_bootstrap_auc", "permute_within_volume",
            "delong_test", "stratified_auc", "association_matrix", "rater_agreement", "positional_ceiling", "run_length_test"]


def main():
    from cohortlens.plans.catalog import REGISTRY
    from cohortlens.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    REGISTRY["class_histogram"].run(spark, sf_dir).count()  # start the executor threads
    times = {}
    for name in HEADLINE:
        start = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
