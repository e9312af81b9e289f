"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "contingency", "info_gain", "split_numeric", "select_split", "id3_tree", "one_rule_nominal", "naive_bayes_score", "naive_bayes_score_numeric",
    "cross_validate", "average_results", "cross_validate_rules", "paired_t", "mcnemar", "bagging", "stack_out_of_fold", "bias_variance", "frequent_itemsets", "association_rules",
    "knn_topk", "knn_choose_k", "kernel_score", "decode_hamming", "decode_loss_hinge", "class_mean_var", "weighted_covariance", "gmm_em_step", "gmm_classify",
    "translate_series", "run_lengths", "frame_series", "delta_features", "transition_counts", "viterbi_score", "baum_welch_step",
    "standardize", "prep_pipeline", "assign_folds",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from strandlab.catalog import QUERIES
    from strandlab.session import build_session

    spark = build_session("bench", cpus, max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # warm the session, not the tables
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
