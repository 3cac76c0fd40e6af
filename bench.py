"""Wall time of the headline queries, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once to warm up and
once timed; results go to Spark's no-op sink, so every row and column is computed.
"""

import json
import os
import sys
import time

from strandloom import build_session
from strandloom.workload.queries import QUERIES

HEADLINE = [
    "l1_state", "strand_filter", "level2", "level3_pvalue", "global_metrics", "pivot_delta",
    "detail_features", "merged_features", "asm_mode_counts", "haplotype_chi2_stat",
    "retention_grid", "tpr_fpr_grid", "descriptive_stats", "corr_matrix", "welch_p",
    "bootstrap_p", "logreg_metrics", "roc_points", "variant_load", "bed_filter",
    "semi_join_positions", "sam_text_scan", "cigar_blocks", "basemod_explode", "interval_join",
    "depth_cap_topn", "level1_sites", "level2_from_reads",
]


def run(spark, name, folder):
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "strandloom-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.strandloom.viewPartitions": cpus,
           "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(run(spark, name, folder), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
