"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from lociframe.plans import catalog
from lociframe.session import local_session

HEADLINE = [
    "trace_summary", "running_mean", "conditional_to_marginal", "conditional_to_marginal_product", "label_switch",
    "compress_patterns", "compress_patterns_jc69", "alignment_summary", "pairwise_differences", "root_divergence",
    "diploid_phased_patterns", "topology_posterior", "clade_posterior", "joint_model_posterior", "ancestor_closure",
    "coalescent_waiting", "msc_migration_log_density", "integrated_theta_density", "relaxed_branch_lengths",
    "transition_probs", "transition_probs_general", "locus_log_likelihood", "trait_bm_log_likelihood",
    "trait_mkv_log_likelihood", "migration_model_posterior", "stream_running_mean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=max(8, int(cores)), app="lociframe-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
