"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is forced to completion with the ``noop`` sink (no collect to the driver).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "segment_pair_counts", "segment_counts", "sample_per_group", "seeded_shuffle", "select_sequences",
    "random_crop", "mask_pretokenise", "bpe_train", "bpe_encode", "windows_bpe", "windows_bases",
    "resolve_species", "taxonomy_closure", "edge_distances", "species_table", "mean_pool", "pool_assembly",
    "fold_table", "standardise", "classification_metrics", "regression_metrics", "layer_scores",
    "pad_batches", "length_median", "running_states", "reconstruction_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from seqlake.session import local_session
    from seqlake.plans import QUERIES
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM, Python workers and file listing, not timed
    QUERIES["corpus_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
