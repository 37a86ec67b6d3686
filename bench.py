"""Time the headline queries and print one JSON line.

The derived read and reference tables are prepared first and timed on their own (`prepare`): they stand in
for a user's stored input.
"""

from __future__ import annotations

import json
import os
import sys
import time


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from cytoquill.queries import QUERIES, derived, load_all
    from cytoquill.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    headline = [
        "cpg_beta", "pileup_position", "pileup_allele", "overlap_dedup", "call_or_reject", "strand_evidence", "bed_records", "vcf_records",
        "seq_entropy", "per_read_methylation", "modbam_mm", "mbias_table", "interval_overlap_join", "coverage_events", "verify_metrics", "ml_features_cpg",
    ]
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else headline
    start = time.time()
    for build in (derived.reference_context, derived.observations, derived.reads):
        build(spark, sf_dir)
    seconds = {"prepare": round(time.time() - start, 3)}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(v for k, v in seconds.items() if k != "prepare"), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
