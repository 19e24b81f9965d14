"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from lintlake.functions import secrets
from lintlake.operators import fixes, flow, scan, secondary
from lintlake.plans.corpus import corpus_files, files_from_lines, lines_from_ids, table
from lintlake.session import build_session, scratch_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=CPUS, spark__driver__memory="8g",
                          spark__sql__files__maxPartitionBytes="4m")
    started = time.time()
    base = scratch_dir(spark, "bench")
    # the input of a scan is a table of files, so it is written before the clock starts
    corpus_files(spark, SF_DIR).repartition(CPUS).write.parquet(f"{base}/files")
    wide = table(spark, SF_DIR, "lineitem").select(
        F.monotonically_increasing_id().alias("event_id"), F.col("l_partkey").alias("user_id"))
    files_from_lines(lines_from_ids(spark, wide)).repartition(CPUS * 2).write.parquet(f"{base}/wide")
    files, wide_files = spark.read.parquet(f"{base}/files"), spark.read.parquet(f"{base}/wide")
    documents = table(spark, SF_DIR, "documents").repartition(CPUS)
    documents.write.parquet(f"{base}/documents")
    documents = spark.read.parquet(f"{base}/documents")

    def count_lines(df):
        return df.select(F.sum(F.size(F.split("content", "\n", -1)))).first()[0]

    n_lines, n_wide = count_lines(files), count_lines(wide_files)
    setup = time.time() - started

    jobs = {
        "scan_repository": lambda: scan.scan_lines(files),
        "scan_repository_wide": lambda: scan.scan_lines(wide_files),
        "scan_and_statistics_wide": lambda: scan.all_facets(scan.scan_lines(wide_files)),
        "flow_checks": lambda: flow.flow_hits(files),
        "scan_repository_flow": lambda: scan.scan(files),
        "secondary_pack": lambda: secondary.secondary_hits(files),
        "fix_template": lambda: fixes.template_fixes(scan.scan_lines(files)),
        "fix_apply_first": lambda: fixes.apply_first(files, fixes.template_fixes(scan.scan_lines(files))),
        "fix_select_batch": lambda: fixes.select_batch(scan.scan_lines(files)),
        "mask_secrets": lambda: documents.select("doc_id", secrets.mask_secrets(F.col("text")).alias("m")),
        "mask_log_text": lambda: documents.select("doc_id", secrets.mask_log_text(F.col("text")).alias("m")),
    }
    seconds = {}
    for name, job in jobs.items():
        best = None
        for _ in range(RUNS):
            t = time.time()
            job().write.format("noop").mode("overwrite").save()
            took = time.time() - t
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(re.sub(r"[^0-9.]", "", os.path.basename(SF_DIR.rstrip("/"))) or 0),
        "lines": n_lines, "lines_wide": n_wide,
        "lines_per_second": round(n_lines / seconds["scan_repository"]),
        "lines_per_second_wide": round(n_wide / seconds["scan_repository_wide"]),
        "setup_sec": round(setup, 1), "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
