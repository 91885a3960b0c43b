"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times into a sink that reads every
row; the fastest run counts. Throughput is text bytes per second of the text jobs.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factsieve.plans.queries import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

# Query and, for jobs that scan one text column, that table and column.
HEADLINES = {
    "contains_pii": ("documents", "text"),
    "detect_pii": ("documents", "text"),
    "detect_pii_pages": ("pages", "html"),
    "extract_numerics_documents": ("documents", "text"),
    "extract_numerics_pages": ("pages", "html"),
    "verify_documents": ("documents", "text"),
    "verify_text": None,
    "unmatched_numerics_in_row": None,
    "unmatched_numerics_by_order": None,
    "answers_grounded_by_order": None,
    "unmatched_against_all_lines": None,
    "last_n_tokens_by_user": None,
    "retain_last_tokens": None,
    "window_length_by_user": None,
    "verify_deltas_of_documents": ("documents", "text"),
    "verify_stream_of_documents": ("documents", "text"),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # the tables are files of one row group, one task each unless their rows are dealt out
        .config("spark.factsieve.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sizes = {
        (t, c): spark.read.parquet(f"{FOLDER}/{t}.parquet").agg(F.sum(F.octet_length(c))).first()[0]
        for t, c in {v for v in HEADLINES.values() if v}
    }
    times, rates = {}, {}
    for name, source in HEADLINES.items():
        best = None
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        if source:
            rates[name] = round(sizes[source] / best / 1e6, 2)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "mb_per_sec": rates,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
