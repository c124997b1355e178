"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

The archive is written first and timed by itself, once as the session's first work
(archive_write_first, not in the total) and once more; searches run over it as over any archive,
once to warm up and three times for the figure, of which the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "search_contains", "search_selective", "search_absent", "count_matches", "search_phrase", "search_limit", "get_row", "reconstruct_doc", "archive_stats",
    "cosine_topk", "cosine_threshold", "quantized_topk", "template_mining", "byte_entropy", "smart_detect", "numeric_delta_zigzag", "timestamp_delta_class",
    "chunk_range_read", "block_delta", "apply_delta", "multi_file_list", "zstd_ratio",
)


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from shalebed import catalog

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(f) -> float:
        began = time.perf_counter()
        f().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    spark.range(10).count()
    took = {}
    for name in ("archive_write_first", "archive_write"):
        catalog.forget()
        began = time.perf_counter()
        archive = catalog.opened(spark, sf_dir)
        took[name] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        run = lambda f=catalog.queries()[name]: f(spark, sf_dir)
        once(run)
        took[name] = round(median(once(run) for _ in range(3)), 3)
    lines = archive.lines
    for term, name in (("License", "full_scan_selective"), ("zzqzz", "full_scan_absent")):
        scan = lambda t=term: lines.filter(F.contains("line", F.lit(t)))
        once(scan)
        took[name] = round(median(once(scan) for _ in range(3)), 3)
    value = round(sum(took[n] for n in ("archive_write", *HEADLINE)), 3)
    print(json.dumps({"metric": "headline queries, total", "value": value, "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
