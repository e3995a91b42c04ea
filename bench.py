"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A table that is a single file with a single row group can be read by one task only.
Such tables are copied into several files first, as a cluster would hold them; the
copies are not timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import compare, registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "spam_b_reasons spam_b_plain spam_a_flags spam_statistics vocab_presence vocab_doc_freq "
    "text_tokens synth_worklist synth_prompts ingest_responses replace_label_slice "
    "validate_records page_fields flatten_reviews stratified_split score_batch stack_features "
    "macro_metrics"
).split()


def spread_tables(spark, folder: str) -> str:
    """The tables in files enough for every core; small ones as they are."""
    for name in compare.TABLES:
        source = f"{SF_DIR}/{name}.parquet"
        table = spark.read.parquet(source)
        files = int(CPUS) if name in ("documents", "pages", "conversations", "lineitem") else 1
        table.repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds for the whole result, computed and thrown away."""
    start = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = compare.session(CPUS)
    spark.conf.set("spark.sql.shuffle.partitions", CPUS)
    seconds = {}
    sf_dir = spread_tables(spark, tempfile.mkdtemp(prefix="reviewmill-bench-"))
    for name in names:
        run(spark, name, sf_dir)  # warm up
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(SF_DIR).name.removeprefix("sf"), "cpus": int(CPUS),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
