"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line. Each query is executed in full with the no-op sink (no driver collect).

BENCH_QUERIES=all runs every registered query; BENCH_EVENT_LOG=1 writes Spark's event
log into a fresh scratch folder for stage and task times.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusflow.plans.catalog import QUERIES  # noqa: E402
from corpusflow.session import build_session  # noqa: E402

HEADLINE = [
    "strip_html", "sentence_chunks", "entries_normalize", "entries_dedupe", "upsert_snapshot", "ingest_metrics",
    "embed_articles", "similar_topk", "similar_all_pairs", "similar_lsh", "articles_list", "home_feed",
    "article_detail", "comments_append", "slo_report", "pairs_load", "batch_pack", "inbatch_loss", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sorted(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    extra = {"spark.sql.files.maxPartitionBytes": str(32 << 20)}
    scratch = tempfile.mkdtemp(prefix="bench-")
    extra["spark.checkpoint.dir"] = os.path.join(scratch, "checkpoints")
    if os.environ.get("BENCH_EVENT_LOG"):
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.path.join(scratch, "events")})
        os.makedirs(os.path.join(scratch, "events"), exist_ok=True)
    spark = build_session(f"local[{cpus}]", "corpusflow-bench", shuffle_partitions=cpus * 2, extra=extra)
    # untimed warm-up: JVM code paths and the Python workers of the Arrow UDFs
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["strip_html"](spark, warm).write.format("noop").mode("overwrite").save()
        QUERIES["embed_articles"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        times[name] = round(time.time() - t0, 3)
    # throughput figures for the baseline table
    extra_metrics = {}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    if "strip_html" in times:
        extra_metrics["strip_html_rows_per_s"] = round(pages / times["strip_html"], 1)
    if "sentence_chunks" in times:
        extra_metrics["sentence_chunks_rows_per_s"] = round(pages / times["sentence_chunks"], 1)
    if "similar_lsh" in times:
        try:
            r = QUERIES["lsh_recall"](spark, sf_dir).collect()[0]
            extra_metrics["lsh_recall_at_5"] = round(float(r["recall_at_k"]), 4)
        except Exception as e:  # noqa: BLE001
            errors["lsh_recall"] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "extra": extra_metrics,
        "errors": errors,
        "scratch": scratch,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
