"""Rolling request counts, error rate and approximate p95 per operation and window, and
mergeable latency sketches that are kept per hour and rolled up to any span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def request_log(events: DataFrame) -> DataFrame:
    """Map raw events to ``(event_id, ts, operation, latency_ms, is_error)``."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("read"))
        .when(F.col("event_type") == "purchase", F.lit("comment"))
        .when(F.col("event_type") == "signup", F.lit("reindex"))
        .otherwise(F.lit("ingest"))
        .alias("operation"),
        (F.col("value") * 10).alias("latency_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_error"),
    )


def rolling_slo(log: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", accuracy: int = 10000) -> DataFrame:
    """Windowed counters with a watermark for late data; p95 is approximate (bounded state)."""
    return log.withWatermark("ts", watermark).groupBy(F.window("ts", window), "operation").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_error").alias("errors"),
        F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_ms"),
    )


SKETCH_K = 2000
# of a merged quantile: 3.5 times the sketch's own bound at 99 % confidence (2.296 / k ** 0.9723)
RANK_ERROR = 0.005


def rolling_sketches(log: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", k: int = SKETCH_K) -> DataFrame:
    """(window, operation, n, errors, sketch): one KLL sketch of the latencies per window and
    operation, of a few times ``k`` values however many requests there were."""
    return log.withWatermark("ts", watermark).groupBy(F.window("ts", window), "operation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_error").alias("errors"), F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch"))


def roll_up(sketches: DataFrame, span: Column, p: float = 0.95) -> DataFrame:
    """(span, operation, n, errors, p95_ms, sketch) over any grouping of windows, without the requests:
    counts add up, sketches merge, and the percentile's rank is off by ``RANK_ERROR`` at most."""
    merged = sketches.groupBy(span.alias("span"), "operation").agg(
        F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("span", "operation", "n", "errors", F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias("p95_ms"), "sketch")
