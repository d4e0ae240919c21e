"""Latency and error-rate service objectives over a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.ids import assign_ids
from corpusflow.session import materialize

# The load test's targets (p95 latency per operation, overall error rate).
P95_TARGET_MS = (("read", 1200.0), ("comment", 1600.0), ("reindex", 3500.0), ("ingest", 8000.0))
ERROR_RATE_TARGET = 0.05


ACCURACY = 10_000                       # of the percentile sketch
MARGINS = (2 / ACCURACY, 0.01, 0.1, 1.0)    # half widths of the bracket, as shares of the rows


def bracketed(df: DataFrame, group_col: str, value_col: str, p: float, stats: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per group: n, further ``stats``; frequency table around the percentile).

    A sketch brackets the rank ``p * (n - 1)``: it errs by at most n / ACCURACY ranks, and the
    bracket is the narrowest one that leaves two more ranks for rounding. Values below and
    above it are counted as -inf and +inf, so the table holds a small share of the values
    of a large group, and all of a small one's. Nulls are left out of it."""
    v = F.col(value_col).cast("double")
    at = [q for m in MARGINS for q in (max(0.0, p - m), min(1.0, p + m))]
    seen = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("_n"), *(stats or []),
                                     F.percentile_approx(v, at, ACCURACY).alias("_q"))
    seen = materialize(seen)
    which = F.coalesce(*[F.when(F.lit(m - 1 / ACCURACY) * F.col("_n") >= 2, F.lit(2 * i)) for i, m in enumerate(MARGINS)],
                       F.lit(2 * len(MARGINS) - 2))
    # one row per group: bounded by the number of groups
    ends = F.broadcast(seen.select(F.col(group_col).alias("_g"), F.get("_q", which).alias("_from"), F.get("_q", which + 1).alias("_to")))
    cut = F.when(v < F.col("_from"), float("-inf")).when(v > F.col("_to"), float("inf")).otherwise(v)
    freq = df.filter(v.isNotNull()).join(ends, F.col(group_col) == F.col("_g")).groupBy(group_col, cut.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    return seen.drop("_n", "_q"), freq


def exact_percentile(df: DataFrame, group_col: str, value_col: str, p: float, stats: list[Column] | None = None) -> DataFrame:
    """Exact percentile ``p`` with linear interpolation (like ``percentile`` / ``quantile_cont``)
    per group with its row count ``n``, without gathering a group's values in one task.

    Two map-side combined passes: a sketch brackets the rank, the values inside the bracket are
    counted exactly. Cumulative counts come from range-bucketed running sums, and the two
    ranks around ``p * (n - 1)`` are picked by one aggregate. A group without values has a
    null percentile. ``stats`` are further aggregates of the first pass.
    """
    seen, freq = bracketed(df, group_col, value_col, p, stats)
    freq = materialize(freq)
    cum = assign_ids(freq, F.col("_v"), 0, "_cum", partition_col=group_col, weight=F.col("_c"))
    pos = F.lit(p) * (F.sum("_c") - 1)
    ranks = freq.groupBy(F.col(group_col).alias("_g")).agg(pos.alias("_pos"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"))
    j = cum.join(F.broadcast(ranks), F.col(group_col) == F.col("_g"))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_cum") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_cum")), F.col("_v")))

    found = j.groupBy("_g").agg(at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), F.max(F.col("_pos") - F.col("_lo")).alias("_part"))
    value = F.col("_vlo") + F.col("_part") * (F.col("_vhi") - F.col("_vlo"))
    return seen.join(F.broadcast(found), F.col(group_col) == F.col("_g"), "left").select(*seen.columns, value.alias("p"))


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(P95_TARGET_MS), "operation string, threshold_ms double")


def slo_report(spark: SparkSession, log: DataFrame, p: float = 0.95) -> DataFrame:
    """A4: per operation: requests, exact p95 latency, error rate, and pass / fail."""
    rates = [(F.sum("is_error") / F.count(F.lit(1))).alias("error_rate")]
    rep = exact_percentile(log, "operation", "latency_ms", p, rates).join(F.broadcast(targets(spark)), "operation", "left")
    return rep.select(
        "operation", "n", F.col("p").alias("p95_ms"), "error_rate", "threshold_ms",
        (F.col("p") < F.col("threshold_ms")).alias("p95_ok"), (F.col("error_rate") < ERROR_RATE_TARGET).alias("error_ok"),
    ).withColumn("passed", F.col("p95_ok") & F.col("error_ok"))
