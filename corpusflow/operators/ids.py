"""Dense, ordered numbering without a single-partition global window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000   # rows that one running number goes over, about
MAX_RANGES = 10_000


def assign_ids(df: DataFrame, order_key: Column, base: Column | int = 0, out: str = "id", buckets: int | None = None,
               partition_col: str | None = None, weight: Column | None = None) -> DataFrame:
    """Add ``out = base + rank`` where rank is 1..n in ``order_key`` order (a unique long),
    over the whole frame or within each value of ``partition_col``.

    The keys are split at their approximate quantiles into ranges of about equally many rows
    (``buckets``, else one per ``ROWS_PER_RANGE`` rows), so neither clustered keys nor an
    outlier fill one range. ``row_number`` runs per (partition, range) in many tasks, and
    each range's offset comes from a count table of at most (partitions x ranges) rows,
    which is broadcast. ``partition_col`` must have few values (datasets, feeds).
    With ``weight`` the result is the running sum of weights (inclusive) instead of the
    row number, e.g. cumulative counts over a frequency table.
    """
    part = [partition_col] if partition_col else []
    base_col = base if isinstance(base, Column) else F.lit(base)
    k = df.withColumn("_k", order_key).withColumn("_d", F.col("_k").cast("double"))
    n = buckets or min(MAX_RANGES, -(-k.count() // ROWS_PER_RANGE))
    cuts = k.stat.approxQuantile("_d", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    cuts = sorted(set(cuts))
    # equal keys as doubles share a range, so the ranges keep the order of the keys
    ranges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_d", outputCol="_b")
    k = (ranges.transform(k) if cuts else k.withColumn("_b", F.lit(0))).withColumn("_b", F.col("_b").cast("int")).drop("_d")
    # one shuffle on (partition, range): the row numbers and the per-range counts come from
    # the same exchange, so the input is not evaluated a second time for the counts
    wb = Window.partitionBy(*part, "_b")
    if weight is None:
        ranked = k.withColumn("_r", F.row_number().over(wb.orderBy("_k"))).withColumn("_n", F.count(F.lit(1)).over(wb))
    else:
        k = k.withColumn("_w", weight)
        running = wb.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = k.withColumn("_r", F.sum("_w").over(running)).withColumn("_n", F.sum("_w").over(wb)).drop("_w")
    if not part and not cuts:
        # one range: its numbers are final
        return ranked.withColumn(out, (base_col + F.col("_r")).cast("long")).drop("_k", "_b", "_r", "_n")
    counts = ranked.groupBy(*part, "_b").agg(F.max("_n").alias("_n"))
    w = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (
        ranked.join(F.broadcast(offsets), [*part, "_b"])
        .withColumn(out, (base_col + F.col("_off") + F.col("_r")).cast("long"))
        .drop("_k", "_b", "_r", "_n", "_off")
    )
