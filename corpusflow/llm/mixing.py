"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A source's documents are laid end to end in a shuffled order and cut into blocks of
``BLOCK`` words. Slot t of the schedule maps the golden-ratio point frac(t * phi) through
the sources' cumulative weights, which spreads every source evenly over the mix; the slots
of a source are ranked, and rank r takes block r modulo the source's number of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import broadcast_bounded, stored, text_key, text_of, words

BLOCK = 1024
WEIGHTS = (3, 1, 2)         # by source in code point order, repeating
SHARE = 1.5                 # words the mix takes, as a share of all words
REPEAT = 2                  # no source is taken more often
PHI = 0.6180339887498949
BUCKET_ROWS = 20_000        # documents, or slots, that one running sum goes over


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating. A target above
    ``repeat`` times its source's size stops there and the excess is shared again by weight
    until none is above: with sources in order of cap per weight, those up to a point are
    capped and the rest share what is left. The windows go over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = sizes.select("source", "source_size", w.cast("double").alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # what a unit of weight gets if this source and all after it are not capped
    s = s.withColumn("unit", left / F.sum("w").over(after)).withColumn("capped", F.col("cap") <= F.col("unit") * F.col("w"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("unit").alias("unit")))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free["unit"] * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast a per-source table of at most ``rows`` rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def _running(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``si`` before this one, by
    ``bucket`` and then ``order``. A window goes over one bucket's rows only; the bucket totals
    are one row per bucket."""
    prior = Window.partitionBy("o_si").orderBy("o_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = stored(df.groupBy(F.col("si").alias("o_si"), F.col("bucket").alias("o_bucket")).agg(F.sum(value).alias("t"))
                  .select("o_si", "o_bucket", F.coalesce(F.sum("t").over(prior), F.lit(0)).alias("o_off")), 8)
    own = Window.partitionBy("si", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn(out, F.coalesce(F.sum(value).over(own), F.lit(0)))
    same = (F.col("si") == F.col("o_si")) & (F.col("bucket") == F.col("o_bucket"))
    return summed.join(broadcast_bounded(offs), same).withColumn(out, (F.col(out) + F.col("o_off")).cast("long")).drop(
        "o_si", "o_bucket", "o_off", "bucket")


def schedule(plan: DataFrame) -> DataFrame:
    """(slot, si, rank): the order of the mix. ``plan``: si, slots (how many the source needs)
    and first (the slots of all sources before it).

    A source's surplus points are void, and slots that its points lack follow at the end, so
    every source gets exactly ``slots`` of them. Both are a few, as the discrepancy of the
    sequence grows with the logarithm of its length."""
    n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not n:
        return plan.sparkSession.createDataFrame([], "slot long, si int, rank long")
    cells = min(n, 4096)
    cell = F.explode(F.sequence(F.floor(F.col("first") * cells / F.lit(n)),
                                F.floor((F.col("first") + F.col("slots") - 1) * cells / F.lit(n) + 1)))
    ranges = _small(stored(plan.filter("slots > 0").select("si", "slots", "first", cell.alias("r_cell")), 1))
    x = F.pmod((F.col("id") + 1) * F.lit(PHI), F.lit(1.0)) * n
    points = plan.sparkSession.range(n).select(F.col("id").alias("slot"), x.alias("x"), F.floor(x * cells / F.lit(n)).alias("cell"))
    hit = points.join(ranges, (F.col("cell") == F.col("r_cell")) & (F.col("x") >= F.col("first"))
                      & (F.col("x") < F.col("first") + F.col("slots")))
    hit = hit.select("slot", "si", "slots", F.floor(F.col("slot") / BUCKET_ROWS).alias("bucket"))
    ranked = stored(_running(hit, [F.col("slot")], F.lit(1), "rank").filter("rank < slots").select("slot", "si", "rank"))
    have = ranked.groupBy(F.col("si").alias("h_si")).agg(F.count(F.lit(1)).alias("have"))
    lack = plan.join(have, F.col("si") == F.col("h_si"), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(
        "have < slots").select((F.lit(n) + F.col("first")).alias("base"), "si", F.explode(
            F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    return ranked.unionByName(lack.select((F.col("base") + F.col("rank")).alias("slot"), "si", "rank"))


@dataclass
class Mix:
    """``documents``: id, size, source, source_size, target, taken, one row per input row.
    ``pieces``: slot, source, rank, id, from_word, n_words: the mix itself, in slot order."""

    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: int = 0) -> Mix:
    """Mix whole documents to the sources' targets.

    Null and empty texts have size 0 and are never taken. A null source is a source of its
    own, the last. The order within a source is by a hash of seed, id and text, so reruns
    agree; rows that repeat lie side by side. The source's words repeat cyclically, block
    ``rank`` of that repetition being the words from ``rank * block``. The last slot takes
    only what the target still lacks, so a source's taken words miss its target by less than
    one word and no document is taken more than ``repeat`` times. Extra columns are not read.
    """
    slim = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                              F.size(words(text_of(text_col))).cast("long").alias("size"),
                              F.xxhash64(F.lit(seed), F.col(id_col), text_key(text_col)).alias("h")))
    per = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), 1)
    goal = targets(per.select("source", "source_size"), weights, share, repeat).withColumnsRenamed(
        {"source": "p_source", "source_size": "p_size"})
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = by_name.rowsBetween(Window.unboundedPreceding, -1)
    plan = per.join(goal, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "source", "source_size", "n", "target", F.floor(F.col("target") + 1e-6).alias("words"))
    plan = plan.withColumn("slots", F.ceil(F.col("words") / block).cast("long")).withColumn(
        "si", F.row_number().over(by_name)).withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    plan = stored(plan, 1)
    side = _small(plan.select(F.col("source").alias("p_source"), "si", "source_size", "target", "words", "n"))
    known = slim.join(side, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")

    # documents in hash order: running sums over ranges of the hash with about BUCKET_ROWS rows each
    ranges = F.ceil(F.col("n") / BUCKET_ROWS)
    spread = F.shiftrightunsigned(F.col("h"), 33) / F.lit(float(1 << 31))
    dealt = known.filter("size > 0").withColumn("bucket", F.floor(spread * ranges))
    laid = stored(_running(dealt, [F.col("h"), F.col("id"), F.col("size")], F.col("size"), "off"))
    passes = laid.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("pass")).withColumn(
        "at", F.col("off") + F.col("pass") * F.col("source_size")).filter("at < words")
    cut = passes.select("*", F.explode(F.sequence(F.floor(F.col("at") / block),
                                                  F.floor((F.col("at") + F.col("size") - 1) / block))).alias("b_rank"))
    placed = schedule(plan.select("si", "slots", "first")).withColumnRenamed("si", "s_si")
    lo = F.greatest(F.col("at"), F.col("rank") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block, F.col("words"))
    pieces = cut.join(placed, (F.col("si") == F.col("s_si")) & (F.col("b_rank") == F.col("rank"))).select(
        "slot", "source", "rank", "id", "si", "off", (lo - F.col("at")).alias("from_word"), (hi - lo).alias("n_words")).filter("n_words > 0")
    took = pieces.groupBy(F.col("si").alias("t_si"), F.col("off").alias("t_off")).agg(F.sum("n_words").alias("t"))
    columns = ["id", "size", "source", "source_size", "target"]
    with_words = laid.join(took, (F.col("si") == F.col("t_si")) & (F.col("off") == F.col("t_off")), "left").select(
        *columns, F.coalesce("t", F.lit(0)).cast("long").alias("taken"))
    empty = known.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    out = with_words.unionByName(empty).withColumn("source_size", F.col("source_size").cast("long")).withColumnsRenamed(
        {"id": id_col, "source": source_col})
    return Mix(out, pieces.select("slot", F.col("source").alias(source_col), "rank", F.col("id").alias(id_col), "from_word", "n_words"))
