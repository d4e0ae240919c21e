"""Structured Streaming queries and the batch SLO report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.operators import slo as SLO
from corpusflow.operators.joins import broadcast_if_small
from corpusflow.plans.common import sql_ts, ts_str
from corpusflow.plans.q_ingest import feed_list, sql_hash_weights
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import INGEST_TS, cte, with_ctes
from corpusflow.plans import sqltext as S
from corpusflow.session import materialize, scratch_path
from corpusflow.sources import fixtures as FX
from corpusflow.sources.store import SnapshotStore
from corpusflow.streaming import ingest as SI
from corpusflow.streaming import slo as SS

STREAM_KEY_BITS = 4     # and few buckets of keys
STREAM_PART_ROWS = 256  # small id-range parts so that the benchmark table spans several parts


def _run_dir(spark, name):
    return scratch_path(spark, "runs", f"{name}-{uuid.uuid4().hex[:12]}")


@query("slo_report", sql=with_ctes("""
select operation, count(*) as n, round(quantile_cont(latency_ms, 0.95), 6) + 0.0 as p95_ms,
       round(avg(is_error), 6) + 0.0 as error_rate,
       case operation when 'read' then 1200.0 when 'comment' then 1600.0 when 'reindex' then 3500.0 else 8000.0 end as threshold_ms,
       quantile_cont(latency_ms, 0.95) < case operation when 'read' then 1200.0 when 'comment' then 1600.0 when 'reindex' then 3500.0 else 8000.0 end as p95_ok,
       avg(is_error) < 0.05 as error_ok,
       quantile_cont(latency_ms, 0.95) < case operation when 'read' then 1200.0 when 'comment' then 1600.0 when 'reindex' then 3500.0 else 8000.0 end
         and avg(is_error) < 0.05 as passed
from request_log group by operation"""))
def q_slo_report(spark, sf_dir):
    """A4: exact p95 latency and error rate per operation against the load-test targets."""
    r = SLO.slo_report(spark, FX.request_log(spark, sf_dir))
    return r.select("operation", "n", (F.round("p95_ms", 6) + F.lit(0.0)).alias("p95_ms"),
                    (F.round("error_rate", 6) + F.lit(0.0)).alias("error_rate"), "threshold_ms", "p95_ok", "error_ok", "passed")


cte("stream_emb", sql_hash_weights(f"(select entry_pos, {S.embedding_text('title', 'content_clean')} as etext from entries_ordered where not conflict)",
                                   "entry_pos", "etext"))


def _ingested(spark, sf_dir, name, expected=None) -> SnapshotStore:
    base = _run_dir(spark, name)
    FX.raw_entries(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/landing")
    store = SnapshotStore(spark, f"{base}/store", part_rows=STREAM_PART_ROWS, files_per_part=2)
    SI.run_ingest_stream(spark, f"{base}/landing", store, f"{base}/checkpoint", FX.ingest_ts, key_bits=STREAM_KEY_BITS,
                         expected=expected).awaitTermination()
    return store


@query("stream_ingest", sql=with_ctes(f"""
select row_number() over (order by ins_feed, ins_entry) as id, source, guid as rss_guid, title, link as url,
       content_clean as content, content_preview, {sql_ts('published_at', True)} as published_at,
       {sql_ts(INGEST_TS)} as created_at, {sql_ts(INGEST_TS)} as updated_at,
       round((select sum(weight) from stream_emb w where w.k = d.entry_pos), 6) + 0.0 as embedding_sum
from entries_ordered d where not conflict"""))
def q_stream_ingest(spark, sf_dir):
    """Landed entries -> readStream -> foreachBatch upsert into the snapshot store."""
    snap = _ingested(spark, sf_dir, "stream_ingest").read()
    return snap.select(
        "id", "source", "rss_guid", "title", "url", "content", "content_preview",
        ts_str("published_at", True).alias("published_at"), ts_str("created_at").alias("created_at"),
        ts_str("updated_at").alias("updated_at"),
        (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6) + F.lit(0.0)).alias("embedding_sum"),
    )


@query("stream_counters", sql=with_ctes("""
select (select count(*) from entries_ordered where not conflict) as ingested, 0 as updated, 0 as unchanged,
       (select count(*) from entries_ordered where conflict) as conflicts,
       (select count(*) from entries_norm where reject_reason is not null) as skipped,
       (select string_agg(feed_url, ',' order by feed_url) from failed_feeds where failed) as failed_feeds"""))
def q_stream_counters(spark, sf_dir):
    """A1 in the stream: counters of all batches of an ingest into an empty store, and the feeds that
    landed nothing."""
    expected = feed_list(spark, sf_dir).filter(F.col("feed_url").startswith(FX.FEED_BASE)).select("feed_url").distinct()
    runs = _ingested(spark, sf_dir, "stream_counters", expected).runs("counters")
    failed = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("failed_feeds")))), ",").alias("failed_feeds")
    return runs.agg(*[F.sum(c).alias(c) for c in ("ingested", "updated", "unchanged", "conflicts", "skipped")], failed)


@query("stream_issues", sql=with_ctes("""
select feed_url, entry_pos, guid, link, reject_reason as reason from entries_norm where reject_reason is not null
union all
select feed_url, entry_pos, guid, link, 'conflict' from entries_ordered where conflict"""))
def q_stream_issues(spark, sf_dir):
    """P5 in the stream: entries that the batches rejected or found in conflict, with the reason."""
    return _ingested(spark, sf_dir, "stream_issues").runs("issues").select("feed_url", "entry_pos", "guid", "link", "reason")


@query("stream_dedupe", sql=with_ctes(f"""
select entry_pos, guid, md5(list_aggregate(list_transform([source, title, link, content_clean, content_preview,
         case when published_ok then {sql_ts('published_at')} else '' end], lambda x: length(x) || ':' || x), 'string_agg', '')) as content_hash
from entries_valid"""))
def q_stream_dedupe(spark, sf_dir):
    """Every entry delivered twice; identical re-deliveries are dropped in the stream."""
    base = _run_dir(spark, "stream_dedupe")
    raw = FX.raw_entries(spark, sf_dir)
    raw.write.mode("overwrite").parquet(f"{base}/landing/copy=1")
    raw.write.mode("overwrite").parquet(f"{base}/landing/copy=2")
    src = SI.entry_stream(spark, f"{base}/landing", recursive=True)
    out = SI.dedupe_stream(src, FX.ingest_ts()).select("entry_pos", "guid", "content_hash")
    q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("stream_changes", sql=with_ctes(f"""
select d.copy, entry_pos, guid, md5(list_aggregate(list_transform([source, title || case when d.copy in (2, 3) then ' (new)' else '' end, link, content_clean,
         content_preview, case when published_ok then {sql_ts('published_at')} else '' end], lambda x: length(x) || ':' || x), 'string_agg', '')) as content_hash
from entries_dedup, (select unnest([1, 2, 4]) as copy) d"""))
def q_stream_changes(spark, sf_dir):
    """Every entry delivered as A, B, B, A in four micro-batches over two runs of the query: the
    changed deliveries pass, also the one back to A."""
    base = _run_dir(spark, "stream_changes")
    # one delivery per guid, so that the expected changes are A, B, A for each
    raw = FX.raw_entries(spark, sf_dir)
    last = materialize(SI.E.dedupe_entries(SI.E.valid_entries(SI.E.normalize_entries(raw, FX.ingest_ts()))).select("entry_pos"))
    raw = raw.join(last, "entry_pos", "left_semi")
    before = {k: spark.conf.get(k) for k in SI.STATE_CONF}
    for k, v in SI.STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        for copy in (1, 2, 3, 4):
            title = F.coalesce("title", F.lit("Untitled"))
            state = raw.withColumn("title", F.concat(title, F.lit(" (new)"))) if copy in (2, 3) else raw
            state.write.mode("overwrite").parquet(f"{base}/landing/copy={copy}")
            src = SI.entry_stream(spark, f"{base}/landing", recursive=True)
            out = SI.changed_entries(src, FX.ingest_ts()).withColumn("copy", F.lit(copy))
            q = (out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(f"{base}/out").select("copy", "entry_pos", "guid", "content_hash")


def _r6(name):
    return (F.round(name, 6) + F.lit(0.0)).alias(name)


def _slo_stream(spark, sf_dir, name, aggregate=SS.rolling_slo, values=("n", "errors", "p95_ms")):
    """Update mode: each micro-batch emits the windows it changed (state older than the
    watermark is dropped); the sink keeps every batch's rows and readers take the latest
    row per window and operation."""
    base = _run_dir(spark, name)
    # a glob that matches only the events file: file stream sources take a directory or a glob
    events = spark.readStream.schema(SS.EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/[e]vents.parquet")
    agg = aggregate(SS.request_log(events))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    latest = out.groupBy("window", "operation").agg(F.max_by(F.struct(*values), F.col("batch")).alias("r"))
    return latest.select("window", "operation", "r.*")


@query("slo_rollup", sql=with_ctes("""
select span, operation, count(*) as n, cast(sum(is_error) as bigint) as errors, true as within_rank_error
from (select strftime(ts, '%Y-%m-%d') as span, operation, is_error from request_log union all select 'all', operation, is_error from request_log)
group by all"""))
def q_slo_rollup(spark, sf_dir):
    """Hourly latency sketches of a stream, merged to days and to the whole time; the merged
    p95 is checked against its real rank among the requests."""
    hours = materialize(_slo_stream(spark, sf_dir, "slo_rollup", SS.rolling_sketches, ("n", "errors", "sketch")))
    day = F.date_format("window.start", "yyyy-MM-dd")
    spans = SS.roll_up(hours, day).unionByName(SS.roll_up(hours, F.lit("all"))).drop("sketch")
    spans = materialize(spans)
    log = FX.request_log(spark, sf_dir)
    log = log.select(F.explode(F.array(F.date_format("ts", "yyyy-MM-dd"), F.lit("all"))).alias("span"), "operation", "latency_ms")
    # a row per day and operation: behind the size check
    real = log.join(broadcast_if_small(spans.select("span", "operation", "p95_ms"), ready=True), ["span", "operation"]).groupBy("span", "operation").agg(
        F.avg((F.col("latency_ms") < F.col("p95_ms")).cast("double")).alias("below"),
        F.avg((F.col("latency_ms") <= F.col("p95_ms")).cast("double")).alias("upto"), F.count(F.lit(1)).alias("m"))
    # a rank error, and one request more: ranks of few requests are coarse
    off = F.lit(SS.RANK_ERROR) + 1 / F.col("m")
    ok = (F.col("below") <= 0.95 + off) & (F.col("upto") >= 0.95 - off)
    return spans.join(real, ["span", "operation"]).select("span", "operation", "n", F.col("errors").cast("long").alias("errors"),
                                                          ok.alias("within_rank_error"))


@query("stream_slo", sql=with_ctes(f"""
select {sql_ts("date_trunc('hour', ts)")} as window_start, operation, count(*) as n, cast(sum(is_error) as bigint) as errors,
       round(avg(is_error), 6) + 0.0 as error_rate
from request_log group by all"""))
def q_stream_slo(spark, sf_dir):
    """Hourly request count and error rate per operation from the event stream."""
    r = _slo_stream(spark, sf_dir, "stream_slo")
    return r.select(ts_str("window.start").alias("window_start"), "operation", "n", F.col("errors").cast("long").alias("errors"),
                    (F.round(F.col("errors") / F.col("n"), 6) + F.lit(0.0)).alias("error_rate"))


@query("stream_slo_p95", sql=with_ctes(f"""
select {sql_ts("date_trunc('hour', ts)")} as window_start, operation, count(*) as n, round(quantile_disc(latency_ms, 0.95), 6) + 0.0 as p95_ms
from request_log group by all"""))
def q_stream_slo_p95(spark, sf_dir):
    """Hourly p95 latency per operation, a bounded-state sketch. It errs by at most one rank
    in 10,000, so it is the exact lower rank where a window holds fewer requests."""
    r = _slo_stream(spark, sf_dir, "stream_slo_p95")
    return r.select(ts_str("window.start").alias("window_start"), "operation", "n", _r6("p95_ms"))
