"""Whole-column text and date transforms over the pages and feed-entry tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.dates import parse_published
from corpusflow.plans import sqltext as S
from corpusflow.plans.common import sql_ts, ts_str
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import INGEST_TS, with_ctes
from corpusflow.sources import fixtures as FX
from corpusflow.sources.tables import table

TITLE_RE = "<title>([^<]*)</title>"


def _clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", "html", X.strip_html("html").alias("clean"))


@query("strip_html", sql=f"select page_id, {S.strip_html('html')} as clean from pages")
def q_strip_html(spark, sf_dir):
    """Decode entities twice, drop comments and tags, collapse whitespace."""
    return _clean_pages(spark, sf_dir).select("page_id", "clean")


@query("make_preview", sql=f"select page_id, {S.make_preview('c')} as preview from (select page_id, {S.strip_html('html')} as c from pages)")
def q_make_preview(spark, sf_dir):
    """T5: 280-character preview on a word boundary with an ellipsis."""
    return _clean_pages(spark, sf_dir).select("page_id", X.make_preview("clean").alias("preview"))


@query("sentence_split", sql=f"""
select page_id, pos, sentence from (
  select page_id, unnest(range(len(s))) as pos, unnest(s) as sentence
  from (select page_id, {S.sentences(S.strip_html('html'))} as s from pages))""")
def q_sentence_split(spark, sf_dir):
    """Split at whitespace that follows '.', '!' or '?'."""
    # outer + null filter: a plain posexplode infers a filter that re-runs the cleaning UDF
    s = _clean_pages(spark, sf_dir).select("page_id", F.posexplode_outer(X.sentence_split("clean")).alias("pos", "sentence"))
    return s.filter(F.col("pos").isNotNull())


@query("sentence_chunks", sql=f"""
select page_id, pos, chunk from (
  select page_id, unnest(range(len(ch))) as pos, unnest(ch) as chunk
  from (select page_id, {S.sentence_chunks('c')} as ch from (select page_id, {S.strip_html('html')} as c from pages)))""")
def q_sentence_chunks(spark, sf_dir):
    """Greedy sentence packing, at most 8 chunks of about 700 characters."""
    c = _clean_pages(spark, sf_dir).select("page_id", F.posexplode_outer(X.sentence_chunks("clean")).alias("pos", "chunk"))
    return c.filter(F.col("pos").isNotNull())


@query("embedding_text", sql=f"""
select page_id, {S.embedding_text("regexp_extract(html, '<title>([^<]*)</title>', 1)", 'c', 8)} as embedding_text
from (select page_id, html, {S.strip_html('html')} as c from pages)""")
def q_embedding_text(spark, sf_dir):
    """Clean title, blank line, chunks one per line."""
    df = _clean_pages(spark, sf_dir)
    return df.select("page_id", X.embedding_text(F.regexp_extract("html", TITLE_RE, 1), F.col("clean"), X.CHUNK_MAX_COUNT).alias("embedding_text"))


@query("published_parse", sql=with_ctes(f"""
select s.entry_pos, coalesce(s.published, '') as published, coalesce(s.updated, '') as updated,
       {sql_ts(f"coalesce(s.published_parsed, {INGEST_TS})")} as published_at_strict,
       {sql_ts(f"coalesce(l.published_parsed, {INGEST_TS})")} as published_at
from entries_parsed_strict s join entries_parsed l on l.entry_pos = s.entry_pos"""))
def q_published_parse(spark, sf_dir):
    """RFC 2822 (strict, like the reference) and RFC 2822 then ISO-8601 (default)."""
    raw = FX.raw_entries(spark, sf_dir)
    fallback = FX.ingest_ts()
    return raw.select(
        "entry_pos",
        F.coalesce("published", F.lit("")).alias("published"),
        F.coalesce("updated", F.lit("")).alias("updated"),
        ts_str(F.coalesce(parse_published("published", "updated", strict_rfc=True), fallback)).alias("published_at_strict"),
        ts_str(F.coalesce(parse_published("published", "updated"), fallback)).alias("published_at"),
    )
