"""Comment writes: validate payloads, reject unknown articles, append with new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import py_strip
from corpusflow.operators.articles import AUTHOR_MAX
from corpusflow.operators.ids import assign_ids
from corpusflow.operators.joins import broadcast_if_small
from corpusflow.session import materialize
from corpusflow.sources.store import SnapshotStore

COMMENT_SCHEMA = "id long, article_id long, author_name string, body string, created_at timestamp"


def validate(requests: DataFrame) -> DataFrame:
    """Strip the body, blank body rejected, '' author becomes NULL, author <= 120 chars.

    Adds ``reject_reason`` (NULL when valid). Both of the reference's input paths are
    folded into one rule: a blank body is rejected rather than stored as ''.
    """
    body = py_strip(F.col("body"))
    author = F.nullif(F.col("author_name"), F.lit(""))
    reason = (
        F.when(F.col("body").isNull() | (body == ""), F.lit("body_blank"))
        .when(F.length(author) > AUTHOR_MAX, F.lit("author_too_long"))
    )
    return requests.select(*[c for c in requests.columns if c not in ("author_name", "body")],
                           author.alias("author_name"), body.alias("body"), reason.alias("reject_reason"))


def existing_ids(articles: DataFrame, requested: DataFrame, col: str = "article_id") -> DataFrame:
    """The requested article ids that exist, as ``_aid``. The (size-checked, broadcast)
    request ids filter the article table in place, so the big table is not shuffled."""
    req = broadcast_if_small(requested.select(F.col(col).alias("_req")).distinct())
    return articles.select(F.col("id").alias("_aid")).join(req, F.col("_aid") == F.col("_req"), "left_semi")


def split_fk(valid: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): semi / anti join of the comment's article id to the articles."""
    ids = existing_ids(articles, valid)
    accepted = valid.join(ids, valid.article_id == ids._aid, "left_semi")
    rejected = valid.join(ids, valid.article_id == ids._aid, "left_anti").withColumn("reject_reason", F.lit("article_not_found"))
    return accepted, rejected


def append(comments: DataFrame | int, requests: DataFrame, articles: DataFrame, created_at: Column,
           order_col: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Validate, check the article, and return ``(appended_rows, rejected_requests)``. New ids
    follow the highest one of ``comments``, or that id itself where it is known."""
    v = validate(requests)
    ok = v.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = v.filter(F.col("reject_reason").isNotNull())
    accepted, missing = split_fk(ok, articles)
    # the numbering reads the accepted batch three times: check the articles once
    accepted = materialize(accepted)
    base = F.lit(comments).cast("long") if isinstance(comments, int) else comments.select(
        F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    rows = assign_ids(accepted, F.col(order_col).cast("long"), base, out="id")
    rows = rows.select("id", "article_id", "author_name", "body", created_at.alias("created_at"))
    return rows, bad.unionByName(missing)


def append_to(store: SnapshotStore, requests: DataFrame, articles: DataFrame, created_at: Column,
              batch: tuple[str, int] | None = None) -> DataFrame:
    """Append the valid requests to the stored comments and return the rejected ones.

    The first free id comes from the store's manifest, so stored comments are not scanned; new
    ids fall into the last parts, the only ones written. ``batch`` makes a replay a no-op."""
    if batch is not None and store.committed(batch):
        return validate(requests).limit(0)
    rows, rejected = append(store.max_id(), requests, articles, created_at)
    store.commit(materialize(rows), batch=batch)
    return rejected
