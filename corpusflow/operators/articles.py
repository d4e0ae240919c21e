"""Read paths over the article table: listing, home feed, facet, lookup, detail, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators.embed import Embedder, embed
from corpusflow.operators.joins import broadcast_if_small

LIST_COLUMNS = ("id", "source", "title", "url", "content_preview", "published_at")
DETAIL_COLUMNS = ("id", "source", "rss_guid", "title", "url", "content", "published_at")
COMMENT_COLUMNS = ("id", "article_id", "author_name", "body", "created_at")
# Request bounds of the listing and recommendation endpoints.
LIST_LIMIT_DEFAULT, LIST_LIMIT_MAX = 20, 200
HOME_LIMIT = 50
RECS_K_DEFAULT, RECS_K_MAX = 5, 20
# Column limits of the stored tables.
MAX_LEN = {"source": 255, "rss_guid": 1024, "title": 512, "url": 1024}
AUTHOR_MAX = 120
PAGE_IDS = 10_000    # comment ids per list of a nested payload


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= LIST_LIMIT_MAX:
        raise ValueError(f"limit must be in 1..{LIST_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def check_k(k: int) -> None:
    if not 1 <= k <= RECS_K_MAX:
        raise ValueError(f"k must be in 1..{RECS_K_MAX}")


def filter_source(articles: DataFrame, source: str | None) -> DataFrame:
    """Exact source filter, only when ``source`` is non-empty."""
    return articles.filter(F.col("source") == source) if source else articles


def list_articles(articles: DataFrame, source: str | None = None, limit: int = LIST_LIMIT_DEFAULT,
                  offset: int = 0) -> DataFrame:
    """Newest first, ``id`` as tie-break; plans as one TakeOrderedAndProject."""
    check_page(limit, offset)
    df = filter_source(articles, source).select(*LIST_COLUMNS)
    return df.orderBy(F.col("published_at").desc(), F.col("id").desc()).offset(offset).limit(limit)


def home_feed(articles: DataFrame, source: str | None = None) -> DataFrame:
    """The 50 newest articles with the listing excerpt and display time."""
    df = list_articles(articles, source, HOME_LIMIT, 0)
    return df.select("id", "source", "title", "url", X.excerpt("content_preview").alias("excerpt"),
                     X.display_time("published_at").alias("published"))


def sources(articles: DataFrame) -> DataFrame:
    """Distinct sources in ascending (binary) order; ignores any active filter."""
    return articles.select("source").distinct().orderBy("source")


def lookup(articles: DataFrame, ids: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Batch point lookup: every requested id with ``found`` and the detail columns."""
    req = ids.select(F.col(id_col).alias("_req")).distinct()
    # the requested ids filter the big table in place (size-checked broadcast), then the
    # small matched set joins back
    a = articles.select(*DETAIL_COLUMNS).join(broadcast_if_small(req.select(F.col("_req").alias("_k"))),
                                              F.col("id") == F.col("_k"), "left_semi")
    return req.join(a, req._req == a.id, "left").select(
        F.col("_req").alias(id_col), F.col("id").isNotNull().alias("found"), *[F.col(c) for c in DETAIL_COLUMNS if c != "id"]
    )


def detail_rows(articles: DataFrame, comments: DataFrame) -> DataFrame:
    """Article detail with its comments, flat: one row per comment (NULL comment columns
    for an article without comments). No per-article list is built, so a heavily
    commented article does not become one huge row."""
    a = articles.select(*DETAIL_COLUMNS)
    c = comments.select(*[F.col(x).alias("comment_" + x) for x in COMMENT_COLUMNS if x != "article_id"],
                        F.col("article_id").alias("_aid"))
    # inner join with the comments as the streamed side: when one article holds a large
    # share of all comments, adaptive execution can split that side (it cannot split the
    # null-supplying side of an outer join); articles without comments are added by an anti join
    with_comments = c.join(a, a.id == c._aid).select(*DETAIL_COLUMNS, *[x for x in c.columns if x != "_aid"])
    without = a.join(c.select("_aid"), a.id == c._aid, "left_anti")
    return with_comments.unionByName(without, allowMissingColumns=True)


def nest_comments(articles: DataFrame, comments: DataFrame, ids: DataFrame, id_col: str = "article_id") -> DataFrame:
    """A3, the API payload of the requested articles: ``comments`` as an id-ordered list.

    Both tables are reduced to the requested ids first. A list holds the comments of one
    article in one range of ``PAGE_IDS`` comment ids, so it is bounded by that number however
    many comments an article has; such an article has several rows, in the order of ``page``.
    An article without comments has one row with page 0 and an empty list; an id without an
    article has none."""
    k = broadcast_if_small(ids.select(F.col(id_col).alias("_req")).distinct())
    a = articles.select(*DETAIL_COLUMNS).join(k, F.col("id") == F.col("_req"), "left_semi")
    c = comments.select(*COMMENT_COLUMNS).join(k, F.col("article_id") == F.col("_req"), "left_semi")
    pages = c.groupBy("article_id", F.floor(F.col("id") / PAGE_IDS).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(*COMMENT_COLUMNS))).alias("comments"))
    empty = F.array().cast(pages.schema["comments"].dataType)
    return a.join(pages, a.id == pages.article_id, "left").select(
        *DETAIL_COLUMNS, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("comments", empty).alias("comments"))


def quality_report(articles: DataFrame, comments: DataFrame, dim: int | None = None) -> DataFrame:
    """One-row constraint report: NOT NULL, VARCHAR(n), UNIQUE and FK violations, and vectors
    that are absent or not ``dim`` long. Both unique keys are counted in one aggregate."""
    nulls = F.count_if(F.greatest(*[F.col(c).isNull() for c in ("source", "rss_guid", "title", "url", "content", "published_at")]))
    lens = [F.count_if(F.length(c) > n).alias(f"{c}_too_long") for c, n in MAX_LEN.items()]
    vectors = [] if dim is None else [F.count_if(bad_vector("embedding", dim)).alias("bad_vectors")]
    base = articles.agg(F.count(F.lit(1)).alias("n_articles"), nulls.alias("null_violations"), *lens, *vectors)
    keys = articles.select(F.explode(F.array(F.struct(F.lit("guid").alias("of"), F.col("rss_guid").alias("v")),
                                             F.struct(F.lit("url").alias("of"), F.col("url").alias("v")))).alias("k"))
    twice = keys.groupBy("k.of", "k.v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.struct(
        F.count_if(F.col("of") == "guid").alias("guid"), F.count_if(F.col("of") == "url").alias("url"))).scalar()
    orphans = comments.join(articles.select(F.col("id").alias("_aid")), comments.article_id == F.col("_aid"), "left_anti").agg(
        F.count(F.lit(1))).scalar()
    return base.select("*", twice["guid"].alias("duplicate_guids"), twice["url"].alias("duplicate_urls"), orphans.alias("orphan_comments"))


def bad_vector(col: str, dim: int) -> Column:
    return F.col(col).isNull() | (F.size(col) != dim)


def length_reason(columns: dict[str, str]) -> Column:
    """``<column>_too_long`` for the first column above its limit, else NULL. ``columns`` maps the
    stored column to the one that holds its value."""
    return F.coalesce(*[F.when(F.length(columns[c]) > n, F.lit(f"{c}_too_long")) for c, n in MAX_LEN.items()])


def quarantine(articles: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows that would violate NOT NULL, a column limit or the vector length into a
    quarantine with a reason."""
    null_key = F.when(F.col("rss_guid").isNull() | F.col("url").isNull(), F.lit("null_key"))
    vector = F.lit(None) if dim is None else F.when(bad_vector("embedding", dim), F.lit("vector_length"))
    tagged = articles.withColumn("reason", F.coalesce(null_key, length_reason({c: c for c in MAX_LEN}), vector))
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def cascade_delete(articles: DataFrame, comments: DataFrame, delete_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete articles and, with them, their comments (anti joins against the delete set)."""
    d = broadcast_if_small(delete_ids.select(F.col("id").alias("_del")).distinct())
    kept_articles = articles.join(d, articles.id == d._del, "left_anti")
    kept_comments = comments.join(d, comments.article_id == d._del, "left_anti")
    return kept_articles, kept_comments


def backfill_previews(articles: DataFrame) -> DataFrame:
    """The data migration: preview = first 280 chars of whitespace-collapsed, trimmed content."""
    return articles.withColumn("content_preview", X.preview_backfill("content"))


def missing_ids(articles: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The requested ids that no article has (what a reindex request reports)."""
    req = ids.select(F.col(id_col).alias("_rid")).distinct()
    hit = articles.select(F.col("id").alias("_hit")).join(broadcast_if_small(req), F.col("_hit") == F.col("_rid"), "left_semi")
    return req.join(hit, F.col("_rid") == F.col("_hit"), "left_anti").select(F.col("_rid").alias(id_col))


def reindex(articles: DataFrame, ids: DataFrame | None, embedder: Embedder | None = None, dim: int = 64) -> DataFrame:
    """Re-clean stored content, re-embed title + content and refresh the preview for the
    articles in ``ids`` (all when None); stored ``content`` is left as is. Ids that no article
    has change nothing; ``missing_ids`` names them."""
    cols = articles.columns
    if ids is None:
        todo, rest = articles, None
    else:
        k = broadcast_if_small(ids.select(F.col("id").alias("_rid")).distinct())
        todo = articles.join(k, articles.id == k._rid, "left_semi")
        rest = articles.join(k, articles.id == k._rid, "left_anti")
    todo = todo.withColumn("_clean", X.strip_html("content"))
    todo = todo.withColumn("_etext", X.embedding_text(F.col("title"), F.col("_clean")))
    todo = embed(todo.drop("embedding"), "_etext", "embedding", embedder, dim)
    todo = todo.withColumn("content_preview", X.make_preview("_clean")).select(*cols)
    return todo if rest is None else todo.unionByName(rest)


def display_comments(comments: DataFrame) -> DataFrame:
    return comments.withColumn("author_display", X.display_author("author_name"))


def clean_for_display(col) -> Column:
    """Read-time clean of stored content (the template filter)."""
    return X.strip_html(col)
