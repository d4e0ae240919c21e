"""Vectors: normalisation, distance, embedding, pooling and k-NN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.text import embedding_text
from corpusflow.functions.vectors import cosine_distance, l2_normalize
from corpusflow.operators import similar as SIM
from corpusflow.operators.embed import MAX_TOKENS, hashing_vector, pool_tokens, token_bucket, tokens
from corpusflow.plans import sqltext as S
from corpusflow.plans.q_articles import _sql_dist
from corpusflow.plans.q_ingest import sql_hash_weights
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import cte, with_ctes
from corpusflow.sources import fixtures as FX
from corpusflow.sources.tables import table

TOPK_SUBJECT = 7
K = 5


def _r6(c):
    return F.round(c, 6) + F.lit(0.0)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding")


@query("l2_normalize", sql="""
select vec_id, d - 1 as dim, round(x / sqrt(list_sum(list_transform(e, lambda y: y * y))), 6) + 0.0 as value
from (select vec_id, cast(embedding as double[]) as e, unnest(range(1, len(embedding) + 1)) as d, unnest(cast(embedding as double[])) as x
      from embeddings)""")
def q_l2(spark, sf_dir):
    """Unit-length vectors (zero vectors give NULL)."""
    v = _vectors(spark, sf_dir).select("vec_id", l2_normalize("embedding").alias("u"))
    v = v.select("vec_id", F.posexplode("u").alias("dim", "value"))
    return v.select("vec_id", F.col("dim").cast("long").alias("dim"), _r6(F.col("value")).alias("value"))


@query("cosine_distance", sql=f"""
select a.vec_id as a_id, b.vec_id as b_id, round({_sql_dist('a.embedding', 'b.embedding')}, 6) + 0.0 as distance
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q_cosine(spark, sf_dir):
    """V1: cosine distance between consecutive vectors."""
    v = _vectors(spark, sf_dir)
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id").alias("a_id"), F.col("b.vec_id").alias("b_id"),
                    _r6(cosine_distance(F.col("a.embedding"), F.col("b.embedding"))).alias("distance"))


@query("similar_topk", sql=with_ctes(f"""
select row_number() over (order by distance, id) as rank, id, source, title, url,
       round(distance, 6) + 0.0 as distance, round(greatest(0, 1 - distance), 6) + 0.0 as similarity
from (select a.id, a.source, a.title, a.url, {_sql_dist('a.embedding', 's.embedding')} as distance
      from articles a, (select embedding from articles where id = {TOPK_SUBJECT}) s where a.id <> {TOPK_SUBJECT})
where distance is not null and not isnan(distance) order by distance, id limit {K}"""))
def q_similar_topk(spark, sf_dir):
    """The 5 articles closest to one article, similarity clamped at 0."""
    r = SIM.similar_to(FX.articles(spark, sf_dir), TOPK_SUBJECT, K)
    return r.select(F.col("rank").cast("long").alias("rank"), "id", "source", "title", "url",
                    _r6(F.col("distance")).alias("distance"), _r6(F.col("similarity")).alias("similarity"))


ALL_PAIRS_SQL = f"""
select subject_id, rank, id, round(distance, 6) + 0.0 as distance, round(greatest(0, 1 - distance), 6) + 0.0 as similarity from (
  select *, row_number() over (partition by subject_id order by distance, id) as rank from (
    select a.vec_id as subject_id, b.vec_id as id, {_sql_dist('a.embedding', 'b.embedding')} as distance
    from embeddings a join embeddings b on a.vec_id <> b.vec_id)
  where distance is not null and not isnan(distance))
where rank <= {K}"""


def _pairs_out(df):
    return df.select("subject_id", F.col("rank").cast("long").alias("rank"), "id",
                     _r6(F.col("distance")).alias("distance"), _r6(F.col("similarity")).alias("similarity"))


@query("similar_all_pairs", sql=ALL_PAIRS_SQL)
def q_all_pairs(spark, sf_dir):
    """Exact top-5 neighbours of every vector (blocked matmul)."""
    return _pairs_out(SIM.all_pairs_topk(_vectors(spark, sf_dir), K, "vec_id", "embedding"))


SUBJECT_STEP = 50


@query("similar_subjects", sql=f"select * from ({ALL_PAIRS_SQL}) where subject_id % {SUBJECT_STEP} = 0")
def q_similar_subjects(spark, sf_dir):
    """J4 for a set of subjects: the exact neighbours, among all vectors, of every id that
    ``SUBJECT_STEP`` divides (the query set; all rows are searched)."""
    v = _vectors(spark, sf_dir)
    return _pairs_out(SIM.topk_for(v, v.filter(F.col("vec_id") % SUBJECT_STEP == 0), K, "vec_id", "embedding"))


LSH_SEED, LSH_RECALL = 17, 0.9

cte("lsh_vecs", "select vec_id as id, cast(embedding as double[]) as e from embeddings where list_dot_product(cast(embedding as double[]), cast(embedding as double[])) > 0")
cte("lsh_angle", f"""
select avg(acos(least(1.0, greatest(-1.0, 1 - d)))) as angle from (
  select d, row_number() over (partition by subject order by d, id) as rank from (
    select a.id as subject, b.id as id, {_sql_dist('a.e', 'b.e')} as d
    from (select * from lsh_vecs order by md5(cast(id as varchar)), id limit {SIM.SAMPLE_SUBJECTS}) a
         join lsh_vecs b on b.id <> a.id))
where rank = {K}""")
cte("lsh_shapes", f"""
select b, cast(ceil(ln({1 - LSH_RECALL!r}) / ln(1 - pow(p, b))) as bigint) as t
from (select unnest(range(1, {SIM.MAX_BITS + 1})) as b) bb, (select least(1 - 1e-9, greatest(0.5, 1 - angle / pi())) as p from lsh_angle) pp""")
cte("lsh_bits", f"""
select (select b from lsh_shapes order by t * ((select count(*) from lsh_vecs) / pow(2, b) + {SIM.TABLE_COST}), b limit 1) as bits,
       (select t from lsh_shapes order by t * ((select count(*) from lsh_vecs) / pow(2, b) + {SIM.TABLE_COST}), b limit 1) as tables,
       (select max(len(e)) from lsh_vecs) as dim""")
cte("lsh_planes", f"""
select t, b, i, case when ('0x' || substr(md5('{LSH_SEED}:' || cast(t as varchar) || ':' || cast(b as varchar) || ':' || cast(i as varchar)), 1, 1))::int % 2 = 0
                     then 1.0 else -1.0 end as sgn
from (select unnest(range((select tables from lsh_bits))) as t) tt,
     (select unnest(range((select bits from lsh_bits))) as b) bb,
     (select unnest(range((select dim from lsh_bits))) as i) ii""")
cte("lsh_sig", """
select v.id, p.t, p.b, sum(v.x * p.sgn) as d
from (select id, unnest(range(len(e))) as i, unnest(e) as x from lsh_vecs) v join lsh_planes p on p.i = v.i
group by all""")
cte("lsh_bucket", "select id, t, sum(case when d >= 0 then (1::bigint << b) else 0 end) as bucket from lsh_sig group by id, t")
cte("lsh_cands", """
select distinct a.id as subject_id, c.id as id from lsh_bucket a join lsh_bucket c on c.t = a.t and c.bucket = a.bucket and c.id <> a.id""")
cte("lsh_top", f"""
select subject_id, rank, id, distance from (
  select *, row_number() over (partition by subject_id order by distance, id) as rank from (
    select k.subject_id, k.id,
           1 - list_dot_product(a.e, c.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(c.e, c.e))) as distance
    from lsh_cands k join lsh_vecs a on a.id = k.subject_id join lsh_vecs c on c.id = k.id))
where rank <= {K}""")
cte("exact_top", ALL_PAIRS_SQL)


@query("similar_lsh", sql=with_ctes(f"""
select subject_id, rank, id, round(distance, 6) + 0.0 as distance, round(greatest(0, 1 - distance), 6) + 0.0 as similarity
from lsh_top"""))
def q_lsh(spark, sf_dir):
    """V5: approximate top-5 neighbours from sign-hyperplane LSH buckets, exactly re-ranked."""
    return _pairs_out(SIM.lsh_topk(_vectors(spark, sf_dir), K, 64, "vec_id", "embedding", seed=LSH_SEED, recall=LSH_RECALL))


@query("lsh_recall", sql=with_ctes(f"""
select round(avg(coalesce(h, 0) / {K}.0), 6) + 0.0 as recall_at_k, count(*) as subjects
from (select distinct subject_id from exact_top) s
left join (select l.subject_id, count(*) as h from lsh_top l join exact_top x on x.subject_id = l.subject_id and x.id = l.id
           group by l.subject_id) hh using (subject_id)"""))
def q_lsh_recall(spark, sf_dir):
    """V6: recall@5 of the LSH neighbours against the exact ones."""
    v = _vectors(spark, sf_dir)
    approx = SIM.lsh_topk(v, K, 64, "vec_id", "embedding", seed=LSH_SEED, recall=LSH_RECALL)
    r = SIM.recall_at_k(approx, SIM.all_pairs_topk(v, K, "vec_id", "embedding"), K)
    return r.select((F.round("recall_at_k", 6) + F.lit(0.0)).alias("recall_at_k"), "subjects")


cte("article_etext", f"select id, {S.embedding_text('title', 'content')} as etext from articles")
cte("article_emb", sql_hash_weights("article_etext", "id", "etext"))


@query("embed_articles", sql=with_ctes("select k as id, dim, round(weight, 6) + 0.0 as weight from article_emb where weight <> 0"))
def q_embed_articles(spark, sf_dir):
    """Hashing embedding of every article's embedding text (the whole text)."""
    a = FX.articles(spark, sf_dir).select("id", hashing_vector(embedding_text(F.col("title"), F.col("content"))).alias("v"))
    # posexplode_outer: no inferred size(v) > 0 filter re-running the UDFs below the join
    e = a.select("id", F.posexplode_outer("v").alias("dim", "weight")).filter(F.col("weight") != 0)
    return e.select("id", F.col("dim").cast("int").alias("dim"), _r6(F.col("weight").cast("double")).alias("weight"))


@query("mean_pool", sql=f"""
with t as (
  select doc_id, ((('0x' || substr(md5(tok), 1, 8))::bigint) % (select count(*) from embeddings))::bigint as vec_id,
         case when pos <= {MAX_TOKENS} then 1.0 else 0.0 end as m
  from (select doc_id, unnest(ts) as tok, unnest(range(1, len(ts) + 1)) as pos
        from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ts from documents)))
select doc_id, dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 as value from (
  select t.doc_id, d - 1 as dim, x, m from t join (
    select vec_id, unnest(range(1, len(embedding) + 1)) as d, unnest(cast(embedding as double[])) as x from embeddings) v
  on v.vec_id = t.vec_id)
group by doc_id, dim""")
def q_mean_pool(spark, sf_dir):
    """Masked mean pooling of token vectors into one vector per document. Every
    token of the whole text is read; the attention mask is 1 on the first 256 (the model's
    input limit) and 0 on the others, whose vectors weigh nothing."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    toks = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "tok"))
    toks = toks.select("doc_id", token_bucket(F.col("tok"), FX.row_count(spark, sf_dir, "embeddings")).cast("long").alias("vec_id"),
                       F.when(F.col("pos") < MAX_TOKENS, F.lit(1.0)).otherwise(F.lit(0.0)).alias("m"))
    # tokens behind the mask weigh nothing, so a document has at most MAX_TOKENS vectors
    pooled = pool_tokens(toks.filter("m > 0"), _vectors(spark, sf_dir), "doc_id")
    out = pooled.select("doc_id", F.posexplode("p").alias("dim", "value"))
    return out.select("doc_id", F.col("dim").cast("long").alias("dim"), _r6(F.col("value")).alias("value"))
