"""Training-pair preparation queries over the conversation-derived pair corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import training as TR
from corpusflow.plans.q_ingest import sql_hash_weights
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import cte, with_ctes
from corpusflow.sources import fixtures as FX
from corpusflow.session import materialize, scratch_path

SPEC = TR.BatchSpec()
S = SPEC.samples_per_draw
DPB = SPEC.datasets_per_batch
REDDIT = ("conv0",)
MIN_CONTEXT = 20  # shorter anchors are written without a context key (dropped on load)


def pair_lines(spark, sf_dir):
    """The pair corpora as JSON lines in the three formats: reddit objects (conv0),
    ``{"texts": [...]}`` (conv1) and bare lists (conv2)."""
    p = FX.training_pairs(spark, sf_dir)
    t0, t1 = F.get("texts", 0), F.get("texts", 1)
    line = (
        F.when(F.col("dataset") == "conv0",
               F.to_json(F.struct(t1.alias("response"), F.when(F.length(t0) >= MIN_CONTEXT, t0).alias("context"))))
        .when(F.col("dataset") == "conv1", F.to_json(F.struct(F.col("texts").alias("texts"))))
        .otherwise(F.to_json("texts"))
    )
    return p.select("dataset", "pair_id", line.alias("line"))


def loaded(spark, sf_dir):
    return TR.check_arity(materialize(TR.parse_pairs(pair_lines(spark, sf_dir), REDDIT)))


def packed(spark, sf_dir):
    pairs = loaded(spark, sf_dir)
    draws = materialize(TR.weighted_draws(spark, pairs, FX.PAIR_WEIGHTS, SPEC))
    order = materialize(TR.epoch_order(pairs, SPEC))
    return materialize(TR.pack_batches(order, draws, SPEC))


SHARD = 8       # iterations of a shard


def refilled(spark, sf_dir):
    pairs = loaded(spark, sf_dir)
    draws = materialize(TR.weighted_draws(spark, pairs, FX.PAIR_WEIGHTS, SPEC))
    return TR.greedy_batches(materialize(TR.epoch_order(pairs, SPEC)), draws, SPEC, SHARD)


def undoubled(spark, sf_dir):
    return TR.dedupe_batches(packed(spark, sf_dir), SPEC)


def _manifest_sql() -> str:
    rows, start = [], 0
    for name, w in FX.PAIR_WEIGHTS:
        rows.append(f"('{name}', {w}, {start}, {start + w - 1})")
        start += w
    return "select * from (values " + ", ".join(rows) + ") m(dataset, weight, first, last)"


WALL = sum(w for _, w in FX.PAIR_WEIGHTS)

cte("pairs_loaded", f"""
select dataset, pair_id, case when dataset = 'conv0' then [texts[2], texts[1]] else texts end as texts
from training_pairs
where not (dataset = 'conv0' and (texts[1] is null or length(texts[1]) < {MIN_CONTEXT} or texts[2] is null))""")
cte("pairs_width", "select dataset, max(len(texts)) as width from pairs_loaded group by dataset")
cte("pairs_manifest", f"""
select m.*, w.width, coalesce(sum(m.weight) over (partition by w.width order by m.first rows between unbounded preceding and 1 preceding), 0) as wfirst
from ({_manifest_sql()}) m join pairs_width w on w.dataset = m.dataset""")
cte("pairs_draws_raw", f"""
select i // {DPB} as batch_id, i % {DPB} as draw,
       ('0x' || substr(md5('{SPEC.seed}:' || cast(i // {DPB} as varchar) || ':' || cast(i % {DPB} as varchar)), 1, 8))::bigint / 4294967296.0 as u
from (select unnest(range((select greatest(1, cast(ceil(count(*) / {DPB * S}.0) as bigint)) from pairs_loaded) * {DPB})) as i)""")
cte("pairs_draws_first", f"""
select d.batch_id, d.draw, m.dataset, m.width
from pairs_draws_raw d join pairs_manifest m on floor(d.u * {WALL}) between m.first and m.last where d.draw = 0""")
cte("pairs_draws", """
select * from pairs_draws_first
union all
select d.batch_id, d.draw, m.dataset, m.width
from pairs_draws_raw d join pairs_draws_first f on f.batch_id = d.batch_id
     join (select width, sum(weight) as wsum from pairs_manifest group by width) ws on ws.width = f.width
     join pairs_manifest m on m.width = f.width and floor(d.u * ws.wsum) between m.wfirst and m.wfirst + m.weight - 1
where d.draw > 0""")
cte("pairs_order", f"""
select dataset, pair_id, texts,
       row_number() over (partition by dataset order by ('0x' || substr(md5('{SPEC.seed}:{SPEC.epoch}:' || cast(pair_id as varchar)), 1, 15))::bigint) - 1 as r
from pairs_loaded""")
cte("pairs_packed", f"""
select q.batch_id, q.draw, j // {SPEC.batch_size} as chunk, j % {SPEC.batch_size} as slot, q.dataset, o.pair_id, o.texts
from (select *, row_number() over (partition by dataset order by batch_id * {DPB} + draw) - 1 as q from pairs_draws) q
     join (select dataset, count(*) as n_ds from pairs_loaded group by dataset) z on z.dataset = q.dataset
     cross join range({S}) t(j)
     join pairs_order o on o.dataset = q.dataset and o.r = (q.q * {S} + t.j) % z.n_ds""")
cte("pairs_pos", f"select *, draw * {S} + chunk * {SPEC.batch_size} + slot as pos from pairs_packed")
cte("pairs_dedup", """
select * exclude (pos), row_number() over (partition by batch_id order by pos) - 1 as new_pos
from pairs_pos p
where not exists (
  select 1 from (select batch_id, pos, unnest(list_distinct(texts)) as t from pairs_pos) x
  join (select batch_id, t, min(pos) as owner from (select batch_id, pos, unnest(list_distinct(texts)) as t from pairs_pos) group by all) o
    on o.batch_id = x.batch_id and o.t = x.t
  where x.batch_id = p.batch_id and x.pos = p.pos and o.owner <> x.pos)""")
cte("pairs_rows", f"""
select batch_id, draw, chunk // {SPEC.nprocs} as step, (chunk % {SPEC.nprocs}) * {SPEC.batch_size} + slot as i, texts
from pairs_dedup""")
cte("pairs_texts", f"""
select batch_id, draw, step, i as j, texts[1] as txt, 'a' as role from pairs_rows
union all select batch_id, draw, step, i, texts[2], 'c' from pairs_rows
union all select batch_id, draw, step, {SPEC.nprocs * SPEC.batch_size} + i, texts[3], 'c' from pairs_rows where len(texts) > 2""")
cte("pairs_text_keys", "select distinct txt from pairs_texts")
cte("pairs_text_w", sql_hash_weights("pairs_text_keys", "txt", "txt"))
cte("pairs_scores", f"""
select a.batch_id, a.draw, a.step, a.j as i, c.j, {SPEC.scale} * coalesce((
         select sum(wa.weight * wc.weight) from pairs_text_w wa join pairs_text_w wc on wc.dim = wa.dim and wc.k = c.txt
         where wa.k = a.txt), 0) as score
from pairs_texts a join pairs_texts c on c.batch_id = a.batch_id and c.draw = a.draw and c.step = a.step
where a.role = 'a' and c.role = 'c'""")


@query("pairs_load", sql=with_ctes("""
select dataset, pair_id, pos, text from (
  select dataset, pair_id, unnest(range(len(texts))) as pos, unnest(texts) as text from pairs_loaded)"""))
def q_pairs_load(spark, sf_dir):
    """JSON lines in three formats -> (dataset, texts); reddit rows need both keys."""
    p = loaded(spark, sf_dir)
    return p.select("dataset", "pair_id", F.posexplode("texts").alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


def pair_files(spark, sf_dir):
    """The corpora as gzipped files, one folder per dataset, some lines cut off and some blank; read
    back with a reason for every line that holds no texts."""
    import uuid

    out = scratch_path(spark, "runs", f"pair_files-{uuid.uuid4().hex[:12]}")
    p = pair_lines(spark, sf_dir)
    line = F.when(F.col("pair_id") % 11 == 5, F.expr("left(line, length(line) div 2)")).when(F.col("pair_id") % 13 == 6, F.lit("  ")).otherwise(
        F.col("line"))
    p.select("dataset", line.alias("line")).write.partitionBy("dataset").option("compression", "gzip").text(out)
    return TR.split_pairs(TR.read_pair_lines(spark, [f"{out}/*"], by_folder=True), REDDIT)


cte("pair_files", f"""
select dataset, case when dataset = 'conv0' then [texts[2], texts[1]] else texts end as texts,
       case when pair_id % 11 = 5 then 'not_json' when pair_id % 13 = 6 then 'empty'
            when dataset = 'conv0' and (texts[1] is null or length(texts[1]) < {MIN_CONTEXT} or texts[2] is null) then 'missing_key' end as reject_reason
from training_pairs""")


@query("pairs_files", sql=with_ctes("""
select dataset, pos, text, count(*) as n from (
  select dataset, unnest(range(len(texts))) as pos, unnest(texts) as text from pair_files where reject_reason is null) group by all"""))
def q_pairs_files(spark, sf_dir):
    """Pair corpora from gzipped files, in three formats, some lines damaged."""
    p = pair_files(spark, sf_dir).filter("reject_reason is null")
    return p.select("dataset", F.posexplode("texts").alias("pos", "text")).withColumn("pos", F.col("pos").cast("long")).groupBy(
        "dataset", "pos", "text").agg(F.count(F.lit(1)).alias("n"))


@query("pairs_rejects", sql=with_ctes("""
select dataset, coalesce(reject_reason, 'kept') as outcome, count(*) as n from pair_files group by all"""))
def q_pairs_rejects(spark, sf_dir):
    """Every line of the files is kept or has a reason."""
    return pair_files(spark, sf_dir).groupBy("dataset", F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


@query("pairs_arity", sql=with_ctes("""
select dataset, count(*) as n_rows, min(len(texts)) as min_cols, max(len(texts)) as max_cols,
       min(len(texts)) = max(len(texts)) as consistent
from pairs_loaded group by dataset"""))
def q_pairs_arity(spark, sf_dir):
    """Every dataset must be all pairs or all triplets."""
    a = TR.arity(loaded(spark, sf_dir))
    return a.select("dataset", "n_rows", F.col("min_cols").cast("long").alias("min_cols"),
                    F.col("max_cols").cast("long").alias("max_cols"), "consistent")


@query("pairs_shuffle", sql=with_ctes("select dataset, pair_id, r from pairs_order"))
def q_pairs_shuffle(spark, sf_dir):
    """The epoch's deterministic shuffle position of each pair within its dataset."""
    return TR.epoch_order(loaded(spark, sf_dir), SPEC).select("dataset", "pair_id", "r")


@query("pairs_weighted_sample", sql=with_ctes("select batch_id, draw, dataset, width from pairs_draws"))
def q_pairs_sample(spark, sf_dir):
    """Weighted dataset draws per iteration, later draws of the same width."""
    d = TR.weighted_draws(spark, loaded(spark, sf_dir), FX.PAIR_WEIGHTS, SPEC)
    return d.select("batch_id", F.col("draw").cast("long").alias("draw"), "dataset", F.col("width").cast("long").alias("width"))


@query("batch_pack", sql=with_ctes("select batch_id, draw, chunk, slot, dataset, pair_id from pairs_packed"))
def q_batch_pack(spark, sf_dir):
    """Device batches filled from each drawn dataset's shuffled stream."""
    p = packed(spark, sf_dir)
    return p.select("batch_id", F.col("draw").cast("long").alias("draw"), F.col("chunk").cast("long").alias("chunk"),
                    F.col("slot").cast("long").alias("slot"), "dataset", "pair_id")


@query("batch_dedupe", sql=with_ctes("select batch_id, new_pos, dataset, pair_id from pairs_dedup"))
def q_batch_dedupe(spark, sf_dir):
    """No text twice in one iteration (first holder keeps it), slots re-packed."""
    d = undoubled(spark, sf_dir)
    return d.select("batch_id", F.col("new_pos").cast("long").alias("new_pos"), "dataset", "pair_id")


cte("refill_slices", f"""
select shard, dataset, n_ds, floor(n_ds * bef / tot)::bigint as lo,
       greatest(floor(n_ds * (bef + need) / tot)::bigint - floor(n_ds * bef / tot)::bigint, least(n_ds, need * {S})) as n
from (select *, coalesce(sum(need) over (partition by dataset order by shard rows between unbounded preceding and 1 preceding), 0) as bef,
             sum(need) over (partition by dataset) as tot
      from (select batch_id // {SHARD} as shard, dataset, count(*) as need from pairs_draws group by all)
           join (select dataset, count(*) as n_ds from pairs_loaded group by dataset) using (dataset))""")
cte("refill_queue", f"""
select batch_id // {SHARD} as shard, row_number() over (partition by batch_id // {SHARD} order by batch_id, draw) as q, batch_id, draw, dataset
from pairs_draws""")
# one step looks at one sample: at[d] samples of the shard's dataset d were looked at before
cte("refill_run", f"""
select shard, 1::bigint as q, 0::bigint as j, 0::bigint as passed, -1::bigint as cur, []::varchar[] as taken,
       (select list({{'d': dataset, 'n': 0::bigint}}) from (select distinct dataset from pairs_loaded)) as looked, null::bigint as pair_id, null::bigint as o_q, null::bigint as o_j
from (select distinct shard from refill_queue)
union all
select shard, case when j2 = {S} or passed2 >= n then q + 1 else q end, case when j2 = {S} or passed2 >= n then 0 else j2 end,
       case when j2 = {S} or passed2 >= n then 0 else passed2 end, batch_id, case when ok then seen || texts else seen end,
       list_transform(looked, lambda x: {{'d': x.d, 'n': case when x.d = dataset then x.n + 1 else x.n end}}), case when ok then pid end, q, j
from (select *, j + ok::bigint as j2, case when ok then 0 else passed + 1 end as passed2
      from (select r.shard, r.q, r.j, r.passed, r.looked, k.batch_id, k.dataset, s.n, o.texts, o.pair_id as pid,
                   case when k.batch_id = r.cur then r.taken else []::varchar[] end as seen,
                   not list_has_any(case when k.batch_id = r.cur then r.taken else []::varchar[] end, o.texts) as ok
            from refill_run r join refill_queue k on k.shard = r.shard and k.q = r.q
                 join refill_slices s on s.shard = k.shard and s.dataset = k.dataset
                 join pairs_order o on o.dataset = k.dataset
                   and o.r = (s.lo + list_filter(r.looked, lambda x: x.d = k.dataset)[1].n % s.n) % s.n_ds))""")


@query("batch_refill", sql=with_ctes(f"""
select k.batch_id, k.draw, o_j // {SPEC.batch_size} as chunk, o_j % {SPEC.batch_size} as slot, k.dataset, r.pair_id
from refill_run r join refill_queue k on k.shard = r.shard and k.q = r.o_q where r.pair_id is not null"""))
def q_batch_refill(spark, sf_dir):
    """The greedy scan with refill: no text twice in an iteration, and every iteration full."""
    p = refilled(spark, sf_dir)
    return p.select("batch_id", F.col("draw").cast("long").alias("draw"), F.col("chunk").cast("long").alias("chunk"),
                    F.col("slot").cast("long").alias("slot"), "dataset", "pair_id")


@query("inbatch_scores", sql=with_ctes("select batch_id, draw, step, i, j, round(score, 6) + 0.0 as score from pairs_scores"))
def q_inbatch_scores(spark, sf_dir):
    """Scaled cosine scores of every anchor against every candidate of its step."""
    s = TR.inbatch_scores(undoubled(spark, sf_dir), SPEC)
    return s.select("batch_id", F.col("draw").cast("long").alias("draw"), F.col("step").cast("long").alias("step"),
                    F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
                    (F.round("score", 6) + F.lit(0.0)).alias("score"))


cte("loss_lse_row", "select batch_id, draw, step, i, ln(sum(exp(score))) as lse from pairs_scores group by all")
cte("loss_mi", "select batch_id, draw, step, max(i) as mi from pairs_scores group by all")
cte("loss_lse_col", """
select s.batch_id, s.draw, s.step, s.j as i, ln(sum(exp(s.score))) as lse
from pairs_scores s join loss_mi m on m.batch_id = s.batch_id and m.draw = s.draw and m.step = s.step
where s.j <= m.mi group by all""")
cte("loss_diag", "select batch_id, draw, step, i, score as d from pairs_scores where i = j")
cte("loss_rl", "select batch_id, draw, step, avg(lse - d) as row_loss from loss_lse_row join loss_diag using (batch_id, draw, step, i) group by all")
cte("loss_cl", "select batch_id, draw, step, avg(lse - d) as col_loss from loss_lse_col join loss_diag using (batch_id, draw, step, i) group by all")
cte("loss_w", f"select batch_id, draw, chunk // {SPEC.nprocs} as step, max(len(texts)) as width from pairs_dedup group by all")


@query("inbatch_loss", sql=with_ctes("""
select batch_id, draw, step, round(case when width = 2 then (row_loss + col_loss) / 2 else row_loss end, 6) + 0.0 as loss
from loss_rl join loss_cl using (batch_id, draw, step) join loss_w using (batch_id, draw, step)"""))
def q_inbatch_loss(spark, sf_dir):
    """Symmetric (pairs) or one-way (triplets) in-batch cross-entropy per step."""
    loss = TR.inbatch_loss(undoubled(spark, sf_dir), SPEC)
    return loss.select("batch_id", F.col("draw").cast("long").alias("draw"), F.col("step").cast("long").alias("step"),
                       (F.round("loss", 6) + F.lit(0.0)).alias("loss"))
