"""DuckDB SQL with the same rows as the operators' queries, where SQL can express them."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UP, LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP4 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
p as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') as ws,
             string_split(text, chr(10)) as ls from d),
wins as (select r, i, hash(list_slice(ws, i, i + 7)) as h
         from (select r, ws, unnest(range(1, len(ws) - 6)) as i from p where len(ws) > 8)),
rep as (select r, i from (select r, i, count(*) over (partition by r, h) as n from wins) where n > 1),
cov as (select r, count(distinct i + k) as n from rep, (select unnest(range(0, 8)) as k) group by r),
m as (select p.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (length(text) - length(replace(text, '!', '')))::bigint as n_exclaim, len(ls)::bigint as n_lines,
  (len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
   - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
  coalesce(cov.n, 0)::bigint as n_repeat_words from p left join cov using (r)),
b as (select *, (n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (100 * n_symbols > 20 * n_words)::int
  + 8 * (10 * n_dup_lines > 3 * n_lines)::int + 16 * (100 * n_exclaim > 30 * n_words)::int
  + 32 * (word_chars < 2 * n_words)::int + 64 * (word_chars > 20 * n_words)::int as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed,
  (bits & 119) = 0 as kept, bits::bigint as fail_bits, only_rule, (case when only_rule is not null then count(*) over (partition by only_rule) end)::bigint as n_only_rule
from (select *, case bits & 119 when 1 then 'too_short' when 2 then 'repeated_words' when 4 then 'symbols' when 16 then 'exclamation'
                when 32 then 'word_length_low' when 64 then 'word_length_high' end as only_rule from b)
"""

_WORDS5 = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UP}, {LOW}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP5 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS5} as ws from documents),
it as (select coalesce(item_id::varchar, 'null') as item, {_WORDS5} as ws from benchmark),
win as (select distinct item, list_slice(ws, s, s + 9) as w from
  (select item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) as s from it where len(ws) > 0)),
lens as (select distinct len(w) as l from win),
dw as (select r, s, l, list_slice(ws, s, s + l - 1) as w from
  (select r, ws, l, unnest(range(1, len(ws) - l + 2)) as s from d, lens where len(ws) >= l)),
hit as (select r, s, l, item from dw join win using (w)),
cov as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + l)) as p from (select distinct r, s, l from hit)) group by r),
its as (select r, count(distinct item) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (r) left join its using (r)
"""

_LINES10 = "string_split(coalesce(text, ''), chr(10))"
OP10 = f"""
with d as (select row_number() over () as r, doc_id, {_LINES10} as ls from documents),
l as (select r, unnest(ls) as line, unnest(range(0, len(ls))) as pos from d),
k as (select r, pos, line, translate(trim(line, {TRIM}), {UP}, {LOW}) as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10),
z as (select k.r, pos, line, f.key is not null as gone from k left join f on k.key = f.key),
a as (select r, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
             coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from z group by r)
select d.doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d join a using (r)
"""

OP11 = f"""
with tab as (select list(list_reduce(range(0, 8), lambda c, k: if(c % 2 = 1, xor(c // 2, 3988292384), c // 2), b) order by b) as t from range(0, 256) r(b)),
d as (select row_number() over () as r, doc_id, ws from (select doc_id, {_WORDS5} as ws from documents)),
dw as (select r, unnest(ws) as w from d),
tw as (select unnest(ws) as w from (select {_WORDS5} as ws from benchmark)),
v as (select w, list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::bigint) as bs
      from (select w from dw union select w from tw)),
crc as (select w, xor(list_reduce(bs, lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 as b from v, tab),
s as (select b, count(*) as n from dw join crc using (w) group by b),
t as (select b, count(*) as n from tw join crc using (w) group by b),
g as (select b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
        / ((s.n + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain from s left join t using (b)),
w as (select r, sum(gain)::bigint as weight from dw join crc using (w) join g using (b) group by r),
sc as (select d.r, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5)::double
    / 4294967296)))::bigint as score from d left join w using (r)),
rk as (select r, row_number() over (order by score desc, doc_id asc nulls last) as k from sc where n_features >= 20)
select doc_id, n_features, weight, score, if(k <= (select count(*) from rk) * 10 // 100, k, null)::bigint as rank from sc left join rk using (r)
"""

_NEAR12 = "min({'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'k': k}) as a"


def _mean12(i: int) -> str:
    return f"""m{i} as (select p, k, list(m order by j) as c from
  (select p, a.k as k, j, ((sum(x[j]) - (sum(x[j]) % count(*) + count(*)) % count(*)) / count(*))::bigint as m
   from a{i}, w, unnest(range(1, w + 1)) u(j) group by p, a.k, j) group by p, k),
c{i} as (select o.p, o.k, coalesce(m.c, o.c) as c from c{i - 1} o left join m{i} m using (p, k))"""


OP12 = f"""
with e0 as (select vec_id, label, list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = len(embedding)),
e as (select row_number() over () as r, * from e0),
w as (select any_value(len(v)) // 16 as w from e),
p as (select r, p, list_slice(v, p * w + 1, p * w + w) as x from e, w, unnest(range(0, 16)) u(p)),
first as (select r, row_number() over (order by vec_id, v) - 1 as k from e qualify k < 64),
c0 as (select p, k, x as c from p join first using (r)),
a1 as (select r, p, any_value(x) as x, {_NEAR12} from p join c0 using (p) group by r, p),
{_mean12(1)},
a2 as (select r, p, any_value(x) as x, {_NEAR12} from p join c1 using (p) group by r, p),
{_mean12(2)},
a3 as (select r, p, {_NEAR12} from p join c2 using (p) group by r, p),
code as (select r, string_agg(printf('%02x', a.k), '' order by p) as code, sum(a.d)::bigint as error from a3 group by r),
books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, k)) as codebooks_sha256 from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e join code using (r), books
"""

ORACLE = {"op4_quality": OP4, "op5_decontam": OP5, "op10_line_dedup": OP10, "op11_importance": OP11, "op12_vector_codes": OP12}
