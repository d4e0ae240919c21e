"""The FIXTURES.md views as DuckDB CTEs over the pre-registered tables, plus a resolver
that inlines the CTEs an oracle query needs (SQL text cannot see Spark views)."""

from __future__ import annotations

import re

from corpusflow.plans import sqltext as S

INGEST_TS = "TIMESTAMP '2026-01-01 00:00:00'"
RFC = "strftime(e.ts, '%a, %d %b %Y %H:%M:%S')"
DAYS = "mon|tue|wed|thu|fri|sat|sun"
MONTHS = "january february march april may june july august september october november december".split()
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
         "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
TS_FMT = "'%Y-%m-%d %H:%M:%S'"

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _deps(body: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", body)]


def with_ctes(final: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _deps(CTES[n]):
            if d != n:
                visit(d)
        order.append(n)

    for n in _deps(final):
        visit(n)
    if not order:
        return final
    # a CTE that names itself is recursive
    head = "with recursive " if any(re.search(rf"\b{n}\b", CTES[n]) for n in order) else "with "
    return head + ",\n".join(f"{n} as (\n{CTES[n]}\n)" for n in order) + "\n" + final


def derived(name: str, source: str, names: dict[str, str]) -> None:
    """Register ``name`` as CTE ``source`` over other relations."""
    cte(name, re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: names[m[1]], CTES[source]))


def published_sql(src: str, strict: bool) -> str:
    """CTE body adding ``published_parsed`` to relation ``src`` (columns published, updated)."""
    mon = "case when lower(pp[2]) in ({}) then upper(left(pp[2], 1)) || lower(substr(pp[2], 2, 2)) else pp[2] end".format(
        ", ".join(f"'{m}'" for m in MONTHS))
    zone_case = " ".join(f"when upper(coalesce(pp[5], '')) = '{z}' then {o}" for z, o in ZONES.items())
    off = (f"case when regexp_matches(coalesce(pp[5], ''), '^[+-][0-9]{{4}}$') then "
           f"(case when left(pp[5], 1) = '-' then -1 else 1 end) * (cast(substr(pp[5], 2, 2) as int) * 60 + cast(substr(pp[5], 4, 2) as int)) "
           f"{zone_case} else 0 end")
    body = f"""
select *, case when len(pp) >= 4 then coalesce(
            try_strptime(pp[1] || ' ' || {mon} || ' ' || pp[3] || ' ' || pp[4], ['%d %b %Y %H:%M:%S', '%d %b %Y %H:%M'])
            - to_minutes(cast({off} as bigint)), NULL) end as rfc_ts
from (select *, string_split(regexp_replace(regexp_replace(trim(regexp_replace(praw, '{S.WS}+', ' ', 'g')),
                    '(?i)^(\\S*,\\s*|({DAYS})(\\s+|$))', ''), '^(\\S+ \\S+ \\S+ [0-9:]+)([+-][0-9]+)( |$)', '\\1 \\2\\3'), ' ') as pp
      from (select *, coalesce(nullif(published, ''), nullif(updated, '')) as praw from {src}))"""
    if strict:
        return f"select * exclude (pp, rfc_ts, praw), rfc_ts as published_parsed from ({body})"
    iso = ("case when regexp_matches(praw, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:?[0-9]{2})?$') "
           "then try_strptime(left(praw, 19), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S']) - to_minutes(cast(case when length(praw) > 20 then "
           "(case when substr(praw, 20, 1) = '-' then -1 else 1 end) * (cast(substr(praw, 21, 2) as int) * 60 + cast(right(praw, 2) as int)) "
           "else 0 end as bigint)) end")
    return f"select * exclude (pp, rfc_ts, praw), coalesce(rfc_ts, {iso}) as published_parsed from ({body})"


cte("raw_entries", f"""
select 'https://feeds.example.invalid/' || cast(p.page_id % 5 as varchar) as feed_url,
       case when p.page_id % 5 = 4 then null else 'Feed ' || cast(p.page_id % 5 as varchar) end as feed_title,
       p.page_id % 5 as feed_pos,
       p.page_id as entry_pos,
       case when p.page_id % 7 = 0 then null
            when p.page_id % 13 = 0 then 'guid-' || cast(p.page_id - 1 as varchar)
            else 'guid-' || cast(p.page_id as varchar) end as id,
       cast(null as varchar) as guid,
       case when p.page_id % 11 = 0 then '' else p.url end as link,
       case when p.page_id % 17 = 0 then null when p.page_id % 37 = 0 then rpad(regexp_extract(p.html, '<title>([^<]*)</title>', 1), 513, 'x')
            else regexp_extract(p.html, '<title>([^<]*)</title>', 1) end as title,
       case when p.page_id % 3 = 0 then null else p.html end as content_value,
       case when p.page_id % 19 = 0 then null else p.html end as summary,
       case when p.page_id % 23 = 0 then null
            when p.page_id % 29 = 0 then 'not a date'
            when p.page_id % 31 = 0 then strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
            else {RFC} || case when p.page_id % 2 = 0 then ' GMT' else ' +0200' end end as published,
       {RFC} || ' GMT' as updated
from pages p join events e on e.event_id = p.page_id""")

cte("entries_parsed", published_sql("raw_entries", strict=False))
cte("entries_parsed_strict", published_sql("raw_entries", strict=True))

cte("entries_clean0", f"""
select feed_url, feed_pos, entry_pos, coalesce(feed_title, feed_url) as source,
       coalesce(nullif(id, ''), nullif(guid, ''), nullif(link, '')) as guid, link,
       coalesce(title, 'Untitled') as title,
       {S.strip_html("case when content_value is not null then content_value else coalesce(summary, '') end")} as clean,
       published_parsed
from entries_parsed""")

cte("entries_norm", f"""
select feed_url, feed_pos, entry_pos, source, guid, link, title,
       coalesce(nullif(clean, ''), 'No content') as content_clean,
       {S.make_preview("clean")} as content_preview,
       coalesce(published_parsed, {INGEST_TS}) as published_at,
       published_parsed is not null as published_ok,
       case when guid is null then 'no_guid' when link is null or link = '' then 'no_link'
            when length(source) > 255 then 'source_too_long' when length(guid) > 1024 then 'rss_guid_too_long'
            when length(title) > 512 then 'title_too_long' when length(link) > 1024 then 'url_too_long' end as reject_reason
from entries_clean0""")

cte("entries_valid", "select * exclude (reject_reason) from entries_norm where reject_reason is null")

cte("entries_dedup", """
select * exclude (rn) from (
  select *, row_number() over (partition by link order by feed_pos desc, entry_pos desc) as rn
  from (select * exclude (rn) from (
          select *, row_number() over (partition by guid order by feed_pos desc, entry_pos desc) as rn
          from entries_valid) where rn = 1)) where rn = 1""")

# entries applied one after the other: by guid, else by link; first guid, last link and content
def cte_fold(name: str, entries: str, stored: str) -> None:
    """``name``: one row per touched article and conflicting entry. ``entries`` has the valid entries,
    ``stored`` (id, rss_guid, url); i is an entry's place in feed order."""
    cte(f"{name}_in", f"select row_number() over (order by feed_pos, entry_pos) as i, * from {entries}")
    cte(f"{name}_run", f"""
select 0::bigint as i, (select coalesce(list({{'k': id::bigint, 'g': rss_guid, 'u': url, 'p': null::bigint, 'f': null::bigint, 'd': null::bigint}}), [])
                from {stored}) as st, []::bigint[] as bad
union all
select i, case when a is not null and b is not null and a.k <> b.k then st
               when a is null and b is null then list_append(st, {{'k': -i, 'g': guid, 'u': link, 'p': i, 'f': i, 'd': case when published_ok then i end}})
               else list_transform(st, lambda x: case when x.k = coalesce(a.k, b.k) then {{'k': x.k, 'g': x.g, 'u': link, 'p': i, 'f': coalesce(x.f, i),
                                                        'd': case when published_ok then i else x.d end}} else x end) end,
       case when a is not null and b is not null and a.k <> b.k then list_append(bad, i) else bad end
from (select n.i, n.guid, n.link, n.published_ok, r.st, r.bad, list_filter(r.st, lambda x: x.g = n.guid)[1] as a,
             list_filter(r.st, lambda x: x.u = n.link)[1] as b from {name}_run r join {name}_in n on n.i = r.i + 1)""")
    cte(f"{name}_end", f"select st, bad from {name}_run order by i desc limit 1")
    cte(name, f"""
select e.* replace (x.g as guid, coalesce(d.published_at, e.published_at) as published_at, d.i is not null as published_ok),
       f.feed_pos as ins_feed, f.entry_pos as ins_entry, case when x.k >= 0 then x.k end as art,
       case when x.k < 0 then null when e.guid = x.g then 'guid' else 'url' end as match_by, false as conflict
from (select unnest(st) as x from {name}_end) join {name}_in e on e.i = x.p join {name}_in f on f.i = x.f left join {name}_in d on d.i = x.d
union all
select e.*, feed_pos, entry_pos, null, null, true from {name}_in e where list_contains((select bad from {name}_end), i)""")


cte("no_articles", "select 0::bigint as id, ''::varchar as rss_guid, ''::varchar as url where false")
cte_fold("entries_ordered", "entries_valid", "no_articles")

# entries that share keys in chains and across feeds: see fixtures.chained_entries
cte("chained_raw", """
select * from raw_entries
union all
select 'https://feeds.example.invalid/' || cast(feed as varchar), 'Feed ' || cast(feed as varchar), feed, entry_pos + 1000000 * k,
       case k when 2 then 'guid-' || cast(entry_pos as varchar) when 5 then 'late-' || cast(entry_pos as varchar) else 'alt-' || cast(entry_pos as varchar) end,
       guid, case when k in (2, 4, 5) then link || '#moved' else link end, title || ' (' || cast(k as varchar) || ')',
       content_value, summary, case when k = 2 then null else published end, case when k = 2 then null else updated end
from raw_entries, (select unnest([1, 2, 3, 4, 5]) as k, unnest([5, 5, 6, 6, 6]) as feed)
where entry_pos % 10 = 3 and link <> '' and (k <= 3 or (k = 4) = (entry_pos % 20 = 3))""")
cte("chained_parsed", published_sql("chained_raw", strict=False))
derived("chained_clean0", "entries_clean0", {"entries_parsed": "chained_parsed"})
derived("chained_norm", "entries_norm", {"entries_clean0": "chained_clean0"})
derived("chained_valid", "entries_valid", {"entries_norm": "chained_norm"})

cte("articles", f"""
select d.doc_id as id, d.source as source, 'guid-' || cast(d.doc_id as varchar) as rss_guid,
       left(d.text, 60) as title, 'https://example.invalid/' || cast(d.doc_id as varchar) as url,
       d.text as content, {S.make_preview("d.text")} as content_preview,
       e.ts as published_at, v.embedding as embedding,
       {INGEST_TS} as created_at, {INGEST_TS} as updated_at
from documents d cross join (select count(*) as n from embeddings) nv join events e on e.event_id = d.doc_id
     join embeddings v on v.vec_id = d.doc_id % nv.n""")

cte("comments", f"""
select conv_id * 100 + turn as id, conv_id as article_id,
       case when role = 'system' then null else role end as author_name, text as body,
       {INGEST_TS} as created_at
from conversations""")

cte("comment_requests", """
select conv_id * 100 + turn as request_id, conv_id * 13 + turn as article_id,
       case when role = 'system' then '' when role = 'user' then null else role || '-' || cast(conv_id as varchar) end as author_name,
       case when turn % 5 = 4 and conv_id % 2 = 0 then '   ' when turn % 5 = 4 then chr(10) || chr(9) || chr(160) || ' '
            when conv_id % 3 = 1 then chr(9) || chr(160) || text || chr(13) || chr(10) else ' ' || text || ' ' end as body
from conversations""")

cte("request_log", """
select event_id, ts,
       case when event_type in ('view', 'click') then 'read' when event_type = 'purchase' then 'comment'
            when event_type = 'signup' then 'reindex' else 'ingest' end as operation,
       value * 10 as latency_ms, case when event_type = 'error' then 1 else 0 end as is_error
from events""")

cte("training_pairs", """
select 'conv' || cast(q.conv_id % 3 as varchar) as dataset, q.conv_id * 1000 + q.turn as pair_id,
       case when q.conv_id % 3 = 2 then [q.text, a.text, b.text] else [q.text, a.text] end as texts
from conversations q cross join (select count(*) as n from benchmark) nb
     join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
     left join benchmark b on b.item_id = q.conv_id % nb.n
where q.role = 'user' and a.role = 'assistant'""")
