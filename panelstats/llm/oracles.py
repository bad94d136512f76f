"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op4_url_filter"] = r"""
with parts as (
  select page_id, case when url is null or position('://' in url) = 0 then ''
                       else regexp_extract(url, '^(?s:.*?)://(?s:([^/?#]*))', 1) end as raw_host,
         case when url is null or position('://' in url) = 0 then ''
              else regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) end as path
  from pages),
p as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path
      from parts),
j as (select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/' end as rule from p)
select page_id, host, path, rule,
       case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict
from j
"""

SQL["op3_decontaminate"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n,
              list_slice(w, i, i + least(len(w), 10) - 1) as win
       from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
pos as (select doc_id, w, unnest(generate_series(1, len(w))) as i from d where len(w) > 0),
hit as (select p.doc_id, p.i, l.n, bw.item_id from pos p cross join lens l
        join bw on bw.n = l.n and bw.win = list_slice(p.w, p.i, p.i + l.n - 1)
        where p.i + l.n - 1 <= len(p.w)),
cov as (select doc_id, count(distinct j) as n_hit
        from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from (select distinct doc_id, i, n from hit))
        group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit,
       coalesce(its.n_items, 0) as n_items, sha256(coalesce(its.items, '')) as items_sha256,
       coalesce(c.n_hit, 0) > 0 as contaminated
from d left join cov c using (doc_id) left join its using (doc_id)
"""

_ESCAPED = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"
SQL["op7_chat_format"] = rf"""
with c as (select conv_id, turn, role, text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok'
           union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<turn>') + length({_ESCAPED.format('role')}) + length('<text>')
            + length({_ESCAPED.format('text')}) + length('</turn>') + 1) as bigint) as formatted_chars
from t group by conv_id
"""

SQL["op11_warc"] = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
q as (select *, min(page_id) over (partition by payload_digest) as leader from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> leader then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> leader then leader end as refers_to
from q
"""
