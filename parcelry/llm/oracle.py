"""The queries that SQL can express, for DuckDB, over the same tables."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_URLS = f"""
with split as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3)
                       else '' end as rest
  from pages),
parts as (
  select page_id, row_number() over () as place,
         translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from split),
rules(rule_host, rule_path, verdict) as (values
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
blocked(rule_host) as (values
  ('ads-track.example.com'), ('casino-win.example.com'), ('cheap-pills.example.com'),
  ('free-bets.example.com')),
best as (
  select place, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
         arg_max(verdict, length(rule_host || rule_path)) as verdict
  from parts join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by place),
listed as (
  select distinct place from parts join blocked
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, '/'))
select page_id, host, path, rule,
       coalesce(verdict, case when listed.place is null then 'allow' else 'block' end) as verdict
from parts left join best using (place) left join listed using (place)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31), 1)"
_WARC = f"""
with records as (
  select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h,
         row_number() over (partition by coalesce(html, '') order by page_id nulls last) as n,
         first_value(page_id) over (partition by coalesce(html, '') order by page_id nulls last)
           as response
  from pages)
select page_id, strlen(html) as payload_bytes,
       array_to_string(list_transform(
         list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i, 5))::int),
         lambda v: {' || '.join(_DIGIT.format(shift) for shift in (15, 10, 5, 0))}), '')
         as payload_digest,
       case when n = 1 then 'response' else 'revisit' end as record_type,
       case when n > 1 then response end as refers_to,
       replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as target_uri
from records
"""

_WORDS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)
_LEAKS = f"""
with docs as (select doc_id, {_WORDS} as words from documents),
items as (select item_id, {_WORDS} as words from benchmark),
windows as (
  select distinct item_id, size, array_to_string(words[i : i + size - 1], ' ') as phrase
  from (select item_id, words, size, unnest(range(1, len(words) - size + 2)) as i
        from (select *, least(10, len(words)) as size from items where len(words) > 0))),
places as (
  select doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') as phrase
  from (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as i
        from docs, (select distinct size from windows) where len(words) >= size)),
found as (select doc_id, i, places.size, item_id from places join windows using (phrase)),
hit as (
  select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(i, i + size)) as word from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, item_id::varchar as item from found where item_id is not null)
  group by doc_id)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit,
       coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)
"""

_SEARCH = f"""
with docs as (
  select place, doc_id, words, len(words) as n
  from (select row_number() over () as place, doc_id, {_WORDS} as words from documents)
  where len(words) > 0),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from docs),
items as (
  select item_id, term, count(*) as times
  from (select item_id, unnest({_WORDS}) as term from benchmark) group by all),
found as (
  select place, doc_id, n, term, count(*) as tf
  from (select place, doc_id, n, unnest(words) as term from docs)
  where term in (select term from items) group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w
  from found, totals group by term, n_docs),
parts as (
  select place, doc_id, term, w * ((1000000000 * tf)
           // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) as part
  from found join weights using (term), totals),
scores as (
  select item_id, doc_id, sum(times * part)::bigint as score
  from parts join items using (term) group by item_id, place, doc_id having sum(times * part) > 0)
select item_id, row_number() over best :: int as rank, doc_id, score from scores
window best as (partition by item_id order by score desc, doc_id nulls last)
qualify row_number() over best <= 10
"""


def _clusters(size: int = 64, clusters: int = 16, rounds: int = 3) -> str:
    steps = [
        f"""kept as materialized (
  select row_number() over () as place, vec_id,
         list_transform(embedding, lambda x: floor({size} * x::double)::bigint) as v
  from embeddings
  where len(embedding) = {size}
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"""centroids0 as materialized (
  select row_number() over first - 1 as cluster, v from kept
  window first as (order by sha256('1:' || vec_id) nulls last, v)
  qualify row_number() over first <= {clusters})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""assigned{i} as materialized (
  select place, vec_id, kept.v, cluster,
         list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
           ::bigint as distance
  from kept, centroids{i} c
  qualify row_number() over (partition by place order by distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""centroids{i + 1} as materialized (
  select cluster, coalesce(means.v, old.v) as v
  from centroids{i} old left join (
    select cluster, list(((s - (s % n + n) % n) // n)::bigint order by j) as v
    from (select cluster, j, sum(v[j]) as s, count(*) as n
          from assigned{i}, (select unnest(range(1, {size + 1})) as j) group by cluster, j)
    group by cluster) means using (cluster))""")
    return f"""
with {", ".join(steps)}
select vec_id, cluster::int as cluster, distance,
       (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
       (sum(distance) over ())::bigint as inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::varchar), ',')) as centroid_sha256
from assigned{rounds} join centroids{rounds} c using (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_urls": _URLS,
        "op7_warc": _WARC,
        "op8_decontaminate": _LEAKS,
        "op12_search": _SEARCH,
        "op13_clusters": _clusters(),
    }
