"""The checks in SQL, for a comparison with another engine on the same tables."""

from __future__ import annotations

# The frames of ``fixtures.py`` and the operators' results on them, as named queries.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "cust": ((), """
        select lower(replace(r_name, ' ', '-')) as registry,
               lower(c_mktsegment) || '/' || c_name as pkg_name, c_custkey, c_mktsegment
        from customer join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey"""),
    "ord": (("cust",), """
        select registry, pkg_name, sha256('rev-' || cast(o_orderkey as varchar)) as top_hash,
               cast(cast(epoch(o_orderdate) as bigint) as varchar) as timestamp,
               o_orderpriority as message, '{"status":"' || o_orderstatus || '"}' as user_meta,
               c_mktsegment, o_orderkey, o_orderdate,
               row_number() over (partition by c_custkey
                                  order by o_orderdate desc, o_orderkey desc) as newest,
               row_number() over (partition by c_custkey
                                  order by o_orderdate, o_orderkey) as oldest
        from orders join cust on o_custkey = c_custkey"""),
    "pk": (("ord",), """
        select registry, pkg_name, top_hash, timestamp, message, user_meta from ord
        union all
        select registry, pkg_name, top_hash, 'latest', message, user_meta
        from ord where newest = 1"""),
    "ob": (("ord",), """
        select registry, top_hash,
               'line/' || cast(l_linenumber as varchar) || '/part-' || cast(l_partkey as varchar)
                   as logical_key,
               's3://' || registry || '/parts/' || cast(l_partkey as varchar)
                   || '?versionId=' || cast(l_suppkey as varchar) as physical_key,
               case l_returnflag when 'A' then 'SHA256' when 'N' then 'sha2-256-chunked'
                    else 'MD5' end as hash_type,
               sha256(cast(l_partkey as varchar)) as hash_value,
               cast(l_quantity as bigint) * 1024 as size,
               case when l_linestatus = 'O' then '{"flag":"' || l_returnflag || '"}' end as meta
        from lineitem join ord on l_orderkey = o_orderkey"""),
    "revisions": (("pk",), """
        select registry, pkg_name, top_hash,
               make_timestamp(cast(timestamp as bigint) * 1000000) as timestamp,
               message, user_meta as metadata
        from pk where timestamp <> 'latest'"""),
    "tags": (("pk",), """
        select registry, pkg_name, timestamp as tag_name, top_hash
        from pk where timestamp = 'latest'"""),
    "entries": (("ob",), """
        select registry, top_hash, logical_key, physical_key,
               (case hash_type when 'SHA256' then '1220' when 'sha2-256-chunked' then 'b150'
                     else '0000' end) || hash_value as multihash,
               size, meta as metadata
        from ob"""),
    "loaded_revisions": (("ord",), """
        select registry, pkg_name, top_hash, o_orderdate as timestamp, 'imported' as message,
               user_meta as metadata
        from ord where o_orderdate < timestamp '1998-01-01'"""),
    "loaded_entries": (("entries", "ord"), """
        select e.registry, e.top_hash, e.logical_key,
               replace(e.physical_key, '/parts/', '/archive/') as physical_key,
               e.multihash, e.size, e.metadata
        from entries e join ord o on e.top_hash = o.top_hash
        where o.o_orderdate < timestamp '1998-01-01'"""),
    "loaded_tags": (("ord",), """
        select registry, pkg_name, 'latest' as tag_name, top_hash from ord
        where (newest = 1 and c_mktsegment in ('MACHINERY', 'FURNITURE'))
        union all
        select registry, pkg_name, 'latest' as tag_name, top_hash from ord
        where oldest = 1 and c_mktsegment not in ('MACHINERY', 'BUILDING')"""),
    "two_tags": (("tags", "ord"), """
        select registry, pkg_name, tag_name, top_hash from tags
        union all
        select registry, pkg_name, 'latest', top_hash from ord
        where oldest = 1 and c_mktsegment = 'AUTOMOBILE'"""),
    "new_revisions": (("revisions", "loaded_revisions"), """
        select distinct s.* from revisions s left join loaded_revisions t
          on s.pkg_name = t.pkg_name and s.top_hash = t.top_hash and s.registry = t.registry
        where t.pkg_name is null"""),
    "new_entries": (("entries", "loaded_entries"), """
        select distinct s.* from entries s left join loaded_entries t
          on s.logical_key is not distinct from t.logical_key
          and s.metadata is not distinct from t.metadata
          and s.top_hash is not distinct from t.top_hash and s.registry = t.registry
        where t.registry is null"""),
    "new_entries_strict": (("entries", "loaded_entries"), """
        select distinct s.* from entries s left join loaded_entries t
          on s.logical_key = t.logical_key and s.metadata = t.metadata
          and s.top_hash = t.top_hash and s.registry = t.registry
        where t.logical_key is null"""),
    "new_tags_strict": (("tags", "loaded_tags"), """
        select distinct s.* from tags s left join loaded_tags t
          on s.pkg_name = t.pkg_name and s.tag_name = t.tag_name and s.registry = t.registry
        where t.top_hash is null or s.top_hash <> t.top_hash"""),
    "chosen_tags": (("two_tags", "revisions"), """
        select registry, pkg_name, tag_name, top_hash from (
          select s.*, row_number() over (
                   partition by s.registry, s.pkg_name, s.tag_name
                   order by r.timestamp desc nulls last, s.top_hash desc) as place
          from two_tags s left join revisions r
            on s.registry = r.registry and s.pkg_name = r.pkg_name and s.top_hash = r.top_hash)
        where place = 1"""),
    "all_revisions": (("new_revisions", "loaded_revisions"), """
        select * from loaded_revisions union all select * from new_revisions"""),
    "all_entries": (("new_entries", "loaded_entries"), """
        select * from loaded_entries union all select * from new_entries"""),
    "names": ((), """
        select lower(replace(c_name, '#', '-')) || '_packages-view' as name from customer
        union all
        select lower(replace(c_name, '#', '-')) || '_objects-view' from customer
        where c_acctbal >= 0
        union all
        select lower(replace(c_name, '#', '-')) || '_other-view' from customer
        where c_mktsegment = 'FURNITURE'
        union all
        select lower(replace(c_name, '#', '-')) || '-table' from customer
        where c_mktsegment = 'BUILDING'
        union all
        select '' from customer where c_mktsegment = 'MACHINERY'"""),
    "views": (("names",), """
        select name,
               regexp_matches(name, '_(packages|objects)-view$') as matched,
               regexp_extract(name, '^(.*?)(_packages-view|_objects-view)$', 1) as registry
        from names where name like '%-view'"""),
    "qualified": (("names",), """
        select name from names
        union all
        select '"Catalog"."db-1"."' || name || '"' from names"""),
    "ev": (("cust",), """
        select cast(event_id as varchar) as id,
               case when event_type in ('click', 'error') then 'package-revision'
                    when event_type = 'purchase' then 'package-tag'
                    when event_type = 'view' then 'package-entry'
                    else 'package-deleted' end as detail_type,
               case when event_type = 'error' then 'org.example.other'
                    else 'org.example.packages' end as source,
               strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as time, date_trunc('second', ts) as sent,
               case when value < 10 then 'created' when value < 40 then 'updated'
                    else 'deleted' end as type,
               case when c_mktsegment = 'HOUSEHOLD' then null
                    when registry = 'asia' then 'former-asia' else registry end as bucket,
               pkg_name as handle, sha256(props) as top_hash
        from events join cust on user_id = c_custkey"""),
    "matching": (("ev",), """
        select * from ev
        where source = 'org.example.packages'
          and detail_type in ('package-revision', 'package-tag', 'package-entry')
          and type in ('created', 'updated')"""),
    "log": ((), """
        select ts as timestamp,
               case event_type when 'error' then 'ERROR Athena query failed '
                    when 'click' then 'WARN slow listing of bucket '
                    when 'purchase' then 'SUCCESS merged ' when 'signup' then '✅ table ready '
                    else 'scan of bucket done ' end || props as message
        from events"""),
    "log_window": (("log",), """
        select * from log where timestamp >= timestamp '2024-01-31' - interval 7 day"""),
    "broken": (("pk",), """
        select registry, pkg_name, top_hash,
               case when message = '5-LOW' then null
                    when message = '2-HIGH' then 'v' || timestamp else timestamp end as timestamp,
               message, user_meta
        from pk"""),
}


def _with(select: str, *parts: str) -> str:
    """The select behind the named queries it needs, each after those it needs itself."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        add(part)
    ctes = ",\n".join(f"{name} as ({PARTS[name][1]})" for name in ordered)
    return f"with {ctes}\n{select}"


def _all(part: str) -> str:
    return _with(f"select * from {part}", part)


# The three tables side by side in one frame, as ``queries.state`` lays them out.
def _state(revisions: str, tags: str, entries: str) -> str:
    return f"""
        select 'package_revision' as table_name, registry, pkg_name, top_hash,
               timestamp::varchar as timestamp, message,
               metadata, null::varchar as tag_name, null::varchar as logical_key,
               null::varchar as physical_key, null::varchar as multihash, null::varchar as size
        from ({revisions})
        union all
        select 'package_tag', registry, pkg_name, top_hash, null, null, null, tag_name, null, null,
               null, null
        from ({tags})
        union all
        select 'package_entry', registry, null, top_hash, null, null, metadata, null, logical_key,
               physical_key, multihash, size::varchar
        from ({entries})"""


_ONE = "middle-east"
_LISTING = """
    select e.size, e.logical_key, e.physical_key, e.registry, e.multihash
    from entries e join tags t on e.top_hash = t.top_hash and e.registry = t.registry
    where t.tag_name = 'latest'"""
_ONE_PACKAGE = """
    and t.registry = (select registry from cust where c_custkey = 1)
    and t.pkg_name = (select pkg_name from cust where c_custkey = 1)"""
_SEVERITY = """
    case when message like '%ERROR%' or message like '%❌%' then 'error'
         when message like '%WARN%' or message like '%⚠️%' then 'warn'
         when message like '%✅%' or message like '%SUCCESS%' then 'success'
         else 'plain' end"""
_MERGED_STATE = _state(
    "select * from all_revisions", "select * from tags", "select * from all_entries"
)
#: What events that are not too old name; "asia" is never among it.
_NAMED = """select bucket from matching
            where bucket is not null and sent >= timestamp '2024-01-14'"""
_MERGED = ("all_revisions", "tags", "all_entries")


def oracle_sql() -> dict[str, str]:
    return {
        # sources
        "select_registries": _with("select distinct registry from views where matched", "views"),
        "select_registry_target": _with(
            "select distinct registry from views where matched and registry = 'customer-000000007'",
            "views",
        ),
        "skipped_views": _with(
            "select name from views where not (matched and registry = 'customer-000000007')",
            "views",
        ),
        "pair_views": _with(
            """select registry,
                      max(case when name like '%packages-view' then name end) as packages_view,
                      max(case when name like '%objects-view' then name end) as objects_view
               from views where matched group by registry""",
            "views",
        ),
        "registry_from_name": _with(
            r"""select name,
                       coalesce(nullif(regexp_extract(split_part(replace(name, '"', ''),
                         'Catalog.db-1.', -1), '^(.+?)_packages-view$', 1), ''), 'unknown')
                         as from_packages,
                       coalesce(nullif(regexp_extract(split_part(replace(name, '"', ''),
                         'Catalog.db-1.', -1), '^(.+?)_objects-view$', 1), ''), 'unknown')
                         as from_objects
                from qualified""",
            "qualified",
        ),
        "strip_view_suffix": _with(
            "select name, regexp_replace(name, '_(objects|packages)-view$', '') as stripped "
            "from names",
            "names",
        ),
        "scan_packages": _with(
            "select pkg_name, top_hash, timestamp, message, user_meta from pk", "pk"
        ),
        "scan_objects": _with(
            "select top_hash, logical_key, physical_key, size, meta, hash_type, hash_value from ob",
            "ob",
        ),
        "union_registries": _all("pk"),
        # projections
        "project_revisions": _all("revisions"),
        "project_tags": _all("tags"),
        "project_entries": _all("entries"),
        "epoch_to_timestamp": _with(
            "select top_hash, cast(timestamp as bigint) as seconds, "
            "make_timestamp(cast(timestamp as bigint) * 1000000) as created "
            "from pk where timestamp <> 'latest'",
            "pk",
        ),
        "filter_revisions": _with("select * from pk where timestamp <> 'latest'", "pk"),
        "filter_tags": _with("select * from pk where timestamp = 'latest'", "pk"),
        "multihash": _with(
            "select hash_type, hash_value, (case hash_type when 'SHA256' then '1220' "
            "when 'sha2-256-chunked' then 'b150' else '0000' end) || hash_value as multihash "
            "from ob",
            "ob",
        ),
        "quarantine_timestamps": _with(
            "select registry, count(*) filter (timestamp is null) as null_timestamps, "
            "count(*) filter (timestamp is not null) as non_numeric_timestamps "
            "from broken where timestamp is null or (timestamp <> 'latest' "
            "and try_cast(timestamp as bigint) is null) group by registry",
            "broken",
        ),
        "quarantine_revisions": _with(
            "select registry, pkg_name, top_hash, "
            "make_timestamp(try_cast(timestamp as bigint) * 1000000) as timestamp, message, "
            "user_meta as metadata from broken "
            "where timestamp <> 'latest' and try_cast(timestamp as bigint) is not null",
            "broken",
        ),
        "distinct_rows": _with(
            "select distinct * from (select * from entries union all select * from entries)",
            "entries",
        ),
        # merges
        "merge_revisions": _all("new_revisions"),
        "merge_entries": _all("new_entries"),
        "merge_entries_strict": _all("new_entries_strict"),
        "merge_tags_strict": _all("new_tags_strict"),
        "choose_tags": _all("chosen_tags"),
        "changed_tags": _with(
            """select c.* from chosen_tags c left join (
                 select registry, pkg_name, tag_name, count(*) as n, max(top_hash) as held
                 from loaded_tags group by all) t
               on c.registry = t.registry and c.pkg_name = t.pkg_name and c.tag_name = t.tag_name
               where t.n is null or t.n > 1 or c.top_hash <> t.held""",
            "chosen_tags",
            "loaded_tags",
        ),
        "upsert_tags": _with(
            """select * from chosen_tags
               union all
               select t.* from loaded_tags t anti join chosen_tags c
                 on t.registry = c.registry and t.pkg_name = c.pkg_name
                 and t.tag_name = c.tag_name""",
            "chosen_tags",
            "loaded_tags",
        ),
        "tag_listing": _with(_LISTING, "entries", "tags"),
        "tag_listing_package": _with(_LISTING + _ONE_PACKAGE, "entries", "tags", "cust"),
        "tag_lookup": _with(_LISTING + _ONE_PACKAGE, "entries", "tags", "cust"),
        "tag_lookup_resolved": _with(_LISTING + _ONE_PACKAGE, "entries", "tags", "cust"),
        "compact_entries": _all("entries"),
        # tables
        "create_partitioned": _with("select distinct * from revisions", "revisions"),
        "create_empty": _all("tags"),
        "append_rows": _with(
            "select * from loaded_entries union all select * from new_entries",
            "loaded_entries",
            "new_entries",
        ),
        "partition_layout": _with(
            """select 'package_revision' as table_name, registry, count(*) as n_rows
               from revisions group by registry
               union all
               select 'package_tag', registry, count(*) from tags group by registry
               union all
               select 'package_entry', registry, count(*) from entries group by registry""",
            "revisions",
            "tags",
            "entries",
        ),
        "count_probe": _with(
            """select 'package_revision' as table_name, count(*) as n_rows from revisions
               union all select 'package_tag', count(*) from tags
               union all select 'package_entry', count(*) from entries""",
            "revisions",
            "tags",
            "entries",
        ),
        "missing_tables": _with(
            """select 'package_revision' as table_name, true as present, count(*) as n_rows
               from revisions
               union all select 'package_tag', false, 0::bigint
               union all select 'package_entry', true, count(*) from entries""",
            "revisions",
            "entries",
        ),
        # whole runs
        "consolidate_all": _with(_MERGED_STATE, *_MERGED),
        "consolidate_one": _with(
            _state(
                f"""select * from loaded_revisions
                    union all select * from new_revisions where registry = '{_ONE}'""",
                f"""select * from loaded_tags where registry <> '{_ONE}'
                    union all select * from tags where registry = '{_ONE}'""",
                f"""select * from loaded_entries
                    union all select * from new_entries where registry = '{_ONE}'""",
            ),
            "loaded_revisions",
            "new_revisions",
            "loaded_tags",
            "tags",
            "loaded_entries",
            "new_entries",
        ),
        "consolidate_isolated": _with(_MERGED_STATE, *_MERGED),
        "consolidate_shuffled": _with(_MERGED_STATE, *_MERGED),
        "consolidate_discovered": _with(_MERGED_STATE, *_MERGED),
        "consolidate_after_failure": _with(_MERGED_STATE, *_MERGED),
        "consolidate_after_failure_partitioned": _with(_MERGED_STATE, *_MERGED),
        "consolidate_bad_registry": _with(
            f"""select table_name, registry, count(*) as n_rows,
                       case when registry = '{_ONE}' and table_name <> 'package_entry'
                            then 'failed' else 'ok' end as status
                from (
                  select 'package_revision' as table_name, registry from loaded_revisions
                  union all
                  select 'package_revision', registry from new_revisions where registry <> '{_ONE}'
                  union all
                  select 'package_tag', registry from loaded_tags where registry = '{_ONE}'
                  union all select 'package_tag', registry from tags where registry <> '{_ONE}'
                  union all select 'package_entry', registry from loaded_entries
                  union all select 'package_entry', registry from new_entries)
                group by table_name, registry""",
            "loaded_revisions",
            "new_revisions",
            "loaded_tags",
            "tags",
            "loaded_entries",
            "new_entries",
        ),
        "consolidate_strict": _with(
            _state(
                "select * from loaded_revisions union all select * from new_revisions",
                """select * from loaded_tags union all select * from new_tags_strict
                   union all
                   select s.* from tags s where exists (
                     select 1 from (select * from loaded_tags
                                    union all select * from new_tags_strict) t
                     where t.registry = s.registry and t.pkg_name = s.pkg_name
                       and t.tag_name = s.tag_name and t.top_hash <> s.top_hash)""",
                """select * from loaded_entries union all select * from new_entries_strict
                   union all
                   select distinct * from entries
                   where registry is null or top_hash is null or logical_key is null
                      or metadata is null""",
            ),
            "loaded_revisions",
            "new_revisions",
            "loaded_tags",
            "new_tags_strict",
            "tags",
            "loaded_entries",
            "new_entries_strict",
            "entries",
        ),
        "consolidate_rerun": _with(
            """select 'package_revision' as table_name, count(*) as first_run, 0::bigint as second_run
               from new_revisions
               union all
               select 'package_tag', count(*), 0::bigint
               from tags s anti join (
                 select registry, pkg_name, max(top_hash) as top_hash from loaded_tags
                 group by all having count(*) = 1) t
               on s.registry = t.registry and s.pkg_name = t.pkg_name and s.top_hash = t.top_hash
               union all
               select 'package_entry', count(*), 0::bigint from new_entries""",
            "new_revisions",
            "tags",
            "loaded_tags",
            "new_entries",
        ),
        "run_summary": _with(
            """select registries as num_tables, ok as successful_tables,
                      0::bigint as failed_tables, 1::bigint as skipped_tables, ok as total_queries
               from (select count(distinct registry) as registries,
                            3 * count(distinct registry) - 1 as ok from pk)""",
            "pk",
        ),
        # events
        "event_filter": _with(
            "select id, detail_type, time, type, bucket, handle, top_hash from matching",
            "matching",
        ),
        "event_registries": _with(
            """select distinct c.registry from cust c
               where exists (select 1 from matching where bucket is null)
                  or c.registry in (select bucket from matching where bucket is not null)""",
            "cust",
            "matching",
        ),
        "event_registries_named": _with(
            "select distinct bucket as registry from matching "
            "where bucket in (select registry from cust)",
            "matching",
            "cust",
        ),
        "dead_letter_split": _with(
            """select id, time,
                      case when sent < timestamp '2024-01-14' then 'dead_letter'
                           else 'deliver' end as route,
                      case when sent < timestamp '2024-01-14' then 'expired' end as reason
               from matching""",
            "matching",
        ),
        "dead_letters_retained": _with(
            "select id, time from matching where sent >= timestamp '2024-01-15' - interval 14 day",
            "matching",
        ),
        "stream_retries": _with(
            f"""select id, time, bucket, case when sent < timestamp '2024-01-14' then 'expired'
                                             else 'retries exhausted' end as reason
                from matching
                where sent < timestamp '2024-01-14' or bucket is null or bucket = '{_ONE}'""",
            "matching",
        ),
        "stream_merge": _with(_MERGED_STATE, *_MERGED),
        "stream_merge_named": _with(
            _state(
                f"""select * from loaded_revisions
                    union all select * from new_revisions where registry in ({_NAMED})""",
                f"""select * from loaded_tags where registry not in ({_NAMED})
                    union all select * from tags where registry in ({_NAMED})""",
                f"""select * from loaded_entries
                    union all select * from new_entries where registry in ({_NAMED})""",
            ),
            "loaded_revisions",
            "new_revisions",
            "loaded_tags",
            "tags",
            "loaded_entries",
            "new_entries",
            "matching",
        ),
        "stream_dead_letters": _with(
            "select id, time, bucket, 'expired' as reason from matching "
            "where sent < timestamp '2024-01-14'",
            "matching",
        ),
        "stream_redelivered": _with(
            """select distinct c.registry, 1::bigint as refreshed from cust c
               where exists (select 1 from matching
                             where bucket is null and sent >= timestamp '2024-01-14')
                  or c.registry in (select bucket from matching
                                    where bucket is not null and sent >= timestamp '2024-01-14')""",
            "cust",
            "matching",
        ),
        "stream_retries_later": _with(
            f"""select registry, case when registry = '{_ONE}' then 3 else 1 end::bigint as attempts,
                       0::bigint as letters, count(*) as n_revisions
                from (select registry from loaded_revisions
                      union all select registry from new_revisions)
                group by registry""",
            "loaded_revisions",
            "new_revisions",
        ),
        "event_put_form": _with(_MERGED_STATE, *_MERGED),
        # log triage
        "log_recent": _all("log_window"),
        "log_severity": _with(f"select timestamp, message, {_SEVERITY} as severity from log", "log"),
        "log_pattern": _with("select * from log_window where message like '%bucket%'", "log_window"),
        "log_error_count": _with(
            "select count(*) as error_count from log_window where message like '%ERROR%'",
            "log_window",
        ),
    }
