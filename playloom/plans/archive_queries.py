"""Queries over the read-model archive and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playloom.operators import dashboard, explorers, filters, habits
from playloom.operators.visible import visible
from playloom.shared import shared_dir
from playloom.sources import sinks
from playloom.sources.archive import ARCHIVE_SQL, Archive


def _on(operator, *args):
    def query(spark, sf_dir):
        rows = operator(Archive(spark, sf_dir), *args)
        dates = [name for name, kind in rows.dtypes if kind == "date"]
        return rows.withColumns({name: rows[name].cast("string") for name in dates})  # as text, which every engine prints alike

    return query


def _joined(operator, *args):
    """The operator with its lists as text."""

    def query(spark, sf_dir):
        rows = operator(Archive(spark, sf_dir), *args)
        return rows.select(*[F.array_join(c, "|").alias(c) if c in ("servers", "worlds") else F.col(c) for c in rows.columns])

    return query


def exported(spark, sf_dir):
    """Visible sessions written as CSV and read again, with instances hidden."""
    folder = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    rows = visible(Archive(spark, sf_dir)).select("session_id", "start_ms", "seconds", "instance_name", "version", "loader")
    sinks.export(rows, folder, "csv", ("instance_name",))
    return spark.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(folder).withColumn("version", F.coalesce("version", F.lit("")))


QUERIES = {
    "visible_count": _on(dashboard.visible_count),
    "dash_totals": _on(dashboard.totals),
    "unique_runtime": _on(dashboard.unique_runtime),
    "day_slices": _on(dashboard.day_slices),
    "active_days": _on(dashboard.active_days),
    "daily_activity": _on(dashboard.daily_activity),
    "monthly_activity": _on(dashboard.monthly_activity),
    "observed_months": _on(dashboard.observed_months),
    "coverage": _on(dashboard.coverage),
    "top_metrics": _on(dashboard.top_metrics),
    "month_average": _on(dashboard.month_average),
    "heatmap_stats": _on(dashboard.heatmap_stats),
    "recent_sessions": _on(dashboard.recent),
    "session_page": _on(dashboard.session_page),
    "session_contexts": _joined(dashboard.session_contexts),
    "session_contexts_after": _joined(dashboard.session_contexts, 40, (900_000_000_000, 7000)),
    "session_page_after": _on(dashboard.session_page, 500, (900_000_000_000, 7000)),
    "instances": _on(explorers.instances),
    "worlds": _on(explorers.worlds),
    "world_page": _on(explorers.world_page),
    "context_shares": _on(dashboard.context_shares),
    "heat_levels": _on(dashboard.heat_levels),
    "month_seam": _on(dashboard.month_seam),
    "exported": exported,
    "staged_sessions": _on(lambda archive: sinks.staged(archive.sessions.select("session_id", "start_ms", "seconds", "loader"), "session_id")),
    "instance_page": _on(explorers.instance_page),
    "server_page": _on(explorers.server_page),
    "version_page": _on(explorers.version_page),
    "filtered_sessions": _on(filters.filtered_sessions, "world", "high"),
    "filter_totals": _on(lambda archive: filters.filter_totals(filters.filtered_sessions(archive, "server", "all", " fabric"))),
    "servers": _on(explorers.servers),
    "versions": _on(explorers.versions),
    "launcher_usage": _on(explorers.launcher_usage),
    "archive_budget": _on(explorers.archive_budget),
    "crash_share": _on(explorers.crash_share),
    "sessions_by_day": _on(explorers.sessions_by_day),
    "archive_state": _on(explorers.archive_state),
    "session_search": _on(filters.session_search, "Brand#1"),
    "session_scope": _on(filters.session_scope, "version", "24w14a"),
    "session_scope_world": _on(filters.session_scope, "world", "Brand#12"),
    "session_kind": _on(filters.session_kind),
    "session_filter_summary": _on(filters.session_filter_summary),
    "library_search": _on(filters.library_search, "2"),
    "instance_search": _on(filters.instance_search, "auto"),
    "mask_servers": _on(filters.mask_servers),
    "breaks": _on(habits.breaks),
    "streaks": _on(habits.streaks),
    "weekdays": _on(habits.weekdays),
    "start_hours": _on(habits.start_hours),
    "medians": _on(habits.medians),
    "crash_frequency": _on(habits.crash_frequency),
}

_LABEL = "case when {0} >= 80 then 'verified' when {0} >= 55 then 'high' when {0} >= 30 then 'partial' else 'unknown' end"
_RANK = "case {0} when 'verified' then 3 when 'high' then 2 when 'partial' then 1 else 0 end"
_OF_RANK = "case {0} when 3 then 'verified' when 2 then 'high' when 1 then 'partial' else 'unknown' end"

_SLICES = f""", spans as (
    select session_id, run_score, start_ms + coalesce(offset_min, 0) * 60000 as a,
           start_ms + greatest(coalesce(run_s, 0), 0) * 1000 + coalesce(offset_min, 0) * 60000 as b from runs),
numbered as (
    select *, unnest(range((a // 86400000)::bigint, ((case when b > a then b - 1 else a end) // 86400000)::bigint + 1)) as n from spans),
slices as (
    select session_id, date '1970-01-01' + n::integer as day, (least(b, (n + 1) * 86400000) - greatest(a, n * 86400000)) // 1000 as day_seconds,
        {_LABEL.format("run_score")} as day_label from numbered),
last_day as (
    select date '1970-01-01' + ((coalesce(run_end, start_ms) + coalesce(offset_min, 0) * 60000) // 86400000)::integer as last_day
    from runs order by coalesce(run_end, start_ms) desc, session_id limit 1),
daily as (
    select day, sum(day_seconds)::bigint // 60 as minutes, count(*) as sessions, min({_RANK.format("day_label")}) as rank from slices group by day),
calendar as (
    select d.day::date as day, minutes, sessions, case when minutes is null then 'missing' else {_OF_RANK.format("rank")} end as day_label
    from (select unnest(generate_series(last_day - 364, last_day, interval 1 day)) as day from last_day) d left join daily on daily.day = d.day::date),
months as (
    select year(day) * 12 + month(day) - 1 as m, sum(day_seconds)::bigint // 60 as minutes, count(distinct session_id) as sessions,
           coalesce(sum(case when day_label <> 'verified' then day_seconds else 0 end) / nullif(sum(day_seconds), 0), 0) as share, min({_RANK.format("day_label")}) as rank
    from slices group by 1),
monthly as (
    select (c.m // 12)::varchar || '-' || lpad((c.m % 12 + 1)::varchar, 2, '0') as month, minutes, sessions, round(share, 6) as estimated_share,
           case when minutes is null then 'missing' else {_OF_RANK.format("rank")} end as month_label
    from (select unnest(range(greatest((select min(m) from months), year(last_day) * 12 + month(last_day) - 12), year(last_day) * 12 + month(last_day))) as m from last_day) c
    left join months on months.m = c.m)"""

_JUDGED = """, judged as (
    select * exclude (wrong), wrong and seconds is not null as wrong, case when wrong and seconds is not null then 0 else coalesce(seconds, 0) end as jrun_s,
           case when wrong and seconds is not null then start_ms else coalesce(end_ms, start_ms) end as seen_ms,
           case when wrong and seconds is not null then least(score, 54) else score end as jscore from visible),
world_rows as (
    select session_id, trim(world) as world, min(segment_score) as segment_score from segments where kind = 'world' and trim(world) <> '' group by 1, 2),
world_sums as (
    select instance_id, world, sum(jrun_s)::bigint // 60 as minutes, count(*) as sessions, max(seen_ms) as last_ms, """ + _LABEL.format("min(least(jscore, segment_score))") + """ as label
    from world_rows join judged using (session_id) group by 1, 2),
server_rows as (
    select session_id, server_id, coalesce(nullif(trim(display_name), ''), address) as name, min(segment_score) as segment_score
    from segments join servers using (server_id) where kind = 'server' group by all),
server_sums as (
    select server_id, name, sum(jrun_s)::bigint // 60 as minutes, count(*) as sessions, max(seen_ms) as last_ms, """ + _LABEL.format("min(least(jscore, segment_score))") + """ as label
    from server_rows join judged using (session_id) group by 1, 2),
favorite as (
    select server_id, version as favorite_version from (
        select server_id, version, row_number() over (partition by server_id order by sum(jrun_s) desc, count(*) desc, version) as r
        from server_rows join judged using (session_id) where version <> '' group by 1, 2) where r = 1),
version_sums as (
    select version, sum(jrun_s)::bigint // 60 as minutes, count(*) as sessions, min(start_ms) as first_ms, max(seen_ms) as last_ms, """ + _LABEL.format("min(jscore)") + """ as label,
           '[' || coalesce(string_agg(distinct '"' || loader || '"', ',' order by '"' || loader || '"'), '') || ']' as loaders,
           case when regexp_matches(version, '^[0-9]+(\\.[0-9]+){1,2}$') then 'release' when regexp_matches(version, '^[0-9]{2}w[0-9]{2}[a-z]+$') then 'snapshot' else
               'other' end as version_class
    from judged where trim(version) <> '' group by version),
instance_sums as (
    select instance_id, instance_name, launcher, sum(coalesce(seconds, 0))::bigint // 60 as minutes, count(*) as sessions, max(coalesce(end_ms, start_ms)) as last_ms,
           count(*) filter (where exit_kind = 'crash') as crashes, """ + _LABEL.format("min(score)") + """ as label,
           first(version order by start_ms desc, session_id) filter (where version <> '') as version, first(loader order by start_ms desc, session_id) filter (where
               loader is not null) as loader
    from visible group by 1, 2, 3),
instance_worlds as (
    select instance_id, count(distinct nullif(trim(world), '')) as worlds from segments join visible using (session_id) where kind = 'world' group by 1),
contexts as (
    select distinct session_id, kind, case kind when 'server' then coalesce(nullif(trim(display_name), ''), address) when 'world' then nullif(trim(world), '') end as name
    from segments left join servers using (server_id) where kind in ('server', 'world'))"""


_ACTIVE = ", active as (select day from slices group by day having sum(day_seconds) >= 60)"


def _sql(select: str, *parts: str) -> str:
    return f"with {ARCHIVE_SQL}{''.join(parts)}\n{select}"


_TOP = """select category, name, seconds // 60 as minutes from (
        select category, name, sum(s)::bigint as seconds, row_number() over (partition by category order by sum(s) desc, lower(name), name) as r from (
            select 'launcher' as category, launcher as name, coalesce(run_s, 0) as s from runs union all
            select 'instance', instance_name, coalesce(run_s, 0) from runs union all
            select 'version', coalesce(nullif(trim(version), ''), 'Unknown'), coalesce(run_s, 0) from runs union all
            select kind, name, coalesce(run_s, 0) from contexts join runs using (session_id) where name is not null) group by 1, 2) where r = 1"""
_KIND = """(exists (select 1 from contexts c where c.session_id = v.session_id and c.kind = '{0}' and c.name is not null)
        or session_id in (select session_id from segments group by 1 having count(distinct kind) = 1 and min(kind) = '{0}'))"""
_CONTEXTS = """select session_id, start_ms, instance_name, version, coalesce(k, 'menu') as kind, coalesce(d, '') as destination, coalesce(ss, '') as servers, coalesce(ws, '') as worlds
        from (select session_id, start_ms, instance_name, version from visible where {where} order by start_ms desc, session_id limit {size}) left join (
            select session_id, case when count(distinct kind) > 1 then 'mixed' else min(kind) end as k,
                   case when count(*) filter (where kind in ('server', 'world')) > 1 then 'Multiple observed destinations' else max(name) filter (where kind in
                       ('server', 'world')) end as d,
                   string_agg(distinct name, '|' order by lower(name), name) filter (where kind = 'server' and trim(name) <> '') as ss,
                   string_agg(distinct name, '|' order by lower(name), name) filter (where kind = 'world' and trim(name) <> '') as ws
            from (select session_id, kind, case kind when 'server' then coalesce(display_name, address) when 'world' then world end as name from segments left join servers using (server_id)) group by 1) using (session_id)"""
ORACLE_SQL = {
    "visible_count": _sql("select count(*) as visible_sessions from visible"),
    "dash_totals": _sql("""select count(*) as sessions, count(run_s) as known_sessions, coalesce(sum(run_s), 0)::bigint as total_seconds, max(run_s) as longest_seconds,
        (sum(run_s)::bigint // nullif(count(run_s), 0)) as average_seconds from runs"""),
    "unique_runtime": _sql("""select (coalesce(sum(greatest(0, e - greatest(s, coalesce(p, s)))), 0)::bigint // 1000) as unique_seconds from (
        select start_ms as s, run_end as e, max(run_end) over (order by start_ms, run_end rows between unbounded preceding and 1 preceding) as p
        from runs where run_s is not null and run_end > start_ms)"""),
    "day_slices": _sql("select session_id, day::varchar as day, day_seconds, day_label from slices", _SLICES),
    "active_days": _sql("select count(*) filter (where s >= 60) as active_days, count(*) as observed_days from (select day, sum(day_seconds) as s from slices group by day)", _SLICES),
    "daily_activity": _sql("select day::varchar as day, minutes, sessions, day_label from calendar", _SLICES),
    "monthly_activity": _sql("select * from monthly", _SLICES),
    "observed_months": _sql("select count(distinct year(day) * 12 + month(day)) as observed_months from slices", _SLICES),
    "coverage": _sql(f"""select first_ms, last_ms, observed_months, greatest(0, year(last_day) * 12 + month(last_day) - year(first_day) * 12 - month(first_day) + 1 - observed_months)::bigint as gap_months,
        round(v, 6) as verified_share, round(b, 6) as bounded_share, least(79, round(62 * v + 38 * b))::integer as coverage_score,
        case when least(79, round(62 * v + 38 * b)) >= 55 then 'partial' when least(79, round(62 * v + 38 * b)) >= 20 then 'limited' else 'unknown' end as quality
        from (select min(start_ms) as first_ms, max(coalesce(run_end, start_ms)) as last_ms, first(local_day order by start_ms, session_id) as first_day,
              avg(({_LABEL.format("run_score")} = 'verified')::integer) as v, avg((run_s is not null and run_end is not null)::integer) as b from runs),
             last_day, (select count(distinct year(day) * 12 + month(day)) as observed_months from slices)""", _SLICES),
    "context_shares": _sql(f"""select category, name, minutes, round(100.0 * minutes / greatest(1, (select coalesce(sum(run_s), 0)::bigint // 60 from runs)), 1)::double as percent from ({_TOP})""", _JUDGED),
    "heat_levels": _sql("select day::varchar as day, day_label, (case when coalesce(minutes, 0) = 0 then 0 when minutes < 45 then 1 when minutes < 100 then 2 when minutes < 180 then 3 else 4 end)::integer as level from calendar", _SLICES),
    "month_seam": _sql("""select month, strftime((month || '-01')::date, '%B %Y') as name, (case when minutes is null then 0 else least(4, greatest(1, ceil(minutes / 3000))) end)::integer as intensity from monthly""", _SLICES),
    "exported": _sql("select session_id, start_ms, seconds, 'hidden-' || left(sha256(instance_name), 8) as instance_name, version, loader from visible"),
    "staged_sessions": _sql("""select session_id as stage_key, '{"start_ms":' || start_ms || ',"seconds":' || coalesce(seconds::varchar, 'null') || ',"loader":' || coalesce('"' || loader || '"', 'null') || '}' as payload_json from sessions"""),
    "top_metrics": _sql(_TOP, _JUDGED),
    "month_average": _sql("select round(avg(minutes), 6) as average_minutes, max(minutes) as largest_minutes, count(*) as months from monthly where month_label <> 'missing'", _SLICES),
    "heatmap_stats": _sql("""select count(*) filter (where coalesce(minutes, 0) > 0) as active, count(*) filter (where minutes is null) as missing, count(*) filter (where minutes = 0) as zero,
        first(day order by coalesce(minutes, -1) desc, day)::varchar as peak_day from calendar""", _SLICES),
    "recent_sessions": _sql(f"select session_id, instance_name, start_ms, run_s, {_LABEL.format('run_score')} as label from runs order by start_ms desc, session_id limit 24"),
    "session_page": _sql("select session_id, start_ms, exit_kind, label, (select count(*) from visible) as total, (select count(*) from visible) > 500 as truncated from visible order by start_ms desc, session_id limit 500"),
    "session_contexts": _sql(_CONTEXTS.format(where="true", size=500)),
    "session_contexts_after": _sql(_CONTEXTS.format(where="start_ms < 900000000000 or (start_ms = 900000000000 and session_id > 7000)", size=40)),
    "session_page_after": _sql("""select session_id, start_ms, exit_kind, label, (select count(*) from visible) as total, (select count(*) from visible) > 500 as truncated from visible
        where start_ms < 900000000000 or (start_ms = 900000000000 and session_id > 7000) order by start_ms desc, session_id limit 500"""),
    "instances": _sql("select i.*, coalesce(worlds, 0) as worlds from instance_sums i left join instance_worlds using (instance_id)", _JUDGED),
    "worlds": _sql("select * from world_sums", _JUDGED),
    "instance_page": _sql("""select i.instance_id, i.instance_name as name, coalesce(l.launcher_name, o.adapter_kind) as launcher, coalesce(minutes, 0) as minutes, coalesce(sessions, 0) as sessions, last_ms,
            coalesce(crashes, 0) as crashes, coalesce(worlds, 0) as worlds, version, loader, coalesce(label, 'unknown') as label, count(*) over () as total
        from instances i join locations o on o.location_id = i.location_id left join launchers l on l.launcher_id = i.launcher_id left join (select * exclude
            (instance_name, launcher) from instance_sums) s using (instance_id) left join instance_worlds using (instance_id)
        where (instance_id in (select instance_id from visible) or instance_id in (select instance_id from sources join scans using (scan_id) where state = 'completed'
            and current_revision is not null))
            and exists (select 1 from scans where state = 'completed')
        order by coalesce(minutes, 0) desc, last_ms desc nulls last, lower(i.instance_name), instance_id limit 500""", _JUDGED),
    "server_page": _sql("""select server_id, name, minutes, sessions, last_ms, label, favorite_version, count(*) over () as total from server_sums left join favorite using (server_id)
        where exists (select 1 from scans where state = 'completed') order by minutes desc, last_ms desc, lower(name), server_id limit 500""", _JUDGED),
    "version_page": _sql("""select version, version_class, minutes, sessions, first_ms, last_ms, label, loaders, count(*) over () as total from version_sums
        where exists (select 1 from scans where state = 'completed') order by last_ms desc, minutes desc, version limit 500""", _JUDGED),
    "filtered_sessions": _sql(f"select session_id, start_ms, seconds, label from visible v where label = 'high' and {_KIND.format('world')}", _JUDGED),
    "filter_totals": _sql(f"""select n as sessions, m as minutes, format('{{:,}}', n) || case when n = 1 then ' session' else ' sessions' end as sessions_text,
            case when m < 60 then m || 'm' else format('{{:,}}', m // 60) || ' h' || case when m % 60 > 0 then ' ' || (m % 60) || ' min' else '' end end as minutes_text
        from (select count(*) as n, coalesce(sum(seconds), 0)::bigint // 60 as m from visible v where {_KIND.format('server')} and (contains(lower(instance_name),
            'fabric') or contains(lower(launcher), 'fabric')
            or contains(lower(version), 'fabric') or coalesce(contains(lower(loader), 'fabric'), false) or exists (select 1 from contexts c where c.session_id = v.session_id and contains(lower(c.name), 'fabric'))))""", _JUDGED),
    "world_page": _sql("select instance_id, world, last_ms, (select count(*) from world_sums) as total from world_sums order by last_ms desc, instance_id, world limit 500", _JUDGED),
    "servers": _sql("select s.*, favorite_version from server_sums s left join favorite using (server_id)", _JUDGED),
    "versions": _sql("select * from version_sums", _JUDGED),
    "launcher_usage": _sql("""select l.launcher_id, l.launcher_name, count(distinct instance_id) as instances, count(*) as sessions,
        coalesce(sum(case when seconds between 0 and 2678400 then seconds end), 0)::bigint as seconds, min(start_ms) as first_ms, max(start_ms) as last_ms
        from launchers l join visible v on v.launcher_id = l.launcher_id group by 1, 2"""),
    "archive_budget": _sql("""select instance_id, count(*) as sessions, sum(coalesce(n, 0))::bigint as contexts
        from sessions left join (select session_id, count(*) as n from segments group by 1) using (session_id) group by 1"""),
    "crash_share": _sql("select instance_id, round(100.0 * crashes / sessions, 1)::double as crash_percent from instance_sums", _JUDGED),
    "sessions_by_day": _sql("select local_day::varchar as local_day, count(*) as sessions, sum(coalesce(seconds, 0))::bigint as seconds from visible group by 1"),
    "archive_state": _sql("select count(*) as visible_sessions, case when count(*) > 0 then 'ready' when (select count(*) from instances) > 0 then 'scannedNoEvidence' else 'unscanned' end as state from visible"),
    "session_search": _sql("""select session_id, instance_name, version from visible v where contains(lower(instance_name), 'brand#1') or contains(lower(launcher), 'brand#1')
        or contains(lower(version), 'brand#1') or coalesce(contains(lower(loader), 'brand#1'), false)
        or exists (select 1 from contexts c where c.session_id = v.session_id and contains(lower(c.name), 'brand#1'))""", _JUDGED),
    "session_scope": _sql("select session_id, start_ms from visible where version = '24w14a'"),
    "session_scope_world": _sql("select session_id, start_ms from visible v where exists (select 1 from contexts c where c.session_id = v.session_id and kind = 'world' and name = 'Brand#12')", _JUDGED),
    "session_kind": _sql("""select session_id, case when n > 1 then 'mixed' when kind in ('server', 'world') then kind else 'menu' end as kind
        from visible left join (select session_id, count(distinct kind) as n, min(kind) as kind from segments group by 1) using (session_id)"""),
    "session_filter_summary": _sql("select label, count(*) as sessions, sum(coalesce(seconds, 0))::bigint // 60 as minutes from visible group by 1"),
    "library_search": _sql("""select * from (select 'world' as kind, world as name, sessions from world_sums union all select 'server', name, sessions from server_sums
        union all select 'version', version, sessions from version_sums) where contains(lower(name), '2')""", _JUDGED),
    "instance_search": _sql("""select instance_id, instance_name, launcher, sessions from instance_sums
        where contains(lower(instance_name), 'auto') or contains(lower(launcher), 'auto') or coalesce(contains(lower(version), 'auto'), false) or coalesce(contains(lower(loader), 'auto'), false)""", _JUDGED),
    "breaks": _sql("select b::varchar as last_day, day::varchar as next_day, (day - b - 1)::integer as days_off from (select day, lag(day) over (order by day) as b from active) where day - b > 1", _SLICES, _ACTIVE),
    "streaks": _sql("select min(day)::varchar as first_day, count(*) as days from (select day, day - row_number() over (order by day)::integer as g from active) group by g", _SLICES, _ACTIVE),
    "weekdays": _sql("select isodow(day)::integer as weekday, sum(day_seconds)::bigint // 60 as minutes from slices group by 1", _SLICES),
    "start_hours": _sql("select ((start_ms + coalesce(offset_min, 0) * 60000) % 86400000) // 3600000 as hour, count(*) as sessions from runs group by 1"),
    "medians": _sql("select instance_id, median(run_s) as median_seconds, min(run_s) as shortest_seconds from runs where run_s is not null group by 1"),
    "crash_frequency": _sql("select version, round(100.0 * count(*) filter (where exit_kind = 'crash') / count(*), 6)::double as crashes_per_100 from runs group by 1"),
    "mask_servers": _sql("select server_id, 'Server ' || server_id as name, minutes, sessions from server_sums", _JUDGED),
}
