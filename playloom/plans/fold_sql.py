"""DuckDB SQL for repeats and for the session fold, over a table ``events_``."""

#: Repeated events: of copies, and the longest end of the source before that begins a source. From ``events_``, where
#: content_hash names the source that a source equals.
REPEATS_SQL = """
keyed as (
    select instance_id, source_order, source_id, list({'kind': kind, 'detail': detail, 'at': local_ms} order by line_number, event_order) as keys,
           list(line_number order by line_number, event_order) as lines
    from events_ where local_ms is not null and source_id = content_hash group by all),
chained as (
    select *, lag(keys) over w as keys_before, lag(lines) over w as lines_before from keyed window w as (partition by instance_id order by source_order, source_id)),
common as (
    select source_id, lines, lines_before, list_max(list_filter(range(1, least(len(keys), len(keys_before)) + 1), lambda k: keys[1:k] = keys_before[len(keys_before) - k
        + 1:])) as k
    from chained where keys_before is not null),
lapped as (
    select source_id, k from common where k >= 2 and lines[1] <> lines[k] and lines_before[len(lines_before) - k + 1] <> lines_before[-1]),
marked as (
    select e.*, coalesce(source_id <> content_hash or (local_ms is not null and
           row_number() over (partition by source_id order by local_ms is null, line_number, event_order) <= k), false) as repeated
    from events_ e left join lapped using (source_id))"""

#: The fold as a recursion over each instance's events that are not ``repeated`` in ``marked``: one state and what it gave, for each event.
FOLD_SQL = """
numbered as (
    select *, row_number() over (partition by instance_id order by source_order, source_id, line_number, event_order) as i, kind in ('server', 'integrated', 'world') as acts
    from marked where not repeated),
fold as (
    select instance_id, 0::bigint as i, false as opened, 0 as nth, null::bigint as start_ms, false as explicit, null::varchar as src, null::bigint as last_ms,
        null::bigint as hint, null::bigint as stop_ms,
           []::varchar[] as versions, []::varchar[] as places, false as shut, null::bigint as shut_at, null::varchar as shut_kind, null::bigint as shut_last,
               []::varchar[] as shut_versions,
           []::varchar[] as shut_places, 0 as shut_nth, null::bigint as shut_start, false as shut_explicit, []::varchar[] as roles, 0 as orphan_ends, 0 as
               orphan_activity, 0 as untimed_starts, 0 as fell_back
    from (select distinct instance_id from numbered)
    union all
    select instance_id, i, opened and not ends, nth, start_ms, explicit, src, last_ms, hint, case when kind = 'stopping' and opened then coalesce(stop_ms, t_ms) else
        stop_ms end, versions, places,
           closes or ends, case when ends then t_ms else shut_at end, case when ends then kind else shut_kind end, case when ends then last_ms else shut_last end,
           case when ends then versions else shut_versions end, case when ends then places else shut_places end, case when ends then nth else shut_nth end,
           case when ends then start_ms else shut_start end, case when ends then explicit else shut_explicit end, roles, orphan_ends, orphan_activity, untimed_starts, fell_back
    from (
        select *, case when new_place is null or list_contains(kept_places, new_place) or (new_place = 'world:' and has_named) then kept_places else
            list_append(kept_places, new_place) end as places
        from (
            select *, case when sees and t_ms < seen_last then seen_last when sees then t_ms else seen_last end as last_ms, (sees and t_ms < seen_last)::integer as fell_back,
                   case when new_version is null or list_contains(had_versions, new_version) then had_versions else list_append(had_versions, new_version) end as versions,
                   len(list_filter(had_places, lambda p: p like 'world:_%')) > 0 as has_named,
                   case when new_place like 'world:_%' and len(list_filter(had_places, lambda p: p like 'world:_%')) = 0 then list_filter(had_places, lambda p: p <>
                       'world:') else had_places end as kept_places
            from (
                select *, opened and kind in ('clean_shutdown', 'crash') and t_ms is not null as ends,
                       opened and t_ms is not null and (boots or begins or acts or kind in ('version', 'disconnected', 'stopping', 'clean_shutdown', 'crash')) as sees,
                       case when opened and (kind = 'version' or (kind = 'integrated' and detail is not null)) then detail end as new_version,
                       case when opened and kind = 'server' then 'server:' || detail when opened and kind = 'world' then 'world:' || coalesce(detail, '') when opened and
                           acts then 'world:' end as new_place,
                       case when not opened then [] when begins and kind = 'start' then ['start']
                            when acts then (case when begins then ['start'] else [] end) || (case when kind = 'integrated' and detail is not null then ['version'] else
                                [] end) || ['destination']
                            when kind in ('start', 'disconnected') then ['supporting'] when kind = 'version' then ['version']
                            when kind = 'stopping' or t_ms is not null then ['end', 'exit'] else [] end as roles
                from (
                    select n.instance_id, n.i, n.kind, n.detail, n.acts, t_ms, boots, closes, begins, begins or (f.opened and not closes) as opened, f.nth + begins::integer as nth,
                           case when begins then t_ms else f.start_ms end as start_ms, case when begins then n.kind = 'start' else f.explicit end as explicit, case when
                               begins then n.source_id else f.src end as src,
                           case when begins then t_ms else f.last_ms end as seen_last, case when begins then null else f.stop_ms end as stop_ms,
                           case when begins then n.hint_ms when f.opened and (boots or acts or n.kind in ('version', 'disconnected', 'stopping')) then greatest(f.hint,
                               n.hint_ms) else f.hint end as hint,
                           case when begins then [] else f.versions end as had_versions, case when begins then [] else f.places end as had_places,
                           case when closes then coalesce(f.stop_ms, f.last_ms) end as shut_at, case when closes then case when f.stop_ms is null then 'next_start' else
                               'client_stopping' end end as shut_kind,
                           f.last_ms as shut_last, f.versions as shut_versions, f.places as shut_places, f.nth as shut_nth, f.start_ms as shut_start, f.explicit as shut_explicit,
                           (not f.opened and n.kind in ('disconnected', 'stopping', 'clean_shutdown', 'crash'))::integer as orphan_ends,
                           (acts and t_ms is null and (not f.opened or f.stop_ms is not null))::integer as orphan_activity, (n.kind = 'start' and t_ms is null)::integer
                               as untimed_starts
                    from (select *, local_ms as t_ms from numbered) n join fold f on f.instance_id = n.instance_id and n.i = f.i + 1,
                         lateral (select n.kind = 'start' and t_ms is not null and f.opened and f.stop_ms is null and f.src = n.source_id and t_ms - f.start_ms > -1000
                             and t_ms - f.start_ms < 121000 as boots),
                         lateral (select (n.kind = 'start' and t_ms is not null and f.opened and not boots) or (acts and f.opened and f.stop_ms is not null) as closes),
                         lateral (select t_ms is not null and ((n.kind = 'start' and not boots) or (acts and (not f.opened or closes))) as begins)))))),
ending as (
    select *, case when stop_ms is not null then stop_ms when hint - last_ms > -1000 and hint - last_ms < 901000 then hint else last_ms end as t_ms,
           case when stop_ms is not null then 'client_stopping' when hint - last_ms > -1000 and hint - last_ms < 901000 then 'source_end_hint' else 'truncated' end as end_kind
    from (select *, row_number() over (partition by instance_id order by i desc) as r from fold) where r = 1 and opened),
closed as (
    select instance_id, shut_nth as nth, shut_start as start_ms, shut_explicit as explicit, shut_at as t_ms, shut_kind as end_kind, shut_last as last_ms, shut_versions
        as versions, shut_places as places from fold where shut
    union all select instance_id, nth, start_ms, explicit, t_ms, end_kind, last_ms, versions, places from ending),
measured as (
    select *, case when t_ms < start_ms then last_ms else t_ms end as end_ms, greatest(0, case when t_ms < start_ms then last_ms else t_ms end - start_ms) // 1000 as
        seconds from closed),
found as (
    select instance_id, nth, start_ms, end_ms, seconds::bigint as seconds, case when explicit then 'explicit' else 'inferred' end as start_kind, end_kind,
           case when end_kind in ('clean_shutdown', 'client_stopping') then 'clean' when end_kind = 'crash' then 'crash' else 'unknown' end as exit_kind,
           greatest(0, least(case when explicit then 72 else 52 end + bonus + case when len(versions) > 0 then 4 else 0 end + case when len(places) > 0 then 4 else 0 end
               - case when seconds = 0 then 20 else 0 end,
               most, case when explicit then 100 else 79 end, case when seconds = 0 then 54 else 100 end))::integer as score, versions, places, (t_ms < start_ms)::integer as turned
    from measured join (values ('clean_shutdown', 20, 100), ('client_stopping', 16, 100), ('crash', 18, 100), ('source_end_hint', 5, 69), ('next_start', 0, 54),
        ('truncated', -4, 54)) e(end_kind, bonus, most)
        using (end_kind)),
linked as (
    select n.instance_id, f.nth, unnest(f.roles) as role, unnest(range(len(f.roles))) as r, n.kind, n.score, n.source_id, n.line_number, n.event_order, n.i
    from fold f join numbered n using (instance_id, i) where len(f.roles) > 0),
firsts as (
    select instance_id, nth, arg_min(source_id, i) as start_source, arg_min(line_number, i) as start_line, arg_min(event_order, i)::integer as start_event from linked group by all)"""
