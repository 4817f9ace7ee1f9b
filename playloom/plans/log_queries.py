"""Queries over logs made from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from playloom.operators import parsing, reconstruct
from playloom.plans.fold_sql import FOLD_SQL, REPEATS_SQL
from playloom.sources.logs import LINES_SQL, event_lines


def log_lines(spark, sf_dir):
    """Lines with half-open byte ranges."""
    lines = event_lines(spark, sf_dir).withColumn("n", F.octet_length("value").cast("long"))
    end = F.expr("sum(n + 1) over (partition by source_id order by line_number)")
    return lines.select("source_id", "line_number", (end - F.col("n") - 1).alias("byte_start"), (end - 1).alias("byte_end"))


def log_body(spark, sf_dir):
    return event_lines(spark, sf_dir).select("source_id", "line_number", parsing.prefix(F.col("value")).alias("prefix"), parsing.body(F.col("value")).alias("body"))


def log_timestamp(spark, sf_dir):
    return parsing.timed_lines(event_lines(spark, sf_dir)).select("source_id", "line_number", "local_ms", "origin")


def log_rollover(spark, sf_dir):
    """The same lines without dates and with their clock turned by half a day, so that midnight falls inside."""
    lines = event_lines(spark, sf_dir)
    clock = F.substring("value", 2, 8)
    turned = F.concat(F.lit("["), F.lpad(F.pmod(F.substring("value", 2, 2).try_cast("int") + 12, F.lit(24)).cast("string"), 2, "0"), F.substring("value", 4, 6))
    lines = lines.filter(clock.rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$")).withColumn("value", F.concat(turned, F.lit("] x"))).withColumn("date_hint", F.lit(None).cast("date"))
    timed = parsing.timed_lines(lines.withColumn("final_ms", (F.col("source_order").cast("long") + 1) * parsing.DAY_MS + 11 * 3_600_000))
    return parsing.anchor_final_day(timed, "final_ms").select("source_id", "line_number", "day_index", "sequence_ms", "local_ms")


def log_events(spark, sf_dir):
    return parsing.log_events(event_lines(spark, sf_dir)).select("source_id", "line_number", "event_order", "kind", "detail", "score")


def log_diag(spark, sf_dir):
    return parsing.diagnostics(event_lines(spark, sf_dir)).drop("longest_line")


def server_address(spark, sf_dir):
    rows = parsing.log_events(event_lines(spark, sf_dir)).filter("kind = 'server'")
    from playloom.functions.core import canonical_server

    return rows.groupBy(canonical_server(F.col("detail")).alias("address")).agg(F.count(F.lit(1)).alias("joins"))


def _events(spark, sf_dir):
    return parsing.log_events(event_lines(spark, sf_dir)).withColumn("hint_ms", F.lit(None).cast("long"))


def dedupe_overlap(spark, sf_dir):
    return reconstruct.dedupe_overlap(_events(spark, sf_dir)).select("source_id", "line_number", "event_order", "kind")


def reconstructed(spark, sf_dir):
    return reconstruct.sessions(reconstruct.dedupe_overlap(_events(spark, sf_dir))).drop("versions", "destinations", "sources")


def session_rows(spark, sf_dir):
    return reconstruct.session_rows(reconstruct.sessions(_events(spark, sf_dir))).drop("destinations")


def segments(spark, sf_dir):
    """One row per session and destination; a world without a name gets a fixed one."""
    rows = reconstruct.sessions(_events(spark, sf_dir)).select("instance_id", "start_ms", F.posexplode("destinations").alias("place", "to"))
    name = F.nullif(F.regexp_extract("to", "^[a-z]+:(.*)$", 1), F.lit(""))
    return rows.select("instance_id", "start_ms", "place", F.regexp_extract("to", "^([a-z]+):", 1).alias("kind"), F.coalesce(name, F.lit("Local world")).alias("name"))


def session_confidence(spark, sf_dir):
    """The score of every order read as a session: start, end, versions, destinations and length from its keys."""
    key, ends = F.col("o_orderkey"), list(reconstruct.ENDS)
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (key % len(ends) + 1).cast("int"))
    score = reconstruct.score_column(key % 2 == 0, end, key % 3 == 0, key % 5 < 3, key % 7)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("session_id"), end.alias("end_kind"), score.alias("score"))


QUERIES = {
    "log_lines": log_lines, "log_body": log_body, "log_timestamp": log_timestamp, "log_rollover": log_rollover, "log_events": log_events, "log_diag": log_diag,
    "server_canonical": server_address, "dedupe_overlap": dedupe_overlap, "reconstruct": reconstructed, "session_rows": session_rows, "segments": segments, "session_confidence": session_confidence,
}

_BODY = r"trim(case when contains(value, ']: ') then regexp_extract(value, '^.*\]: (.*)$', 1) else value end)"
_PARSED = rf""", parsed as (
    select *, {_BODY} as body, lower({_BODY}) as low, case when value like '[%' then regexp_extract(value, '^\[([^\]]*)\]', 1) end as prefix from lines),
stamped as (
    select *, case when prefix like '____-__-__ __:__:__' then epoch_ms(prefix::timestamp) end as full_ms,
           case when prefix like '____-__-__ __:__:__' then epoch_ms(prefix::timestamp) % 86400000
                when prefix like '__:__:__' and prefix <> '99:99:99' then epoch_ms(('1970-01-01 ' || prefix)::timestamp) end as clock from parsed),
typed as (
    select source_id, line_number, low, body, case
        when contains(low, 'loading minecraft ') then [struct_pack(kind := 'start', detail := null::varchar, score := 94), struct_pack(kind := 'version', detail :=
            regexp_replace(regexp_extract(body, '(?i)loading minecraft (\S+)', 1), ',$', ''), score := 98)]
        when contains(low, 'connecting to ') then [struct_pack(kind := 'server', detail := regexp_replace(regexp_extract(body, '(?i)connecting to (.*)$', 1), ', ', ':'),
            score := 95)]
        when contains(low, 'preparing level ') then [struct_pack(kind := 'world', detail := regexp_extract(body, '"(.*)"', 1), score := 94)]
        when low = 'stopping!' then [struct_pack(kind := 'stopping', detail := null::varchar, score := 96)]
        when low = 'stopping worker threads' then [struct_pack(kind := 'clean_shutdown', detail := null::varchar, score := 94)]
        when contains(low, 'unreported exception thrown') then [struct_pack(kind := 'crash', detail := null::varchar, score := 98)]
        when contains(low, 'disconnected from server') then [struct_pack(kind := 'disconnected', detail := 'remote', score := 92)]
        else [] end as events from parsed)"""


#: The typed events as input of the fold.
_EVENTS = """, events_ as (
    select instance_id, source_id, source_id as content_hash, source_order, line_number, unnest(range(len(events)))::integer as event_order, unnest(events).kind as kind,
           unnest(events).detail as detail, unnest(events).score as score, local_ms, null::bigint as hint_ms
    from typed join (select instance_id, source_id, source_order, line_number, coalesce(full_ms, epoch_ms(date_hint) + clock) as local_ms from stamped) using (source_id, line_number)),"""
_UNMARKED = "marked as (select *, false as repeated from events_),"


def _sql(select: str, *parts: str) -> str:
    return f"with recursive {LINES_SQL}{''.join(parts)}\n{select}"


ORACLE_SQL = {
    "log_lines": _sql("""select source_id, line_number, (sum(strlen(value) + 1) over w - strlen(value) - 1)::bigint as byte_start, (sum(strlen(value) + 1) over w - 1)::bigint as byte_end
        from lines window w as (partition by source_id order by line_number)"""),
    "log_body": _sql("select source_id, line_number, prefix, body from parsed", _PARSED),
    "log_timestamp": _sql("""select source_id, line_number, case when full_ms is not null then full_ms when clock is not null then epoch_ms(date_hint) + clock end as local_ms,
        case when full_ms is not null then 'line_datetime' when clock is null then 'missing' else 'line_time_with_date_hint' end as origin from stamped""", _PARSED),
    "log_rollover": _sql("""select source_id, line_number, day_index, day_index * 86400000 + c as sequence_ms,
            ((source_order + 1 - case when last_c - 39600000 > 43200000 then 1 else 0 end) - max(day_index) over (partition by source_id) + day_index) * 86400000 + c as
                local_ms from (
        select *, last_value(c) over (partition by source_id order by line_number rows between unbounded preceding and unbounded following) as last_c,
               (sum(case when p - c > 43200000 then 1 else 0 end) over (partition by source_id order by line_number))::bigint as day_index from (
            select *, lag(c) over (partition by source_id order by line_number) as p from (select *, (clock + 43200000) % 86400000 as c from stamped where clock is not null and full_ms is null)))""", _PARSED),
    "log_events": _sql("select source_id, line_number, unnest(range(len(events)))::integer as event_order, unnest(events).kind as kind, unnest(events).detail as detail, unnest(events).score as score from typed", _PARSED),
    "log_diag": _sql("""select source_id, count(*) as lines, sum(n)::bigint as events, count(*) filter (where prefix = '99:99:99') as unparsed, 0::bigint as rollovers, 0::bigint as non_monotonic,
            count(*) filter (where clock is null) as untimed, 0::bigint as malformed, count(*) filter (where clock is null) > 0 as warns, false as failed
        from stamped join (select source_id, line_number, len(events) as n from typed) using (source_id, line_number) group by 1""", _PARSED),
    "server_canonical": _sql("""select regexp_replace(lower(regexp_extract(body, '(?i)connecting to (.*)$', 1)), ', 25565$', '') as address, count(*) as joins
        from parsed where contains(low, 'connecting to ') group by 1""", _PARSED),
    "dedupe_overlap": _sql("select source_id, line_number, event_order, kind from marked where not repeated", _PARSED, _EVENTS, REPEATS_SQL),
    "reconstruct": _sql("select instance_id, start_ms, end_ms, seconds, start_kind, end_kind, exit_kind, score from found", _PARSED, _EVENTS, REPEATS_SQL, ",", FOLD_SQL),
    "session_rows": _sql("""select left(sha256(concat_ws('|', strlen(id) || ':' || id, strlen(s) || ':' || s, strlen(e) || ':' || e, strlen(v) || ':' || v, strlen(p) || ':' || p)), 32) as session_key, instance_id, start_ms,
            case when end_kind <> 'truncated' and seconds <= 2678400 then end_ms end as end_ms, case when end_kind <> 'truncated' and seconds <= 2678400 then seconds end
                as seconds,
            case when seconds > 2678400 then 'unknown' else exit_kind end as exit_kind, score, case when score >= 80 then 'verified' when score >= 55 then 'high' when
                score >= 30 then 'partial' else 'unknown' end as label,
            versions[-1] as version, 'UTC+00:00' as offset_label
        from (select *, instance_id::varchar as id, start_ms::varchar as s, end_ms::varchar as e, array_to_string(versions, ',') as v, array_to_string(places, ',') as p,
                     if(seconds > 2678400, least(raw, 54), raw) as score from (select * rename (score as raw) from found))""", _PARSED, _EVENTS, _UNMARKED, FOLD_SQL),
    "segments": _sql("""select instance_id, start_ms, place - 1 as place, split_part(to_, ':', 1) as kind, coalesce(nullif(substr(to_, instr(to_, ':') + 1), ''), 'Local world') as name
        from (select instance_id, start_ms, unnest(places) as to_, unnest(range(1, len(places) + 1))::integer as place from found)""", _PARSED, _EVENTS, _UNMARKED, FOLD_SQL),
    "session_confidence": """select o_orderkey as session_id, end_kind, greatest(0, least(
            case when o_orderkey % 2 = 0 then 72 else 52 end + bonus + case when o_orderkey % 3 = 0 then 4 else 0 end + case when o_orderkey % 5 < 3 then 4 else 0 end -
                case when o_orderkey % 7 = 0 then 20 else 0 end,
            most, case when o_orderkey % 2 = 0 then 100 else 79 end, case when o_orderkey % 7 = 0 then 54 else 100 end))::integer as score
        from orders join (values (0, 'clean_shutdown', 20, 100), (1, 'client_stopping', 16, 100), (2, 'crash', 18, 100), (3, 'source_end_hint', 5, 69), (4, 'next_start',
            0, 54), (5, 'truncated', -4, 54)) e(k, end_kind, bonus, most)
            on k = o_orderkey % 6""",
}
