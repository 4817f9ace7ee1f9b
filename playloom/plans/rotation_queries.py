"""Queries over rotated logs: parsing, repeats, sessions with their evidence, and counters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from playloom.operators import parsing, reconstruct
from playloom.plans.fold_sql import FOLD_SQL, REPEATS_SQL
from playloom.shared import materialize, shared_dir
from playloom.sources import scan
from playloom.sources.logs import read_logs
from playloom.sources.rotations import ROTATED_SQL, TEXTS_SQL, rotated_lines, rotated_sources, with_hints, write_logs


def _events(spark, sf_dir):
    lines = rotated_lines(spark, sf_dir)
    return with_hints(parsing.log_events(lines)), rotated_sources(lines)


def rotated_events(spark, sf_dir):
    """Events of every kind of line."""
    return parsing.log_events(rotated_lines(spark, sf_dir)).select("source_id", "line_number", "event_order", "kind", "detail", "score", "local_ms")


def rotated_diag(spark, sf_dir):
    """Counters of each source: rollovers, times that fell back, bad stamps and bad bytes among them."""
    return parsing.diagnostics(rotated_lines(spark, sf_dir)).drop("longest_line")


def repeats(spark, sf_dir):
    """Events that a copy or a rotation's overlap repeats."""
    events, sources = _events(spark, sf_dir)
    return reconstruct.mark_repeats(events, sources).filter("repeated").select("source_id", "line_number", "event_order", "kind")


def rotated_sessions(spark, sf_dir):
    found, _, _ = reconstruct.reconstructed(*_events(spark, sf_dir))
    lists = [F.array_join(c, "|").alias(c) for c in ("versions", "destinations", "sources")]
    return found.select("instance_id", "start_ms", "end_ms", "seconds", "start_kind", "end_kind", "exit_kind", "score", *lists)


def evidence_links(spark, sf_dir):
    """The events each session rests on, with their roles."""
    return reconstruct.reconstructed(*_events(spark, sf_dir))[1]


def reconstruct_diag(spark, sf_dir):
    return reconstruct.reconstructed(*_events(spark, sf_dir))[2]


def evidence_rows(spark, sf_dir):
    return reconstruct.evidence_rows(parsing.log_events(rotated_lines(spark, sf_dir)))


def _written(spark, sf_dir):
    return write_logs(rotated_lines(spark, sf_dir), f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}")


def file_lines(spark, sf_dir):
    """Lines and their bytes, of logs that are written as files and read again in splits."""
    rows = read_logs(spark, f"file:{_written(spark, sf_dir)}")
    name = F.regexp_extract("source_id", r"/([^/]+)\.log$", 1)
    return rows.select(name.alias("source"), "line_number", "byte_start", "byte_end", "value", "malformed")


def scan_inventory(spark, sf_dir):
    """The same files found by a walk, fingerprinted, and read again as verified snapshots."""
    root = _written(spark, sf_dir)
    found = materialize(scan.fingerprints(scan.inventory(spark, [root]).filter("warning is null")), "inventory")
    content, verdicts = scan.snapshot(found)
    per = content.groupBy("path").agg(F.sum(F.octet_length("bytes")).alias("bytes"))
    return found.join(verdicts, ["root", "path"]).join(per, "path").select("path", "kind", "size", "hash", "verified", "bytes")


QUERIES = {
    "rotated_events": rotated_events, "rotated_diag": rotated_diag, "repeats": repeats, "rotated_sessions": rotated_sessions, "evidence_links": evidence_links,
    "reconstruct_diag": reconstruct_diag, "evidence_rows": evidence_rows, "file_lines": file_lines, "scan_inventory": scan_inventory,
}

def _sql(select: str, *parts: str) -> str:
    return f"with recursive {','.join(part.strip() for part in parts)}\n{select}"


_ALL = (ROTATED_SQL, REPEATS_SQL, FOLD_SQL)
#: Sessions as a select over ``found``.
SESSIONS_SQL = """select instance_id, start_ms, end_ms, seconds, start_kind, end_kind, exit_kind, score, array_to_string(versions, '|') as versions, array_to_string(places, '|') as destinations,
        (select string_agg(distinct source_id, '|' order by source_id) from linked l where l.instance_id = found.instance_id and l.nth = found.nth) as sources from found"""

ORACLE_SQL = {
    "rotated_events": _sql("select source_id, line_number, event_order, kind, detail, score, local_ms from events_", ROTATED_SQL),
    "rotated_diag": _sql("""select source_id, count(*) as lines, coalesce(sum(n_events), 0)::bigint as events, count(*) filter (where bad_stamp) as unparsed, count(*) filter (where rolled) as rollovers,
            count(*) filter (where before > clock and not rolled and (full_ms is null or full_ms // 86400000 * 86400000 = day_before)) as non_monotonic,
            count(*) filter (where clock is null) as untimed, count(*) filter (where malformed) as malformed,
            count(*) filter (where bad_stamp or clock is null or malformed or (before > clock and not rolled and (full_ms is null or full_ms // 86400000 * 86400000 =
                day_before))) > 0 as warns, false as failed
        from rotated left join (select phrase, count(*) as n_events from says group by phrase) using (phrase) group by source_id""", ROTATED_SQL),
    "file_lines": _sql("""select replace(source_id, '/', '_') as source, line_number, (sum(strlen(value) + 1) over w - strlen(value) - 1)::bigint as byte_start, (sum(strlen(value) + 1) over w)::bigint as byte_end,
            value, false as malformed from texts window w as (partition by source_id order by line_number)""", ROTATED_SQL, TEXTS_SQL),
    "scan_inventory": _sql("""select path, 'plain' as kind, strlen(content) as size, sha256(content) as hash, true as verified, strlen(content) as bytes
        from (select 'instances/' || instance_id || '/logs/' || replace(source_id, '/', '_') || '.log' as path, string_agg(value || chr(10), '' order by line_number) as content from texts group by instance_id, source_id)""", ROTATED_SQL, TEXTS_SQL),
    "repeats": _sql("select source_id, line_number, event_order, kind from marked where repeated", ROTATED_SQL, REPEATS_SQL),
    "rotated_sessions": _sql(SESSIONS_SQL, *_ALL),
    "evidence_links": _sql("""select instance_id, start_source, start_line, start_event, role, kind, score, source_id, line_number, event_order from linked join firsts using (instance_id, nth)""", *_ALL),
    "reconstruct_diag": _sql("""select instance_id, coalesce(repeated, 0)::bigint as repeated, coalesce(orphan_ends, 0)::bigint as orphan_ends, coalesce(orphan_activity, 0)::bigint as orphan_activity,
            coalesce(untimed_starts, 0)::bigint as untimed_starts, (coalesce(fell_back, 0) + coalesce(turned, 0))::bigint as non_monotonic, coalesce(zero, 0)::bigint as zero_length
        from (select instance_id, count(*) filter (where repeated) as repeated from marked group by 1)
        left join (select instance_id, sum(orphan_ends) as orphan_ends, sum(orphan_activity) as orphan_activity, sum(untimed_starts) as untimed_starts, sum(fell_back) as
            fell_back from fold group by 1) using (instance_id)
        left join (select instance_id, sum(turned) as turned, count(*) filter (where seconds = 0) as zero from found group by 1) using (instance_id)""", *_ALL),
    "evidence_rows": _sql("""select left(sha256(source_id || '|' || line_number || '|' || event_order || '|' || kind), 32) as evidence_id, source_id, line_number, event_order, kind, score,
            strftime(make_timestamp_ms(local_ms), '%Y-%m-%dT%H:%M:%S.%g') as observed_local,
            case when full_ms is not null then 'line_datetime' when clock is null then 'missing' else 'line_time_with_date_hint' end as origin,
            '{"kind":"' || kind || '"' || case when detail is null then '' else ',"detail":' || to_json(detail) end || '}' as payload,
            left(sha256(source_id || '|' || line_number || '|' || kind), 32) as event_key
        from events_ join (select source_id, line_number, full_ms, clock from rotated) using (source_id, line_number)""", ROTATED_SQL),
}
