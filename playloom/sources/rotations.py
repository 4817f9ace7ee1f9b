"""Rotated client logs derived from the event table: every kind of line, overlaps, copies, bad stamps and end hints."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playloom.shared import table

#: Lines a client writes ({n} is a number), their thread, and the events they stand for (kind, detail, score).
PHRASES = [
    ("Loading Minecraft 1.{n}.1 with Fabric Loader", "main/INFO", [("start", None, 94), ("version", "1.{n}.1", 98)]),
    ("Starting Minecraft client version 1.{n}", "main/INFO", [("start", None, 96), ("version", "1.{n}", 99)]),
    ("Forge Mod Loader version 7.{n} for Minecraft 1.{n} loading", "main/INFO", [("start", None, 91), ("version", "1.{n}", 96)]),
    ("Minecraft Version: 1.{n}.2", "main/INFO", [("version", "1.{n}.2", 96)]),
    ("Setting user: player{n}", "main/INFO", [("start", None, 82)]),
    ("LWJGL Version: 2.{n}", "main/INFO", [("start", None, 72)]),
    ("Backend library: LWJGL version 3.{n}", "main/INFO", [("start", None, 72)]),
    ("Connecting to S{n}.Example.net, 25565", "Render thread/INFO", [("server", "S{n}.Example.net:25565", 95)]),
    ("Connecting to h{n} now", "Render thread/INFO", [("server", "h{n}", 95)]),
    ("Starting integrated minecraft server version 1.{n}", "Server thread/INFO", [("integrated", "1.{n}", 96)]),
    ("Starting integrated minecraft server", "Server thread/INFO", [("integrated", None, 96)]),
    ('Preparing level "World {n}"', "Server thread/INFO", [("world", "World {n}", 94)]),
    ("Preparing start region for dimension {n}", "Server thread/INFO", [("world", None, 80)]),
    ("Stopping integrated server", "Server thread/INFO", [("disconnected", "integrated", 92)]),
    ("Disconnected from server", "Render thread/INFO", [("disconnected", "remote", 92)]),
    ("Client disconnected with reason: bye {n}", "Render thread/INFO", [("disconnected", "network", 88)]),
    ("Stopping!", "Render thread/INFO", [("stopping", None, 96)]),
    ("Stopping Minecraft {n}", "Render thread/INFO", [("stopping", None, 96)]),
    ("Stopping worker threads", "Render thread/INFO", [("clean_shutdown", None, 94)]),
    ("SoundSystem shutting down...", "Render thread/INFO", [("clean_shutdown", None, 94)]),
    ("This crash report has been saved to: x{n}", "Render thread/ERROR", [("crash", None, 100)]),
    ("Unreported exception thrown!", "Render thread/ERROR", [("crash", None, 98)]),
    ("The game crashed whilst {n}", "Render thread/ERROR", [("crash", None, 96)]),
    ("failed {n}", "main/FATAL", [("crash", None, 96)]),
    ("Could not read {n}", "main/INFO", []),
]
#: Lines that a rotation repeats from the log before it.
TAIL = 3


def rotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instance per user, one source per user and day. Every third user's sources begin with the last lines of the source
    before; every fifth user's sources have a copy. One stamp in 31 has no date, one in 53 is none, one in 29 is 90 seconds early."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), (k % 7 + 14).cast("string").alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id")))
    days = rows.select("user_id", "day").distinct()
    days = days.withColumn("next", F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))).filter("next is not null and user_id % 3 = 0")
    tails = rows.withColumn("rank", rank).filter(F.col("rank") <= TAIL).join(days, ["user_id", "day"]).withColumn("day", F.col("next")).drop("rank", "next")
    both = rows.withColumn("part", F.lit(1)).unionByName(tails.withColumn("part", F.lit(0)))
    number = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("part", "ts", "event_id")).cast("long")
    which = (F.col("event_id") % len(PHRASES)).cast("int")
    text = F.replace(F.get(F.array(*[F.lit(p[0]) for p in PHRASES]), which), F.lit("{n}"), F.col("n"))
    head = F.get(F.array(*[F.lit(p[1]) for p in PHRASES]), which)
    shown = F.when(F.col("event_id") % 29 == 0, F.col("ts") - F.expr("interval 90 seconds")).otherwise(F.col("ts"))
    stamp = F.when(F.col("event_id") % 53 == 0, "99:99:99").when(F.col("event_id") % 31 == 0, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format(shown, "yyyy-MM-dd HH:mm:ss"))
    value = F.concat(F.lit("["), stamp, F.lit("] ["), head, F.lit("]: "), text)
    own = F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string"))
    lines = both.select(
        F.col("user_id").alias("instance_id"), own.alias("content_hash"), F.datediff("day", F.lit("1970-01-01")).alias("source_order"), F.col("day").alias("date_hint"),
        number.alias("line_number"), value.alias("value"), (F.col("event_id") % 61 == 0).alias("malformed"),
    )
    copies = F.when(F.col("instance_id") % 5 == 0, F.array(F.lit(""), F.lit("-copy"))).otherwise(F.array(F.lit("")))
    return lines.select("*", F.explode(copies).alias("copy")).withColumn("source_id", F.concat("content_hash", "copy")).drop("copy")


def rotated_sources(lines: DataFrame) -> DataFrame:
    return lines.select("instance_id", "source_id", "source_order", "content_hash").distinct()


def with_hints(events: DataFrame) -> DataFrame:
    """An end hint of each source, up to 25 minutes after its last timed event."""
    last = F.max("local_ms").over(Window.partitionBy("source_id"))
    return events.withColumn("hint_ms", last + F.col("instance_id") % 1500 * 1000)


def _text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


_EVENTS = ", ".join(f"({k}, {order}, '{kind}', {_text(detail)}, {score})" for k, (_, _, events) in enumerate(PHRASES) for order, (kind, detail, score) in enumerate(events))

#: Lines as above, their times, and events by construction (not by rules of text): ``rotated`` and ``events_``.
ROTATED_SQL = f"""
says(phrase, event_order, kind, detail, score) as (values {_EVENTS}),
plain as (
    select user_id, event_id, ts, ts::date as day, ((props->>'$.k')::integer % 7 + 14)::varchar as n,
           row_number() over (partition by user_id, ts::date order by ts desc, event_id desc) as rank from events),
days as (
    select *, lead(day) over (partition by user_id order by day) as next from (select distinct user_id, day from plain)),
both_ as (
    select user_id, event_id, ts, day, n, 1 as part from plain
    union all select user_id, event_id, ts, next, n, 0 from plain join days using (user_id, day) where rank <= {TAIL} and next is not null and user_id % 3 = 0),
placed as (
    select *, row_number() over (partition by user_id, day order by part, ts, event_id) as line_number,
           (epoch(date_trunc('second', case when event_id % 29 = 0 then ts - interval 90 seconds else ts end)) * 1000)::bigint as shown_ms,
           ((epoch(date_trunc('second', ts))::bigint % 86400) * 1000)::bigint as clock_ms, epoch(day)::bigint * 1000 as hint_day from both_),
clocked as (
    select *, case when event_id % 53 <> 0 and event_id % 31 <> 0 then shown_ms end as full_ms,
           case when event_id % 53 = 0 then null when event_id % 31 = 0 then clock_ms else shown_ms % 86400000 end as clock from placed),
runs as (
    select *, count(full_ms) over w as run,
           last_value(clock ignore nulls) over (partition by user_id, day order by line_number rows between unbounded preceding and 1 preceding) as before
    from clocked window w as (partition by user_id, day order by line_number)),
rolls as (
    select *, full_ms is null and coalesce((before - clock) // 1000 * 1000 > 43200000, false) as rolled,
           coalesce(first_value(full_ms // 86400000 * 86400000 ignore nulls) over (partition by user_id, day, run order by line_number), hint_day) as base from runs),
timed as (
    select *, base + sum(rolled::integer) over (partition by user_id, day, run order by line_number) * 86400000 as day_ms from rolls),
rotated as (
    select user_id as instance_id, user_id || '/' || day || suffix as source_id, user_id || '/' || day as content_hash, (day - date '1970-01-01')::integer as
        source_order, line_number,
           (event_id % 25)::integer as phrase, n, event_id, full_ms, clock, before, rolled, (day_ms + clock)::bigint as local_ms,
           lag(day_ms) over (partition by user_id, day, suffix order by line_number) as day_before, event_id % 53 = 0 as bad_stamp, event_id % 61 = 0 as malformed
    from timed, (values (''), ('-copy')) c(suffix) where suffix = '' or user_id % 5 = 0),
events_ as (
    select instance_id, source_id, content_hash, source_order, line_number, event_order, kind, replace(detail, '{{n}}', n) as detail, score, local_ms,
           max(local_ms) over (partition by source_id) + instance_id % 1500 * 1000 as hint_ms
    from rotated join says using (phrase))"""

_TEXTS = ", ".join(f"({k}, {_text(text)}, {_text(head)})" for k, (text, head, _) in enumerate(PHRASES))

#: The lines themselves: ``texts``, from ``rotated``.
TEXTS_SQL = f"""
wording(phrase, text, head) as (values {_TEXTS}),
texts as (
    select instance_id, source_id, line_number, '[' || case when bad_stamp then '99:99:99' when full_ms is null then strftime(make_timestamp_ms(clock), '%H:%M:%S')
           else strftime(make_timestamp_ms(full_ms), '%Y-%m-%d %H:%M:%S') end || '] [' || head || ']: ' || replace(text, '{{n}}', n) as value
    from rotated join wording using (phrase))"""


def write_logs(lines: DataFrame, folder: str) -> str:
    """Writes each source as ``instances/<instance>/logs/<source>.log`` below a folder that all executors have mounted; gives its path.

    Each task writes the sources of its partition, one after the other as their lines stream by; a file takes its name when it is whole.
    """
    if not re.match(r"(file:)?/", folder):
        raise ValueError("logs can be written to a mounted folder only")
    root = re.sub("^file:/*", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, part = None, None, None

        def done() -> None:
            if out is not None:
                out.close()
                os.replace(part, name)

        for batch in batches:
            for instance, source, value in zip(*(batch.column(c).to_pylist() for c in ("instance_id", "source_id", "value"))):
                path = f"{root}/instances/{instance}/logs/{source.replace('/', '_')}.log"
                if path != name:
                    done()
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    name, part = path, f"{path}.{uuid.uuid4().hex}"
                    out = open(part, "wb")
                out.write(value.encode() + b"\n")
            yield batch.slice(0, 0)
        done()

    rows = lines.select("instance_id", "source_id", "line_number", "value").repartition("source_id").sortWithinPartitions("source_id", "line_number")
    rows.mapInArrow(run, rows.schema).write.format("noop").mode("overwrite").save()
    return root
