"""Budgets of a scan: of logs, instances, reconstructed sessions and the whole scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.operators.prefix import running_sums


@dataclass
class Limits:
    """Limits of an instance, of a session, of a scan, and what a log that failed to parse is charged (fixed values by default)."""

    instance_logs: int = 4096
    instance_bytes: int = 512 << 20
    instance_events: int = 500_000
    instance_sessions: int = 100_000
    session_destinations: int = 64
    session_versions: int = 64
    session_links: int = 100_000
    destination_bytes: int = 512
    version_bytes: int = 256
    scan_logs: int = 16_384
    scan_bytes: int = 2 << 30
    scan_events: int = 1_000_000
    scan_sessions: int = 200_000
    scan_contexts: int = 500_000
    failed_bytes: int = 256 << 20
    failed_events: int = 250_000


def _first(*tests: tuple[Column, str]) -> Column:
    """Name of the first test that holds, null if none does."""
    return F.coalesce(*[F.when(test, name) for test, name in tests])


def judge(files: DataFrame, sessions: DataFrame, limits: Limits | None = None) -> DataFrame:
    """instance_id, status, resource of each instance with files to parse.

    ``files``: instance_id, file_order, ok, bytes, events, longest_destination, longest_version (in bytes).
    ``sessions``: instance_id, destinations, versions, links (numbers) of what the files of an instance give.
    An instance is ``taken``, or fails as a whole: ``instance_limit``, ``failed_parse``, ``session_limit``. Its logs are read in order up
    to the first one that breaks a limit; each is charged to the scan, a failed one with the most a log may have. The first instance that
    takes the scan beyond a limit gets ``scan_limit``, and all after it, in the order of instance_id, are ``deferred``.
    """
    m = limits or Limits()
    counted = files.join(files.groupBy("instance_id").agg(F.count(F.lit(1)).alias("files")), "instance_id")
    few = counted.filter(F.col("files") <= m.instance_logs)
    upto = Window.partitionBy("instance_id").orderBy("file_order").rowsBetween(Window.unboundedPreceding, 0)
    running = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0)).over(upto)
    broken = F.when(F.col("ok"), _first(
        (F.col("longest_destination") > m.destination_bytes, "destination bytes"), (F.col("longest_version") > m.version_bytes, "version bytes"),
        (running("bytes") > m.instance_bytes, "bytes"), (running("events") > m.instance_events, "events"),
    ))
    read = few.withColumn("broken", broken)
    read = read.withColumn("broken_before", F.count("broken").over(upto.rowsBetween(Window.unboundedPreceding, -1))).filter("broken_before = 0")
    parsed = read.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("logs"), F.sum(F.when(F.col("ok"), F.col("bytes")).otherwise(m.failed_bytes)).alias("bytes"),
        F.sum(F.when(F.col("ok"), F.col("events")).otherwise(m.failed_events)).alias("events"),
        F.max("broken").alias("broken"), F.bool_and("ok").alias("whole"),
    )
    found = sessions.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("destinations").alias("contexts"),
        *[F.max(c).alias(f"most_{c}") for c in ("destinations", "versions", "links")],
    )
    rows = files.select("instance_id").distinct().join(parsed, "instance_id", "left").join(found, "instance_id", "left")
    rows = rows.fillna(0, ["logs", "bytes", "events", "sessions", "contexts", "most_destinations", "most_versions", "most_links"])
    own = _first(
        (F.col("sessions") > m.instance_sessions, "sessions"), (F.col("most_destinations") > m.session_destinations, "destinations"),
        (F.col("most_versions") > m.session_versions, "versions"), (F.col("most_links") > m.session_links, "links"),
    )
    status = F.when(F.col("whole").isNull() | F.col("broken").isNotNull(), "instance_limit").when(~F.col("whole"), "failed_parse").when(own.isNotNull(), "session_limit").otherwise("taken")
    resource = F.when(F.col("whole").isNull(), "logs").when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("whole"), own)
    rows = rows.withColumn("status", status).withColumn("resource", resource)
    for c in ("sessions", "contexts"):
        rows = rows.withColumn(c, F.when(F.col("status") == "taken", F.col(c)).otherwise(0))
    names = ("logs", "bytes", "events", "sessions", "contexts")
    summed = running_sums(rows.select("instance_id", "status", "resource", *names), "instance_id", {f"all_{c}": c for c in names})
    over = _first(*[(F.col(f"all_{c}") > getattr(m, f"scan_{c}"), c) for c in names])
    judged = summed.withColumn("over", over)
    end = judged.filter("over is not null").agg(F.min("instance_id").alias("end"))  # one row
    place = F.when(F.col("instance_id") == F.col("end"), "scan_limit").when(F.col("instance_id") > F.col("end"), "deferred")
    return judged.crossJoin(end).select(
        "instance_id", F.coalesce(place, "status").alias("status"), F.when(place == "scan_limit", F.col("over")).when(place.isNull(), F.col("resource")).alias("resource")
    )
