"""Explorer reads: one summary row per instance, world, server, version and launcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.functions.core import CAPPED_SCORE, ascii_lower, implausible, label, not_blank, version_class
from playloom.operators.visible import visible
from playloom.sources.archive import Archive

#: Rows of an explorer read: a top-k report.
TOP = 500


def _judged(archive: Archive) -> DataFrame:
    """Visible sessions under the explorers' rule: without a duration no bound is tested."""
    wrong = implausible(F.col("start_ms"), F.col("end_ms"), F.col("seconds"), needs_duration=True)
    return visible(archive).withColumn("wrong", wrong).select(
        "*", F.when(~F.col("wrong"), F.coalesce("seconds", F.lit(0))).otherwise(0).alias("run_s"),
        F.when(F.col("wrong"), F.col("start_ms")).otherwise(F.coalesce("end_ms", "start_ms")).alias("seen_ms"),
        F.when(F.col("wrong"), F.least(F.col("score"), F.lit(CAPPED_SCORE))).otherwise(F.col("score")).alias("run_score"),
    )


def instances(archive: Archive) -> DataFrame:
    """Per instance: raw seconds (no bounds test), sessions, last seen, crashes, weakest label, latest version, distinct worlds."""
    newest = F.struct("start_ms", -F.col("session_id"))
    per = visible(archive).groupBy("instance_id", "instance_name", "launcher").agg(
        F.sum(F.coalesce("seconds", F.lit(0))).alias("seconds"), F.count(F.lit(1)).alias("sessions"), F.max(F.coalesce("end_ms", "start_ms")).alias("last_ms"),
        F.count_if(F.col("exit_kind") == "crash").alias("crashes"), label(F.min("score")).alias("label"),
        F.max_by(F.nullif(F.col("version"), F.lit("")), F.when(F.col("version") != "", newest)).alias("version"), F.max_by("loader", F.when(F.col("loader").isNotNull(), newest)).alias("loader"),
    )
    worlds = archive.segments.filter("kind = 'world'").join(visible(archive).select("session_id", "instance_id"), "session_id")
    worlds = worlds.groupBy("instance_id").agg(F.countDistinct(not_blank(F.col("world"))).alias("worlds"))
    return per.join(worlds, "instance_id", "left").withColumn("minutes", F.floor(F.col("seconds") / 60)).drop("seconds").fillna({"worlds": 0})


def worlds(archive: Archive) -> DataFrame:
    """Per instance and world: each session counts once, with its weakest segment."""
    named = archive.segments.filter("kind = 'world'").select("session_id", not_blank(F.col("world")).alias("world"), "segment_score").filter("world is not null")
    seen = named.groupBy("session_id", "world").agg(F.min("segment_score").alias("segment_score")).join(_judged(archive), "session_id")
    return seen.groupBy("instance_id", "world").agg(
        F.floor(F.sum("run_s") / 60).alias("minutes"), F.count(F.lit(1)).alias("sessions"), F.max("seen_ms").alias("last_ms"),
        label(F.min(F.least("run_score", "segment_score"))).alias("label"),
    )


def servers(archive: Archive) -> DataFrame:
    """Per server: runtime, sessions, last seen, weakest label and the version played longest there."""
    named = archive.segments.filter("kind = 'server'").join(archive.servers, "server_id")
    seen = named.groupBy("session_id", "server_id", "address", "display_name").agg(F.min("segment_score").alias("segment_score")).join(_judged(archive), "session_id")
    per = seen.groupBy("server_id", F.coalesce(not_blank(F.col("display_name")), F.col("address")).alias("name")).agg(
        F.floor(F.sum("run_s") / 60).alias("minutes"), F.count(F.lit(1)).alias("sessions"), F.max("seen_ms").alias("last_ms"), label(F.min(F.least("run_score", "segment_score"))).alias("label")
    )
    played = seen.filter("version <> ''").groupBy("server_id", "version").agg(F.sum("run_s").alias("s"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("server_id").orderBy(F.col("s").desc(), F.col("n").desc(), "version")
    favorite = played.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("server_id", F.col("version").alias("favorite_version"))
    return per.join(favorite, "server_id", "left")


def versions(archive: Archive) -> DataFrame:
    """Per version: class, runtime, sessions, first and last seen, weakest label, loaders as JSON."""
    return _judged(archive).filter("trim(version) <> ''").groupBy("version").agg(
        F.floor(F.sum("run_s") / 60).alias("minutes"), F.count(F.lit(1)).alias("sessions"), F.min("start_ms").alias("first_ms"), F.max("seen_ms").alias("last_ms"),
        label(F.min("run_score")).alias("label"), F.to_json(F.array_sort(F.collect_set("loader"))).alias("loaders"),
    ).withColumn("version_class", version_class(F.col("version")))


def launcher_usage(archive: Archive) -> DataFrame:
    """Per named launcher: instances, sessions, seconds within 0 to 31 days, first and last start."""
    ok = F.col("seconds").between(0, 2_678_400)
    rows = archive.launchers.join(visible(archive).drop("location_id"), "launcher_id")
    return rows.groupBy("launcher_id", "launcher_name").agg(
        F.countDistinct("instance_id").alias("instances"), F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(F.when(ok, F.col("seconds"))), F.lit(0)).alias("seconds"),
        F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"),
    )


def top(rows: DataFrame, *order: Column, size: int = TOP) -> DataFrame:
    """The first rows of an explorer and, on each, how many there are in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(size).crossJoin(total)  # total is one row


def world_page(archive: Archive) -> DataFrame:
    return top(worlds(archive), F.col("last_ms").desc(), F.col("instance_id"), F.col("world")).select("instance_id", "world", "last_ms", "total")


def eligible_instances(archive: Archive) -> DataFrame:
    """Instances with a visible session, and those with a current source that a completed scan saw."""
    scanned = archive.sources.filter("current_revision is not null").join(archive.scans.filter("state = 'completed'"), "scan_id", "left_semi")
    return visible(archive).select("instance_id").union(scanned.filter("instance_id is not null").select("instance_id")).distinct()


def gated(rows: DataFrame, archive: Archive) -> DataFrame:
    """The rows once any scan was completed, none before."""
    done = archive.scans.agg(F.count_if(F.col("state") == "completed").alias("completed_scans"))  # one row
    return rows.crossJoin(done).filter("completed_scans > 0").drop("completed_scans")


def instance_page(archive: Archive) -> DataFrame:
    """The first eligible instances, most minutes first; those without a visible session have none and the label of no evidence."""
    dims = archive.instances.join(archive.locations, "location_id").join(archive.launchers.select("launcher_id", "launcher_name"), "launcher_id", "left")
    named = dims.select("instance_id", F.col("instance_name").alias("name"), F.coalesce("launcher_name", "adapter_kind").alias("launcher"))
    seen = instances(archive).drop("instance_name", "launcher")
    rows = named.join(eligible_instances(archive), "instance_id", "left_semi").join(seen, "instance_id", "left").fillna({"minutes": 0, "sessions": 0, "crashes": 0, "worlds": 0, "label": "unknown"})
    order = F.col("minutes").desc(), F.col("last_ms").desc_nulls_last(), ascii_lower(F.col("name")), F.col("instance_id")
    return top(gated(rows, archive), *order).select("instance_id", "name", "launcher", "minutes", "sessions", "last_ms", "crashes", "worlds", "version", "loader", "label", "total")


def server_page(archive: Archive) -> DataFrame:
    order = F.col("minutes").desc(), F.col("last_ms").desc(), ascii_lower(F.col("name")), F.col("server_id")
    return top(gated(servers(archive), archive), *order).select("server_id", "name", "minutes", "sessions", "last_ms", "label", "favorite_version", "total")


def version_page(archive: Archive) -> DataFrame:
    order = F.col("last_ms").desc(), F.col("minutes").desc(), F.col("version")
    return top(gated(versions(archive), archive), *order).select("version", "version_class", "minutes", "sessions", "first_ms", "last_ms", "label", "loaders", "total")


def archive_budget(archive: Archive) -> DataFrame:
    """Sessions and contexts per instance, hidden ones too."""
    contexts = archive.segments.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    rows = archive.sessions.select("session_id", "instance_id").join(contexts, "session_id", "left")
    return rows.groupBy("instance_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("n", F.lit(0))).alias("contexts"))


def crash_share(archive: Archive) -> DataFrame:
    return instances(archive).select("instance_id", F.round(100.0 * F.col("crashes") / F.col("sessions"), 1).alias("crash_percent"))


def sessions_by_day(archive: Archive) -> DataFrame:
    return visible(archive).groupBy("local_day").agg(F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("seconds", F.lit(0))).alias("seconds"))


def archive_state(archive: Archive) -> DataFrame:
    """unscanned, scannedNoEvidence or ready."""
    seen = visible(archive).agg(F.count(F.lit(1)).alias("visible_sessions"))
    scanned = archive.instances.agg(F.count(F.lit(1)).alias("n"))
    return seen.crossJoin(scanned).select(  # one row each
        "visible_sessions", F.when(F.col("visible_sessions") > 0, "ready").when(F.col("n") > 0, "scannedNoEvidence").otherwise("unscanned").alias("state")
    )
