"""Filters of the session list and the libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.functions.core import not_blank
from playloom.functions.formats import duration, plural
from playloom.operators.explorers import instances, servers, versions, worlds
from playloom.operators.visible import visible
from playloom.sources.archive import Archive


def contexts(archive: Archive) -> DataFrame:
    """session_id, kind, name of each distinct named context."""
    rows = archive.segments.join(archive.servers, "server_id", "left")
    name = F.when(F.col("kind") == "server", F.coalesce(not_blank(F.col("display_name")), F.col("address"))).when(F.col("kind") == "world", not_blank(F.col("world")))
    return rows.select("session_id", "kind", name.alias("name")).filter("name is not null").distinct()


def _holds(text: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.strip().lower())), F.lit(False))


def session_search(archive: Archive, needle: str) -> DataFrame:
    """Sessions with the text in instance, launcher, version, loader or any context; a blank text matches all."""
    hits = contexts(archive).filter(_holds(F.col("name"), needle)).select("session_id", F.lit(True).alias("hit")).distinct()
    own = _holds(F.col("instance_name"), needle) | _holds(F.col("launcher"), needle) | _holds(F.col("version"), needle) | _holds(F.col("loader"), needle)
    rows = visible(archive).join(hits, "session_id", "left")
    return rows.filter(F.lit(not needle.strip()) | own | F.coalesce("hit", F.lit(False))).select("session_id", "instance_name", "version")


def session_scope(archive: Archive, kind: str, name: str) -> DataFrame:
    """Sessions of exactly one instance, version or context."""
    if kind in ("instance", "version"):
        return visible(archive).filter(F.col("instance_name" if kind == "instance" else "version") == name).select("session_id", "start_ms")
    own = contexts(archive).filter((F.col("kind") == kind) & (F.col("name") == name))
    return visible(archive).join(own, "session_id", "left_semi").select("session_id", "start_ms")


def session_kind(archive: Archive) -> DataFrame:
    """Each session's kind: the one kind of its segments, mixed, or menu for none and unknown."""
    kinds = archive.segments.groupBy("session_id").agg(F.countDistinct("kind").alias("n"), F.min("kind").alias("kind"))
    shown = F.when(F.col("n") > 1, "mixed").when(F.col("kind").isin("server", "world"), F.col("kind")).otherwise("menu")
    return visible(archive).join(kinds, "session_id", "left").select("session_id", shown.alias("kind"))


def session_filter_summary(archive: Archive) -> DataFrame:
    """Sessions and known minutes by label."""
    return visible(archive).groupBy("label").agg(F.count(F.lit(1)).alias("sessions"), F.floor(F.sum(F.coalesce("seconds", F.lit(0))) / 60).alias("minutes"))


def library_search(archive: Archive, needle: str) -> DataFrame:
    """Worlds, servers and versions whose name holds the text."""
    found = worlds(archive).select(F.lit("world").alias("kind"), F.col("world").alias("name"), "sessions")
    found = found.unionByName(servers(archive).select(F.lit("server").alias("kind"), "name", "sessions"))
    found = found.unionByName(versions(archive).select(F.lit("version").alias("kind"), F.col("version").alias("name"), "sessions"))
    return found.filter(_holds(F.col("name"), needle))


def instance_search(archive: Archive, needle: str) -> DataFrame:
    rows = instances(archive)
    own = _holds(F.col("instance_name"), needle) | _holds(F.col("launcher"), needle) | _holds(F.col("version"), needle) | _holds(F.col("loader"), needle)
    return rows.filter(own).select("instance_id", "instance_name", "launcher", "sessions")


def mask_servers(archive: Archive) -> DataFrame:
    """Servers with a neutral name in place of the real one."""
    return servers(archive).select("server_id", F.concat(F.lit("Server "), F.col("server_id").cast("string")).alias("name"), "minutes", "sessions")


def filtered_sessions(archive: Archive, kind: str = "all", level: str = "all", needle: str = "") -> DataFrame:
    """Sessions of a kind (their own, or that of one of their contexts), of a label, and with a text; any of them may be left out."""
    rows = visible(archive)
    if kind != "all":
        own = session_kind(archive).filter(F.col("kind") == kind).select("session_id")
        if kind in ("server", "world"):
            own = own.union(contexts(archive).filter(F.col("kind") == kind).select("session_id")).distinct()
        rows = rows.join(own, "session_id", "left_semi")
    if level != "all":
        rows = rows.filter(F.col("label") == level)
    if needle.strip():
        rows = rows.join(session_search(archive, needle).select("session_id"), "session_id", "left_semi")
    return rows.select("session_id", "start_ms", "seconds", "label")


def filter_totals(rows: DataFrame) -> DataFrame:
    """Number and known minutes of filtered sessions, with texts for both."""
    one = rows.agg(F.count(F.lit(1)).alias("sessions"), F.floor(F.coalesce(F.sum("seconds"), F.lit(0)) / 60).alias("minutes"))
    return one.select("*", plural(F.col("sessions"), "session").alias("sessions_text"), duration(F.col("minutes")).alias("minutes_text"))
