"""Sessions a reader may see, with their bounds judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playloom.functions.core import CAPPED_SCORE, implausible, local_date
from playloom.sources.archive import Archive

#: What a launcher is called where its installation has no name of its own (fixed values).
ADAPTER_NAMES = {"official": "Official launcher", "prism": "Prism Launcher", "multimc": "MultiMC"}


def visible(archive: Archive) -> DataFrame:
    """Sessions that no user has hidden, with instance and launcher. Dimensions are joined on keys; Spark broadcasts small ones."""
    hidden = archive.user_state.filter("ignored").select("session_id")
    name = F.lit("Manual folder")
    for kind, shown in ADAPTER_NAMES.items():
        name = F.when(F.col("adapter_kind") == kind, shown).otherwise(name)
    launchers = archive.launchers.select("launcher_id", "launcher_name")
    dims = archive.instances.join(archive.locations, "location_id").join(launchers, "launcher_id", "left")
    dims = dims.select("instance_id", "instance_name", "location_id", "launcher_id", F.coalesce("launcher_name", name).alias("launcher"))
    wrong = implausible(F.col("start_ms"), F.col("end_ms"), F.col("seconds"))
    return (
        archive.sessions.join(hidden, "session_id", "left_anti")
        .join(dims, "instance_id")
        .withColumn("wrong", wrong)
        .withColumn("local_day", local_date(F.col("start_ms"), F.col("offset_min")))
    )


def runs(archive: Archive) -> DataFrame:
    """Visible sessions with run_s and run_end (null where unknown or implausible) and run_score (capped where implausible)."""
    wrong = F.col("wrong")
    return visible(archive).select(
        "*", F.when(~wrong, F.col("seconds")).alias("run_s"), F.when(~wrong, F.col("end_ms")).alias("run_end"),
        F.when(wrong, F.least(F.col("score"), F.lit(CAPPED_SCORE))).otherwise(F.col("score")).alias("run_score"),
    )
