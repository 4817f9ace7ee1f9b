"""Reads that are documented but not built in the application: streaks, breaks, weekdays, hours and the median."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playloom.functions.core import DAY_MS
from playloom.operators.dashboard import ACTIVE_S, day_slices
from playloom.operators.visible import runs
from playloom.sources.archive import Archive


def _active(archive: Archive) -> DataFrame:
    """Active days with the day before; one row per day, so the window is small whatever the archive's size."""
    days = day_slices(archive).groupBy("day").agg(F.sum("day_seconds").alias("s")).filter(F.col("s") >= ACTIVE_S)
    return days.withColumn("before", F.lag("day").over(Window.orderBy("day")))


def breaks(archive: Archive) -> DataFrame:
    """Days without play between two active days."""
    gap = F.datediff("day", "before") - 1
    return _active(archive).select(F.col("before").alias("last_day"), F.col("day").alias("next_day"), gap.alias("days_off")).filter("days_off > 0")


def streaks(archive: Archive) -> DataFrame:
    """Runs of active days, with first day and length."""
    starts = (F.datediff("day", "before") != 1) | F.col("before").isNull()
    number = F.sum(starts.cast("int")).over(Window.orderBy("day"))
    return _active(archive).withColumn("streak", number).groupBy("streak").agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("days")).drop("streak")


def weekdays(archive: Archive) -> DataFrame:
    """Minutes per ISO weekday (1: Monday)."""
    return day_slices(archive).groupBy((F.weekday("day") + 1).alias("weekday")).agg(F.floor(F.sum("day_seconds") / 60).alias("minutes"))


def start_hours(archive: Archive) -> DataFrame:
    """Sessions by local hour of their start."""
    local = F.col("start_ms") + F.coalesce("offset_min", F.lit(0)) * 60_000
    return runs(archive).groupBy(F.floor(F.pmod(local, F.lit(DAY_MS)) / 3_600_000).alias("hour")).agg(F.count(F.lit(1)).alias("sessions"))


def medians(archive: Archive) -> DataFrame:
    """Median and shortest known session per instance."""
    return runs(archive).filter("run_s is not null").groupBy("instance_id").agg(F.median("run_s").alias("median_seconds"), F.min("run_s").alias("shortest_seconds"))


def crash_frequency(archive: Archive) -> DataFrame:
    """Crashes per 100 launches and version."""
    return runs(archive).groupBy("version").agg(F.round(100.0 * F.count_if(F.col("exit_kind") == "crash") / F.count(F.lit(1)), 6).alias("crashes_per_100"))
