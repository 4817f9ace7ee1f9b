"""Texts of numbers, times and identifiers as a reader sees them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(minutes: Column, compact: bool = False) -> Column:
    """``5m``, ``1,234 h 5 min``, or ``1234h 5m`` if compact; ``Unknown`` for null."""
    hours, rest = F.floor(minutes / 60), F.round(minutes % 60).cast("long")
    if compact:
        long_text = F.concat(hours.cast("string"), F.lit("h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(""))
    else:
        long_text = F.concat(F.format_number(hours, 0), F.lit(" h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit(" min"))).otherwise(""))
    return F.when(minutes.isNull(), "Unknown").when(hours == 0, F.concat(rest.cast("string"), F.lit("m"))).otherwise(long_text)


def plural(value: Column, one: str, many: str | None = None) -> Column:
    return F.concat(F.format_number(value, 0), F.lit(" "), F.when(value == 1, one).otherwise(many or f"{one}s"))


def observed_day(moment: Column) -> Column:
    """The date that a text of a moment begins with, as it was seen, without any zone."""
    return F.regexp_extract(moment, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def short_date(moment: Column) -> Column:
    return F.date_format(observed_day(moment), "MMM d, yyyy")


def long_date(moment: Column) -> Column:
    return F.date_format(observed_day(moment), "EEEE, MMMM d")


def month_name(month: Column) -> Column:
    """``August 2026`` for ``2026-08``."""
    return F.date_format(F.concat(month, F.lit("-01")).try_cast("date"), "MMMM yyyy")


def rfc3339(ms: Column, offset_min: Column) -> Column:
    """The moment at its offset from UTC, in minutes (null: UTC)."""
    offset = F.coalesce(offset_min, F.lit(0))
    local = F.date_format(F.timestamp_millis(ms + offset * 60_000).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    sign = F.when(offset < 0, "-").otherwise("+")
    size = F.abs(offset)
    return F.concat(local, sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def humanise(identifier: Column) -> Column:
    """``minecraft:oak_log`` as ``Oak Log``: the part after the last colon, words at underscores and hyphens."""
    words = F.filter(F.split(F.element_at(F.split(identifier, ":"), -1), "[_-]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def measured(value: Column, unit: Column) -> Column:
    """A statistic in its unit: ticks as a duration, tenths, centimetres as kilometres, or a count."""
    minutes = F.floor(value / 1200)
    return (
        F.when(unit == "ticks", duration(minutes)).when(unit == "tenths", F.format_number(value / 10, 1))
        .when(unit == "centimeters", F.concat(F.format_number(value / 100_000, 2), F.lit(" km"))).otherwise(F.format_number(value, 0))
    )


def activity_level(minutes: Column) -> Column:
    """0 to 4 for a day of the heat map; days that are missing count as 0. Borders are fixed values."""
    return F.when(F.coalesce(minutes, F.lit(0)) == 0, 0).when(minutes < 45, 1).when(minutes < 100, 2).when(minutes < 180, 3).otherwise(4)


def seam_intensity(minutes: Column) -> Column:
    """1 to 4 for a month that was observed, a step for each 3,000 minutes; 0 for a missing one."""
    return F.when(minutes.isNull(), 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(minutes / 3000)))).cast("int")


def accent(identifier: Column) -> Column:
    """One of four colours that depends on the identifier alone."""
    first = F.conv(F.substring(F.sha2(identifier, 256), 1, 2), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(c) for c in ("moss", "copper", "quartz", "slate")]), first % 4)
