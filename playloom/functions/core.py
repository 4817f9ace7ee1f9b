"""Column helpers shared by the archive's operators: scores, bounds, local dates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: A session longer than this is implausible (31 days).
LONGEST_S = 2_678_400
#: Score an implausible session keeps at most.
CAPPED_SCORE = 54
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; a text of ASCII alone, which most are, without the slower replacement by letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def not_blank(text: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def label(score: Column) -> Column:
    return F.when(score >= 80, "verified").when(score >= 55, "high").when(score >= 30, "partial").otherwise("unknown")


def label_rank(name: Column) -> Column:
    """Order of labels, weakest first."""
    return F.when(name == "verified", 3).when(name == "high", 2).when(name == "partial", 1).otherwise(0)


def label_of_rank(rank: Column) -> Column:
    return F.when(rank == 3, "verified").when(rank == 2, "high").when(rank == 1, "partial").otherwise("unknown")


def implausible(start: Column, end: Column, seconds: Column, needs_duration: bool = False) -> Column:
    """Bounds that cannot be right. With ``needs_duration`` nothing is tested where the duration is unknown."""
    elapsed = end - start
    wrong = (
        F.coalesce(seconds > LONGEST_S, F.lit(False))
        | F.coalesce(elapsed < 0, F.lit(False))
        | F.coalesce(elapsed > LONGEST_S * 1000, F.lit(False))
        | F.coalesce(F.abs(elapsed - seconds * 1000) >= 1000, F.lit(False))
    )
    return wrong & seconds.isNotNull() if needs_duration else wrong


def local_date(ms: Column, offset_minutes: Column) -> Column:
    """Calendar date of an instant at a fixed offset (null: UTC), free of session time zones."""
    days = F.floor((ms + F.coalesce(offset_minutes, F.lit(0)) * 60_000) / DAY_MS).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def version_class(version: Column) -> Column:
    return F.when(version.rlike(r"^[0-9]+(\.[0-9]+){1,2}$"), "release").when(version.rlike(r"^[0-9]{2}w[0-9]{2}[a-z]+$"), "snapshot").otherwise("other")


def canonical_server(address: Column) -> Column:
    """Trimmed, ASCII lower case; without the default port and the host's trailing dots; bare IPv6 stays."""
    text = ascii_lower(F.trim(address))
    bracketed = F.regexp_replace(text, r"^(\[[^\]]*\]):25565$", "$1")
    host, port = F.regexp_replace(F.regexp_extract(text, r"^([^:]*)", 1), r"\.+$", ""), F.regexp_extract(text, r"^[^:]*:(.*)$", 1)
    plain = F.when(port.isin("", "25565"), host).otherwise(F.concat(host, F.lit(":"), port))
    return F.when(text.startswith("["), bracketed).when(F.regexp_count(text, F.lit(":")) > 1, text).otherwise(plain)


def utc_label(offset_minutes: Column) -> Column:
    size = F.abs(offset_minutes)
    sign = F.when(offset_minutes < 0, "-").otherwise("+")
    return F.when(offset_minutes.isNotNull(), F.concat(F.lit("UTC"), sign, F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0")))
