"""Dashboard reads: totals, de-overlapped time, calendars, coverage and top contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.functions.core import DAY_MS, ascii_lower, label, label_of_rank, label_rank, local_date, not_blank
from playloom.functions.formats import activity_level, month_name, seam_intensity
from playloom.operators.prefix import running_sums
from playloom.operators.visible import runs, visible
from playloom.shared import materialize
from playloom.sources.archive import Archive

#: A day counts as active from so many seconds.
ACTIVE_S = 60
#: Days and months of the calendars.
DAYS, MONTHS = 365, 12


def visible_count(archive: Archive) -> DataFrame:
    return visible(archive).agg(F.count(F.lit(1)).alias("visible_sessions"))


def totals(archive: Archive) -> DataFrame:
    """Sums over sessions of known length; longest and average are null when there is none."""
    known = F.col("run_s").isNotNull()
    return runs(archive).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(known).alias("known_sessions"), F.coalesce(F.sum("run_s"), F.lit(0)).alias("total_seconds"),
        F.max("run_s").alias("longest_seconds"), F.expr("try_divide(sum(run_s), count(run_s))").cast("long").alias("average_seconds"),
    )


def unique_runtime(archive: Archive) -> DataFrame:
    """Seconds covered by at least one session: the true union of all intervals.

    Begins and ends are added up by moment; running sums in two levels tell how many sessions are open after each. Where that
    number leaves zero the union begins, where it comes back to zero it ends. No window holds more than a range of moments.
    """
    spans = runs(archive).filter("run_s is not null and run_end > start_ms")
    ends = F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("change")), F.struct(F.col("run_end").alias("at"), F.lit(-1).alias("change")))
    moments = spans.select(F.inline(ends)).groupBy("at").agg(F.sum("change").alias("change")).filter("change <> 0")
    open_ = running_sums(moments, "at", {"open": "change"})
    border = F.when((F.col("open") > 0) & (F.col("open") == F.col("change")), -F.col("at")).when(F.col("open") == 0, F.col("at"))
    return open_.agg(F.floor(F.coalesce(F.sum(border), F.lit(0)) / 1000).alias("unique_seconds"))


def day_slices(archive: Archive) -> DataFrame:
    """Seconds of each session on each local day; a session of no or unknown length has one row of 0 seconds."""
    offset = F.coalesce("offset_min", F.lit(0)) * 60_000
    length = F.greatest(F.coalesce("run_s", F.lit(0)), F.lit(0)) * 1000  # a session ends its length after its start
    rows = runs(archive).withColumn("a", F.col("start_ms") + offset).withColumn("b", F.col("a") + length)
    first, last = F.floor(F.col("a") / DAY_MS), F.floor(F.when(F.col("b") > F.col("a"), F.col("b") - 1).otherwise(F.col("a")) / DAY_MS)
    cut = rows.select("session_id", "run_score", "a", "b", F.explode(F.sequence(first, last)).alias("n"))
    ms = F.least("b", (F.col("n") + 1) * DAY_MS) - F.greatest("a", F.col("n") * DAY_MS)
    return cut.select(
        "session_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("n").cast("int")).alias("day"), F.floor(ms / 1000).alias("day_seconds"), label(F.col("run_score")).alias("day_label")
    )


def active_days(archive: Archive) -> DataFrame:
    days = day_slices(archive).groupBy("day").agg(F.sum("day_seconds").alias("s"))
    return days.agg(F.count_if(F.col("s") >= ACTIVE_S).alias("active_days"), F.count(F.lit(1)).alias("observed_days"))


def _last_day(archive: Archive) -> DataFrame:
    """Local day of the last observation, one row."""
    seen = F.coalesce("run_end", "start_ms")
    return runs(archive).agg(F.max_by(local_date(seen, F.col("offset_min")), F.struct(seen, -F.col("session_id"))).alias("last_day"))


def daily_activity(archive: Archive, today: Column | None = None) -> DataFrame:
    """The 365 days up to the last observation, or up to ``today`` where there is none; days without one are marked as missing."""
    days = day_slices(archive).groupBy("day").agg(
        (F.floor(F.sum("day_seconds") / 60)).alias("minutes"), F.count(F.lit(1)).alias("sessions"), F.min(label_rank(F.col("day_label"))).alias("rank")
    )
    last = F.coalesce("last_day", F.current_date() if today is None else today)
    calendar = _last_day(archive).select(F.explode(F.sequence(F.date_sub(last, DAYS - 1), last)).alias("day"))
    return calendar.join(days, "day", "left").select("day", "minutes", "sessions", F.when(F.col("minutes").isNotNull(), label_of_rank(F.col("rank"))).otherwise("missing").alias("day_label"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_text(month: Column) -> Column:
    return F.concat((month / 12).cast("int").cast("string"), F.lit("-"), F.lpad((month % 12 + 1).cast("int").cast("string"), 2, "0"))


def monthly_activity(archive: Archive) -> DataFrame:
    """Up to 12 months, none before the first one observed; minutes, distinct sessions, estimated share and weakest label."""
    slices = day_slices(archive).withColumn("month", _month(F.col("day")))
    estimated = F.sum(F.when(F.col("day_label") != "verified", F.col("day_seconds")).otherwise(0))
    months = slices.groupBy("month").agg(
        F.floor(F.sum("day_seconds") / 60).alias("minutes"), F.countDistinct("session_id").alias("sessions"),
        F.coalesce(F.expr("try_divide(sum(case when day_label <> 'verified' then day_seconds else 0 end), sum(day_seconds))"), F.lit(0.0)).alias("share"),
        F.min(label_rank(F.col("day_label"))).alias("rank"), estimated.alias("estimated_seconds"),
    )
    bounds = slices.agg(F.min("month").alias("first")).crossJoin(_last_day(archive)).filter("last_day is not null")  # one row each
    calendar = bounds.select(F.explode(F.sequence(F.greatest("first", _month(F.col("last_day")) - (MONTHS - 1)), _month(F.col("last_day")))).alias("month"))
    return calendar.join(months, "month", "left").select(
        month_text(F.col("month")).alias("month"), "minutes", "sessions", F.round("share", 6).alias("estimated_share"),
        F.when(F.col("minutes").isNotNull(), label_of_rank(F.col("rank"))).otherwise("missing").alias("month_label"),
    )


def observed_months(archive: Archive) -> DataFrame:
    return day_slices(archive).agg(F.countDistinct(_month(F.col("day"))).alias("observed_months"))


def coverage(archive: Archive) -> DataFrame:
    """First and last observation, gap months, shares and the coverage score."""
    seen = F.coalesce("run_end", "start_ms")
    one = runs(archive).agg(
        F.min("start_ms").alias("first_ms"), F.max(seen).alias("last_ms"), F.min_by("local_day", F.struct("start_ms", "session_id")).alias("first_day"),
        F.max_by(local_date(seen, F.col("offset_min")), F.struct(seen, -F.col("session_id"))).alias("last_day"),
        F.avg((label(F.col("run_score")) == "verified").cast("double")).alias("v"), F.avg((F.col("run_s").isNotNull() & F.col("run_end").isNotNull()).cast("double")).alias("b"),
    )
    score = F.least(F.lit(79), F.round(F.col("v") * 62 + F.col("b") * 38)).cast("int")
    joined = one.crossJoin(observed_months(archive))  # one row each
    span = _month(F.col("last_day")) - _month(F.col("first_day")) + 1
    return joined.select(
        "first_ms", "last_ms", "observed_months", F.greatest(F.lit(0), span - F.col("observed_months")).cast("long").alias("gap_months"),
        F.round("v", 6).alias("verified_share"), F.round("b", 6).alias("bounded_share"), score.alias("coverage_score"),
        F.when(score >= 55, "partial").when(score >= 20, "limited").otherwise("unknown").alias("quality"),
    )


def top_metrics(archive: Archive) -> DataFrame:
    """The context with the most runtime in each of five categories."""
    base = runs(archive).select("session_id", "launcher", "instance_name", "version", F.coalesce("run_s", F.lit(0)).alias("s"))
    parts = [
        base.select(F.lit(kind).alias("category"), F.coalesce(not_blank(F.col(column)), F.lit("Unknown")).alias("name"), "s")
        for kind, column in (("launcher", "launcher"), ("instance", "instance_name"), ("version", "version"))
    ]
    named = archive.segments.join(archive.servers, "server_id", "left").select(
        "session_id", "kind", F.when(F.col("kind") == "server", F.coalesce(not_blank(F.col("display_name")), F.col("address"))).when(F.col("kind") == "world", not_blank(F.col("world"))).alias("name")
    )
    contexts = named.filter("name is not null").distinct().join(base.select("session_id", "s"), "session_id")
    parts.append(contexts.select(F.col("kind").alias("category"), "name", "s"))
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.unionByName(p)
    sums = sums.groupBy("category", "name").agg(F.sum("s").alias("seconds"))
    order = Window.partitionBy("category").orderBy(F.col("seconds").desc(), F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "name")
    best = sums.withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    return best.select("category", "name", F.floor(F.col("seconds") / 60).alias("minutes"))


def month_average(archive: Archive) -> DataFrame:
    months = monthly_activity(archive).filter("month_label <> 'missing'")
    return months.agg(F.round(F.avg("minutes"), 6).alias("average_minutes"), F.max("minutes").alias("largest_minutes"), F.count(F.lit(1)).alias("months"))


def heatmap_stats(archive: Archive) -> DataFrame:
    """Active, missing and zero days of the calendar, and the first day with the most minutes."""
    return daily_activity(archive).agg(
        F.count_if(F.coalesce(F.col("minutes"), F.lit(0)) > 0).alias("active"), F.count_if(F.col("minutes").isNull()).alias("missing"),
        F.count_if(F.col("minutes") == 0).alias("zero"), F.max_by("day", F.struct(F.coalesce("minutes", F.lit(-1)), -F.datediff("day", F.lit("1970-01-01")))).alias("peak_day"),
    )


def recent(archive: Archive, n: int = 24) -> DataFrame:
    """The newest sessions: a top-k report."""
    return runs(archive).orderBy(F.col("start_ms").desc(), "session_id").limit(n).select("session_id", "instance_name", "start_ms", "run_s", label(F.col("run_score")).alias("label"))


def session_page(archive: Archive, size: int = 500, after: tuple[int, int] | None = None) -> DataFrame:
    """One page, newest first, after the cursor (start_ms, session_id); the number of all visible sessions comes with it."""
    rows = visible(archive)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    if after:
        rows = rows.filter((F.col("start_ms") < after[0]) | ((F.col("start_ms") == after[0]) & (F.col("session_id") > after[1])))
    page = rows.orderBy(F.col("start_ms").desc(), "session_id").limit(size).select("session_id", "start_ms", "exit_kind", "label")
    return page.crossJoin(total).withColumn("truncated", F.col("total") > size)  # total is one row


def session_contexts(archive: Archive, size: int = 500, after: tuple[int, int] | None = None) -> DataFrame:
    """A page of sessions, newest first, each with its kind, destination and the contexts of its segments in order.

    The page comes first; its keys, at most ``size``, are then the filter of the segments, so that their scan reads what the page needs.
    ``servers`` and ``worlds`` are distinct names by letters without case. A session with several segments at servers or worlds
    has the destination ``SEVERAL``, one without any an empty one.
    """
    rows = visible(archive)
    if after:
        rows = rows.filter((F.col("start_ms") < after[0]) | ((F.col("start_ms") == after[0]) & (F.col("session_id") > after[1])))
    page = materialize(rows.orderBy(F.col("start_ms").desc(), "session_id").limit(size).select("session_id", "start_ms", "instance_name", "version"), "page")
    keys = [r["session_id"] for r in page.select("session_id").collect()]
    own = archive.segments.filter(F.col("session_id").isin(keys)).join(archive.servers, "server_id", "left")
    place = F.when(F.col("kind") == "server", F.coalesce("display_name", "address")).when(F.col("kind") == "world", F.col("world"))
    own = own.select("session_id", "kind", place.alias("name"))
    going = F.col("kind").isin("server", "world")

    def names(kind: str) -> Column:
        named = F.when((F.col("kind") == kind) & (F.trim("name") != ""), F.struct(ascii_lower(F.col("name")).alias("low"), F.col("name").alias("name")))
        return F.transform(F.array_sort(F.collect_set(named)), lambda x: x["name"])

    per = own.groupBy("session_id").agg(
        F.when(F.countDistinct("kind") > 1, "mixed").otherwise(F.min("kind")).alias("kind"), names("server").alias("servers"), names("world").alias("worlds"),
        F.when(F.count_if(going) > 1, SEVERAL).otherwise(F.max(F.when(going, F.col("name")))).alias("destination"),
    )
    none = F.array().cast("array<string>")
    return page.join(per, "session_id", "left").select(
        *page.columns, F.coalesce("kind", F.lit("menu")).alias("kind"), F.coalesce("destination", F.lit("")).alias("destination"),
        F.coalesce("servers", none).alias("servers"), F.coalesce("worlds", none).alias("worlds"),
    )


#: Shown for a session with several destinations (fixed value).
SEVERAL = "Multiple observed destinations"


def context_shares(archive: Archive) -> DataFrame:
    """The top contexts with their percentage of all known minutes, one decimal."""
    minutes = totals(archive).select(F.floor(F.col("total_seconds") / 60).alias("all_minutes"))  # one row
    share = F.round(100.0 * F.col("minutes") / F.greatest("all_minutes", F.lit(1)), 1)
    return top_metrics(archive).crossJoin(minutes).withColumn("percent", share).drop("all_minutes")


def heat_levels(archive: Archive) -> DataFrame:
    """The days of the calendar with the level they are painted in."""
    return daily_activity(archive).select("day", "day_label", activity_level(F.col("minutes")).alias("level"))


def month_seam(archive: Archive) -> DataFrame:
    """The months with name and intensity."""
    return monthly_activity(archive).select("month", month_name(F.col("month")).alias("name"), seam_intensity(F.col("minutes")).alias("intensity"))
