"""From log lines to typed, time-anchored events, as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.functions.core import DAY_MS, ascii_lower

#: A clock that goes back further than this has passed midnight.
ROLLOVER_MS = 12 * 3_600_000
#: Limits of one source; beyond them it counts as failed.
MAX_LINE_BYTES, MAX_LINES, MAX_EVENTS, MAX_DECODED_BYTES = 512 * 1024, 5_000_000, 250_000, 256 << 20


def prefix(line: Column) -> Column:
    """Text between a leading bracket and the first closing one, null without."""
    return F.when(line.startswith("[") & line.contains("]"), F.substring_index(F.substr(line, F.lit(2)), "]", 1))


def body(line: Column) -> Column:
    """The message: after the last ``]: ``, else after the first ``]``, else the whole line; trimmed."""
    plain = F.regexp_extract(line, r"(?s)^[^\]]*\](.*)$", 1)
    text = F.when(line.contains("]: "), F.substring_index(line, "]: ", -1)).when(line.contains("]"), plain).otherwise(line)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _millis(stamp: Column) -> Column:
    """Milliseconds behind the first stop, 0 without."""
    digits = F.when(stamp.contains("."), F.rpad(F.regexp_extract(stamp, r"\.([0-9]{1,3})", 1), 3, "0").try_cast("long"))
    return F.coalesce(digits, F.lit(0).cast("long"))


def _clock(stamp: Column, at: int) -> Column:
    """Milliseconds of the ``HH:mm:ss`` at a position of a stamp that was tested before."""
    hours, minutes, seconds = (F.substring(stamp, at + k, 2).try_cast("long") for k in (0, 3, 6))
    return (hours * 3600 + minutes * 60 + seconds) * 1000


#: A time of day that exists, and what may follow it.
_TIME = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"


def full_local_ms(stamp: Column) -> Column:
    """A date and time without zone as milliseconds; null if it is not one."""
    day = F.unix_date(F.substring(stamp, 1, 10).try_cast("date")).cast("long")
    named = F.try_to_timestamp(F.regexp_replace(stamp, r"\.[0-9]+$", ""), F.lit("ddMMMyyyy HH:mm:ss"))
    parsed = F.coalesce(
        F.when(stamp.rlike(rf"^(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T]{_TIME}\z"), day * DAY_MS + _clock(stamp, 12)),
        F.when(stamp.rlike(r"^[0-9]{2}[A-Za-z]{3}[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"), _seconds(named) * 1000),
    )
    return parsed + _millis(stamp)


def _seconds(stamp: Column) -> Column:
    """Clock seconds of a parsed stamp, whatever the session's time zone."""
    return F.datediff(F.to_date(stamp), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)


def clock_ms(stamp: Column) -> Column:
    """A time of day as milliseconds; null if it is not one."""
    return F.when(stamp.rlike(f"^{_TIME}$"), _clock(stamp, 1) + _millis(stamp))


def _token(text: Column, marker: str) -> Column:
    """First word after a marker, without brackets, quotes and stops around it; null if nothing is left."""
    word = F.regexp_extract(text, rf"(?i){marker}\s*(\S+)", 1)
    return F.nullif(F.regexp_replace(word, r"""^[,;:'"()\[\]]+|[,;:'"()\[\]]+$""", ""), F.lit(""))


def server_address(text: Column) -> Column:
    """host:port or host after ``connecting to``; null if there is none."""
    rest = F.regexp_replace(F.regexp_extract(text, r"(?i)connecting to (.*)$", 1), r"(?i) with .*$", "")
    rest = F.regexp_replace(F.trim(rest), r"[.;]+$", "")
    host, port = F.trim(F.regexp_extract(rest, r"^([^,]*),", 1)), F.trim(F.regexp_extract(rest, r"^[^,]*,(.*)$", 1))
    pair = (host != "") & port.rlike("^[0-9]+$")
    first = F.regexp_replace(F.regexp_extract(rest, r"^\s*([^\s,]+)", 1), "[\"']", "")
    return F.nullif(F.when(pair, F.concat(host, F.lit(":"), port)).otherwise(first), F.lit(""))


def quoted(text: Column, marker: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, rf"""(?i){marker}\s*(["'])(.*?)\1""", 2)), F.lit(""))


def _details(text: Column, low: Column) -> dict[str, Column]:
    """What the rules take from a text; looked for only where the text holds the marker."""
    has = lambda s: low.contains(s)
    return {
        "loading": F.when(has("loading minecraft "), _token(text, "loading minecraft ")),
        "starting": F.when(has("starting minecraft client version "), _token(text, "starting minecraft client version ")),
        "target": F.when(has("for minecraft ") & has("forge mod loader version"), _token(text, "for minecraft ")),
        "plain": F.when(has("minecraft version: "), _token(text, "minecraft version: ")),
        "address": F.when(has("connecting to "), server_address(text)),
        "level": F.when(has("preparing level "), quoted(text, "preparing level ")),
        "integrated": F.when(has("starting integrated minecraft server") & has("version "), _token(text, "version ")),
        "gone": F.when(has("stopping integrated server"), "integrated").when(has("disconnected from server"), "remote")
        .when(has("network disconnect") | has("client disconnected with reason"), "network"),
    }


def _rules(low: Column, whole: Column, of: dict[str, Column]) -> list[tuple]:
    """(test, kind, score, detail) of each event a line may hold, in fixed order. Text rules are fixed values of the log format."""
    has = lambda s: low.contains(s)
    first = F.when(of["loading"].isNotNull(), 1).when(of["starting"].isNotNull(), 2).when(of["target"].isNotNull(), 3).when(of["plain"].isNotNull(), 4).otherwise(0)
    later = F.when(low.startswith("setting user:"), 82).when(low.startswith("lwjgl version:") | low.startswith("backend library: lwjgl version"), 72)
    start = F.when(first == 1, 94).when(first == 2, 96).when(first == 3, 91).otherwise(later)
    version = F.coalesce(of["loading"], of["starting"], of["target"], of["plain"])
    version_score = F.when(first == 1, 98).when(first == 2, 99).otherwise(96)
    dimension = of["level"].isNull() & has("preparing start region for dimension")
    stopping = (low == "stopping!") | low.startswith("stopping minecraft")
    shutdown = low.startswith("stopping worker threads") | low.startswith("soundsystem shutting down") | low.startswith("sound engine shut down") | (low == "shutdown complete")
    crash = F.when(whole.contains("---- minecraft crash report ----") | has("this crash report has been saved to:"), 100).when(has("unreported exception thrown"), 98)
    crash = crash.when(whole.contains("/fatal]") | has("minecraft has crashed") | has("the game crashed whilst"), 96)

    return [
        (start.isNotNull(), "start", start), (version.isNotNull(), "version", version_score, version), (of["address"].isNotNull(), "server", 95, of["address"]),
        (has("starting integrated minecraft server"), "integrated", 96, of["integrated"]), (of["level"].isNotNull(), "world", 94, of["level"]), (dimension, "world", 80),
        (of["gone"].isNotNull(), "disconnected", F.when(of["gone"] == "network", 88).otherwise(92), of["gone"]), (stopping, "stopping", 96), (shutdown, "clean_shutdown", 94),
        (crash.isNotNull(), "crash", crash),
    ]


def _event(test: Column, order: Column | None, kind: str, score, detail: Column | None = None) -> Column:
    detail = F.lit(None).cast("string") if detail is None else detail
    score = F.lit(score) if isinstance(score, int) else score
    place = [] if order is None else [order.alias("event_order")]
    return F.when(test, F.struct(*place, F.lit(kind).alias("kind"), detail.alias("detail"), score.cast("int").alias("score")))


def events_of(text: Column, line: Column) -> Column:
    """Events of one line in fixed order: array<struct<kind,detail,score>>. For many lines, ``log_events`` costs far less."""
    low = ascii_lower(text)
    return F.array_compact(F.array(*[_event(test, None, *rule) for test, *rule in _rules(low, ascii_lower(line), _details(text, low))]))


def _with_tests(rows: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """Rows of lines with what the rules look at, and the rules. Each text is made once a line, as a column of its own:
    within one expression it would be made again for every use."""
    rows = rows.withColumn("said_body", body(F.col("value"))).withColumn("said_whole", ascii_lower(F.col("value")))
    rows = rows.withColumn("said_low", ascii_lower(F.col("said_body")))
    details = _details(F.col("said_body"), F.col("said_low"))
    rows = rows.withColumns({f"said_{name}": detail for name, detail in details.items()})
    return rows, _rules(F.col("said_low"), F.col("said_whole"), {name: F.col(f"said_{name}") for name in details})


def _count(tests: list[Column]) -> Column:
    return sum((F.coalesce(test, F.lit(False)).cast("int") for test in tests), F.lit(0))


def timed_lines(lines: DataFrame) -> DataFrame:
    """Lines with local_ms (null without a time), rolled over midnight from the source's date or the last full stamp.

    A full stamp starts a new run; within a run the day goes on where the clock
    falls back by more than twelve hours. Windows run per source.
    """
    stamp = F.col("stamp")
    rows = lines.withColumn("stamp", prefix(F.col("value"))).withColumn("full_ms", full_local_ms(stamp)).withColumn("clock", F.coalesce(F.pmod(F.col("full_ms"), F.lit(DAY_MS)), clock_ms(stamp)))
    rows = rows.withColumn("bad_stamp", stamp.rlike("^[0-9]") & F.col("clock").isNull()).drop("stamp")
    order = Window.partitionBy("source_id").orderBy("line_number")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("clock", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.sum(F.col("full_ms").isNotNull().cast("int")).over(upto)).withColumn("before", before)
    behind = F.col("before") - F.col("clock")
    seconds_behind = F.floor(behind / 1000)
    rows = rows.withColumn("rolled", F.coalesce(F.col("full_ms").isNull() & (seconds_behind * 1000 > ROLLOVER_MS), F.lit(False)))
    own = Window.partitionBy("source_id", "run").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("day_index", F.sum(F.col("rolled").cast("int")).over(own))
    day = F.first(F.floor(F.col("full_ms") / DAY_MS), ignorenulls=True).over(own)
    base = F.coalesce(day, F.datediff("date_hint", F.lit("1970-01-01")).cast("long"))
    rows = rows.withColumn("local_ms", (base + F.col("day_index")) * DAY_MS + F.col("clock")).withColumn("anchored", base.isNotNull())
    same_day = F.col("full_ms").isNull() | (F.floor(F.col("full_ms") / DAY_MS) == F.lag(base + F.col("day_index")).over(order))
    rows = rows.withColumn("fell_back", F.coalesce((behind > 0) & ~F.col("rolled") & same_day, F.lit(False)))
    sequence = F.coalesce(F.col("local_ms"), F.when(~F.col("anchored"), F.col("day_index") * DAY_MS + F.col("clock")))
    origin = F.when(F.col("full_ms").isNotNull(), "line_datetime").when(F.col("clock").isNull(), "missing").when(F.col("date_hint").isNotNull(), "line_time_with_date_hint")
    origin = origin.when(F.col("anchored"), "line_datetime").otherwise("line_time_only")
    return rows.withColumn("sequence_ms", sequence).withColumn("origin", origin).drop("before", "run")


def anchor_final_day(timed: DataFrame, final_ms: str) -> DataFrame:
    """Anchors undated sources to the day of their end (column ``final_ms``): their last day index falls on it,
    or on the day before if the last clock leads the end's clock by more than twelve hours."""
    source = Window.partitionBy("source_id")
    last_index = F.max(F.when(~F.col("anchored"), F.col("day_index"))).over(source)
    last_clock = F.max_by("clock", F.when(~F.col("anchored") & F.col("clock").isNotNull(), F.col("line_number"))).over(source)
    final_day = F.floor(F.col(final_ms) / DAY_MS) - (last_clock - F.pmod(F.col(final_ms), F.lit(DAY_MS)) > ROLLOVER_MS).cast("long")
    anchored = (final_day - last_index + F.col("day_index")) * DAY_MS + F.col("clock")
    rows = timed.withColumn("anchored_ms", F.when(F.col("anchored"), F.col("local_ms")).otherwise(anchored))
    return rows.drop("local_ms").withColumnRenamed("anchored_ms", "local_ms")


def log_events(lines: DataFrame) -> DataFrame:
    """One row per event with its place and time."""
    timed = timed_lines(lines)
    keep = [c for c in ("instance_id", "source_id", "source_order", "line_number", "local_ms", "sequence_ms", "origin") if c in timed.columns]
    rows, rules = _with_tests(timed.select(*keep, "value"))
    tests = [f"said_test{k}" for k in range(len(rules))]
    rows = rows.withColumns({name: F.coalesce(test, F.lit(False)) for name, (test, *_) in zip(tests, rules)})

    orders = [_count([F.col(name) for name in tests[:k]]) for k in range(len(tests))]
    said = rows.select(*keep, *[_event(F.col(tests[k]), orders[k], *rule).alias(f"event{k}") for k, (_, *rule) in enumerate(rules)])
    # One event of each rule, null where the rule says nothing: the array needs no function that runs interpreted.
    found = said.select(*keep, F.explode(F.array(*[f"event{k}" for k in range(len(rules))])).alias("event")).filter("event is not null")
    return found.select(*keep, "event.event_order", "event.kind", "event.detail", "event.score")


def diagnostics(lines: DataFrame) -> DataFrame:
    """Counters per source, whether it deserves a warning, and whether it breaks a limit."""
    timed = timed_lines(lines)
    # Lines of files come with what was wrong with their bytes.
    malformed = F.col("malformed") if "malformed" in lines.columns else ~F.is_valid_utf8("value")
    timed, rules = _with_tests(timed)
    rows = timed.select(
        "source_id", "bad_stamp", "rolled", "fell_back", "clock", _count([test for test, *_ in rules]).alias("n"),
        malformed.alias("malformed"), F.octet_length("value").alias("bytes"),
    )
    per = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("n").alias("events"), F.count_if("bad_stamp").alias("unparsed"), F.count_if("rolled").alias("rollovers"),
        F.count_if("fell_back").alias("non_monotonic"), F.count_if(F.col("clock").isNull()).alias("untimed"), F.count_if("malformed").alias("malformed"), F.max("bytes").alias("longest_line"),
        F.sum(F.col("bytes") + 1).alias("decoded"),
    )
    over = (F.col("longest_line") > MAX_LINE_BYTES) | (F.col("lines") > MAX_LINES) | (F.col("events") > MAX_EVENTS) | (F.col("decoded") > MAX_DECODED_BYTES)
    return per.withColumn("warns", (F.col("malformed") + F.col("unparsed") + F.col("non_monotonic") + F.col("untimed")) > 0).withColumn("failed", over).drop("decoded")
