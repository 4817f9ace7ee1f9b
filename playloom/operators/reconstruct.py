"""Sessions from ordered events: one fold with three kinds of output, shared by batch and streaming.

A timed crash or clean shutdown always leaves no session open, so an instance's
events are cut there: each piece is folded on its own and a busy instance
spreads over tasks. Pieces are numbered by prefix sums in two levels (over the
sources of an instance, and within each source), so that no window holds a whole
instance. A task folds its pieces as one sorted stream and gives sessions, the
events that each session rests on with their roles, and counters of what was odd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from playloom.functions.core import LONGEST_S, label, utc_label
from playloom.shared import materialize

MERGE_S, TAIL_S = 120, 900
#: Score of an end and the most a session with it can have.
ENDS = {"clean_shutdown": (20, 100), "client_stopping": (16, 100), "crash": (18, 100), "source_end_hint": (5, 69), "next_start": (0, 54), "truncated": (-4, 54)}
EXITS = {"clean_shutdown": "clean", "client_stopping": "clean", "crash": "crash"}
SESSION = (
    "start_ms long, end_ms long, seconds long, start_kind string, end_kind string, exit_kind string, score int, "
    "versions array<string>, destinations array<string>, sources array<string>"
)
#: An event that a session rests on; the session is named by the event that began it.
LINK = (
    "start_source string, start_line long, start_event int, role string, kind string, score int, "
    "source_id string, line_number long, event_order int"
)
COUNTS = ("orphan_ends", "orphan_activity", "untimed_starts", "non_monotonic", "zero_length")
ORDER = ["source_order", "source_id", "line_number", "event_order"]
#: Shown for a world without a name.
UNNAMED = "world:"


def session_score(explicit: bool, end: str, versions: bool, destinations: bool, seconds: int) -> int:
    bonus, most = ENDS[end]
    score = (72 if explicit else 52) + bonus + 4 * versions + 4 * destinations - 20 * (seconds == 0)
    return max(0, min(score, most, 100 if explicit else 79, 100 if seconds else 54))


def score_column(explicit, end, versions, destinations, seconds):
    """The same score as a column expression."""
    bonus, most = F.lit(0), F.lit(100)
    for name, (b, m) in ENDS.items():
        bonus, most = F.when(end == name, b).otherwise(bonus), F.when(end == name, m).otherwise(most)
    score = F.when(explicit, 72).otherwise(52) + bonus + 4 * versions.cast("int") + 4 * destinations.cast("int") - F.when(seconds == 0, 20).otherwise(0)
    return F.greatest(F.lit(0), F.least(score, most, F.when(explicit, 100).otherwise(79), F.when(seconds == 0, 54).otherwise(100))).cast("int")


@dataclass
class Open:
    """The session that is open now. ``links`` are (role, kind, score, source, line, event) of its events, in order."""

    start_ms: int
    explicit: bool
    source: str
    last_ms: int
    hint_ms: int | None = None
    stop_ms: int | None = None
    versions: list = field(default_factory=list)
    destinations: list = field(default_factory=list)
    links: list = field(default_factory=list)

    def hint(self, at: int | None) -> None:
        if at is not None and (self.hint_ms is None or at > self.hint_ms):
            self.hint_ms = at

    def visit(self, place: str) -> None:
        named = any(d.startswith(UNNAMED) and d != UNNAMED for d in self.destinations)
        if place == UNNAMED and named:
            return
        if place.startswith(UNNAMED) and place != UNNAMED and not named:
            self.destinations = [d for d in self.destinations if d != UNNAMED]
        if place not in self.destinations:
            self.destinations.append(place)


class Fold:
    """Takes events in order and closes sessions.

    ``done`` holds closed sessions, ``linked`` the events of each of them, ``counts`` what was odd.
    """

    def __init__(self, state: dict | None = None):
        self.now = Open(**state) if state else None
        self.done: list[dict] = []
        self.linked: list[list] = []
        self.counts = dict.fromkeys(COUNTS, 0)

    def state(self) -> dict | None:
        return asdict(self.now) if self.now else None

    def _see(self, at: int | None) -> None:
        if at is not None:
            if at >= self.now.last_ms:
                self.now.last_ms = at
            else:
                self.counts["non_monotonic"] += 1

    def close(self, at: int, end: str) -> None:
        s, self.now = self.now, None
        if at < s.start_ms:
            at = s.last_ms
            self.counts["non_monotonic"] += 1
        seconds = max(0, at - s.start_ms) // 1000
        self.counts["zero_length"] += seconds == 0
        score = session_score(s.explicit, end, bool(s.versions), bool(s.destinations), seconds)
        self.done.append({
            "start_ms": s.start_ms, "end_ms": at, "seconds": seconds, "start_kind": "explicit" if s.explicit else "inferred", "end_kind": end,
            "exit_kind": EXITS.get(end, "unknown"), "score": score, "versions": s.versions, "destinations": s.destinations,
            "sources": sorted({link[3] for link in s.links}),
        })
        self.linked.append(s.links)

    def take(self, kind: str, detail: str | None, at: int | None, source: str, hint: int | None, line: int = 0, order: int = 0, score: int = 0) -> None:
        event = (kind, score, source, line, order)
        if kind == "start":
            self._start(at, source, hint, event)
        elif kind in ("server", "integrated", "world"):
            self._activity(kind, detail, at, source, hint, event)
        elif self.now is None:
            self.counts["orphan_ends"] += kind != "version"
        elif kind in ("clean_shutdown", "crash"):
            if at is not None:
                self._link(event, "end", "exit")
                self._see(at)
                self.close(at, kind)
        else:
            if kind == "version":
                self._version(detail)
            self._link(event, *{"version": ("version",), "stopping": ("end", "exit")}.get(kind, ("supporting",)))
            self._see(at)
            self.now.hint(hint)
            if kind == "stopping" and at is not None and self.now.stop_ms is None:
                self.now.stop_ms = at

    def _link(self, event: tuple, *roles: str) -> None:
        for role in roles:
            link = [role, *event]
            if link not in self.now.links[-3:]:  # an event's links are neighbours
                self.now.links.append(link)

    def _version(self, version: str | None) -> None:
        if version not in self.now.versions:
            self.now.versions.append(version)

    def _begin(self, at: int, explicit: bool, source: str, hint: int | None, event: tuple) -> None:
        self.now = Open(at, explicit, source, at, hint)
        self._link(event, "start")

    def _start(self, at: int | None, source: str, hint: int | None, event: tuple) -> None:
        s = self.now
        if at is None:
            self.counts["untimed_starts"] += 1
            if s:
                self._link(event, "supporting")
            return
        if s and s.stop_ms is None and s.source == source and 0 <= _seconds(at - s.start_ms) <= MERGE_S:
            self._link(event, "supporting")
            self._see(at)
            s.hint(hint)
            return
        if s:
            self.close(*((s.last_ms, "next_start") if s.stop_ms is None else (s.stop_ms, "client_stopping")))
        self._begin(at, True, source, hint, event)

    def _activity(self, kind: str, detail: str | None, at: int | None, source: str, hint: int | None, event: tuple) -> None:
        if self.now and self.now.stop_ms is not None:
            self.close(self.now.stop_ms, "client_stopping")
        if self.now is None:
            if at is None:
                self.counts["orphan_activity"] += 1
                return
            self._begin(at, False, source, hint, event)
        else:
            self.now.hint(hint)
        if kind == "integrated" and detail:
            self._version(detail)
            self._link(event, "version")
        self.now.visit(f"server:{detail}" if kind == "server" else UNNAMED + (detail or "" if kind == "world" else ""))
        self._link(event, "destination")
        self._see(at)

    def end(self) -> None:
        """No more events: the pending stop, a near enough source end, or a cut."""
        s = self.now
        if s is None:
            return
        if s.stop_ms is not None:
            self.close(s.stop_ms, "client_stopping")
        elif s.hint_ms is not None and 0 <= _seconds(s.hint_ms - s.last_ms) <= TAIL_S:
            self.close(s.hint_ms, "source_end_hint")
        else:
            self.close(s.last_ms, "truncated")


def _seconds(ms: int) -> int:
    """Whole seconds, cut towards zero."""
    return ms // 1000 if ms >= 0 else -(-ms // 1000)


def pieces(events: DataFrame) -> DataFrame:
    """Events with the number of the piece they are in: the timed closing events of the instance before them."""
    source = ["instance_id", "source_order", "source_id"]
    closes = (F.col("kind").isin("clean_shutdown", "crash") & F.col("local_ms").isNotNull()).cast("long")
    before = Window.partitionBy("instance_id").orderBy("source_order", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    per = events.groupBy(source).agg(F.sum(closes).alias("closes")).withColumn("pieces_before", F.coalesce(F.sum("closes").over(before), F.lit(0)))
    own = Window.partitionBy(source).orderBy("line_number", "event_order").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(closes).over(own), F.lit(0))
    return events.join(per.drop("closes"), source).withColumn("piece", F.col("pieces_before") + within).drop("pieces_before")


def folded(events: DataFrame) -> DataFrame:
    """instance_id, piece, session, links, counts: a row for each session, and one for each piece with counters."""
    cut = pieces(events)
    names = ["instance_id", "piece", "kind", "detail", "local_ms", "source_id", "hint_ms", "line_number", "event_order", "score"]
    if "score" not in events.columns:
        cut = cut.withColumn("score", F.lit(0))
    kind = events.schema["instance_id"].dataType.simpleString()
    counts = ", ".join(f"{c}: bigint" for c in COUNTS)
    as_struct = lambda fields: ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", "))
    out = f"instance_id {kind}, piece long, session struct<{as_struct(SESSION)}>, links array<struct<{as_struct(LINK)}>>, counts struct<{counts}>"
    schema = to_arrow_schema(StructType.fromDDL(out))
    link_names = [f.split()[0] for f in LINK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        key, fold = None, Fold()

        def finish() -> None:
            fold.end()
            for session, links in zip(fold.done, fold.linked):
                first = links[0][3:6]
                named = [dict(zip(link_names, (*first, *link))) for link in links]
                rows.append({"instance_id": key[0], "piece": key[1], "session": session, "links": named, "counts": None})
            if any(fold.counts.values()):
                rows.append({"instance_id": key[0], "piece": key[1], "session": None, "links": None, "counts": fold.counts})

        for batch in batches:
            for instance, piece, kind, detail, at, source, hint, line, order, score in zip(*(batch.column(n).to_pylist() for n in names)):
                if key != (instance, piece):
                    if key is not None:
                        finish()
                    key, fold = (instance, piece), Fold()
                fold.take(kind, detail, at, source, hint, line, order, score)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if key is not None:
            finish()
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    stream = cut.repartition("instance_id", "piece").sortWithinPartitions("instance_id", "piece", *ORDER).select(*names)
    return stream.mapInArrow(run, out)


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of each instance from events (instance_id, source_id, source_order, line_number, event_order, kind, detail, local_ms, hint_ms, score)."""
    events = materialize(events, "events")  # pieces are counted first, then joined to the events
    return folded(events).filter("session is not null").select("instance_id", "session.*")


def reconstructed(events: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, links, counters) of one fold over the events without copies.

    The fold is written once and split afterwards. Counters are per instance: repeated events, ends without a session,
    activity and starts without a time, times that fell back, sessions of no length.
    """
    marked = materialize(mark_repeats(events, sources), "marked-events")
    found = materialize(folded(marked.filter("not repeated").drop("repeated")), "folded")
    named = found.filter("session is not null").select("instance_id", "session.*")
    links = found.filter("session is not null").select("instance_id", F.inline("links"))
    odd = found.filter("counts is not null").select("instance_id", F.lit(0).cast("long").alias("repeated"), "counts.*")
    repeats = marked.groupBy("instance_id").agg(F.count_if("repeated").alias("repeated")).select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    per = odd.unionByName(repeats).groupBy("instance_id").agg(*[F.sum(c).alias(c) for c in ("repeated", *COUNTS)])
    return named, links, per


def session_rows(found: DataFrame, offset_min: int = 0) -> DataFrame:
    """Rows to store: cut and implausible sessions lose end and length; a digest names each session."""
    wrong = F.col("seconds") > LONGEST_S
    cut = (F.col("end_kind") == "truncated") | wrong
    score = F.when(wrong, F.least(F.col("score"), F.lit(54))).otherwise(F.col("score"))
    key = F.concat_ws("|", *[F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in (
        F.col("instance_id").cast("string"), F.col("start_ms").cast("string"), F.coalesce("end_ms", "start_ms").cast("string"), F.array_join("versions", ","), F.array_join("destinations", ","))])
    return found.select(
        F.substring(F.sha2(key, 256), 1, 32).alias("session_key"), "instance_id", "start_ms", F.when(~cut, F.col("end_ms")).alias("end_ms"), F.when(~cut, F.col("seconds")).alias("seconds"),
        F.when(wrong, "unknown").otherwise(F.col("exit_kind")).alias("exit_kind"), score.alias("score"), label(score).alias("label"), F.try_element_at("versions", F.lit(-1)).alias("version"),
        "destinations", utc_label(F.lit(offset_min)).alias("offset_label"),
    )


def dedupe_exact(sources: DataFrame) -> DataFrame:
    """Marks sources whose content hash came earlier in the same instance; sources without a hash are never copies."""
    order = Window.partitionBy("instance_id", "content_hash").orderBy("source_order", "source_id")
    return sources.withColumn("copy", F.col("content_hash").isNotNull() & (F.row_number().over(order) > 1))


#: Two prime moduli with a base each, for hashes of runs of keys (62 bits together).
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_711))


def _power(exponent: Column, base: int, modulus: int) -> Column:
    """base ** exponent modulo a prime below 2**31, by the exponent's digits to base 64, each looked up: few enough steps
    that the code made of them is compiled."""
    out, shift = None, 0
    while shift < 31:
        powers = F.expr(f"array({', '.join(f'{pow(base, digit << shift, modulus)}L' for digit in range(64))})")
        factor = F.get(powers, F.shiftright(exponent, shift).bitwiseAND(63).cast("int"))
        out = factor if out is None else out * factor % modulus
        shift += 6
    return out


def moment_keys(events: DataFrame) -> Column:
    """What two sources must agree in to hold the same event: kind, detail and moment, told apart by what kind of moment it is."""
    utc = F.col("utc_ms") if "utc_ms" in events.columns else F.lit(None).cast("long")
    tag = F.when(utc.isNotNull(), "utc").when(F.col("local_ms").isNotNull(), "local").otherwise("sequence")
    return F.struct("kind", "detail", tag.alias("tag"), F.coalesce(utc, "local_ms", "sequence_ms").alias("at"))


def overlaps(events: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """source_id, common: how many of a source's first keyed events are the last ones of the source before it.

    The source before is the nearest one of the instance that has keyed events and is no copy. Runs of keys
    are compared by polynomial hashes modulo two primes: prefix sums give the hash of each begin of a source
    and of each end of the one before, and an equi-join on length and hash finds the longest common
    one. Work and memory are linear in the events; no source is gathered in one row. The common part counts
    only if it spans two events and, on both sides, two lines.
    """
    keyed = events.filter("sequence_ms is not null")
    if copies is not None:
        keyed = keyed.join(copies.filter("copy").select("source_id"), "source_id", "left_anti")
    source = ["instance_id", "source_order", "source_id"]
    own = Window.partitionBy(source).orderBy("line_number", "event_order")
    key = moment_keys(events)
    hashes = [F.pmod(F.xxhash64(F.lit(m), key, key["detail"].isNull()), F.lit(p)).alias(f"h{m}") for m, (p, _) in enumerate(MODULI)]
    rows = keyed.select(*source, "line_number", "event_order", *hashes).withColumn("place", (F.row_number().over(own) - 1).cast("long"))
    for m, (p, base) in enumerate(MODULI):
        rows = rows.withColumn(f"t{m}", F.col(f"h{m}") * _power(F.col("place"), base, p) % p)
        rows = rows.withColumn(f"s{m}", F.sum(f"t{m}").over(own.rowsBetween(Window.unboundedPreceding, 0)) % p)
    rows = materialize(rows.select(*source, "place", "line_number", "t0", "s0", "t1", "s1"), "hashed-keys")  # read three times
    totals = [(F.sum(f"t{m}") % p).alias(f"total{m}") for m, (p, _) in enumerate(MODULI)]
    per = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first"), F.max("line_number").alias("last"), *totals)
    chain = Window.partitionBy("instance_id").orderBy("source_order", "source_id")
    per = per.withColumn("n_before", F.lag("n").over(chain)).withColumn("next_id", F.lead("source_id").over(chain)).withColumn("n_next", F.lead("n").over(chain))
    joined = rows.join(per, source)
    begins = joined.filter(F.col("place") < F.col("n_before")).withColumn("k", F.col("place") + 1)
    shifted = [(F.col(f"s{m}") * _power(F.col("n_before") - F.col("k"), base, p) % p).alias(f"v{m}") for m, (p, base) in enumerate(MODULI)]
    begins = begins.select("source_id", "k", *shifted, (F.col("line_number") > F.col("first")).alias("lines"))
    ends = joined.filter(F.col("n") - F.col("place") <= F.col("n_next")).withColumn("k", F.col("n") - F.col("place"))
    suffix = [F.pmod(F.col(f"total{m}") - F.col(f"s{m}") + F.col(f"t{m}"), F.lit(p)).alias(f"v{m}") for m, (p, _) in enumerate(MODULI)]
    ends = ends.select(F.col("next_id").alias("source_id"), "k", *suffix, (F.col("line_number") < F.col("last")).alias("lines_before"))
    same = begins.join(ends, ["source_id", "k", "v0", "v1"])
    spans = F.max_by((F.col("k") >= 2) & F.col("lines") & F.col("lines_before"), F.col("k"))
    return same.groupBy("source_id").agg(F.max("k").alias("common"), spans.alias("spans")).filter("spans").select("source_id", "common")


def mark_repeats(events: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Events with ``repeated``: of a source that is a copy (``sources`` with content hashes), or of a rotation's overlap.

    The events are written once: their keys are hashed from there and the marks are joined to them.
    """
    events = materialize(events, "events")
    copies = dedupe_exact(sources) if sources is not None else None
    place = Window.partitionBy("source_id").orderBy(F.col("sequence_ms").isNull(), "line_number", "event_order")
    ranked = events.join(overlaps(events, copies), "source_id", "left").withColumn("place", F.row_number().over(place))
    repeated = F.coalesce(F.col("sequence_ms").isNotNull() & (F.col("place") <= F.col("common")), F.lit(False))
    if copies is not None:
        ranked = ranked.join(copies.select("source_id", "copy"), "source_id", "left")
        repeated = repeated | F.coalesce("copy", F.lit(False))
    return ranked.withColumn("repeated", repeated).select(*events.columns, "repeated")


def dedupe_overlap(events: DataFrame) -> DataFrame:
    """Drops from each source the events that repeat the end of the source before it (a rotation's overlap)."""
    return mark_repeats(events).filter("not repeated").drop("repeated")


def evidence_rows(events: DataFrame) -> DataFrame:
    """The rows to store for events: an id of each, its place, time and origin, and what was seen as JSON."""
    digest = lambda *parts: F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)
    line = F.col("line_number").cast("string")
    observed = F.date_format(F.timestamp_millis("local_ms").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return events.select(
        digest("source_id", line, F.col("event_order").cast("string"), "kind").alias("evidence_id"), "source_id", "line_number", "event_order", "kind", "score",
        observed.alias("observed_local"), "origin", F.to_json(F.struct("kind", "detail")).alias("payload"), digest("source_id", line, "kind").alias("event_key"),
    )
