"""Golden cases of the parser, the session fold and the merge of rotations."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from playloom.functions.core import canonical_server, implausible, version_class
from playloom.operators import parsing, reconstruct
from playloom.sources import inventory
from playloom.sources import logs as log_source
from playloom.sources.logs import read_logs

DAY = 20_671  # 2026-08-06
LINES = "instance_id long, source_id string, source_order int, date_hint date, line_number long, value string"


def ms(clock, day=DAY):
    h, m, s = map(int, clock.split(":"))
    return day * 86_400_000 + (h * 3600 + m * 60 + s) * 1000


def lines_of(spark, sources, dated=True):
    rows = []
    for order, (name, lines) in enumerate(sources):
        rows += [(1, name, order, None, k, line) for k, line in enumerate(lines, 1)]
    out = spark.createDataFrame(rows, LINES)
    return out.withColumn("date_hint", F.date_add(F.lit("1970-01-01").cast("date"), DAY)) if dated else out


def said(clock, text, head="Render thread/INFO"):
    return f"[{clock}] [{head}]: {text}"


CLEAN = [
    said("14:02:03", "Loading Minecraft 1.20.1 now"), said("14:02:05", "Setting user: someone"), said("14:04:00", "Connecting to play.example.net, 25565"),
    said("15:00:00", "Disconnected from server"), said("15:01:00", "Stopping!"), said("15:01:01", "Stopping worker threads"),
]
CRASH = [
    said("06Aug2026 22:55:01.123", "Loading Minecraft 1.21.1 with mods"), said("06Aug2026 22:55:08.000", "Starting integrated minecraft server version 1.21.1"),
    said("06Aug2026 22:55:09.500", 'Preparing level "My World"'), said("06Aug2026 23:14:42.010", "Unreported exception thrown!"),
    said("06Aug2026 23:14:42.500", "This crash report has been saved to: x", "main/FATAL"),
]
NOISE = ["no bracket here", said("25:61:61", "odd"), said("09:00:00", "Loading Minecraft 1.19.4 x"), said("09:00:02", "hello"), said("08:59:59", "Backend library: LWJGL version 3"), said("09:30:00", "Stopping!")]
OLDER = [said("18:00:00", "Loading Minecraft 1.20.4 x"), said("18:00:08", "Starting integrated minecraft server"), said("18:00:10", "Preparing level 'W'"), said("18:47:00", "Stopping integrated server")]
NEWER = [said("20:05:00", "Loading Minecraft 1.20.4 x"), said("20:05:11", "Connecting to a.example.net, 25565"), said("21:22:30", "Disconnected from server"), said("21:23:00", "Stopping!"), said("21:23:01", "SoundSystem shutting down")]


def sessions_of(spark, sources, hint=None):
    events = parsing.log_events(lines_of(spark, sources)).withColumn("hint_ms", F.lit(hint).cast("long"))
    return sorted(reconstruct.sessions(reconstruct.dedupe_overlap(events)).collect(), key=lambda r: r["start_ms"])


def test_clean_session(spark):
    (s,) = sessions_of(spark, [("a", CLEAN)])
    assert (s["seconds"], s["start_kind"], s["end_kind"], s["exit_kind"], s["score"]) == (3538, "explicit", "clean_shutdown", "clean", 100)
    assert s["versions"] == ["1.20.1"] and s["destinations"] == ["server:play.example.net:25565"] and s["start_ms"] == ms("14:02:03")


def test_crash_with_named_world(spark):
    (s,) = sessions_of(spark, [("a", CRASH)])
    assert (s["seconds"], s["end_kind"], s["score"], s["destinations"]) == (1180, "crash", 98, ["world:My World"])


def test_noise(spark):
    d = parsing.diagnostics(lines_of(spark, [("a", NOISE)])).first()
    assert (d["lines"], d["unparsed"], d["non_monotonic"], d["rollovers"], d["warns"]) == (6, 1, 1, 0, True)
    first, second = sorted(sessions_of(spark, [("a", NOISE)]), key=lambda s: s["seconds"])
    assert (first["seconds"], first["end_kind"], first["score"]) == (0, "next_start", 54)
    assert (second["seconds"], second["end_kind"], second["score"]) == (1801, "client_stopping", 88)


def test_rotations_in_any_order(spark):
    one, two = sessions_of(spark, [("old", OLDER), ("new", NEWER)])
    assert (one["seconds"], one["end_kind"], one["score"]) == (2820, "next_start", 54)
    assert (two["seconds"], two["end_kind"], two["score"]) == (4681, "clean_shutdown", 100)


def test_tail_hint_single_start_and_quick_restart(spark):
    tail = [said("10:00:00", "Loading Minecraft 1.20 x"), said("10:30:00", "Connecting to a.b, 1")]
    (s,) = sessions_of(spark, [("a", tail)], ms("10:30:30"))
    assert (s["seconds"], s["end_kind"], s["exit_kind"]) == (1830, "source_end_hint", "unknown")
    (s,) = sessions_of(spark, [("a", tail[:1])])
    assert (s["seconds"], s["end_kind"]) == (0, "truncated")
    stored = reconstruct.session_rows(spark.createDataFrame([tuple([1, *s[1:]])], f"instance_id long, {reconstruct.SESSION}")).first()
    assert stored["end_ms"] is None and stored["seconds"] is None and stored["label"] == "partial"
    quick = [said("10:00:00", "Loading Minecraft 1.20 x"), said("10:00:20", "Stopping!"), said("10:00:40", "Loading Minecraft 1.20 x"), said("10:01:00", "Stopping!")]
    assert [(s["seconds"], s["end_kind"]) for s in sessions_of(spark, [("a", quick)])] == [(20, "client_stopping")] * 2


def test_overlap_of_rotations(spark):
    first = CLEAN[:3]
    assert len(sessions_of(spark, [("a", first), ("b", first[1:] + CLEAN[3:])])) == 1
    again = [said("10:00:00", "Loading Minecraft 1.20 x")]
    assert len(sessions_of(spark, [("a", again), ("b", again)])) == 2


def test_overlap_length_against_brute_force(spark):
    """Many short sources over few keys, each the rotation after the one before."""
    rng, rows, wanted = random.Random(4), [], {}
    for instance in range(400):
        before = []
        for order in range(3):
            keys = sorted((rng.randint(1, 4), rng.choice("ab"), rng.randint(0, 1)) for _ in range(rng.randint(0, 7)))
            if rng.random() < 0.3:  # a true rotation, with lines of its own
                keys = [(k, *x[1:]) for k, x in enumerate(before[-rng.randint(1, 5) :], 1)] + [(9, *x[1:]) for x in keys[:2]]
            name = f"{instance}/{order}"
            rows += [(instance, name, order, line, k, "server", detail, at, at) for k, (line, detail, at) in enumerate(keys)]
            best = max((k for k in range(min(len(before), len(keys)) + 1) if [x[1:] for x in before[len(before) - k :]] == [x[1:] for x in keys[:k]]), default=0)
            if best >= 2 and len({x[0] for x in before[-best:]}) > 1 and len({x[0] for x in keys[:best]}) > 1:
                wanted[name] = best
            before = keys or before
    events = spark.createDataFrame(rows, "instance_id long, source_id string, source_order int, line_number long, event_order int, kind string, detail string, local_ms long, sequence_ms long")
    assert len(wanted) > 100
    assert {r["source_id"]: r["common"] for r in reconstruct.overlaps(events).collect()} == wanted


def test_exact_copies_are_marked(spark):
    rows = spark.createDataFrame([(1, "a", 0, "h"), (1, "b", 1, "h"), (2, "c", 0, "h"), (1, "d", 2, None), (1, "e", 3, None)], "instance_id long, source_id string, source_order int, content_hash string")
    assert {r["source_id"] for r in reconstruct.dedupe_exact(rows).filter("copy").collect()} == {"b"}


@pytest.mark.parametrize("clocks,days", [(("23:59:58", "00:00:03"), (3, 4)), (("23:58:00", "23:59:58"), (3, 3))])
def test_final_day(spark, clocks, days):
    """An undated log that ends on 2026-08-10 at 00:00:05."""
    rows = lines_of(spark, [("a", [said(clocks[0], "Loading Minecraft 1 x"), said(clocks[1], "Stopping!")])], dated=False).withColumn("end_ms", F.lit(ms("00:00:05", DAY + 4)))
    got = parsing.anchor_final_day(parsing.timed_lines(rows), "end_ms").orderBy("line_number").collect()
    assert [r["local_ms"] for r in got] == [ms(c, DAY + d) for c, d in zip(clocks, days)]


def test_rules_and_addresses(spark):
    cases = {
        "Loading Minecraft (1.20.1), x": [("start", None, 94), ("version", "1.20.1", 98)], "Starting Minecraft client version 1.7.10;": [("start", None, 96), ("version", "1.7.10", 99)],
        "Forge Mod Loader version 7 for Minecraft 1.5 loading": [("start", None, 91), ("version", "1.5", 96)], "Minecraft Version: 1.8": [("version", "1.8", 96)],
        "Connecting to Host.Example. with x": [("server", "Host.Example", 95)], 'Connecting to "h" x': [("server", "h", 95)], "Preparing start region for dimension 0": [("world", None, 80)],
        "Client disconnected with reason: bye": [("disconnected", "network", 88)], "Stopping Minecraft": [("stopping", None, 96)], "Sound engine shut down": [("clean_shutdown", None, 94)],
        "The game crashed whilst x": [("crash", None, 96)], "nothing": [],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", parsing.events_of(F.col("t"), F.col("t")).alias("e")).collect()
    assert {r["t"]: [tuple(e) for e in r["e"]] for r in rows} == cases


def test_names_and_bounds(spark):
    servers = {" Play.Example.NET.:25565 ": "play.example.net", "a.b:1": "a.b:1", "[2001:DB8::1]:25565": "[2001:db8::1]", "[::1]:1": "[::1]:1", "2001:DB8::1": "2001:db8::1"}
    got = spark.createDataFrame(list(servers.items()), "a string, want string").withColumn("got", canonical_server(F.col("a"))).collect()
    assert all(r["got"] == r["want"] for r in got)
    kinds = {"1.20": "release", "1.20.1": "release", "24w14a": "snapshot", "1.2.3.4": "other", "1.²": "other", "1": "other"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in kinds], "v string").select("v", version_class(F.col("v"))).collect()} == kinds
    bounds = spark.createDataFrame([(0, 10_000, 10, False, False), (0, 11_000, 10, True, True), (0, -5, None, True, False), (0, None, 10, False, False), (0, None, 2_678_401, True, True)], "s long, e long, d long, a boolean, b boolean")
    rows = bounds.select("a", "b", implausible(F.col("s"), F.col("e"), F.col("d")).alias("x"), implausible(F.col("s"), F.col("e"), F.col("d"), True).alias("y")).collect()
    assert all((r["x"], r["y"]) == (r["a"], r["b"]) for r in rows)


def test_files_and_inventory(spark, tmp_path):
    logs = tmp_path / "instances" / "One" / "Logs"
    logs.mkdir(parents=True)
    (logs / "latest.log").write_bytes("\r\n".join(CLEAN).encode())
    with gzip.open(logs / "2026-08-05-1.log.gz", "wt") as out:
        out.write("\n".join(OLDER) + "\n")
    (tmp_path / "instances" / "One" / "other.log").write_text("x")
    rows = read_logs(spark, str(logs)).collect()
    assert len(rows) == 10 and {r["value"] for r in rows} == set(CLEAN + OLDER)
    found = inventory.walk(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["2026-08-05-1.log.gz", "latest.log"]
    names = ["a/latest.log", "a/2026-08-10-2.log", "a/2026-08-10-1.log.gz", "a/2026-08-09-9.log", "a/x.log", "a/b.log"]
    files = spark.createDataFrame([(k, n, 1, 5) for k, n in enumerate(names)], "file_id long, path string, instance_id long, mtime_ms long")
    order = [r["path"][2:] for r in inventory.rotations(files).orderBy("rotation").collect()]
    assert order == ["2026-08-09-9.log", "2026-08-10-1.log.gz", "2026-08-10-2.log", "b.log", "x.log", "latest.log"]


def test_bad_bytes_and_nul_are_replaced_and_counted(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "latest.log").write_bytes(b"[10:00:00] [main/INFO]: a\xff\xfe\r\nplain\r\nnu\x00l\n")
    rows = read_logs(spark, str(tmp_path / "logs")).orderBy("line_number").collect()
    assert [(r["line_number"], r["value"], r["malformed"]) for r in rows] == [(1, "[10:00:00] [main/INFO]: a��", True), (2, "plain", False), (3, "nul", True)]


def test_texts_of_a_line_are_made_once(spark):
    plan = parsing.log_events(lines_of(spark, [("a", CLEAN)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 2 and "lambdafunction" not in plan


@pytest.mark.parametrize(("stamp", "full", "clock"), [
    ("2026-08-06 01:02:03", 3_723_000, None), ("2026-08-06T01:02:03.5", 3_723_500, None), ("2026-08-06 24:02:03", None, None), ("2026-02-30 01:02:03", None, None),
    ("06Aug2026 01:02:03.1234", 3_723_123, None), ("0000-08-06 01:02:03", None, None), ("2026-08-06 01:02:03\n", None, None), ("01:02:03.25", None, 3_723_250),
    ("01:02:60", None, None), ("01:02:03", None, 3_723_000), ("x", None, None),
])
def test_stamps(spark, stamp, full, clock):
    row = spark.createDataFrame([(stamp,)], "s string").select(parsing.full_local_ms(F.col("s")).alias("f"), parsing.clock_ms(F.col("s")).alias("c")).first()
    assert (row["f"], row["c"]) == (full if full is None else DAY * 86_400_000 + full, clock)


def test_events_are_parsed_once(spark, monkeypatch):
    """Marks, hashes and pieces read the events from a table, not from their lines."""
    written = []
    monkeypatch.setattr(reconstruct, "materialize", lambda df, name: written.append(name) or spark.createDataFrame(df.collect(), df.schema))
    events = parsing.log_events(lines_of(spark, [("old", OLDER), ("new", NEWER)])).withColumn("hint_ms", F.lit(None).cast("long"))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (reconstruct.mark_repeats(events), reconstruct.sessions(events))]
    assert all("connecting to" not in plan for plan in plans) and written == ["events", "hashed-keys", "events"]


def test_small_files_share_tasks_and_read_as_spark_reads_them(spark, tmp_path, monkeypatch):
    for k in range(300):
        folder = tmp_path / f"i {k % 40}" / "größe%20"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.log").write_bytes(f"one {k}\r\n\ntwo\nlast".encode() if k % 3 else b"")
    (tmp_path / ".hidden.log").write_bytes(b"x\n")
    (tmp_path / "z.log.gz").write_bytes(gzip.compress(b"one\ntwo"))
    (tmp_path / "large.log").write_bytes(b"".join(b"x" * (k % 97) + b"\n" for k in range(4000)))
    wanted = sorted(map(tuple, log_source._read_store(spark, f"file:{tmp_path}").collect()))
    monkeypatch.setattr(log_source, "_split_bytes", lambda _: 10_000)
    got = read_logs(spark, f"file:{tmp_path}")
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) == 4802
    assert got.filter("source_id not like '%large.log'").rdd.getNumPartitions() < 150


def test_byte_order_mark_counts_as_bytes_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbfone\ntwo\n")
    assert [tuple(r)[1:5] for r in read_logs(spark, str(tmp_path)).orderBy("line_number").collect()] == [(1, 0, 7, "one"), (2, 7, 11, "two")]
