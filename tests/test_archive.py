"""Golden cases of the dashboard, snapshots, profile and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from playloom.functions import formats
from playloom.operators import budgets, dashboard, discovery, ingest, profile, reconcile
from playloom.operators.prefix import running_sums
from playloom.sources import sinks
from playloom.sources.archive import Archive


class Rows:
    """An archive of given sessions in one instance."""

    def __init__(self, spark, sessions):
        make = spark.createDataFrame
        self.sessions = make(sessions, "session_id long, start_ms long, end_ms long, seconds long, score int, offset_min int").select(
            "*", F.lit(1).cast("long").alias("instance_id"), F.lit("clean").alias("exit_kind"), F.lit("high").alias("label"), F.lit("1.20").alias("version"), F.lit(None).cast("string").alias("loader")
        )
        self.user_state = make([], "session_id long, ignored boolean")
        self.instances = make([(1, 0, None, "I")], "instance_id long, location_id long, launcher_id long, instance_name string")
        self.locations = make([(0, "prism")], "location_id long, adapter_kind string")
        self.launchers = make([], "launcher_id long, location_id long, launcher_name string")
        self.servers = make([(1, "a.b", None)], "server_id long, address string, display_name string")
        self.segments = make([(1, "server", 1, None, 80), (1, "world", None, "W", 80)], "session_id long, kind string, server_id long, world string, segment_score int")


def at(text):
    import datetime

    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def test_midnight_split_and_coverage(spark):
    archive = Rows(spark, [(1, at("2026-07-31T21:30:00"), at("2026-07-31T23:30:00"), 7200, 85, 120)])
    assert [(str(r["day"]), r["day_seconds"]) for r in dashboard.day_slices(archive).orderBy("day").collect()] == [("2026-07-31", 1800), ("2026-08-01", 5400)]
    assert dashboard.active_days(archive).first()["active_days"] == 2
    assert dashboard.coverage(archive).first()["coverage_score"] == 79
    tops = {r["category"]: r["minutes"] for r in dashboard.top_metrics(archive).collect()}
    assert tops == {"launcher": 120, "instance": 120, "version": 120, "server": 120, "world": 120}


def test_union_of_nested_islands(spark):
    archive = Rows(spark, [(k, a * 1000, b * 1000, b - a, 60, None) for k, (a, b) in enumerate([(10, 11), (5, 6), (1, 20)])])
    assert dashboard.unique_runtime(archive).first()["unique_seconds"] == 19
    same = Rows(spark, [(k, 0, 60_000, 60, 60, None) for k in range(2050)])
    assert dashboard.unique_runtime(same).first()["unique_seconds"] == 60
    total = dashboard.totals(same).first()
    assert (total["total_seconds"], total["average_seconds"]) == (2050 * 60, 60)
    page = dashboard.session_page(same).collect()
    assert len(page) == 500 and page[0]["total"] == 2050 and page[0]["truncated"]
    after = dashboard.session_page(same, after=(0, 499)).collect()
    assert sorted(r["session_id"] for r in after) == list(range(500, 1000))


def test_calendars(spark):
    archive = Rows(spark, [(1, at("2024-04-10T10:00:00"), at("2024-04-10T11:00:00"), 3600, 85, 0), (2, at("2025-03-10T10:00:00"), at("2025-03-10T10:01:00"), 60, 40, 0)])
    months = dashboard.monthly_activity(archive).orderBy("month").collect()
    assert len(months) == 12 and [r["month_label"] for r in months].count("missing") == 10 and months[0]["month"] == "2024-04"
    days = dashboard.daily_activity(archive).collect()
    assert len(days) == 365 and sum(r["minutes"] is not None for r in days) == 2


def test_open_and_implausible_sessions(spark):
    archive = Rows(spark, [(1, at("2026-01-01T10:00:00"), None, None, 85, 0), (2, at("2026-01-02T10:00:00"), at("2026-02-05T10:00:00"), 34 * 86400, 85, 0)])
    total = dashboard.totals(archive).first()
    assert (total["sessions"], total["known_sessions"], total["longest_seconds"], total["average_seconds"]) == (2, 0, None, None)
    assert dashboard.active_days(archive).first()["active_days"] == 0
    assert {r["day_label"] for r in dashboard.day_slices(archive).collect()} == {"verified", "partial"}


def test_empty_archive(spark):
    archive = Rows(spark, [])
    assert dashboard.totals(archive).first()["total_seconds"] == 0
    assert dashboard.top_metrics(archive).count() == 0 == dashboard.monthly_activity(archive).count()
    days = dashboard.daily_activity(archive, F.lit("2026-03-01").cast("date")).orderBy("day").collect()
    assert len(days) == 365 and {r["day_label"] for r in days} == {"missing"} and {r["minutes"] for r in days} == {None}
    assert (str(days[0]["day"]), str(days[-1]["day"])) == ("2025-03-02", "2026-03-01")


def test_snapshots(spark, tmp_path):
    store = ingest.Snapshots(spark, f"file://{tmp_path}")
    assert store.revision() == 0
    assert store.commit({"t": spark.range(3)}) == 1 and store.read("t").count() == 3
    assert store.commit({"t": store.read("t").union(spark.range(2))}) == 2 and store.read("t").count() == 5
    with pytest.raises(Exception, match="."):
        store.commit({"t": spark.range(1).select(F.raise_error(F.lit("stop")).alias("x"))})
    assert store.revision() == 2 and store.read("t").count() == 5


def test_promotion_keeps_replaced_history(spark):
    make = spark.createDataFrame
    links = make([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1)], "session_id long, file_id long, generation long")
    sessions = links.select("session_id")
    decided = make([(1, "appended", 2), (2, "replaced", 2), (3, "unchanged", 1), (5, "new", 1)], "file_id long, decision string, generation long")
    gone = make([(4,)], "file_id long")
    fresh = make([(11, 1, 2), (13, 3, 1), (15, 5, 1)], "session_id long, file_id long, generation long")
    kept, _ = ingest.promote(sessions, links, decided, gone, fresh.select("session_id"), fresh)
    assert sorted(r[0] for r in kept.collect()) == [2, 4, 11, 13, 15]
    with pytest.raises(ValueError):
        ingest.promote(sessions, links, decided.withColumn("decision", F.lit("odd")), gone, fresh.select("session_id"), fresh)


def test_profile(spark):
    files = [("w1", json.dumps({"stats": {"minecraft:mined": {"minecraft:stone": 3}, "minecraft:custom": {"minecraft:jump": 2}}})), ("w2", json.dumps({"stat.mineBlock.minecraft.stone": 4, "stat.jump": 1, "stat.odd": 7})), ("w3", "{broken"), ("w4", None)]
    got = {(r["category"], r["key"].replace("minecraft:", "")): (r["value"], r["worlds"]) for r in profile.merge(profile.statistics(spark.createDataFrame(files, "world_id string, json string"))).collect()}
    assert got == {("mined", "stone"): (7, 2), ("custom", "jump"): (3, 2)}
    a, b = "a" * 32, "b" * 32
    counts = profile.uuid_counts(spark.createDataFrame([(a,), (a.upper(),), (b,), ("x",)], "uuid string"))
    nobody = spark.createDataFrame([], "name string, uuid string, active boolean")
    assert profile.primary_uuid(nobody, counts).collect() == [(a, "inferred")]
    assert profile.primary_uuid(nobody, counts.withColumn("files", F.lit(1).cast("long"))).count() == 0
    assert profile.primary_uuid(spark.createDataFrame([("n", b, True)], "name string, uuid string, active boolean"), counts).collect() == [(b, "identity")]
    texts = [
        ("o", json.dumps({"activeAccountLocalId": "k", "accounts": {"k": {"minecraftProfile": {"name": "A", "id": a}}}})), ("p", json.dumps({"accounts": [{"active": True, "profile": {"name": "B", "id": b}}]})),
        ("c", json.dumps([{"name": "C", "uuid": "c" * 32}])), ("n", json.dumps({"d" * 32: "D"})),
    ]
    rows = profile.account_rows(spark.createDataFrame(texts, "launcher string, json string")).collect()
    assert sorted((r["launcher"], r["name"], r["active"]) for r in rows) == [("c", "C", False), ("n", "D", False), ("o", "A", True), ("p", "B", True)]


def test_an_unchanged_commit_keeps_the_revision(spark, tmp_path):
    store = ingest.Snapshots(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    assert store.commit({"t": rows}) == 1 == store.commit({"t": rows.repartition(3)})
    assert store.commit({"t": rows.limit(2)}) == 2 and store.commit({"t": rows.fillna("")}) == 3
    assert store.commit({}, append={"t": rows}) == 4 and store.read("t").count() == 6
    assert store.commit({}, append={"t": rows.filter("false")}) == 4


def test_two_writers(spark, tmp_path):
    """Only the holder of the newest lease may commit; a lease that ran out can be taken over."""
    one, two = (ingest.Snapshots(spark, f"file://{tmp_path}") for _ in range(2))
    fence = one.acquire("one", seconds=60, now=1000)
    with pytest.raises(ingest.LeaseHeld):
        two.acquire("two", now=1030)
    assert one.commit({"t": spark.range(1)}, fence) == 1
    later = two.acquire("two", seconds=60, now=1100)
    with pytest.raises(ingest.LeaseHeld):
        one.commit({"t": spark.range(5)}, fence)
    assert two.commit({"t": spark.range(2)}, later) == 2 and one.read("t").count() == 2
    two.release(later, "two")
    assert one.acquire("one", now=1101) == later + 2


def test_running_sums_in_blocks(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 11).alias("v"))
    for blocks in (1, 7, 300):
        got = [(r["k"], r["all"]) for r in running_sums(rows, "k", {"all": "v"}, blocks).orderBy("k").collect()]
        want, total = [], 0
        for r in rows.orderBy("k").collect():
            total += r["v"]
            want.append((r["k"], total))
        assert got == want


def test_budgets_of_a_scan(spark):
    """Each limit in turn, the charge of failed logs, and what comes after the scan is full."""
    fine = dict(ok=True, bytes=10, events=5, longest_destination=9, longest_version=9)
    odd = {
        1: [{}] * 3, 2: [{}] * 5, 3: [{"bytes": 95}, {}], 4: [{"events": 60}], 5: [{"longest_destination": 600}], 6: [{"longest_version": 300}], 7: [{"ok": False}, {}],
        8: [{}], 9: [{}], 10: [{}], 11: [{}], 12: [{}] * 4, 13: [{}],
    }
    files = [(i, k, *{**fine, **x}.values()) for i, logs in odd.items() for k, x in enumerate(logs)]
    table = spark.createDataFrame(files, "instance_id long, file_order long, ok boolean, bytes long, events long, longest_destination long, longest_version long")
    gives = {8: (70, 1, 1), 9: (1, 70, 1), 10: (1, 1, 200_000)}
    sessions = [(i, *gives.get(i, (2, 1, 9))) for i in odd]
    found = spark.createDataFrame(sessions, "instance_id long, destinations long, versions long, links long")
    limits = budgets.Limits(instance_logs=4, instance_bytes=100, instance_events=50, scan_logs=17, failed_bytes=100, failed_events=50)
    got = {r["instance_id"]: (r["status"], r["resource"]) for r in budgets.judge(table, found, limits).collect()}
    assert got == {
        1: ("taken", None), 2: ("instance_limit", "logs"), 3: ("instance_limit", "bytes"), 4: ("instance_limit", "events"), 5: ("instance_limit", "destination bytes"),
        6: ("instance_limit", "version bytes"), 7: ("failed_parse", None), 8: ("session_limit", "destinations"), 9: ("session_limit", "versions"), 10: ("session_limit", "links"),
        11: ("taken", None), 12: ("scan_limit", "logs"), 13: ("deferred", None),
    }
    full = budgets.judge(table, found, budgets.Limits(instance_logs=4, instance_bytes=100, instance_events=50, scan_bytes=270, failed_bytes=100))
    assert {r["instance_id"]: r["status"] for r in full.collect()}[7] == "scan_limit"


def test_rotated_copies_replace_their_links(spark):
    """Session 1 comes again from revision 9; its old link to the replaced revision 1 goes, shared evidence stays."""
    make = spark.createDataFrame
    revisions = make([(1, 1, 1, "new"), (2, 1, 2, "replaced"), (3, 2, 1, "new"), (9, 3, 1, "new")], "revision_id long, path_id long, generation long, change_kind string")
    sources = make([(1, 1), (1, 3), (2, 1), (1, 2)], "session_id long, revision_id long")
    evidence = make([(10, 1), (11, 1), (12, 3)], "evidence_id long, revision_id long")
    links = make([(1, 10), (1, 11), (2, 11), (1, 12)], "session_id long, evidence_id long")
    a, b, c = reconcile.reconcile(sources, links, evidence, revisions, make([(1, 9)], "session_id long, revision_id long"))
    assert {tuple(r) for r in a.collect()} == {(1, 3), (2, 1), (1, 2)} and {tuple(r) for r in b.collect()} == {(2, 11), (1, 12)}
    assert {r["evidence_id"] for r in c.collect()} == {11, 12}
    same = reconcile.superseded(sources, revisions, make([(2, 1)], "session_id long, revision_id long"))
    assert same.collect() == []


def test_containment_against_brute_force(spark):
    rng = random.Random(6)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(60)}
    texts = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(80)}
    got = profile.containment(spark.createDataFrame([(n,) for n in names], "norm string"), spark.createDataFrame([(t,) for t in texts], "b_norm string"))
    pairs = [tuple(r) for r in got.collect()]
    assert sorted(pairs) == sorted((n, t) for n in names if n for t in texts if n in t)


def test_missing_worlds_look_at_all_backups(spark):
    make = spark.createDataFrame
    worlds = profile.match_worlds(make([(1, "Home"), (1, "Far")], "instance_id long, save string"), make([(2, "home!"), (2, "Lost")], "instance_id long, world string"),
                                  make([(1, "2026 Home.zip"), (3, "lost-1.zip"), (2, "far.zip"), (2, "other.zip")], "instance_id long, backup string"))
    got = {(r["instance_id"], r["name"]): (r["availability"], r["backups"]) for r in worlds.collect()}
    assert got == {(1, "Home"): ("available", 1), (1, "Far"): ("available", 0), (2, "home!"): ("missing", 1), (2, "Lost"): ("missing", 1), (2, "far.zip"): ("backup_only", 1), (2, "other.zip"): ("backup_only", 1)}


def test_a_page_reads_the_segments_of_its_keys(spark, sf):
    rows = dashboard.session_contexts(Archive(spark, sf), 5)
    assert "In(l_orderkey" in rows._jdf.queryExecution().executedPlan().toString() or "l_orderkey IN" in rows._jdf.queryExecution().executedPlan().toString()


def test_formats(spark):
    rows = spark.createDataFrame([(None, 1), (0, 1), (59, 2), (60, 1000), (74_045, 1234)], "m long, n long")
    got = rows.select(formats.duration(F.col("m")), formats.duration(F.col("m"), True), formats.plural(F.col("n"), "session"), formats.plural(F.col("n"), "entry", "entries")).collect()
    assert [tuple(r) for r in got] == [
        ("Unknown", "Unknown", "1 session", "1 entry"), ("0m", "0m", "1 session", "1 entry"), ("59m", "59m", "2 sessions", "2 entries"), ("1 h", "1h", "1,000 sessions", "1,000 entries"),
        ("1,234 h 5 min", "1234h 5m", "1,234 sessions", "1,234 entries"),
    ]
    one = spark.createDataFrame([("2026-08-06T23:59:00-05:00", "minecraft:oak_log--x")], "t string, k string")
    texts = one.select(formats.short_date(F.col("t")), formats.long_date(F.col("t")), formats.month_name(F.lit("2026-08")), formats.humanise(F.col("k")), formats.rfc3339(F.lit(0), F.lit(-90)), formats.rfc3339(F.lit(1500), F.lit(None).cast("int")))
    assert tuple(texts.first()) == ("Aug 6, 2026", "Thursday, August 6", "August 2026", "Oak Log X", "1969-12-31T22:30:00-01:30", "1970-01-01T00:00:01+00:00")
    units = spark.createDataFrame([(72_000, "ticks"), (25, "tenths"), (123_456, "centimeters"), (1234, "count")], "v long, u string")
    assert [r[0] for r in units.select(formats.measured(F.col("v"), F.col("u"))).collect()] == ["1 h", "2.5", "1.23 km", "1,234"]


def test_choice_of_statistics_files(spark):
    a, b = "a" * 32, "b" * 32
    files = spark.createDataFrame([(1, f"s/{a}.json"), (1, f"s/{b}.json"), (2, f"s/{b}.json"), (3, "s/x.json")], "world_id long, path string")
    player = spark.createDataFrame([(a.upper(), "identity")], "uuid string, basis string")
    assert [tuple(r) for r in profile.chosen_stats(files, player).collect()] == [(1, f"s/{a}.json", "identity")]
    found = {r["world_id"]: r["basis"] for r in profile.chosen_stats(files, player.filter("false")).collect()}
    assert found == {2: "single_local_player", 3: "single_local_player"}


def test_samples_depend_on_the_seed(spark):
    stats = spark.createDataFrame([("mined", f"k{k}", k) for k in range(40)], "category string, key string, value long")
    one, again, other = (sorted(r["key"] for r in profile.sample(stats.repartition(p), seed).collect()) for p, seed in ((1, 5), (4, 5), (2, 6)))
    assert one == again != other and len(one) == 4
    assert [r["key"] for r in profile.search(stats, " K39 ", "key", "category").collect()] == ["k39"] and profile.search(stats, " ", "key").count() == 40


def test_world_order(spark):
    rows = spark.createDataFrame([("b", "missing", 9), ("a", "available", None), ("C", "available", 5), ("d", "backup_only", None), ("c", "available", 5)], "name string, availability string, minutes long")
    assert [r["name"] for r in profile.in_order(rows).collect()] == ["C", "c", "a", "b", "d"]


def test_instances_of_a_launcher(spark):
    columns = ["is_dir", "nested", "nested_logs", "nested_options", "nested_versions", "logs", "instance_file", "options", "mods", "config"]
    entries = [("a", {"nested", "nested_options"}), ("a", {"logs", "mods"}), ("a", {"logs"}), ("a", {"nested"}), ("b", {"logs", "config", "file"})]
    rows = [(root, "file" not in has, *(c in has for c in columns[1:])) for root, has in entries]
    rows += [("c", True, *[True] * 9)] * 3
    table = spark.createDataFrame(rows, f"root string, {', '.join(f'{c} boolean' for c in columns)}")
    assert {r["root"]: (r["instances"], r["over"]) for r in discovery.instance_counts(table).collect()} == {"a": (2, False), "b": (0, False), "c": (3, False)}


def test_saves_and_backups(spark):
    paths = ["saves/One/level.dat", "saves/One/data/x", "saves/file.txt", "x/saves/Two/region/r", "backups/2026 One.zip", "backups/b.ZIP", "backups/deep/c.zip", "y/backups/.zip", "y/backups/d.zip"]
    saves, backups = discovery.worlds_and_backups(spark.createDataFrame([(1, p) for p in paths], "instance_id long, path string"))
    assert sorted(r["save"] for r in saves.collect()) == ["One", "Two"] and [r["backup"] for r in backups.collect()] == ["d", "2026 One"]


def test_accents_and_ranked_identities(spark):
    names = [r[0] for r in spark.range(60).select(formats.accent(F.col("id").cast("string"))).collect()]
    assert set(names) == {"moss", "copper", "quartz", "slate"} and names[0] == spark.range(1).select(formats.accent(F.lit("0"))).first()[0]
    rows = spark.createDataFrame([("b", "u1", False), ("A", "u2", False), ("c", None, True), ("d", "u3", False)], "name string, uuid string, active boolean")
    counts = spark.createDataFrame([("u3", 2)], "uuid string, files long")
    assert [r["name"] for r in profile.ranked_identities(rows, counts).collect()] == ["d", "c", "A", "b"]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,\"b\"\n", ["x", None]), (2, None, [])], "k long, name string, places array<string>")
    sinks.export(rows, f"{tmp_path}/j")
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/j").collect()) == [(1, 'a,"b"\n', ["x", None]), (2, None, [])]
    sinks.export(rows, f"{tmp_path}/c", "csv", ("name",))
    text = spark.read.option("header", "true").option("escape", '"').csv(f"{tmp_path}/c").orderBy("k").collect()
    assert text[0]["name"].startswith("hidden-") and text[0]["places"] == '["x",null]' and text[1]["name"] is None
    with pytest.raises(ValueError):
        sinks.export(rows, f"{tmp_path}/x", "xml")
    staged = {r["stage_key"]: r["payload_json"] for r in sinks.staged(rows.drop("places").union(rows.drop("places")), "k").collect()}
    assert staged == {1: '{"name":"a,\\"b\\"\\n"}', 2: '{"name":null}'}


def test_orphans_take_more_tasks_for_more_keys(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "KEYS_A_TASK", 10)
    sessions = spark.createDataFrame([(k,) for k in [*range(60), 59, 200]], "session_id long")
    segments = spark.createDataFrame([(k,) for k in [*range(10, 59), *range(10, 59), 100, 100]], "session_id long")
    out = reconcile.orphans(sessions, segments)
    assert out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(session_id#") == 4
    assert out._jdf.queryExecution().executedPlan().toString().count(", 17), ") == 4
    assert sorted(map(tuple, out.collect())) == [("segment", 100), *[("session", k) for k in [*range(10), 59, 59, 200]]]
