"""Queries over files: inventory, decisions, budgets and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from playloom.operators import budgets, discovery, ingest, reconcile
from playloom.operators.reconstruct import dedupe_exact as mark_copies
from playloom.shared import table
from playloom.sources import inventory
from playloom.sources.archive import ARCHIVE_SQL
from playloom.sources.inventory import FILES_SQL


def _decided(spark, sf_dir):
    return ingest.decide(inventory.current(spark, sf_dir), inventory.prior(spark, sf_dir))


def _missing(spark, sf_dir):
    scope = inventory.files(spark, sf_dir).select("instance_id").distinct().filter("instance_id <> 'src3'")
    return ingest.missing(inventory.current(spark, sf_dir), inventory.prior(spark, sf_dir), scope)


def classify_source(spark, sf_dir):
    return inventory.files(spark, sf_dir).select("file_id", inventory.classify(F.col("path")).alias("kind"))


def group_instances(spark, sf_dir):
    """Logs by the folder above their logs folder; ``instances/<name>`` names the instance."""
    parts = F.split("path", "/")
    rows = inventory.files(spark, sf_dir).filter("path ilike '%logs/%'").withColumn("root", F.array_join(F.slice(parts, 1, F.array_position(parts, "logs").cast("int") - 1), "/"))
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("files")).withColumn("name", F.when(F.col("root").startswith("instances/"), F.element_at(F.split("root", "/"), 2)))


def rotation_order(spark, sf_dir):
    rows = inventory.files(spark, sf_dir).filter("path like '%logs/%'")
    return inventory.rotations(rows).select("file_id", "instance_id", "rotation", "date_hint")


def dedupe_exact(spark, sf_dir):
    rows = inventory.files(spark, sf_dir).select("instance_id", F.col("file_id").alias("source_id"), F.col("mtime_ms").alias("source_order"), F.sha2("content", 256).alias("content_hash"))
    return mark_copies(rows).select("source_id", "copy")


def fingerprint(spark, sf_dir):
    """Hash of the whole, of the first 64 KiB, size and time of each file."""
    return inventory.files(spark, sf_dir).select("file_id", "size", "mtime_ms", F.sha2("content", 256).alias("hash"), F.sha2(F.substring(F.col("content"), F.lit(1), F.lit(65536)), 256).alias("prefix_hash"))


def file_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("file_id", "decision", "generation")


def scan_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("files"))


def scan_mode_filter(spark, sf_dir):
    decided, out = _decided(spark, sf_dir), None
    for mode in ("quick", "standard", "deep"):
        one = ingest.mode_filter(decided, mode).groupBy("instance_id").agg(F.count(F.lit(1)).alias("files")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def replace_all_flag(spark, sf_dir):
    return ingest.replace_all(_decided(spark, sf_dir), _missing(spark, sf_dir))


def budget_cut(spark, sf_dir):
    return ingest.budget_cut(_decided(spark, sf_dir), 10_000, 100_000_000, 1_000_000)


#: Limits that the documents as logs break here and there.
LIMITS = budgets.Limits(
    instance_logs=18, instance_bytes=45_000, instance_events=5_000, instance_sessions=16, session_destinations=57, session_versions=64, session_links=9_000, destination_bytes=512, version_bytes=256,
    scan_logs=520, scan_bytes=2_600_000, scan_events=200_000, scan_sessions=400, scan_contexts=9_000, failed_bytes=20_000, failed_events=900,
)


def scan_budgets(spark, sf_dir):
    """Twelve documents as the logs of an instance, every fifth with more of them; each gives one session."""
    k, n = F.col("doc_id"), F.char_length("text")
    rows = table(spark, sf_dir, "documents").withColumn("instance_id", F.when(k % 5 == 0, F.floor(k / 60) * 5).otherwise(F.floor(k / 12)))
    files = rows.select("instance_id", k.alias("file_order"), (k % 41 != 7).alias("ok"), n.cast("long").alias("bytes"), (n % 997).cast("long").alias("events"),
                        (k % 521).alias("longest_destination"), (k % 260).alias("longest_version"))
    sessions = rows.select("instance_id", (k % 59).alias("destinations"), (k % 67).alias("versions"), n.alias("links"))
    return budgets.judge(files, sessions, LIMITS)


def _revisions(spark, sf_dir):
    """Orders as revisions of a path for each customer, lineitems as evidence; links by arithmetic on the keys."""
    key = F.col("o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    kind = F.when(key % 3 == 0, "replaced").otherwise("appended")
    revisions = orders.select(key.alias("revision_id"), F.col("o_custkey").alias("path_id"), F.row_number().over(order).alias("generation"), kind.alias("change_kind"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("revision_id"), "l_linenumber", "l_partkey", "l_suppkey")
    links = lines.select((F.col("revision_id") % 503).alias("session_id"), "evidence_id")
    links = links.unionByName(lines.filter("l_linenumber = 1").select((F.col("l_partkey") % 503).alias("session_id"), "evidence_id")).distinct()
    sources = orders.select((key % 503).alias("session_id"), key.alias("revision_id"))
    return revisions, lines, links, sources


def reconcile_rotation(spark, sf_dir):
    """Links and evidence that are left after every fifth order came as a new revision of its session."""
    revisions, lines, links, sources = _revisions(spark, sf_dir)
    incoming = sources.filter("revision_id % 5 = 0")
    kept = reconcile.reconcile(sources, links, lines.select("evidence_id", "revision_id"), revisions, incoming)
    parts = [rows.select(F.lit(name).alias("part"), F.col(a).alias("a"), F.col(b).alias("b")) for name, rows, (a, b) in zip(("source", "link", "evidence"), kept, (("session_id", "revision_id"), ("session_id", "evidence_id"), ("evidence_id", "revision_id")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cascade_deletes(spark, sf_dir):
    """What is left of each table after every thirteenth session was deleted."""
    _, lines, links, sources = _revisions(spark, sf_dir)
    segments = lines.select((F.col("revision_id") % 503).alias("session_id"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey")).alias("server_id"))
    tables = {
        "sessions": sources.select("session_id").distinct(), "session_sources": sources, "session_evidence": links, "segments": segments,
        "evidence": lines.select("evidence_id", "revision_id"), "servers": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server_id")),
    }
    left = reconcile.cascade(tables, tables["sessions"].filter("session_id % 13 = 0"))
    rows = [left[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.sum(key).alias("keys")) for name, key in (
        ("sessions", "session_id"), ("session_sources", "revision_id"), ("session_evidence", "evidence_id"), ("segments", "server_id"), ("evidence", "evidence_id"), ("servers", "server_id"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def complete_instances(spark, sf_dir):
    return ingest.complete_instances(inventory.files(spark, sf_dir).select("instance_id", (F.col("file_id") % 97 != 5).alias("ok")))


def protected_sessions(spark, sf_dir):
    """Each file linked to sessions by its number; generations as decided."""
    links = inventory.prior(spark, sf_dir).select((F.col("file_id") % 211).alias("session_id"), "file_id", "generation")
    return ingest.protected(links, _missing(spark, sf_dir), _decided(spark, sf_dir).filter("decision = 'replaced'").select("file_id", "generation"))


def promoted(spark, sf_dir):
    """Sessions after a promotion that adds one fresh session per new file."""
    prior = inventory.prior(spark, sf_dir)
    links = prior.select((F.col("file_id") % 211).alias("session_id"), "file_id", "generation")
    decided = _decided(spark, sf_dir)
    fresh_links = decided.filter("decision = 'new'").select((F.col("file_id") + 1000).alias("session_id"), "file_id", "generation")
    sessions, _ = ingest.promote(links.select("session_id").distinct(), links, decided, _missing(spark, sf_dir), fresh_links.select("session_id").distinct(), fresh_links)
    return sessions


def upsert_servers(spark, sf_dir):
    """Stored servers (even keys) merged with those seen now (keys divisible by 3)."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server_id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("display_name"), (F.col("s_suppkey") * 10).alias("first_ms"), (F.col("s_suppkey") * 20).alias("last_ms"))
    seen = rows.filter("server_id % 3 = 0").withColumns({"first_ms": F.col("first_ms") - 5, "last_ms": F.col("last_ms") - 5, "display_name": F.when(F.col("server_id") % 2 == 0, F.lit("seen"))})
    return ingest.upsert(rows.filter("server_id % 2 = 0"), seen, "server_id", ["display_name"], ["first_ms"], ["last_ms"])


def validation_score(spark, sf_dir):
    """Every customer read as a folder with the markers that its key's bits show, once as a game folder and once as a launcher's."""
    key = F.col("c_custkey")
    markers = {name: F.shiftright(key, k).bitwiseAND(1) == 1 for k, name in enumerate(ingest.GAME_MARKERS)}
    score, good = ingest.validation_score(markers)
    root, fine = ingest.launcher_score(key % 2 == 0, (key % 3).cast("int"), (key % 7).cast("int"))
    return table(spark, sf_dir, "customer").select(key.alias("folder_id"), score.cast("int").alias("score"), good.alias("supported"), root.cast("int").alias("root_score"), fine.alias("root_supported"))


#: Paths of every kind of file, some in other cases of letters, and what they are ({n} is a number).
PATHS = [
    ("a/logs/{n}.log", "log"), ("a/LOGS/deep/{n}.log.gz", "compressed_log"), ("saves/w{n}/level.dat", "level"), ("servers.dat", "servers"), ("b/mods/m{n}.JAR", "mod"),
    ("saves/w/stats/u{n}.json", "statistics"), ("saves/w/advancements/u{n}.json", "advancements"), ("crash-reports/c{n}.txt", "crash_report"), ("screenshots/s{n}.PNG", "screenshot"),
    ("screenshots/s{n}.jpeg", "screenshot"), ("screenshots/s{n}.bmp", "other"), ("logsx/{n}.log", "other"), ("config/{n}.json", "other"), ("{n}.log", "other"), ("mods/readme{n}.txt", "other"),
]


def classified_paths(spark, sf_dir):
    """Documents as files of every kind."""
    k = F.col("doc_id")
    path = F.replace(F.get(F.array(*[F.lit(p) for p, _ in PATHS]), (k % len(PATHS)).cast("int")), F.lit("{n}"), k.cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("kind", inventory.classify(F.col("path")))


def discover_overlay(spark, sf_dir):
    """Folders found now (keys not divisible by 3) over those saved (even keys): saved state wins, saved-only folders are off."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path_key"), (F.col("c_custkey") % 101).cast("int").alias("score"))
    return discovery.overlay(rows.filter("path_key % 3 <> 0"), rows.filter("path_key % 2 = 0").withColumn("enabled", F.col("path_key") % 4 == 0))


def _folders(spark, sf_dir):
    """Every customer as a folder: the bits of its key as markers, of seven times its key as those of a game folder inside."""
    key = F.col("c_custkey")
    bits = lambda value: {name: F.shiftright(value, k).bitwiseAND(1) == 1 for k, name in enumerate(ingest.GAME_MARKERS)}
    launcher = (key % 11 == 0, (key % 3).cast("int"), (key % 7).cast("int"))
    beside = {"instance.cfg": key % 3 == 0, "mmc-pack.json": key % 5 == 0}
    rows = table(spark, sf_dir, "customer").select(key)
    return discovery.validated(rows, launcher, bits(key * 7 % 128), beside, key % 4 == 0, bits(key)).withColumnRenamed("c_custkey", "folder_id")


def validated_folders(spark, sf_dir):
    return _folders(spark, sf_dir).withColumn("markers", F.array_join("markers", ","))


def added_locations(spark, sf_dir):
    """Folders that users chose, over every fourth saved before; rejected ones come with the reason."""
    name = F.concat(F.lit("folder "), F.col("folder_id").cast("string"))
    path = F.when(F.col("folder_id") % 17 == 0, " ").otherwise(F.concat(F.lit("/games/"), F.col("folder_id").cast("string")))
    asked = _folders(spark, sf_dir).filter("folder_id % 3 = 0").select(path.alias("path_key"), name.alias("name"), "kind", "score", "markers")
    saved = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("/games/"), F.col("c_custkey").cast("string")).alias("path_key"), F.lit("saved").alias("name"), F.lit("game").alias("kind"), F.lit(1).alias("score"))
    kept, rejected = discovery.add_locations(saved, asked)
    none = F.lit(None).cast("string")
    return kept.select("path_key", "name", "kind", "score", none.alias("reason")).unionByName(rejected.select("path_key", none.alias("name"), none.alias("kind"), "score", "reason"))


def newest_run(spark, sf_dir):
    """Customers as scans of which some have ended, orders as their messages."""
    state = F.get(F.array(*[F.lit(x) for x in ("running", "completed", "failed", "queued")]), (F.col("c_custkey") % 4).cast("int"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scan_id"), state.alias("state"), (F.col("c_custkey") % 50).alias("requested_ms"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 60).alias("finished_ms"))
    severity = F.when(F.col("o_orderkey") % 3 == 0, "warning").when(F.col("o_orderkey") % 3 == 1, "error").otherwise("info")
    messages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), F.col("o_orderkey").alias("message_id"), (F.col("o_orderkey") % 97).alias("created_ms"), severity.alias("severity"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("text"))
    return discovery.newest_run(runs, messages, 5).withColumn("messages", F.array_join("messages", ","))


def segment_servers(spark, sf_dir):
    """Orphans both ways of the session and segment tables: sessions without a segment, segments without a visible session."""
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"))
    segments = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    return reconcile.orphans(sessions, segments)


QUERIES = {f.__name__: f for f in (
    classify_source, group_instances, rotation_order, dedupe_exact, fingerprint, file_decision, scan_counts, scan_mode_filter, replace_all_flag, budget_cut, complete_instances,
    protected_sessions, upsert_servers, validation_score, discover_overlay)}
QUERIES |= {"classified_paths": classified_paths}
QUERIES |= {"validated_folders": validated_folders, "added_locations": added_locations, "newest_run": newest_run}
QUERIES |= {"scan_budgets": scan_budgets, "reconcile_rotation": reconcile_rotation, "cascade_deletes": cascade_deletes}
QUERIES |= {"missing_sources": _missing, "promote": promoted, "orphans": segment_servers}

_MISSING = """, missing as (select file_id, prior_instance as instance_id from prior where file_id not in (select file_id from cur) and prior_instance <> 'src3'),
generations as (select *, generation + case when decision = 'unchanged' then 0 else 1 end as next_generation from decided),
links as (select file_id % 211 as session_id, file_id, generation from prior),
protected as (
    select session_id from links where file_id in (select file_id from missing) union
    select l.session_id from links l join generations g using (file_id) where decision = 'replaced' and l.generation < g.next_generation)"""


_REVISIONS = """revisions as (
        select o_orderkey as revision_id, o_custkey as path_id, row_number() over (partition by o_custkey order by o_orderkey) as generation, case when o_orderkey % 3 =
            0 then 'replaced' else 'appended' end as change_kind from orders),
        evidence as (select l_orderkey * 10 + l_linenumber as evidence_id, l_orderkey as revision_id, l_linenumber, l_partkey, l_suppkey from lineitem),
        links as (select revision_id % 503 as session_id, evidence_id from evidence union select l_partkey % 503, evidence_id from evidence where l_linenumber = 1),
        sources as (select o_orderkey % 503 as session_id, o_orderkey as revision_id from orders)"""


def _sql(select: str, *parts: str) -> str:
    return f"with {FILES_SQL}{''.join(parts)}\n{select}"


_WEIGHTS = " + ".join(f"(({{0}} >> {k}) & 1) * {w}" for k, w in enumerate(ingest.GAME_MARKERS.values()))
_NAMES = ", ".join(f"case when ({{0}} >> {k}) & 1 = 1 then '{name}' end" for k, name in enumerate(ingest.GAME_MARKERS))
_FOLDERS = f"""bits as (
        select c_custkey as k, c_custkey * 7 % 128 as c, least(100, {_WEIGHTS.format("c_custkey")}) as g, bit_count(c_custkey & 127) as n, least(100,
            {_WEIGHTS.format("(c_custkey * 7 % 128)")}) as cg,
               least(100, case when c_custkey % 11 = 0 then 25 else 0 end + 30 * (c_custkey % 3) + case when c_custkey % 7 > 0 then 25 + 5 * least(c_custkey % 7, 4) else
                   0 end) as l from customer),
        kinds as (select *, case when k % 11 = 0 and (k % 3 > 0 or k % 7 > 0) then 'launcher' when k % 4 = 0 and bit_count(c) >= 2 and cg >= 30 then 'instance' when n >=
            2 and g >= 30 then 'game' else 'unknown' end as kind from bits),
        folders as (select k as folder_id, kind, (case kind when 'launcher' then l when 'instance' then least(100, cg + 10) when 'game' then g else 0 end)::integer as score,
            (case kind when 'launcher' then k % 7 when 'unknown' then 0 else 1 end)::bigint as instances,
            list_sort(list_filter(case kind when 'launcher' then ['instances'] when 'instance' then ['.minecraft', case when k % 3 = 0 then 'instance.cfg' end, case when
                k % 5 = 0 then 'mmc-pack.json' end, {_NAMES.format("c")}]
                when 'game' then [{_NAMES.format("k")}] else [] end, lambda x: x is not null)) as markers from kinds)"""
ORACLE_SQL = {
    "classified_paths": "select doc_id, replace(path, '{n}', doc_id::varchar) as path, kind from documents join (values "
    + ", ".join(f"({k}, '{p}', '{kind}')" for k, (p, kind) in enumerate(PATHS)) + f") p(k, path, kind) on k = doc_id % {len(PATHS)}",
    "validated_folders": f"with {_FOLDERS} select folder_id, kind, score, instances, array_to_string(markers, ',') as markers from folders",
    "added_locations": f"""with {_FOLDERS}, asked as (select case when folder_id % 17 = 0 then ' ' else '/games/' || folder_id end as path_key, 'folder ' || folder_id as name, kind, score, markers from folders where folder_id % 3 = 0),
        judged as (select *, case when trim(path_key) = '' then 'The selected path is empty.' when kind <> 'unknown' then null when len(markers) = 0 then
            'No recognized Minecraft directory markers were found.'
            else 'Only these markers were found: ' || array_to_string(markers, ', ') || '.' end as reason from asked),
        saved as (select '/games/' || c_custkey as path_key, 'saved' as name, 'game' as kind, 1 as score from customer where c_custkey % 4 = 0)
        select coalesce(a.path_key, s.path_key) as path_key, coalesce(a.name, s.name) as name, coalesce(a.kind, s.kind) as kind, coalesce(a.score, s.score)::integer as
            score, null as reason
            from (select * from judged where reason is null) a full join saved s on s.path_key = a.path_key
        union all select path_key, null, null, case when trim(path_key) = '' then 0 else score end, reason from judged where reason is not null""",
    "newest_run": """with r as (select c_custkey as id, (['running', 'completed', 'failed', 'queued'])[c_custkey % 4 + 1] as state, c_custkey % 50 as requested, case when c_custkey % 3 > 0 then c_custkey % 60 end as finished from customer),
        last as (select * from r where state in ('completed', 'failed') order by coalesce(finished, requested) desc, requested desc, id desc limit 1),
        m as (select o_orderkey as k from orders where o_custkey = (select id from last))
        select id as scan_id, state, (select count(*) from m where k % 3 = 0) as warnings, (select count(*) from m where k % 3 = 1) as errors,
               coalesce((select string_agg('m' || k, ',' order by k % 97, k) from (select k from m order by k % 97 desc, k desc limit 5)), '') as messages from last""",
    "classify_source": _sql("""select file_id, case when path like '%logs/%' and lower(path) like '%.log.gz' then 'compressed_log' when path like '%logs/%' and lower(path) like '%.log' then 'log'
        when path like '%level.dat' then 'level' else 'statistics' end as kind from files"""),
    "group_instances": _sql("""select root, count(*) as files, case when root <> '' then instance_id end as name
        from (select *, case when file_id % 3 = 0 then '' else 'instances/' || instance_id end as root from files where path like '%logs/%') group by root, case when root <> '' then instance_id end"""),
    "rotation_order": _sql(r"""select file_id, instance_id, (row_number() over (partition by instance_id order by k, case when k = 0 then d end nulls first, case when k = 0 then n end nulls first, case when k = 1 then mtime_ms end nulls first, path, file_id))::integer as rotation,
        case when k = 0 then d end as date_hint from (
            select *, case when path like '%/latest.log' or path = 'logs/latest.log' then 2 when path like '%2026-%' then 0 else 1 end as k,
                   regexp_extract(path, '(2026-08-[0-9]{2})', 1) as d, try_cast(regexp_extract(path, '2026-08-[0-9]{2}-([0-9]+)', 1) as bigint) as n from files where path like '%logs/%')"""),
    "dedupe_exact": _sql("select file_id as source_id, row_number() over (partition by instance_id, text order by mtime_ms, file_id) > 1 as copy from files"),
    "file_decision": _sql("select file_id, decision, next_generation as generation from generations", _MISSING),
    "scan_counts": _sql("select decision, count(*) as files from decided group by 1"),
    "scan_mode_filter": _sql("""select instance_id, count(*) as files, 'quick' as mode from decided where path like '%latest.log' group by 1 union all
        select instance_id, count(*), 'standard' from decided where instance_id in (select instance_id from decided where decision <> 'unchanged') group by 1 union all
        select instance_id, count(*), 'deep' from decided group by 1"""),
    "missing_sources": _sql("select * from missing", _MISSING),
    "replace_all_flag": _sql("""select instance_id, count(*) filter (where decision = 'replaced') as replaced, coalesce(any_value(n), 0) as missing,
        count(*) filter (where decision = 'replaced') = 0 and coalesce(any_value(n), 0) = 0 as replace_all
        from decided left join (select instance_id, count(*) as n from missing group by 1) using (instance_id) group by 1""", _MISSING),
    "scan_budgets": """with f as (
            select case when doc_id % 5 = 0 then doc_id // 60 * 5 else doc_id // 12 end as instance_id, doc_id as k, doc_id % 41 <> 7 as ok, length(text) as bytes,
                length(text) % 997 as events, doc_id % 521 as ld, doc_id % 260 as lv from documents),
        c as (select *, count(*) over (partition by instance_id) as files, sum(case when ok then bytes else 0 end) over w as rb, sum(case when ok then events else 0 end)
            over w as re from f window w as (partition by instance_id order by k)),
        b as (select *, case when ok then case when ld > 512 then 'destination bytes' when lv > 256 then 'version bytes' when rb > 45000 then 'bytes' when re > 5000 then
            'events' end end as broken from c where files <= 18),
        r as (select *, count(broken) over (partition by instance_id order by k rows between unbounded preceding and 1 preceding) as earlier from b),
        p as (select instance_id, count(*) as logs, sum(case when ok then bytes else 20000 end) as bytes, sum(case when ok then events else 900 end) as events,
            max(broken) as broken, bool_and(ok) as whole from r where earlier = 0 group by 1),
        s as (select instance_id, count(*) as sessions, sum(k % 59) as contexts, max(k % 59) as d, max(k % 67) as v, max(bytes) as l from f group by 1),
        j as (select instance_id, coalesce(logs, 0) as logs, coalesce(p.bytes, 0) as bytes, coalesce(p.events, 0) as events, sessions, contexts,
                     case when whole is null or broken is not null then 'instance_limit' when not whole then 'failed_parse' when sessions > 16 or d > 57 or v > 64 or l >
                         9000 then 'session_limit' else 'taken' end as status,
                     case when whole is null then 'logs' when broken is not null then broken when whole then case when sessions > 16 then 'sessions' when d > 57 then
                         'destinations' when v > 64 then 'versions' when l > 9000 then 'links' end end as resource
              from s left join p using (instance_id)),
        t as (select *, sum(logs) over w as al, sum(bytes) over w as ab, sum(events) over w as ae, sum(case when status = 'taken' then sessions else 0 end) over w as ss,
                     sum(case when status = 'taken' then contexts else 0 end) over w as ac from j window w as (order by instance_id)),
        o as (select *, case when al > 520 then 'logs' when ab > 2600000 then 'bytes' when ae > 200000 then 'events' when ss > 400 then 'sessions' when ac > 9000 then
            'contexts' end as over from t),
        e as (select min(instance_id) as e from o where over is not null)
        select instance_id, case when instance_id = e then 'scan_limit' when instance_id > e then 'deferred' else status end as status,
               case when instance_id = e then over when instance_id > e then null else resource end as resource from o, e""",
    "reconcile_rotation": f"""with {_REVISIONS}, last as (select path_id, max(generation) as g from revisions where change_kind = 'replaced' group by 1),
        gone as (select distinct s.session_id, s.revision_id from sources s join revisions r using (revision_id) join last l on l.path_id = r.path_id and r.generation < l.g
                 where exists (select 1 from sources i where i.session_id = s.session_id and i.revision_id % 5 = 0 and i.revision_id <> s.revision_id)),
        left_links as (select * from links l where not exists (select 1 from evidence e join gone g using (revision_id) where e.evidence_id = l.evidence_id and
            g.session_id = l.session_id))
        select 'source' as part, session_id as a, revision_id as b from sources s where not exists (select 1 from gone g where g.session_id = s.session_id and
            g.revision_id = s.revision_id)
        union all select 'link', session_id, evidence_id from left_links
        union all select 'evidence', evidence_id, revision_id from evidence where revision_id not in (select revision_id from gone) or evidence_id in (select evidence_id from left_links)""",
    "cascade_deletes": f"""with {_REVISIONS}, left_links as (select * from links where session_id % 13 <> 0),
        touched as (select revision_id from sources where session_id % 13 = 0),
        segments as (select revision_id % 503 as session_id, case when l_linenumber > 1 then l_suppkey end as server_id from evidence),
        left_segments as (select * from segments where session_id % 13 <> 0)
        select 'sessions' as part, count(*) as rows, sum(session_id)::bigint as keys from (select distinct session_id from sources where session_id % 13 <> 0)
        union all select 'session_sources', count(*), sum(revision_id)::bigint from sources where session_id % 13 <> 0
        union all select 'session_evidence', count(*), sum(evidence_id)::bigint from left_links
        union all select 'segments', count(*), sum(server_id)::bigint from left_segments
        union all select 'evidence', count(*), sum(evidence_id)::bigint from evidence where revision_id not in (select revision_id from touched) or evidence_id in
            (select evidence_id from left_links)
        union all select 'servers', count(*), sum(s_suppkey)::bigint from supplier where s_suppkey not in (select server_id from segments where session_id % 13 = 0 and
            server_id is not null)
            or s_suppkey in (select server_id from left_segments where server_id is not null)""",
    "budget_cut": _sql("""select instance_id, files, bytes, fits, fits and used <= 1000000 as taken from (
        select *, sum(case when fits then bytes else 0 end) over (order by instance_id) as used from (
            select instance_id, count(*) as files, sum(size)::bigint as bytes, count(*) <= 10000 and sum(size) <= 100000000 as fits from decided group by 1))"""),
    "complete_instances": _sql("select instance_id from files group by 1 having count(*) filter (where file_id % 97 = 5) = 0"),
    "protected_sessions": _sql("select session_id from protected", _MISSING),
    "promote": _sql("""select distinct session_id from links where session_id not in (
            select session_id from links where file_id in (select file_id from decided where decision in ('appended', 'reparse', 'unchanged')) and session_id not in
                (select session_id from protected))
        union select file_id + 1000 from decided where decision = 'new'""", _MISSING),
    "upsert_servers": """select coalesce(n.k, o.k) as server_id, coalesce(n.d, o.d) as display_name, least(n.f, o.f) as first_ms, greatest(n.l, o.l) as last_ms
        from (select s_suppkey as k, case when s_suppkey % 4 <> 0 then s_name end as d, s_suppkey * 10 as f, s_suppkey * 20 as l from supplier where s_suppkey % 2 = 0) o
        full join (select s_suppkey as k, case when s_suppkey % 2 = 0 then 'seen' end as d, s_suppkey * 10 - 5 as f, s_suppkey * 20 - 5 as l from supplier where s_suppkey % 3 = 0) n on n.k = o.k""",
    "validation_score": """select c_custkey as folder_id, score, n >= 2 and score >= 30 as supported, root_score, c_custkey % 2 = 0 and (c_custkey % 3 > 0 or c_custkey % 7 > 0) as root_supported from (
        select c_custkey, least(100, (c_custkey & 1) * 25 + ((c_custkey >> 1) & 1) * 18 + ((c_custkey >> 2) & 1) * 12 + ((c_custkey >> 3) & 1) * 18 + ((c_custkey >> 4) &
            1) * 15 + ((c_custkey >> 5) & 1) * 8 + ((c_custkey >> 6) & 1) * 8)::integer as score,
               bit_count(c_custkey & 127) as n, least(100, case when c_custkey % 2 = 0 then 25 else 0 end + 30 * (c_custkey % 3) + case when c_custkey % 7 > 0 then 25 + 5 * least(c_custkey % 7, 4) else 0 end)::integer as root_score from customer)""",
    "discover_overlay": """select coalesce(f.k, s.k) as path_key, case when f.k is null then false else coalesce(s.k % 4 = 0, true) end as enabled, (coalesce(f.k, s.k) % 101)::integer as score, f.k is not null as available
        from (select c_custkey as k from customer where c_custkey % 3 <> 0) f full join (select c_custkey as k from customer where c_custkey % 2 = 0) s on f.k = s.k""",
    "orphans": f"""with {ARCHIVE_SQL} select 'session' as kind, session_id from sessions where session_id not in (select session_id from segments)
        union all select distinct 'segment', session_id from segments where session_id not in (select session_id from sessions)""",
    "fingerprint": _sql("select file_id, size, mtime_ms, sha256(text) as hash, case when size <= 65536 then sha256(text) else sha256(encode(text)[1:65536]) end as prefix_hash from files"),
}
