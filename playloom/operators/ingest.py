"""Incremental ingest: decide per file, guard budgets, merge snapshots without losing history."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playloom.functions.core import ascii_lower
from playloom.operators.prefix import running_sums
from playloom.shared import materialize
from playloom.sources.inventory import REVISION

#: Budgets of one instance and one scan.
INSTANCE_LOGS, INSTANCE_BYTES, SCAN_BYTES = 4096, 512 << 20, 2 << 30
#: Weights of what a game folder and a launcher folder show (fixed values).
GAME_MARKERS = {"logs": 25, "versions": 18, "saves": 12, "options": 18, "launcher_profiles": 15, "assets": 8, "libraries": 8}


def decide(now: DataFrame, before: DataFrame, revision: int = REVISION) -> DataFrame:
    """new, reparse, unchanged, appended or replaced for each file of the inventory, and its generation."""
    joined = now.join(before, "file_id", "left")
    head = F.sha2(F.substring(F.col("content"), F.lit(1), F.col("prior_size").cast("int")), 256)
    decision = (
        F.when(F.col("prior_hash").isNull(), "new").when(~F.col("parsed_ok") | (F.col("revision") != revision), "reparse")
        .when((F.col("size") == F.col("prior_size")) & (F.col("hash") == F.col("prior_hash")), "unchanged")
        .when((F.col("size") > F.col("prior_size")) & (head == F.col("prior_hash")), "appended").otherwise("replaced")
    )
    rows = joined.withColumn("decision", decision)
    generation = F.coalesce("generation", F.lit(0)) + F.when(F.col("decision") == "unchanged", 0).otherwise(1)
    return rows.select("file_id", "instance_id", "path", "size", "hash", "decision", generation.cast("long").alias("generation"))


def missing(now: DataFrame, before: DataFrame, complete: DataFrame) -> DataFrame:
    """Files of the generation before that a complete scope no longer has."""
    gone = before.join(now.select("file_id"), "file_id", "left_anti")
    return gone.join(complete, gone["prior_instance"].eqNullSafe(complete["instance_id"]), "left_semi").select("file_id", F.col("prior_instance").alias("instance_id"))


def mode_filter(decided: DataFrame, mode: str) -> DataFrame:
    """quick: plain current files only; standard: all files of instances with a change; deep: all files."""
    if mode == "quick":
        return decided.filter(ascii_lower(F.element_at(F.split("path", "/"), -1)) == "latest.log")
    if mode == "standard":
        return decided.join(decided.filter("decision <> 'unchanged'").select("instance_id").distinct(), "instance_id", "left_semi")
    return decided


def replace_all(decided: DataFrame, gone: DataFrame) -> DataFrame:
    """Whether an instance's sessions may be replaced as a whole: nothing missing, nothing replaced."""
    per = decided.groupBy("instance_id").agg(F.count_if(F.col("decision") == "replaced").alias("replaced"))
    lost = gone.groupBy("instance_id").agg(F.count(F.lit(1)).alias("missing"))
    rows = per.join(lost, "instance_id", "left").fillna({"missing": 0})
    return rows.withColumn("replace_all", (F.col("replaced") == 0) & (F.col("missing") == 0))


def complete_instances(parsed: DataFrame) -> DataFrame:
    """All or nothing: instances none of whose files failed (columns instance_id, ok)."""
    return parsed.groupBy("instance_id").agg(F.bool_and("ok").alias("complete")).filter("complete").select("instance_id")


def budget_cut(decided: DataFrame, instance_logs: int = INSTANCE_LOGS, instance_bytes: int = INSTANCE_BYTES, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """Instances within their own budget, taken in order until the scan's budget is used up.

    Files are summed per instance first; running sums over the instances come in two levels.
    """
    per = decided.groupBy("instance_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    per = per.withColumn("fits", (F.col("files") <= instance_logs) & (F.col("bytes") <= instance_bytes))
    charged = per.withColumn("charged", F.when(F.col("fits"), F.col("bytes")).otherwise(0))
    return running_sums(charged, "instance_id", {"used": "charged"}).withColumn("taken", F.col("fits") & (F.col("used") <= scan_bytes)).drop("charged", "used")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], least: list[str], most: list[str]) -> DataFrame:
    """Rows by key: new values win unless null (``keep``), or the smaller (``least``) or larger (``most``) of both."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    pick = lambda f, c: f(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[pick(F.coalesce, c).alias(c) for c in keep], *[pick(F.least, c).alias(c) for c in least], *[pick(F.greatest, c).alias(c) for c in most])


def protected(links: DataFrame, gone: DataFrame, replaced: DataFrame) -> DataFrame:
    """Sessions that a promotion must keep: linked to a missing file, or to a generation that a replacement followed."""
    lost = links.join(gone, "file_id", "left_semi").select("session_id")
    old = links.join(replaced, (links["file_id"] == replaced["file_id"]) & (links["generation"] < replaced["generation"]), "left_semi").select("session_id")
    return lost.unionByName(old).distinct()


def promote(sessions: DataFrame, links: DataFrame, decided: DataFrame, gone: DataFrame, fresh: DataFrame, fresh_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of (sessions, links): appended, reparsed and unchanged files give up their older sessions unless those are protected."""
    keep = protected(links, gone, decided.filter("decision = 'replaced'").select("file_id", "generation"))
    known = ("new", "replaced", "appended", "reparse", "unchanged")
    if not decided.filter(~F.col("decision").isin(*known)).isEmpty():
        raise ValueError("unknown decision")
    redone = decided.filter("decision in ('appended', 'reparse', 'unchanged')").select("file_id")
    dropped = links.join(redone, "file_id", "left_semi").select("session_id").distinct().join(keep, "session_id", "left_anti")
    dropped = materialize(dropped, "promote-dropped")
    kept = sessions.join(dropped, "session_id", "left_anti").join(fresh, "session_id", "left_anti").unionByName(fresh)
    return kept, links.join(dropped, "session_id", "left_anti").unionByName(fresh_links).distinct()


def validation_score(markers: dict[str, Column], weights: dict[str, int] = GAME_MARKERS) -> tuple[Column, Column]:
    """(score up to 100, whether the folder is supported: two markers and a score of 30)."""
    score, n = F.lit(0), F.lit(0)
    for name, there in markers.items():
        score, n = score + F.when(there, weights[name]).otherwise(0), n + there.cast("int")
    score = F.least(F.lit(100), score)
    return score, (n >= 2) & (score >= 30)


def launcher_score(instances_folder: Column, config_files: Column, found: Column) -> tuple[Column, Column]:
    """(score, supported) of a launcher's root folder."""
    some = F.when(found > 0, 25 + 5 * F.least(found, F.lit(4))).otherwise(0)
    score = F.least(F.lit(100), F.when(instances_folder, 25).otherwise(0) + 30 * config_files + some)
    return score, instances_folder & ((config_files > 0) | (found > 0))


class LeaseHeld(RuntimeError):
    """Another writer holds the lease, or took it over."""


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order: their number and two sums of row hashes."""
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    nulls = [c.isNull() for c in columns]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns, *nulls).cast("decimal(38,0)")) for seed in (1, 2)]
    return "-".join(str(v) for v in rows.agg(F.count(F.lit(1)), *sums).first())


class Snapshots:
    """Versions of a set of tables in a shared folder; the manifest names the current one and is written last.

    At most one writer works at a time: it holds a lease with a fencing number, which a commit checks. A lease that ran out can be
    taken over; the writer before is then refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _newest(self, kind: str) -> int:
        """The largest number of files ``<kind>-<number>.json``, 0 for none."""
        found = self._fs.globStatus(self._path(f"{kind}-*.json"))
        return max((int(f.getPath().getName()[len(kind) + 1 : -5]) for f in found or ()), default=0)

    def _json(self, name: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.root}/{name}").first()["value"])

    def _create(self, name: str, content: dict) -> None:
        """Writes a file that must not exist yet."""
        out = self._fs.create(self._path(name), False)
        out.write(json.dumps(content).encode())
        out.close()

    def revision(self) -> int:
        """0 before the first commit."""
        return self._newest("manifest")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self._json(f"manifest-{self.revision()}.json")["tables"][name])

    def acquire(self, owner: str, seconds: float = 3600, now: float | None = None) -> int:
        """The fencing number of a new lease; raises ``LeaseHeld`` while another owner's lease runs."""
        now = time.time() if now is None else now
        number = self._newest("lease")
        if number:
            held = self._json(f"lease-{number}.json")
            if held["until"] > now and held["owner"] != owner:
                raise LeaseHeld(f"{held['owner']} writes until {held['until']}")
        try:
            self._create(f"lease-{number + 1}.json", {"owner": owner, "until": now + seconds})
        except Py4JJavaError as taken:
            raise LeaseHeld("another writer was first") from taken
        return number + 1

    def release(self, fence: int, owner: str) -> None:
        """Ends a lease before its time."""
        self._held(fence)
        self._create(f"lease-{fence + 1}.json", {"owner": owner, "until": 0})

    def _held(self, fence: int | None) -> None:
        if fence is not None and self._newest("lease") != fence:
            raise LeaseHeld(f"lease {fence} was taken over")

    def commit(self, tables: dict[str, DataFrame], fence: int | None = None, append: dict[str, DataFrame] | None = None, note: dict | None = None) -> int:
        """Writes the tables, then the manifest; without the manifest (a stopped run) readers keep the old version. One writer wins a revision.

        ``append`` adds files to tables of the version before and leaves their other files alone. The revision stays as it is
        if no table has other rows than before. ``note`` is kept with the manifest.
        """
        self._held(fence)
        number = self.revision()
        before = self._json(f"manifest-{number}.json") if number else {"tables": {}, "digests": {}, "note": {}}
        paths, digests = dict(before["tables"]), dict(before["digests"])
        for name, rows in {**tables, **(append or {})}.items():
            path = f"{self.root}/{name}-{uuid.uuid4().hex}"
            rows.write.parquet(path)
            digest = content_digest(self.spark.read.schema(rows.schema).parquet(path))
            added = append is not None and name in append
            if added and not digest.startswith("0-"):
                paths[name], digests[name] = [*paths.get(name, []), path], f"{digests.get(name, '')}+{digest}"
            elif not added or name not in paths:
                paths[name], digests[name] = [path], digest
        if number and digests == before["digests"] and (note is None or note == before["note"]):
            return number
        self._held(fence)
        self._create(f"manifest-{number + 1}.json", {"tables": paths, "digests": digests, "note": note if note is not None else before["note"], "fence": fence})
        return number + 1

    def note(self) -> dict:
        """What the last commit noted."""
        number = self.revision()
        return self._json(f"manifest-{number}.json")["note"] if number else {}
