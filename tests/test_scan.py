"""Walks, fingerprints, verified snapshots, and lines of split files."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from playloom.sources import scan
from playloom.sources.logs import read_logs


@pytest.fixture
def folders(tmp_path):
    for path in (
        "logs/latest.log", "logs/deep/er/2026-08-01-1.log.gz", "logs/readme.txt", ".Minecraft/LOGS/a.Log", ".minecraft2/logs/no.log", "instances/One/logs/one.log",
        "instances/Two/minecraft/logs/two.log", "instances/Two/other/logs/no.log", "other.log", "saves/logs/no.log", "minecraft/instances/x/logs/no.log",
    ):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    os.symlink(tmp_path / "logs" / "latest.log", tmp_path / "logs" / "link.log")
    os.symlink(tmp_path / "logs", tmp_path / "instances" / "Linked")
    return tmp_path


LOGS = [".Minecraft/LOGS/a.Log", "instances/One/logs/one.log", "instances/Two/minecraft/logs/two.log", "logs/deep/er/2026-08-01-1.log.gz", "logs/latest.log"]


def rows_of(spark, *roots, **limits):
    return [tuple(r) for r in scan.inventory(spark, [str(r) for r in roots], scan.ScanLimits(**limits)).collect()]


def test_walk_enters_the_scopes_alone(spark, folders):
    found = rows_of(spark, folders)
    assert [r[1] for r in found if r[5] is None] == LOGS and [r[1] for r in found if r[5]] == ["instances/Linked", "logs/link.log"]
    assert {r[5] for r in found} == {None, "symlink"} and {r[2] for r in found if r[1].endswith("gz")} == {"gzip"}
    assert all(r[3] == len(r[1]) and r[4] > 0 for r in found if r[5] is None)
    assert [r[1] for r in rows_of(spark, folders / "logs") if r[5] is None] == ["deep/er/2026-08-01-1.log.gz", "latest.log"]


def test_limits_of_a_walk(spark, folders):
    shallow = rows_of(spark, folders, depth=2)
    assert {(r[1], r[5]) for r in shallow if r[5] == "depth_limit"} == {("instances/One/logs", "depth_limit"), ("instances/Two/minecraft", "depth_limit"), ("logs/deep/er", "depth_limit")}
    assert [r[5] for r in rows_of(spark, folders, entries=10)] == ["entry_limit"]
    large = rows_of(spark, folders, file_bytes=20)
    assert {r[1] for r in large if r[5] == "file_too_large"} == {p for p in LOGS if len(p) > 20}
    os.symlink(folders, folders / "again")
    odd = rows_of(spark, folders / "again", folders / "other.log", folders / "nowhere", folders)
    assert [r[5] for r in odd[:3]] == ["root_is_symlink", "root_not_directory", "root_unreadable"] and len(odd) > 8


def test_snapshots_are_verified(spark, folders, monkeypatch):
    files = scan.inventory(spark, [str(folders)]).filter("warning is null").withColumn("prior_size", F.lit(4).cast("long"))
    printed = spark.createDataFrame(scan.fingerprints(files).collect(), scan.fingerprints(files).schema)
    assert printed.filter("hash is null or prior_part_hash is null").isEmpty() and printed.select("prior_part_hash").distinct().count() == 3
    (folders / LOGS[1]).write_text("another text")
    os.utime(folders / LOGS[2], (1, 1))
    (folders / LOGS[4]).unlink()
    kept, verdicts = scan.snapshot(printed)
    assert {r["path"]: r["verified"] for r in verdicts.collect()} == {p: p in (LOGS[0], LOGS[3]) for p in LOGS}
    assert {r["path"]: bytes(r["bytes"]).decode() for r in kept.collect()} == {p: p for p in (LOGS[0], LOGS[3])}


def reference_lines(data):
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\n", at) + 1 or len(data)
        content = data[at:end].removesuffix(b"\n").removesuffix(b"\r")
        text = content.decode(errors="replace")
        bad = "\0" in text or text.encode() != content
        out.append((len(out) + 1, at, end, text.replace("\0", ""), bad))
        at = end
    return out


def test_lines_and_bytes_of_split_files(spark, tmp_path):
    """Splits of 900 bytes, in several files and tasks; CRLF, NUL, bad bytes, empty lines, no line feed at the end."""
    rng, wanted = random.Random(8), {}
    for k in range(6):
        pieces = [rng.choice([b"", b"x" * rng.randint(1, 90), b"a\xffb", b"nu\0l", "größe".encode()]) + rng.choice([b"\n", b"\r\n"]) for _ in range(rng.choice([3, 150, 400]))]
        data = b"".join(pieces) + rng.choice([b"", b"last"])
        (tmp_path / f"{k}.log").write_bytes(data)
        wanted[f"{k}.log"] = reference_lines(data)
    (tmp_path / "z.log.gz").write_bytes(gzip.compress(b"one\r\ntwo\n"))
    wanted["z.log.gz"] = reference_lines(b"one\r\ntwo\n")
    (tmp_path / "empty.log").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_logs(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "Sort [" not in plan
        got = {}
        for r in lines.collect():
            got.setdefault(r["source_id"].rsplit("/", 1)[1], []).append(tuple(r)[1:])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert {k: sorted(v) for k, v in got.items()} == wanted
