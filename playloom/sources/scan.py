"""Scans of folders as a Spark data source, fingerprints, and snapshots that are verified while they are read.

A scan root is one partition, so many roots are walked side by side. Roots are paths that every
executor can open (a mounted share); whatever is read of a file is written to a table before it is
used, so a file that changes meanwhile is seen as a whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from playloom.shared import materialize

FOUND = "root string, path string, kind string, size long, mtime_ms long, warning string"
#: Bytes that are read and hashed at once, and bytes of a row of a snapshot.
BUFFER, CHUNK = 64 * 1024, 4 << 20


@dataclass
class ScanLimits:
    """Limits of the walk below one root: folders deep, entries, bytes of a file."""

    depth: int = 24
    entries: int = 250_000
    file_bytes: int = 2 << 30


#: Where a walk is, and the folders it enters from there (any other name: ``*``), in any case of letters.
SCOPES = {
    "root": {"logs": "logs", ".minecraft": "game", "minecraft": "game", "instances": "collection"},
    "collection": {"*": "instance"},
    "instance": {"logs": "logs", ".minecraft": "game", "minecraft": "game"},
    "game": {"logs": "logs"},
    "logs": {"*": "logs"},
}


class _Full(Exception):
    """More entries than the limit."""


def log_kind(name: str) -> str | None:
    """plain or gzip, None for a file that is no log."""
    low = name.lower()
    return "gzip" if low.endswith(".log.gz") else "plain" if low.endswith(".log") else None


def walk_root(root: str, limits: ScanLimits) -> Iterator[tuple]:
    """Rows of ``FOUND``: logs by path, and a warning for what was left out. Symbolic links are never followed.

    A root that is a link, no folder or unreadable, or that holds too many entries, gives one warning and no logs.
    """
    try:
        mode = os.lstat(root).st_mode
        if stat.S_ISLNK(mode) or not stat.S_ISDIR(mode):
            yield root, None, None, None, None, "root_is_symlink" if stat.S_ISLNK(mode) else "root_not_directory"
            return
        yield from sorted(_walk(root, limits), key=lambda row: row[1].encode(errors="surrogateescape"))
    except _Full:
        yield root, None, None, None, None, "entry_limit"
    except OSError:
        yield root, None, None, None, None, "root_unreadable"


def _walk(root: str, limits: ScanLimits) -> list[tuple]:
    rows, seen = [], 0
    begin = "logs" if os.path.basename(root.rstrip("/")).lower() == "logs" else "root"
    todo = [("", 0, begin)]
    while todo:
        folder, depth, scope = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, folder)))
        except OSError:
            if depth == 0:
                raise
            rows.append((root, folder, None, None, None, "unreadable"))
            continue
        seen += len(entries)
        if seen > limits.entries:
            raise _Full
        for entry in entries:
            path = os.path.join(folder, entry.name)
            if entry.is_symlink():
                rows.append((root, path, None, None, None, "symlink"))
            elif entry.is_dir(follow_symlinks=False):
                inner = SCOPES[scope].get(entry.name.lower(), SCOPES[scope].get("*"))
                if inner is not None and depth >= limits.depth:
                    rows.append((root, path, None, None, None, "depth_limit"))
                elif inner is not None:
                    todo.append((path, depth + 1, inner))
            elif scope == "logs" and entry.is_file(follow_symlinks=False) and log_kind(entry.name) is not None:
                try:
                    found = entry.stat(follow_symlinks=False)
                except OSError:
                    rows.append((root, path, None, None, None, "unreadable"))
                    continue
                large = found.st_size > limits.file_bytes
                rows.append((root, path, log_kind(entry.name), found.st_size, found.st_mtime_ns // 1_000_000, "file_too_large" if large else None))
    return rows


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], limits: ScanLimits):
        self.roots, self.limits = roots, limits

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(root) for root in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return walk_root(partition.value, self.limits)


class LogScan(DataSource):
    """``spark.read.format("log_scan")`` with the options ``roots`` (JSON list) and ``limits`` (JSON of ``ScanLimits``)."""

    @classmethod
    def name(cls) -> str:
        return "log_scan"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["roots"]), ScanLimits(**json.loads(self.options.get("limits", "{}"))))


def inventory(spark: SparkSession, roots: list[str], limits: ScanLimits | None = None) -> DataFrame:
    """Logs and warnings below each root: root, path, kind, size, mtime_ms, warning (null for a log to read)."""
    spark.dataSource.register(LogScan)
    reader = spark.read.format("log_scan").option("roots", json.dumps(roots))
    return reader.option("limits", json.dumps(asdict(limits or ScanLimits()))).load()


def _observed(path: str) -> tuple[int, int] | None:
    """(size, mtime_ms) of a plain file, None if it is none any more."""
    try:
        found = os.lstat(path)
    except OSError:
        return None
    return (found.st_size, found.st_mtime_ns // 1_000_000) if stat.S_ISREG(found.st_mode) else None


def fingerprints(files: DataFrame) -> DataFrame:
    """The files with ``hash`` (SHA-256 of the content, null if the file could not be read or changed meanwhile) and
    ``prior_part_hash``, the hash of the first ``prior_size`` bytes where the files have such a column."""
    with_prior = "prior_size" in files.columns
    rows = files if with_prior else files.withColumn("prior_size", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, part = [], []
            for root, path, prior in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "prior_size"))):
                one, other = _hashes(os.path.join(root, path), prior)
                whole.append(one)
                part.append(other)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.string()), pa.array(part, pa.string())], names=[*batch.schema.names, "hash", "prior_part_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", hash string, prior_part_hash string"
    out = rows.mapInArrow(run, schema)
    return out if with_prior else out.drop("prior_size", "prior_part_hash")


def _hashes(path: str, prior: int | None) -> tuple[str | None, str | None]:
    before = _observed(path)
    if before is None:
        return None, None
    whole, part, left = hashlib.sha256(), hashlib.sha256(), prior or 0
    try:
        with open(path, "rb") as source:
            while block := source.read(BUFFER):
                whole.update(block)
                part.update(block[:left])
                left -= min(left, len(block))
    except OSError:
        return None, None
    if _observed(path) != before:
        return None, None
    return whole.hexdigest(), part.hexdigest() if prior is not None and left == 0 else None


def snapshot(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(content, verdicts) of fingerprinted files (root, path, size, mtime_ms, hash).

    Files are read once, in rows of at most ``CHUNK`` bytes (root, path, place, bytes) that are written to the shared folder; the
    verdict says whether exactly the bytes of the fingerprint were read and the file was the same before and after. Content is
    given of verified files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path, size, mtime, digest in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "size", "mtime_ms", "hash"))):
                yield from _copied(root, path, (size, mtime), digest)

    read = files.select("root", "path", "size", "mtime_ms", "hash").mapInArrow(run, "root string, path string, place int, bytes binary, verified boolean")
    read = materialize(read, "snapshot")
    verdicts = read.filter("verified is not null").select("root", "path", "verified")
    content = read.filter("verified is null").join(verdicts.filter("verified"), ["root", "path"], "left_semi").select("root", "path", "place", "bytes")
    return content, verdicts


def _copied(root: str, path: str, expected: tuple[int, int], digest: str | None) -> Iterator[pa.RecordBatch]:
    def row(place: int | None, content: bytes | None, verified: bool | None) -> pa.RecordBatch:
        columns = [pa.array([root]), pa.array([path]), pa.array([place], pa.int32()), pa.array([content], pa.binary()), pa.array([verified], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["root", "path", "place", "bytes", "verified"])

    whole, place, full = hashlib.sha256(), 0, os.path.join(root, path)
    same = digest is not None and _observed(full) == expected
    if same:
        try:
            with open(full, "rb") as source:
                while block := source.read(CHUNK):
                    whole.update(block)
                    yield row(place, block, None)
                    place += 1
        except OSError:
            same = False
    yield row(None, None, same and _observed(full) == expected and whole.hexdigest() == digest)
