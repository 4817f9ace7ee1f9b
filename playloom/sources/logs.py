"""Log lines: from plain and gzip files, and from the event table in the form of client logs."""

from __future__ import annotations

import codecs
import fnmatch
import gzip
import os
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playloom.shared import materialize, table

LINES = "instance_id, source_id, source_order, date_hint, line_number, value"


#: What opening a file or listing a folder costs, in bytes read meanwhile.
OPEN_BYTES = 64 << 10
#: Bytes of lines in a batch.
BATCH_BYTES = 4 << 20


def _listed(folders: DataFrame) -> DataFrame:
    """What is in folders (path): path, folder (boolean), size. Names that begin with a stop or underline are hidden; links are followed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for entry in os.scandir(folder):
                    if not entry.name.startswith((".", "_")):
                        inner = entry.is_dir()
                        if inner or (fnmatch.fnmatchcase(entry.name, "*.log*") and entry.is_file()):
                            rows.append((entry.path, inner, None if inner else entry.stat().st_size))
                paths, inner, sizes = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(inner, pa.bool_()), pa.array(sizes, pa.int64())], names=["path", "folder", "size"])

    return folders.mapInArrow(run, "path string, folder boolean, size long")


def _split_bytes(spark: SparkSession) -> int:
    """Bytes of a split as Spark's readers make them (``spark.sql.files.maxPartitionBytes``)."""
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt over tasks of about a split's bytes each, whose costs are ``size`` bytes together."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // max(_split_bytes(spark), 4 * OPEN_BYTES))))


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size of all ``.log*`` files below a mounted folder. The folders of each level are listed side by side by tasks."""
    level, count, found = spark.createDataFrame([(root,)], "path string"), 1, []
    while count:
        seen = materialize(_listed(_dealt(level, count * OPEN_BYTES)), "listed")
        found.append(seen.filter("not folder").select("path", "size"))
        level = seen.filter("folder").select("path")
        count = level.count()
    return reduce(DataFrame.unionByName, found)


def _uri(path: Column) -> Column:
    """The name Spark gives to a file: its path with what a URI cannot hold as percent signs and digits, other letters left alone."""

    @F.pandas_udf("string")
    def quoted(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: "file:" + re.sub(r"[^A-Za-z0-9/@_.!~'()*,;:$&+=\u00a0-\U0010ffff-]", lambda m: quote(m[0], safe=""), p))

    return F.when(path.rlike(r"^[A-Za-z0-9/_.-]*\z"), F.concat(F.lit("file:"), path)).otherwise(quoted(path))


def _lines_of(path: str, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(line with its line feed, first byte, byte behind) of the lines that begin in a range of a file's decoded bytes."""
    packed = path.lower().endswith(".gz")
    with gzip.open(path, "rb") if packed else open(path, "rb") as source:
        if begin:
            source.seek(begin - 1)
            begin += len(source.readline()) - 1
        for line in source:
            if begin >= end and not packed:
                return
            behind = begin + len(line)
            yield line, begin, behind + (packed and not line.endswith(b"\n"))
            begin = behind


def _read(splits: DataFrame) -> DataFrame:
    """The lines of splits (path, begin, end, before): path, line_number, byte_start, byte_end, line (bytes)."""
    names = ["path", "line_number", "byte_start", "byte_end", "line"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, room = [], BATCH_BYTES

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for path, begin, end, number in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end", "before"))):
                for line, first, behind in _lines_of(path, begin, end):
                    number += 1
                    text = line.removesuffix(b"\n")
                    rows.append((path, number, first, behind, text if first else text.removeprefix(codecs.BOM_UTF8)))
                    room -= len(line) + 100
                    if room < 0:
                        yield batch_of()
                        rows, room = [], BATCH_BYTES
        yield batch_of()

    return splits.select("path", "begin", "end", "before").mapInArrow(run, "path string, line_number long, byte_start long, byte_end long, line binary")


def _counted(splits: DataFrame) -> DataFrame:
    """Splits with the number of lines that begin in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [sum(1 for _ in _lines_of(*split)) for split in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.int64())], names=[*batch.schema.names, "lines"])

    return splits.select("path", "begin", "end").mapInArrow(run, "path string, begin long, end long, lines long")


def _clean(line: Column) -> tuple[Column, Column]:
    """(the line with what is no UTF-8 replaced, without NUL and a carriage return at its end; whether it was malformed)."""
    valid = F.make_valid_utf8(line)
    return F.regexp_replace(F.replace(valid, F.lit("\0"), F.lit("")), "\r$", ""), ~F.is_valid_utf8(line) | F.contains(valid, F.lit("\0"))


#: Tables of splits are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SPLITS = 100_000


def _read_store(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_logs`, of a store that is not mounted, by Spark's reader: for fewer and larger files, which the driver lists.

    Lines and bytes are counted within each split as it streams by; what comes before a split is a prefix sum over the
    splits of its file, a small table.
    """
    files = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log*").text(path)
    where = [F.col(f"_metadata.{name}").alias(alias) for name, alias in (("file_path", "source_id"), ("file_block_start", "split"), ("file_size", "file_size"))]
    rows = files.select("value", *where, (F.octet_length("value") + 1).cast("long").alias("bytes"))
    per = rows.groupBy("source_id", "split").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("source_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")]
    splits = materialize(per.select("source_id", "split", *sums), "splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    clean, malformed = _clean(F.col("value"))
    lines = rows.select("source_id", "split", "file_size", "bytes", clean.alias("value"), malformed.alias("malformed"))
    names = [*lines.columns, "nth", "offset"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines_so_far, bytes_so_far = None, 0, 0
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            ids, blocks = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            # Rows of a split are neighbours: where another one begins, both counts begin anew.
            turns = [k for k in range(len(ids)) if (ids[k], blocks[k]) != (key if k == 0 else (ids[k - 1], blocks[k - 1]))]
            nth, offset = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            for begin, end in zip([0, *turns], [*turns, len(ids)]):
                if begin in turns:
                    lines_so_far = bytes_so_far = 0
                ends = np.cumsum(sizes[begin:end]) + bytes_so_far
                nth[begin:end] = np.arange(1, end - begin + 1) + lines_so_far
                offset[begin:end] = ends - sizes[begin:end]
                if end > begin:
                    lines_so_far, bytes_so_far = int(nth[end - 1]), int(ends[-1])
            if ids:
                key = ids[-1], blocks[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(offset)], names=names)

    counted = lines.mapInArrow(count, "source_id string, split long, file_size long, bytes long, value string, malformed boolean, nth long, offset long")
    start = F.col("bytes_before") + F.col("offset")
    end = F.when(F.lower("source_id").endswith(".gz"), start + F.col("bytes")).otherwise(F.least(start + F.col("bytes"), F.col("file_size")))
    return counted.join(splits, ["source_id", "split"]).select(
        "source_id", (F.col("lines_before") + F.col("nth")).alias("line_number"), start.alias("byte_start"), end.alias("byte_end"), "value", "malformed"
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``.log`` and ``.log.gz`` files below a folder: source_id, line_number, byte_start, byte_end, value, malformed.

    A line with bytes that are no UTF-8 (then replaced) or with NUL (then removed) is malformed. The bytes are those of
    the decoded file, from the line's first to behind its line feed; the last line of a plain file ends with the file, that of
    a compressed one is taken to have a line feed. Folders that all executors have mounted are listed by tasks, level by level, and a task reads many
    small files or a range of a large one, so millions of files never pass through the driver. The lines of a range before another of
    its file are counted first and added up in a table of ranges; files of one range, most of them, are read once. Text is
    neither shuffled nor sorted.
    """
    if not re.match(r"(file:)?/", path):
        return _read_store(spark, path)
    room = _split_bytes(spark)
    files = log_files(spark, re.sub("^file:/*", "/", path).rstrip("/") or "/")
    whole = F.lower("path").endswith(".gz") | (F.col("size") <= room)
    begins = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(room).cast("long")))
    splits = files.select("path", "size", (~whole).alias("parted"), F.explode(begins).alias("begin"))
    splits = splits.withColumn("end", F.when(F.col("parted"), F.col("begin") + room).otherwise(F.lit((1 << 63) - 1)))
    parted = splits.filter("parted")
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    later = materialize(_counted(parted.repartition("path", "begin")).select("path", "begin", "end", before.alias("before")), "ranges")
    small = splits.filter("not parted")
    cost = small.agg(F.sum(F.col("size") + OPEN_BYTES)).first()[0] or 0
    lines = _read(_dealt(small.withColumn("before", F.lit(0).cast("long")), cost)).unionByName(_read(_dealt(later, later.count() * room)))
    value, malformed = _clean(F.col("line").cast("string"))
    return lines.select(_uri(F.col("path")).alias("source_id"), "line_number", "byte_start", "byte_end", value.alias("value"), malformed.alias("malformed"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as logs: one instance per user, one source per user and day, lines in time order."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    message = (
        F.when(kind == "signup", F.concat(F.lit("Loading Minecraft 1."), (k % 6 + 16).cast("string"), F.lit(".1, please wait")))
        .when(kind == "view", F.concat(F.lit("Connecting to S"), (k % 7).cast("string"), F.lit(".Example.net, 25565")))
        .when(kind == "click", F.concat(F.lit('Preparing level "World '), (k % 9).cast("string"), F.lit('"')))
        .when(kind == "purchase", F.when(k % 2 == 0, "Stopping!").otherwise("Stopping worker threads"))
        .otherwise(F.when(k % 3 == 0, "Unreported exception thrown!").otherwise("Disconnected from server"))
    )
    clock = F.date_format("ts", "HH:mm:ss")
    stamp = F.when(F.col("event_id") % 47 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 53 == 0, "99:99:99").otherwise(clock)
    value = F.when(F.col("event_id") % 59 == 0, message).otherwise(F.concat(F.lit("["), stamp, F.lit("] [Render thread/INFO]: "), message))
    day = F.to_date("ts")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", day.alias("day"), value.alias("value"))
    order = "partition by user_id, day order by ts, event_id"
    return rows.select(
        F.col("user_id").alias("instance_id"), F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string")).alias("source_id"),
        F.datediff("day", F.lit("1970-01-01")).alias("source_order"), F.col("day").alias("date_hint"), F.expr(f"row_number() over ({order})").cast("long").alias("line_number"), "value",
    )


LINES_SQL = """
messages as (
    select *, (props->>'$.k')::bigint as k, ts::date as day from events),
lines as (
    select user_id as instance_id, user_id || '/' || day as source_id, (day - date '1970-01-01')::integer as source_order, day as date_hint,
           row_number() over (partition by user_id, day order by ts, event_id) as line_number,
           case when event_id % 59 = 0 then '' else '[' || case when event_id % 47 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when event_id % 53 = 0 then '99:99:99' else
               strftime(ts, '%H:%M:%S') end || '] [Render thread/INFO]: ' end ||
           case event_type when 'signup' then 'Loading Minecraft 1.' || (k % 6 + 16) || '.1, please wait' when 'view' then 'Connecting to S' || (k % 7) || '.Example.net, 25565'
                when 'click' then 'Preparing level "World ' || (k % 9) || '"' when 'purchase' then case when k % 2 = 0 then 'Stopping!' else 'Stopping worker threads' end
                else case when k % 3 = 0 then 'Unreported exception thrown!' else 'Disconnected from server' end end as value
    from messages)"""
