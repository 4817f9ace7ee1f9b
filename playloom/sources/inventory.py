"""File inventories: real folders, and the documents table read as two generations of log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playloom.functions.core import ascii_lower
from playloom.shared import table

#: Limits of a walk.
MAX_DEPTH, MAX_ENTRIES, MAX_FILE = 24, 250_000, 2 << 30
PARSER = "client-log"
REVISION = 3


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Log files under the ``logs`` folders of a root: path, size, mtime_ms, decision to skip; raises beyond the entry limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    found = files.filter(F.exists(parts, lambda p: ascii_lower(p) == "logs") & ascii_lower(F.col("path")).rlike(r"\.log(\.gz)?$"))
    if found.limit(MAX_ENTRIES + 1).count() > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries under {root}")
    return found.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), (F.col("length") > MAX_FILE).alias("skipped")).orderBy("path")


def classify(path: Column) -> Column:
    """Kind of a file by whole path components; the first rule that fits counts."""
    low = ascii_lower(path)
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    inside = lambda folder: F.array_contains(F.slice(parts, 1, F.size(parts) - 1), folder)
    return (
        F.when(inside("logs") & name.endswith(".log.gz"), "compressed_log").when(inside("logs") & name.endswith(".log"), "log")
        .when(name == "level.dat", "level").when(name == "servers.dat", "servers").when(inside("mods") & name.endswith(".jar"), "mod")
        .when(inside("stats") & name.endswith(".json"), "statistics").when(inside("advancements") & name.endswith(".json"), "advancements")
        .when(inside("crash-reports") & name.endswith(".txt"), "crash_report").when(inside("screenshots") & name.rlike(r"\.(png|jpg|jpeg)$"), "screenshot").otherwise("other")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, bytes, size, mtime; the name's form follows doc_id."""
    k = F.col("doc_id")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    name = (
        F.when(k % 10 == 0, "latest.log").when(k % 10 < 5, F.concat(F.lit("2026-08-"), day, F.lit("-"), (k % 12 + 1).cast("string"), F.lit(".log.gz")))
        .when(k % 10 < 8, F.concat(F.lit("debug-"), k.cast("string"), F.lit(".LOG"))).when(k % 10 == 8, "level.dat").otherwise(F.concat(k.cast("string"), F.lit(".json")))
    )
    folder = F.when(k % 10 == 9, "stats").when(k % 10 == 8, "saves").otherwise("logs")
    root = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("instances/"), F.col("source"), F.lit("/")))
    return table(spark, sf_dir, "documents").select(
        k.alias("file_id"), F.concat(root, folder, F.lit("/"), name).alias("path"), F.col("source").alias("instance_id"), F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("long").alias("size"), (F.lit(1_700_000_000_000) + k * 1000).alias("mtime_ms"), "text",
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("file_id % 7 <> 6").withColumn("hash", F.sha2("content", 256))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation before: equal, the first half, or another text; some failed to parse, some were parsed by an older revision."""
    k = F.col("file_id")
    text = F.when(k % 5 == 1, F.substring("text", F.lit(1), (F.char_length("text") / 2).cast("int"))).when(k % 5 == 2, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text"))
    rows = files(spark, sf_dir).filter("file_id % 5 <> 3").withColumn("before", text)
    return rows.select(
        "file_id", F.col("instance_id").alias("prior_instance"), F.octet_length("before").cast("long").alias("prior_size"), F.sha2(F.col("before").cast("binary"), 256).alias("prior_hash"),
        (k % 11 != 0).alias("parsed_ok"), F.when(k % 5 == 4, REVISION - 1).otherwise(REVISION).alias("revision"), (k % 3 + 1).alias("generation"),
    )


def rotations(rows: DataFrame) -> DataFrame:
    """Order of an instance's logs, oldest first: dated names by date and number, undated by time and path, the current file last."""
    name = ascii_lower(F.element_at(F.split("path", "/"), -1))
    date, number = F.regexp_extract(name, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})-[0-9]+\.", 1), F.regexp_extract(name, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-([0-9]+)\.", 1).try_cast("long")
    kind = F.when(name == "latest.log", 2).when(date != "", 0).otherwise(1)
    time = F.when(kind == 1, F.col("mtime_ms"))
    order = Window.partitionBy("instance_id").orderBy(kind, F.when(kind == 0, date), number, time, F.col("path").cast("binary"), "file_id")
    return rows.withColumn("rotation", F.row_number().over(order)).withColumn("date_hint", F.nullif(date, F.lit("")))


FILES_SQL = r"""
files as (
    select doc_id as file_id, source as instance_id, text, strlen(text) as size, 1700000000000 + doc_id * 1000 as mtime_ms,
           case when doc_id % 3 = 0 then '' else 'instances/' || source || '/' end || case when doc_id % 10 = 9 then 'stats' when doc_id % 10 = 8 then 'saves' else
               'logs' end || '/' ||
           case when doc_id % 10 = 0 then 'latest.log' when doc_id % 10 < 5 then '2026-08-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') || '-' || (doc_id % 12 + 1) || '.log.gz'
                when doc_id % 10 < 8 then 'debug-' || doc_id || '.LOG' when doc_id % 10 = 8 then 'level.dat' else doc_id || '.json' end as path
    from documents),
cur as (select *, sha256(text) as hash from files where file_id % 7 <> 6),
prior as (
    select file_id, instance_id as prior_instance, before, strlen(before) as prior_size, file_id % 11 <> 0 as parsed_ok, case when file_id % 5 = 4 then 2 else 3 end as
        revision, file_id % 3 + 1 as generation
    from (select *, case file_id % 5 when 1 then left(text, (length(text) // 2)::integer) when 2 then 'old ' || text else text end as before from files where file_id % 5 <> 3)),
decided as (
    select c.file_id, c.instance_id, c.path, c.size, c.text, c.hash, case when p.file_id is null then 'new' when not parsed_ok or revision <> 3 then 'reparse' when size
        = prior_size and text = before then 'unchanged'
           when size > prior_size and starts_with(text, before) then 'appended' else 'replaced' end as decision, coalesce(p.generation, 0) as generation
    from cur c left join prior p using (file_id))"""
