"""From folders to scan locations: what a folder is, what was found before, what a user adds, and what a game folder holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.operators.ingest import GAME_MARKERS, launcher_score, upsert, validation_score

#: What a game folder inside an instance's folder adds to its score, and the markers beside it (fixed values).
NESTED_BONUS, NESTED, BESIDE = 10, ".minecraft", ("instance.cfg", "mmc-pack.json")
#: Entries of an instances folder that are looked at, at most.
MAX_ENTRIES = 10_000


def markers(there: dict[str, Column]) -> Column:
    """Names of the markers that are there, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(test, name) for name, test in there.items()])))


def nested_instance(child: dict[str, Column], beside: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(score, whether it is supported, markers) of an instance's folder with a game folder inside."""
    score, good = validation_score(child)
    names = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(NESTED)), markers(beside), markers(child))))
    return F.least(F.lit(100), score + NESTED_BONUS), good, names


def instance_counts(entries: DataFrame) -> DataFrame:
    """root, instances, over: folders of a launcher that look like an instance, and whether there are too many entries to say.

    ``entries``: root, is_dir, and whether it has a game folder (``nested``) with logs, options or versions (``nested_logs``,
    ``nested_options``, ``nested_versions``), or logs of its own (``logs``) beside its instance file, options, mods or config
    (``instance_file``, ``options``, ``mods``, ``config``).
    """
    prism = F.col("nested") & (F.col("nested_logs") | F.col("nested_options") | F.col("nested_versions"))
    direct = F.col("logs") & (F.col("instance_file") | F.col("options") | F.col("mods") | F.col("config"))
    per = entries.groupBy("root").agg(F.count_if(F.col("is_dir") & (prism | direct)).alias("instances"), (F.count(F.lit(1)) > MAX_ENTRIES).alias("over"))
    return per.withColumn("instances", F.when(~F.col("over"), F.col("instances")))


def validated(folders: DataFrame, launcher: tuple[Column, Column, Column], child: dict[str, Column], beside: dict[str, Column], has_child: Column, game: dict[str, Column] | None = None) -> DataFrame:
    """The folders with kind, score, instances and markers: a launcher's root, else an instance's folder, else a game folder, else unknown.

    ``launcher``: whether it has an instances folder, its configuration files, its instances.
    """
    game = game or {name: F.col(name) for name in GAME_MARKERS}
    root_score, root_good = launcher_score(*launcher)
    nested_score, nested_good, nested_names = nested_instance(child, beside)
    game_score, game_good = validation_score(game)
    nested_good = has_child & nested_good
    pick = lambda root, nested, own, none: F.when(root_good, root).when(nested_good, nested).when(game_good, own).otherwise(none)
    none = F.array().cast("array<string>")
    return folders.select(
        "*", pick(F.lit("launcher"), F.lit("instance"), F.lit("game"), F.lit("unknown")).alias("kind"), pick(root_score, nested_score, game_score, F.lit(0)).cast("int").alias("score"),
        pick(launcher[2], F.lit(1), F.lit(1), F.lit(0)).cast("long").alias("instances"), pick(F.array(F.lit("instances")), nested_names, markers(game), none).alias("markers"),
    )


def overlay(found: DataFrame, saved: DataFrame) -> DataFrame:
    """Folders found now over those saved before, by ``path_key``: saved choices win, what is only saved is off and not available."""
    both = found.select("path_key", "score").join(saved.select("path_key", "enabled", F.col("score").alias("saved_score")), "path_key", "full")
    here = F.col("score").isNotNull()
    return both.select("path_key", F.when(here, F.coalesce("enabled", F.lit(True))).otherwise(False).alias("enabled"), F.coalesce("score", "saved_score").alias("score"), here.alias("available"))


def add_locations(locations: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locations with the accepted ones, rejected ones with the reason) of folders that a user chose.

    ``asked``: path_key, name, kind, score, markers. ``locations``: path_key, name, kind, score.
    """
    empty = F.coalesce(F.trim("path_key"), F.lit("")) == ""
    few = F.when(F.size("markers") == 0, "No recognized Minecraft directory markers were found.").otherwise(F.concat(F.lit("Only these markers were found: "), F.array_join("markers", ", "), F.lit(".")))
    reason = F.when(empty, "The selected path is empty.").when(F.col("kind") == "unknown", few)
    judged = asked.withColumn("reason", reason)
    taken = judged.filter("reason is null").groupBy("path_key").agg(*[F.max_by(c, F.struct("score", "name")).alias(c) for c in ("name", "kind", "score")])
    rejected = judged.filter("reason is not null").select("path_key", "reason", F.when(empty, 0).otherwise(F.col("score")).alias("score"))
    return upsert(locations, taken, "path_key", ["name", "kind", "score"], [], []), rejected


def worlds_and_backups(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saves, backups) of an inventory with instance_id and path: the folders below ``saves``, the ZIP files in ``backups``, by name downwards."""
    parts = F.split("path", "/")
    named = files.select("instance_id", parts.alias("parts"))
    save = F.expr("array_position(parts, 'saves')")
    saves = named.filter((save > 0) & (F.size("parts") > save + 1)).select("instance_id", F.element_at("parts", (save + 1).cast("int")).alias("save")).distinct()
    name = F.element_at("parts", -1)
    inside = (F.try_element_at("parts", F.lit(-2)) == "backups") & name.rlike(r"(?s)^.+\.zip$")
    backups = named.filter(inside).select("instance_id", F.regexp_replace(name, r"\.zip$", "").alias("backup")).distinct()
    return saves, backups.orderBy(F.col("backup").desc(), "instance_id")


def newest_run(runs: DataFrame, messages: DataFrame, n: int = 20) -> DataFrame:
    """The newest run that has ended with its numbers of warnings and errors and its ``n`` newest messages, oldest of them first.

    ``runs``: scan_id, state, requested_ms, finished_ms. ``messages``: scan_id, message_id, created_ms, severity, text.
    """
    ended = runs.filter(F.col("state").isin("completed", "cancelled", "failed", "interrupted"))
    last = ended.orderBy(F.coalesce("finished_ms", "requested_ms").desc(), F.col("requested_ms").desc(), F.col("scan_id").desc()).limit(1)
    own = messages.join(last.select("scan_id"), "scan_id", "left_semi")
    counts = own.groupBy("scan_id").agg(F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "error").alias("errors"))
    newest = own.orderBy(F.col("created_ms").desc(), F.col("message_id").desc()).limit(n)
    texts = newest.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_ms", "message_id", "text"))), lambda m: m["text"]).alias("messages"))
    none = F.array().cast("array<string>")
    return last.join(counts, "scan_id", "left").join(texts, "scan_id", "left").select("scan_id", "state", F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("messages", none).alias("messages"))
