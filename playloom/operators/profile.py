"""Player profile: statistics of all worlds, identities, and worlds matched with saves and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.functions.formats import measured

#: Largest sum of a statistic (2**53 - 1).
MOST = (1 << 53) - 1
STAT_FILE_BYTES = 8 << 20
#: Old flat names and where they went (fixed values): (category, key).
OLD_KEYS = {
    "playOneMinute": ("custom", "play_time"), "timeSinceDeath": ("custom", "time_since_death"), "leaveGame": ("custom", "leave_game"), "walkOneCm": ("custom", "walk_one_cm"),
    "crouchOneCm": ("custom", "crouch_one_cm"), "sprintOneCm": ("custom", "sprint_one_cm"), "swimOneCm": ("custom", "swim_one_cm"), "flyOneCm": ("custom", "fly_one_cm"),
    "jump": ("custom", "jump"), "deaths": ("custom", "deaths"), "mobKills": ("custom", "mob_kills"), "playerKills": ("custom", "player_kills"),
    "damageDealt": ("custom", "damage_dealt"), "damageTaken": ("custom", "damage_taken"), "drop": ("custom", "drop"), "fishCaught": ("custom", "fish_caught"),
}
OLD_PREFIXES = {"mineBlock": "mined", "craftItem": "crafted", "useItem": "used", "killEntity": "killed"}


def statistics(files: DataFrame) -> DataFrame:
    """(world_id, category, key, value) from JSON texts of both layouts; malformed or oversized files give nothing."""
    rows = files.filter(F.octet_length("json") <= STAT_FILE_BYTES)
    modern = rows.select("world_id", F.explode(F.from_json(F.get_json_object("json", "$.stats"), "map<string,map<string,bigint>>")).alias("category", "m"))
    modern = modern.select("world_id", "category", F.explode("m").alias("key", "value"))
    old = rows.filter(F.get_json_object("json", "$.stats").isNull()).select("world_id", F.explode(F.from_json("json", "map<string,bigint>")).alias("name", "value"))
    old = old.filter(F.col("name").startswith("stat."))
    first, rest = F.split("name", r"\.").getItem(1), F.regexp_extract("name", r"^stat\.[^.]+\.(.+)$", 1)
    category, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (c, k) in OLD_KEYS.items():
        category, key = F.when((first == name) & (rest == ""), c).otherwise(category), F.when((first == name) & (rest == ""), k).otherwise(key)
    for name, c in OLD_PREFIXES.items():
        category, key = F.when((first == name) & (rest != ""), c).otherwise(category), F.when((first == name) & (rest != ""), F.regexp_replace(rest, r"\.", ":")).otherwise(key)
    old = old.select("world_id", category.alias("category"), key.alias("key"), "value").filter("category is not null")
    short = lambda c: F.regexp_replace(c, "^minecraft:", "")
    return modern.unionByName(old).select("world_id", short(F.col("category")).alias("category"), short(F.col("key")).alias("key"), "value").filter("value >= 0")


def merge(stats: DataFrame) -> DataFrame:
    """Sum per category and key, capped, with the number of worlds it comes from."""
    total = F.sum(F.col("value").cast("decimal(38,0)"))
    return stats.groupBy("category", "key").agg(F.least(total, F.lit(MOST)).cast("long").alias("value"), F.countDistinct("world_id").alias("worlds"))


def sections(merged: DataFrame, n: int = 12) -> DataFrame:
    """The n largest entries of each category: a top-k report."""
    order = Window.partitionBy("category").orderBy(F.col("value").desc(), "key")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


#: Single statistics that are shown, with their name and unit (fixed values), in order.
SHOWN = {
    "general": [
        ("play_time", "Time played", "ticks"), ("deaths", "Deaths", "count"), ("damage_dealt", "Damage dealt", "tenths"), ("damage_taken", "Damage taken", "tenths"),
        ("mob_kills", "Mobs defeated", "count"), ("player_kills", "Players defeated", "count"), ("jump", "Jumps", "count"), ("sleep_in_bed", "Times slept", "count"),
        ("animals_bred", "Animals bred", "count"), ("fish_caught", "Fish caught", "count"), ("raid_win", "Raids won", "count"),
        ("interact_with_villager", "Villager interactions", "count"), ("open_chest", "Chests opened", "count"),
    ],
    "movement": [
        ("walk_one_cm", "Walked", "centimeters"), ("sprint_one_cm", "Sprinted", "centimeters"), ("crouch_one_cm", "Crouched", "centimeters"), ("swim_one_cm", "Swam", "centimeters"),
        ("fly_one_cm", "Flown", "centimeters"), ("aviate_one_cm", "Elytra distance", "centimeters"), ("boat_one_cm", "By boat", "centimeters"), ("minecart_one_cm", "By minecart", "centimeters"),
    ],
}


def shown_statistics(merged: DataFrame) -> DataFrame:
    """section, place, label, value, unit, text, worlds of the single statistics that were found, in their fixed order."""
    rows = [F.struct(F.lit(section).alias("section"), F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(name).alias("label"), F.lit(unit).alias("unit"))
            for section, entries in SHOWN.items() for place, (key, name, unit) in enumerate(entries)]
    short = F.regexp_replace("key", "^minecraft:", "")
    own = merged.filter("category = 'custom'").select(short.alias("own"), "value", "worlds")
    found = own.select("value", "worlds", F.inline(F.filter(F.array(*rows), lambda r: r["key"] == F.col("own"))))
    return found.select("section", "place", "label", "value", "unit", measured(F.col("value"), F.col("unit")).alias("text"), "worlds")


def chosen_stats(files: DataFrame, primary: DataFrame) -> DataFrame:
    """The statistics file that counts for each world: world_id, path, basis.

    ``files``: world_id, path of JSON files named by a player's uuid. ``primary``: uuid and basis, no row or one. The primary player's
    file counts; without a primary player a world's only file does (``single_local_player``); else none.
    """
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    known = primary.agg(F.first(uuid(F.col("uuid")), ignorenulls=True).alias("primary"), F.first("basis", ignorenulls=True).alias("basis"), F.count("uuid").alias("players"))  # one row
    rows = files.select("world_id", "path", uuid(name).alias("uuid")).crossJoin(known)
    per = rows.groupBy("world_id").agg(
        F.min(F.when(F.col("uuid") == F.col("primary"), F.col("path"))).alias("exact"), F.min("path").alias("first"), F.count(F.lit(1)).alias("n"), F.first("basis").alias("basis"), F.first("players").alias("players"),
    )
    alone = (F.col("players") == 0) & (F.col("n") == 1)
    path = F.coalesce("exact", F.when(alone, F.col("first")))
    return per.filter(path.isNotNull()).select("world_id", path.alias("path"), F.when(F.col("exact").isNotNull(), F.col("basis")).otherwise("single_local_player").alias("basis"))


def sample(stats: DataFrame, seed: int, n: int = 4) -> DataFrame:
    """A sample of ``n`` statistics that depends on the seed alone, in the order of a digest of seed and name: a sampling operator."""
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("category"), F.lit(":"), F.col("key")), 256)
    return stats.withColumn("digest", order).orderBy("digest", "category", "key").limit(n).drop("digest")


def search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case; a blank text finds all."""
    wanted = needle.strip().lower()
    if not wanted:
        return rows
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return rows.filter(hit)


#: Order of worlds by what is left of them (fixed values).
AVAILABILITY = ("available", "missing", "backup_only")


def in_order(worlds: DataFrame) -> DataFrame:
    """Worlds by availability, most minutes first, then by name."""
    rank = F.array_position(F.array(*[F.lit(a) for a in AVAILABILITY]), F.col("availability"))
    return worlds.orderBy(rank, F.col("minutes").desc_nulls_last(), F.lower("name"), "name")


def uuid(text: Column) -> Column:
    """32 hex digits in lower case; null for anything else."""
    plain = F.lower(F.regexp_replace(text, "-", ""))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), plain)


def uuid_counts(files: DataFrame) -> DataFrame:
    return files.select(uuid(F.col("uuid")).alias("uuid")).filter("uuid is not null").groupBy("uuid").agg(F.count(F.lit(1)).alias("files"))


def ranked_identities(known: DataFrame, counts: DataFrame) -> DataFrame:
    """Identities with their place: those with the most statistics files first, then active ones, then by name."""
    rows = known.join(counts.select(F.col("uuid"), "files"), "uuid", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return rows.orderBy(F.col("files").desc(), F.col("active").desc(), F.lower("name"), "uuid")


def primary_uuid(identities: DataFrame, counts: DataFrame) -> DataFrame:
    """The first identity that has files; else the one uuid with the most files, none on a tie."""
    named = identities.join(counts, "uuid").orderBy(F.col("files").desc(), F.col("active").desc(), "name").limit(1).select("uuid", F.lit("identity").alias("basis"))
    top = counts.agg(F.max("files").alias("files"))
    leaders = counts.join(top, "files").agg(F.count(F.lit(1)).alias("n"), F.min("uuid").alias("uuid")).filter("n = 1").select("uuid", F.lit("inferred").alias("basis"))
    return named.unionByName(leaders.join(named.select(F.lit(True).alias("x")), F.lit(True), "left_anti"))


def identities(accounts: DataFrame) -> DataFrame:
    """Accounts (name, uuid, active, launcher) by uuid, else by name: active if any is, with all launchers."""
    key = F.coalesce(uuid(F.col("uuid")), F.lower("name"))
    return accounts.groupBy(key.alias("identity")).agg(
        F.max_by("name", F.struct("active", "name")).alias("name"), F.max(uuid(F.col("uuid"))).alias("uuid"), F.bool_or("active").alias("active"), F.array_sort(F.collect_set("launcher")).alias("launchers")
    )


def account_rows(text: DataFrame) -> DataFrame:
    """Accounts of the four JSON layouts, one file per row (launcher, json)."""
    json = F.col("json")
    person = "struct<name:string,id:string,uuid:string>"
    by_key = text.select("launcher", F.get_json_object(json, "$.activeAccountLocalId").alias("now"), F.explode(F.from_json(F.get_json_object(json, "$.accounts"), f"map<string,struct<minecraftProfile:{person}>>")).alias("k", "a"))
    parts = [by_key.select("launcher", F.col("a.minecraftProfile.name").alias("name"), F.col("a.minecraftProfile.id").alias("uuid"), F.coalesce(F.col("k") == F.col("now"), F.lit(False)).alias("active"))]
    listed = text.select("launcher", F.explode(F.from_json(F.get_json_object(json, "$.accounts"), f"array<struct<active:boolean,profile:{person}>>")).alias("a"))
    parts.append(listed.select("launcher", F.col("a.profile.name").alias("name"), F.col("a.profile.id").alias("uuid"), F.coalesce("a.active", F.lit(False)).alias("active")))
    cache = text.filter(F.ltrim(json).startswith("[")).select("launcher", F.explode(F.from_json(json, f"array<{person}>")).alias("a"))
    parts.append(cache.select("launcher", F.col("a.name").alias("name"), F.col("a.uuid").alias("uuid"), F.lit(False).alias("active")))
    flat = text.filter(F.ltrim(json).startswith("{") & F.get_json_object(json, "$.accounts").isNull()).select("launcher", F.explode(F.from_json(json, "map<string,string>")).alias("uuid", "name"))
    parts.append(flat.filter(uuid(F.col("uuid")).isNotNull()).select("launcher", "name", "uuid", F.lit(False).alias("active")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name is not null")


def normal_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def match_worlds(saves: DataFrame, archived: DataFrame, backups: DataFrame) -> DataFrame:
    """Each save with the first unmatched archived world of its normal name; the rest of the archive is missing, the rest of the backups stand alone.

    Names repeat, so both sides are numbered within a name and paired by number.
    """
    number = lambda rows, c: rows.withColumn("norm", normal_name(F.col(c))).withColumn("n", F.row_number().over(Window.partitionBy("instance_id", "norm").orderBy(c)))
    s, a = number(saves, "save").alias("s"), number(archived, "world").alias("a")
    both = s.join(a, (F.col("s.instance_id") == F.col("a.instance_id")) & (F.col("s.norm") == F.col("a.norm")) & (F.col("s.n") == F.col("a.n")), "full")
    worlds = both.select(
        F.coalesce("s.instance_id", "a.instance_id").alias("instance_id"), F.coalesce("s.save", "a.world").alias("name"), F.coalesce("s.norm", "a.norm").alias("norm"),
        F.when(F.col("s.save").isNull(), "missing").otherwise("available").alias("availability"), F.col("a.world").isNotNull().alias("played"),
    )
    b = backups.select(F.col("instance_id").alias("b_instance"), F.col("backup"), normal_name(F.col("backup")).alias("b_norm"))
    held = containment(worlds.select("norm").distinct(), b.select("b_norm").distinct())
    # An available world looks at the backups of its instance, a missing one at all.
    ours = (F.col("availability") == "missing") | (F.col("b_instance") == F.col("instance_id"))
    pairs = worlds.join(held, "norm").join(b, "b_norm").filter(ours)
    keys = ["instance_id", "name", "availability"]
    counted = worlds.join(pairs.groupBy(keys).agg(F.count(F.lit(1)).alias("backups")), keys, "left").withColumn("backups", F.coalesce("backups", F.lit(0)))
    alone = b.join(pairs.select("b_instance", "backup").distinct(), ["b_instance", "backup"], "left_anti")
    alone = alone.select(F.col("b_instance").alias("instance_id"), F.col("backup").alias("name"), F.col("b_norm").alias("norm"), F.lit("backup_only").alias("availability"), F.lit(False).alias("played"), F.lit(1).cast("long").alias("backups"))
    return counted.select(*worlds.columns, "backups").unionByName(alone).drop("norm")


#: Letters of the parts that containment is indexed by.
PART = 3


def containment(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (norm, b_norm) where the text contains the name; empty names are contained in nothing.

    Texts are indexed by their distinct parts of up to ``PART`` letters. A name is looked up by the one of its parts that fewest texts have
    (a shorter name by itself), and what is found is verified.
    """
    parts = lambda c, n: F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda k: F.substr(F.col(c), k, F.lit(n)))
    of_length = lambda c, n: F.when(F.char_length(c) >= n, parts(c, n)).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(*[of_length("b_norm", n) for n in range(1, PART + 1)]))
    index = texts.select("b_norm", F.explode(every).alias("part"))
    own = F.array_distinct(F.when(F.char_length("norm") > PART, parts("norm", PART)).otherwise(F.array("norm")))
    asked = needles.filter("norm <> ''").select("norm", F.explode(own).alias("part"))
    common = index.groupBy("part").agg(F.count(F.lit(1)).alias("texts"))
    # A part that no text has cannot lead to one; a name with such a part is dropped by the inner join with the rarest.
    ranked = asked.join(common, "part", "left").groupBy("norm").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "part")).alias("rarest"))
    found = ranked.select("norm", F.col("rarest.part").alias("part")).join(index, "part")
    return found.filter(F.contains("b_norm", "norm")).select("norm", "b_norm")


def summary(worlds: DataFrame) -> DataFrame:
    kind = F.col("availability")
    return worlds.agg(*[F.count_if(kind == k).alias(k) for k in ("available", "missing", "backup_only")], F.count_if("played").alias("played"))
