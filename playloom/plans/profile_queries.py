"""Queries of the player profile, over JSON made from the part table and names from suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from playloom.operators import profile
from playloom.shared import table


def _files(spark, sf_dir):
    """One statistics file per brand and player: even players write the new layout, odd ones the old."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("world_id"), (F.col("p_size") % 4).alias("player"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    sums = parts.groupBy("world_id", "player", (F.col("k") % 30).alias("item")).agg(F.sum("v").alias("v"))
    mined = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("minecraft:item_"), "item"), "v")))
    old = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("stat.mineBlock.minecraft.item_"), "item"), "v")))
    new_json = F.concat(F.lit('{"stats":{"minecraft:mined":'), F.to_json(mined), F.lit(',"minecraft:custom":{"minecraft:jump":'), F.sum("v").cast("string"), F.lit("}}}"))
    rows = sums.groupBy("world_id", "player").agg(F.when(F.col("player") % 2 == 0, new_json).otherwise(F.to_json(F.map_concat(old, F.create_map(F.lit("stat.jump"), F.sum("v"))))).alias("json"))
    return rows.withColumn("uuid", F.concat(F.lit("0000000A-0000-0000-0000-00000000000"), F.col("player").cast("string")))


def stats_merge(spark, sf_dir):
    stats = profile.merge(profile.statistics(_files(spark, sf_dir)))
    return stats.withColumn("key", F.regexp_replace("key", "^minecraft:", ""))


def stats_sections(spark, sf_dir):
    return profile.sections(stats_merge(spark, sf_dir)).select("category", "key", "value", "rank")


def uuid_counts(spark, sf_dir):
    return profile.uuid_counts(_files(spark, sf_dir))


def identities(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Player"), (F.col("s_suppkey") % 9).cast("string")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("0000000a00000000000000000000000"), (F.col("s_suppkey") % 9).cast("string"))).alias("uuid"),
        (F.col("s_suppkey") == 7).alias("active"), F.concat(F.lit("launcher"), (F.col("s_suppkey") % 2).cast("string")).alias("launcher"),
    )
    return profile.identities(rows).withColumn("launchers", F.array_join("launchers", ","))


def world_match(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("instance_id"), "p_brand", "p_partkey")
    saves = parts.filter("p_partkey % 3 = 0").select("instance_id", F.concat("p_brand", F.lit(" (1)")).alias("save")).distinct()
    archived = parts.filter("p_partkey % 3 = 1 and p_partkey % 7 < 3").select("instance_id", F.concat(F.upper("p_brand"), F.lit("_1")).alias("world")).distinct()
    backups = parts.filter("p_partkey % 11 = 0").select("instance_id", F.concat(F.lit("2026 "), "p_brand", F.when(F.col("p_partkey") % 2 == 0, "-1.zip").otherwise(".zip")).alias("backup")).distinct()
    return profile.match_worlds(saves, archived, backups)


def profile_summary(spark, sf_dir):
    return profile.summary(world_match(spark, sf_dir))


def _shown(spark, sf_dir):
    """Parts as statistics of a player: each brand is a world."""
    keys = [key for entries in profile.SHOWN.values() for key, _, _ in entries]
    key = F.get(F.array(*[F.lit(f"minecraft:{k}") for k in keys]), (F.col("p_partkey") % len(keys)).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("world_id"), F.lit("custom").alias("category"), key.alias("key"), (F.col("p_size") * F.col("p_partkey")).cast("long").alias("value"))
    return profile.merge(rows.filter("p_partkey % 5 > 0"))


def stats_shown(spark, sf_dir):
    return profile.shown_statistics(_shown(spark, sf_dir))


def stats_sample(spark, sf_dir):
    return profile.sample(profile.search(_shown(spark, sf_dir), " ONE_", "key"), 42).select("category", "key", "value")


def stats_choice(spark, sf_dir):
    """Suppliers as statistics files of worlds (their nations), named by a few players."""
    player = F.lpad((F.col("s_suppkey") % 4).cast("string"), 32, "a")
    files = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("world_id"), F.concat(F.lit("stats/"), F.when(F.col("s_suppkey") % 3 == 0, F.upper(player)).otherwise(player), F.lit(".json")).alias("path")).distinct()
    primary = table(spark, sf_dir, "region").filter("r_regionkey = 2").select(F.lpad(F.col("r_regionkey").cast("string"), 32, "a").alias("uuid"), F.lit("identity").alias("basis"))
    return profile.chosen_stats(files, primary)


QUERIES = {"stats_shown": stats_shown, "stats_sample": stats_sample, "stats_choice": stats_choice, "stats_merge": stats_merge, "stats_sections": stats_sections, "uuid_counts": uuid_counts, "identities": identities, "world_match": world_match, "profile_summary": profile_summary}

_STATS = """merged as (
    select 'mined' as category, 'item_' || (p_partkey % 30) as key, sum(p_size)::bigint as value, count(distinct p_brand) as worlds from part group by 2
    union all select 'custom', 'jump', sum(p_size)::bigint, count(distinct p_brand) from part)"""
_WORLDS = """s as (select distinct p_partkey % 5 as instance_id, p_brand || ' (1)' as save from part where p_partkey % 3 = 0),
a as (select distinct p_partkey % 5 as instance_id, upper(p_brand) || '_1' as world from part where p_partkey % 3 = 1 and p_partkey % 7 < 3),
w as (
    select coalesce(s.instance_id, a.instance_id) as instance_id, coalesce(save, world) as name, regexp_replace(lower(coalesce(save, world)), '[^a-z0-9]', '', 'g') as norm,
           case when save is null then 'missing' else 'available' end as availability, world is not null as played
    from s full join a on s.instance_id = a.instance_id and regexp_replace(lower(save), '[^a-z0-9]', '', 'g') = regexp_replace(lower(world), '[^a-z0-9]', '', 'g')),
b as (select distinct p_partkey % 5 as instance_id, '2026 ' || p_brand || case when p_partkey % 2 = 0 then '-1.zip' else '.zip' end as backup from part where p_partkey % 11 = 0),
bn as (select *, regexp_replace(lower(backup), '[^a-z0-9]', '', 'g') as b_norm from b),
worlds as (
    select w.instance_id, name, availability, played, count(backup) as backups from w left join bn on (availability = 'missing' or bn.instance_id = w.instance_id) and
        contains(b_norm, norm) group by 1, 2, 3, 4
    union all select instance_id, backup, 'backup_only', false, 1 from bn where not exists (select 1 from w where (availability = 'missing' or w.instance_id = bn.instance_id) and contains(b_norm, norm)))"""
_TABLE = ", ".join(f"('{section}', {place}, '{key}', '{name}', '{unit}')" for section, entries in profile.SHOWN.items() for place, (key, name, unit) in enumerate(entries))
_OWN = f"""shown(section, place, key, label, unit) as (values {_TABLE}),
own as (
    select 'custom' as category, key, sum(p_size::bigint * p_partkey)::bigint as value, count(distinct p_brand) as worlds
    from part join (select *, row_number() over () - 1 as k from shown) on k = p_partkey % {sum(map(len, profile.SHOWN.values()))} where p_partkey % 5 > 0 group by 2)"""
ORACLE_SQL = {
    "stats_shown": f"""with {_OWN} select section, place::integer as place, label, value, unit, worlds, case unit when 'ticks' then case when value // 1200 < 60 then value // 1200 || 'm'
            else format('{{:,}}', value // 72000) || ' h' || case when value // 1200 % 60 > 0 then ' ' || (value // 1200 % 60) || ' min' else '' end end
            when 'tenths' then format('{{:,.1f}}', value / 10) when 'centimeters' then format('{{:,.2f}}', value / 100000) || ' km' else format('{{:,}}', value) end as text
        from own join shown using (key)""",
    "stats_sample": f"""with {_OWN} select category, 'minecraft:' || key as key, value from own where contains(lower(key), 'one_') order by sha256('42|custom:minecraft:' || key) limit 4""",
    "stats_choice": """with files as (select distinct s_nationkey as world_id, lpad((s_suppkey % 4)::varchar, 32, 'a') as player, s_suppkey % 3 = 0 as u from supplier)
        select world_id, min('stats/' || case when u then upper(player) else player end || '.json') as path, 'identity' as basis from files where player = lpad('2', 32, 'a') group by 1""",
    "stats_merge": f"with {_STATS} select * from merged",
    "stats_sections": f"with {_STATS} select category, key, value, rank from (select *, (row_number() over (partition by category order by value desc, key))::integer as rank from merged) where rank <= 12",
    "uuid_counts": "select '0000000a00000000000000000000000' || (p_size % 4) as uuid, count(distinct p_brand) as files from part group by p_size % 4",
    "identities": """with r as (select 'Player' || (s_suppkey % 9) as name, case when s_suppkey % 3 = 0 then '0000000a00000000000000000000000' || (s_suppkey % 9) end as uuid, s_suppkey = 7 as active, 'launcher' || (s_suppkey % 2) as launcher from supplier)
        select coalesce(uuid, lower(name)) as identity, max(name) as name, max(uuid) as uuid, bool_or(active) as active, string_agg(distinct launcher, ',' order by launcher) as launchers from r group by 1""",
    "world_match": f"with {_WORLDS} select * from worlds",
    "profile_summary": f"""with {_WORLDS} select count(*) filter (where availability = 'available') as available, count(*) filter (where availability = 'missing') as missing,
        count(*) filter (where availability = 'backup_only') as backup_only, count(*) filter (where played) as played from worlds""",
}
