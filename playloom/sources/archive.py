"""The read-model archive as DataFrames over the given tables.

Regions stand for scan locations, nations for launchers, customers for
instances, orders with their lineitems for sessions, lineitems for activity
segments and suppliers for servers; all derived fields are integer arithmetic
on keys. ``ARCHIVE_SQL`` states the same tables as DuckDB common table
expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playloom.functions.core import ascii_lower, label
from playloom.shared import table

VERSIONS = {"1-URGENT": "1.20.1", "2-HIGH": "1.21", "3-MEDIUM": "24w14a", "4-NOT SPECIFIED": "1.21-pre1"}


class Archive:
    """Tables of one archive; each property is a fresh logical plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def locations(self) -> DataFrame:
        kinds = F.array(*[F.lit(k) for k in ("official", "prism", "multimc", "manual")])
        return self._table("region").select(F.col("r_regionkey").alias("location_id"), F.element_at(kinds, F.col("r_regionkey") % 4 + 1).alias("adapter_kind"))

    @property
    def launchers(self) -> DataFrame:
        return self._table("nation").filter("n_nationkey % 5 <> 0").select(
            F.col("n_nationkey").alias("launcher_id"), F.col("n_regionkey").alias("location_id"), F.col("n_name").alias("launcher_name")
        )

    @property
    def instances(self) -> DataFrame:
        nations = self._table("nation").select("n_nationkey", F.col("n_regionkey").alias("location_id"))
        key = F.col("c_nationkey")
        return self._table("customer").join(nations, F.col("n_nationkey") == key).select(
            F.col("c_custkey").alias("instance_id"), "location_id", F.when(key % 5 != 0, key).alias("launcher_id"),
            F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("instance_name"),
        )

    @property
    def sessions(self) -> DataFrame:
        key = F.col("o_orderkey")
        lines = self._table("lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity").cast("long") * 97).alias("length"))
        start = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + key % 86400 * 1000
        seconds = F.when(key % 11 != 0, F.coalesce("length", F.lit(0)))
        late = F.when(key % 13 == 0, 5000).otherwise(0) + F.when(key % 97 == 0, 40 * 86_400_000).otherwise(0)
        version = F.lit("")
        for priority, name in VERSIONS.items():
            version = F.when(F.col("o_orderpriority") == priority, name).otherwise(version)
        score = (key * 37 % 101).cast("int")
        return self._table("orders").join(lines, key == F.col("l_orderkey"), "left").select(
            key.alias("session_id"), F.col("o_custkey").alias("instance_id"), start.alias("start_ms"),
            (start + seconds * 1000 + late).alias("end_ms"), seconds.alias("seconds"),
            F.when(F.col("o_orderstatus") == "F", "clean").when(F.col("o_orderstatus") == "O", "crash").otherwise("unknown").alias("exit_kind"),
            score.alias("score"), label(score).alias("label"), version.alias("version"),
            F.when(key % 3 == 0, "fabric").when(key % 3 == 1, "forge").alias("loader"),
            F.when(key % 17 != 0, (F.col("o_custkey") % 27 - 13) * 60).cast("int").alias("offset_min"),
        )

    @property
    def user_state(self) -> DataFrame:
        return self._table("orders").filter("o_orderkey % 19 in (0, 1)").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 19 == 0).alias("ignored"))

    @property
    def servers(self) -> DataFrame:
        name = F.when(F.col("s_suppkey") % 3 == 0, None).when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_name"))
        return self._table("supplier").select(F.col("s_suppkey").alias("server_id"), ascii_lower(F.col("s_name")).alias("address"), name.alias("display_name"))

    @property
    def scans(self) -> DataFrame:
        return self._table("region").select(F.col("r_regionkey").alias("scan_id"), F.when(F.col("r_regionkey") % 2 == 0, "completed").otherwise("failed").alias("state"))

    @property
    def sources(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._table("customer").filter("c_custkey % 4 < 3").select(key.alias("instance_id"), (key % 5).alias("scan_id"), F.when(key % 7 != 0, key).alias("current_revision"))

    @property
    def segments(self) -> DataFrame:
        flag, line = F.col("l_returnflag"), F.col("l_linenumber")
        kind = F.when(flag == "R", "server").when(flag == "A", "world").when(line % 2 == 1, "menu").otherwise("unknown")
        brands = self._table("part").select("p_partkey", "p_brand")
        world = F.when(flag == "A", F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.col("p_brand")))
        return self._table("lineitem").join(brands, F.col("p_partkey") == F.col("l_partkey"), "left").select(
            F.col("l_orderkey").alias("session_id"), kind.alias("kind"), F.when(flag == "R", F.col("l_suppkey")).alias("server_id"),
            world.alias("world"), ((line * 29 + F.col("l_partkey")) % 101).cast("int").alias("segment_score"),
        )


ARCHIVE_SQL = """
locations as (select r_regionkey as location_id, (['official', 'prism', 'multimc', 'manual'])[r_regionkey % 4 + 1] as adapter_kind from region),
launchers as (select n_nationkey as launcher_id, n_regionkey as location_id, n_name as launcher_name from nation where n_nationkey % 5 <> 0),
instances as (
    select c_custkey as instance_id, n_regionkey as location_id, case when c_nationkey % 5 <> 0 then c_nationkey end as launcher_id,
           c_mktsegment || ' ' || (c_custkey % 40) as instance_name
    from customer join nation on n_nationkey = c_nationkey),
lengths as (select l_orderkey, sum(l_quantity)::bigint * 97 as length from lineitem group by all),
sessions0 as (
    select o_orderkey as session_id, o_custkey as instance_id, epoch_ms(o_orderdate) + o_orderkey % 86400 * 1000 as start_ms,
           case when o_orderkey % 11 <> 0 then coalesce(length, 0) end as seconds,
           case o_orderstatus when 'F' then 'clean' when 'O' then 'crash' else 'unknown' end as exit_kind, (o_orderkey * 37 % 101)::integer as score,
           case o_orderpriority when '1-URGENT' then '1.20.1' when '2-HIGH' then '1.21' when '3-MEDIUM' then '24w14a' when '4-NOT SPECIFIED' then '1.21-pre1' else '' end
               as version,
           case o_orderkey % 3 when 0 then 'fabric' when 1 then 'forge' end as loader,
           (case when o_orderkey % 17 <> 0 then (o_custkey % 27 - 13) * 60 end)::integer as offset_min
    from orders left join lengths on l_orderkey = o_orderkey),
sessions as (
    select *, start_ms + seconds * 1000 + (case when session_id % 13 = 0 then 5000 else 0 end) + (case when session_id % 97 = 0 then 3456000000 else 0 end) as end_ms,
           case when score >= 80 then 'verified' when score >= 55 then 'high' when score >= 30 then 'partial' else 'unknown' end as label
    from sessions0),
servers as (
    select s_suppkey as server_id, lower(s_name) as address, case when s_suppkey % 3 = 0 then null when s_suppkey % 7 = 0 then '' else s_name end as display_name from supplier),
segments as (
    select l_orderkey as session_id, case when l_returnflag = 'R' then 'server' when l_returnflag = 'A' then 'world' when l_linenumber % 2 = 1 then 'menu' else 'unknown'
        end as kind,
           case when l_returnflag = 'R' then l_suppkey end as server_id,
           case when l_returnflag = 'A' then case when l_partkey % 50 = 0 then '' else p_brand end end as world, ((l_linenumber * 29 + l_partkey) % 101)::integer as segment_score
    from lineitem left join part on p_partkey = l_partkey),
scans as (select r_regionkey as scan_id, case when r_regionkey % 2 = 0 then 'completed' else 'failed' end as state from region),
sources as (select c_custkey as instance_id, c_custkey % 5 as scan_id, case when c_custkey % 7 <> 0 then c_custkey end as current_revision from customer where c_custkey % 4 < 3),
visible as (
    select s.*, i.instance_name, i.location_id, i.launcher_id, coalesce(l.launcher_name, case o.adapter_kind when 'official' then 'Official launcher' when 'prism' then
        'Prism Launcher' when 'multimc' then 'MultiMC' else 'Manual folder' end) as launcher,
           coalesce(seconds > 2678400, false) or coalesce(end_ms < start_ms, false) or coalesce(end_ms - start_ms > 2678400000, false) or coalesce(abs(end_ms - start_ms
               - seconds * 1000) >= 1000, false) as wrong,
           date '1970-01-01' + floor((start_ms + coalesce(offset_min, 0) * 60000) / 86400000.0)::integer as local_day
    from sessions s join instances i using (instance_id) join locations o on o.location_id = i.location_id left join launchers l on l.launcher_id = i.launcher_id
    where session_id % 19 <> 0),
runs as (
    select *, case when not wrong then seconds end as run_s, case when not wrong then end_ms end as run_end, case when wrong then least(score, 54) else score end as run_score
    from visible)"""
