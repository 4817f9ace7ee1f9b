"""Running sums over a whole table in a given order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playloom.shared import materialize


def running_sums(rows: DataFrame, order: str, sums: dict[str, str], blocks: int | None = None) -> DataFrame:
    """The rows with running sums: ``sums`` names the new column of each summed one. ``order`` must be unique.

    Two levels: ranges of the order become blocks, which are summed up and added up in a table of one row
    for each block; within a block a window adds the rest.
    """
    blocks = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = "prefix_block"
    dealt = materialize(rows.repartitionByRange(blocks, order).withColumn(block, F.spark_partition_id()), "prefix")
    per = dealt.groupBy(block).agg(*[F.sum(c).alias(new) for new, c in sums.items()])
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    per = per.select(block, *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"{new}_before") for new in sums])
    own = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"{new}_before")).alias(new) for new, c in sums.items()]
    return dealt.join(per, block).select(*rows.columns, *totals)
