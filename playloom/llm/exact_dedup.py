"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when they are identical without ASCII white space. Pass one
sets two bits of one 4 KB block per text and keeps the bits that were hit at
least twice; pass two probes every row. A row with a bit that was hit once has
no equal anywhere, so it passes straight through; only possibly repeated rows
are shuffled, by the SHA-256 of their normalised text, and settled exactly.

Scale: the filter has at most ``max_blocks`` blocks (4,096 of 4 KB = 16 MB by
default), which bounds what is broadcast at any input size. Beyond about ten
million rows the filter fills up and more rows go the exact way, so results
stay whole. Copies of one text meet partial aggregates (bits, group winners)
or a rank limit before each shuffle, never one task.

Defined results: null text counts as empty; empty texts equal each other; ties
go to the smaller doc_id (null last); rows that repeat a doc_id with equal text
are all marked kept by :func:`annotate`, while :func:`dedup` returns one of
them; empty tables give empty results; other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playloom.llm.bloom import MAX_BLOCKS, bit_rows, blocks_for, filter_of, marked
from playloom.llm.columns import SPACE, fresh, whole_text
from playloom.shared import materialize


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 and n_points (code points of the original text)."""
    return docs.select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"), F.char_length(whole_text()).alias("n_points"))


def repeated_filter(keys: DataFrame, sha: str, blocks: int) -> DataFrame:
    """The filter as rows (block, bits): bits hit by two rows or more."""
    twice = bit_rows(keys, sha, blocks).groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return filter_of(twice.select("block", "bit"))


def annotate(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = materialize(digests(docs), "exact-keys")
    blocks = blocks_for(keys.count(), max_blocks)
    rows = marked(keys, "text_sha256", repeated_filter(keys, "text_sha256", blocks), blocks, "again")
    maybe = rows.filter("again")
    groups = maybe.groupBy("text_sha256").agg(
        F.max(F.struct("n_points", (-F.col("doc_id")).alias("id"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    # Written first: the join then has a plain exchange on both sides, so AQE can split a group that holds much of the corpus.
    groups = materialize(groups.filter("group_size > 1").select("text_sha256", (-F.col("best.id")).alias("keep_id"), "group_size"), "exact-groups")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    settled = (
        maybe.join(groups, "text_sha256", "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    )
    once = rows.filter("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return once.unionByName(settled.select(out)).select(out)


def dedup(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The rows that stay, with all their columns; possibly repeated rows are ranked per text, one row at most leaves each map task."""
    keys = materialize(digests(docs).select("text_sha256"), "exact-keys")
    blocks = blocks_for(keys.count(), max_blocks)
    bloom = materialize(repeated_filter(keys, "text_sha256", blocks), "exact-bloom")
    sha, flag, rank = fresh(docs, "exact_sha", "exact_again", "exact_rank")
    rows = marked(docs.withColumn(sha, F.sha2(normalised(), 256)), sha, bloom, blocks, flag)
    order = Window.partitionBy(sha).orderBy(F.char_length(whole_text()).desc(), F.col("doc_id").asc_nulls_last())
    best = rows.filter(F.col(flag)).withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).drop(rank)
    return rows.filter(~F.col(flag)).unionByName(best).select(docs.columns)
