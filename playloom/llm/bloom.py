"""Bloom filters of bounded size as rows of bit blocks, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playloom.llm.columns import fresh

#: Bits of a block (4 KB).
BLOCK_BITS = 32768
#: Blocks of a filter that is broadcast, at most (16 MB).
MAX_BLOCKS = 4096


def blocks_for(rows: int, most: int = MAX_BLOCKS) -> int:
    """Sixteen bits a row, up to the bound."""
    return max(1, min(most, -(-rows * 16 // BLOCK_BITS)))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bits_of(key: str) -> list[Column]:
    """Two bits of the key's block."""
    second = F.xxhash64(F.col(key), F.lit(1))
    return [F.shiftrightunsigned(second, k).bitwiseAND(BLOCK_BITS - 1).cast("int") for k in (0, 24)]


def bit_rows(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bit) of every key."""
    return keys.select(block_of(key, blocks).alias("block"), F.explode(F.array_distinct(F.array(*bits_of(key)))).alias("bit"))


def filter_of(bits: DataFrame) -> DataFrame:
    """The filter as rows (block, bits) from rows (block, bit)."""
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0


def marked(rows: DataFrame, key: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """Adds ``flag``: false only for keys that are not in the filter, which has at most ``blocks`` rows of 4 KB and is broadcast."""
    block, bits = fresh(rows, "bloom_block", "bloom_bits")
    probe = F.broadcast(bloom.select(F.col("block").alias(block), F.col("bits").alias(bits)))
    joined = rows.withColumn(block, block_of(key, blocks)).join(probe, block, "left")
    hit = F.col(bits).isNotNull()
    for bit in bits_of(key):
        hit = hit & is_set(F.col(bits), bit)
    return joined.withColumn(flag, hit).drop(block, bits)


def passing(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among the wanted ones: a join after it shuffles few others."""
    blocks = blocks_for(wanted.count())
    (flag,) = fresh(rows, "bloom_hit")
    return marked(rows, key, filter_of(bit_rows(wanted, key, blocks).distinct()), blocks, flag).filter(flag).drop(flag)
