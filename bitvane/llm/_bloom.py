"""Blocked Bloom filters in DataFrame functions: one 4 KB bitmap for each block of hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh

#: Bits in the bitmaps that bitmap_construct_agg makes.
BLOCK_BITS = 32768


def block_count(rows: int, bits_per_row: int, max_bytes: int) -> int:
    """Blocks of a filter for so many rows: a power of two, and never more bytes than may be broadcast."""
    wanted = max(1, math.ceil(rows * bits_per_row / BLOCK_BITS))
    most = max(1, max_bytes // (BLOCK_BITS // 8))
    return min(1 << (wanted - 1).bit_length(), 1 << (most.bit_length() - 1))


def _cells(h: Column, probes: int) -> Column:
    """Bit positions in the block, 15 bits of a second hash for each probe."""
    other = F.xxhash64(h, F.lit(7))
    return F.array(*[F.shiftrightunsigned(other, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(probes)])


def build(df: DataFrame, h: Column, blocks: int, probes: int = 3) -> DataFrame:
    """(block, bits): the filter of df's hashes, at most blocks rows of 4 KB.

    Each task sends one bitmap a block, which are merged by or.
    """
    keyed = df.select(F.pmod(h, F.lit(blocks)).alias("block"), h.alias("h"))
    cells = keyed.select("block", F.explode(_cells(F.col("h"), probes)).alias("cell"))
    return cells.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits"))


def repeated(df: DataFrame, h: Column, cells_log2: int = 44) -> DataFrame:
    """(cell) of a one-probe filter of 2**cells_log2 bits that two rows or more of df hit.

    So large a filter is sparse, so it is held as its cells and not as bitmaps: a task's share is at most one
    number a row, copies within the task are merged before the shuffle, and bitmaps of the same filter
    would be as large for each task as for the whole table.
    """
    cell = _cell(h, cells_log2).alias("cell")
    return df.select(cell).groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1").select("cell")


def _cell(h: Column, cells_log2: int) -> Column:
    return F.shiftrightunsigned(h, 64 - cells_log2)


def flag_repeats(df: DataFrame, h: Column, again: DataFrame, bits_per_cell: int, probes: int, max_bytes: int, cells_log2: int = 44) -> tuple[DataFrame, str]:
    """df with a boolean column, whose name is returned too: whether h's cell may be one of again, written repeated() of df."""
    blocks = block_count(again.count(), bits_per_cell, max_bytes)
    return flag(df, _cell(h, cells_log2), build(again, F.col("cell"), blocks, probes), blocks, probes)


def _hit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def flag(df: DataFrame, h: Column, bloom: DataFrame, blocks: int, probes: int = 3) -> tuple[DataFrame, str]:
    """df with a boolean column, whose name is returned too: whether h may be in the filter."""
    h_name, block, cells, name, bits = fresh(df, "h", "block", "cells", "maybe", "bits")
    keyed = df.withColumn(h_name, h)
    keyed = keyed.withColumn(block, F.pmod(F.col(h_name), F.lit(blocks))).withColumn(cells, _cells(F.col(h_name), probes))
    side = bloom.select(F.col("block").alias(block), F.col("bits").alias(bits))
    probed = keyed.join(F.broadcast(side), block, "left")  # of a size that block_count() bounds
    hit = F.col(bits).isNotNull()
    for i in range(probes):
        hit = hit & F.coalesce(_hit(F.col(bits), F.col(cells)[i]), F.lit(False))
    return probed.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name)), name
