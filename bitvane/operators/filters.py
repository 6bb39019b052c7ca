"""Allow-sets and tombstones: from bitmaps to rows of ids and back, their size, and what they admit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.planner import IndexConfig, Pool, plan_pool
from .search import eligible

__all__ = ["allow_count", "allow_from_bitmap", "allow_to_bitmap", "choose_pool", "eligible", "is_deleted"]


def allow_from_bitmap(spark: SparkSession, words: np.ndarray, capacity: int) -> DataFrame:
    """(id) of the set bits of 64-bit words, least significant first; bits beyond capacity don't count."""
    bits = np.unpackbits(np.asarray(words, "<u8").view(np.uint8), bitorder="little")[:capacity]
    return spark.createDataFrame([(int(i),) for i in np.flatnonzero(bits)], "id bigint")


def allow_to_bitmap(allow: DataFrame, capacity: int) -> DataFrame:
    """(bucket, bits): the allow-set as bitmaps of 32,768 ids each, built before the shuffle.

    Bit positions repeat in every bucket, so the bucket is always part of the key.
    """
    known = allow.where((F.col("id") >= 0) & (F.col("id") < capacity))
    return known.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


#: Ids of a bitmap of deletions: bucket b has ids b * 32,768 and following, one bit each.
BITS = 32_768


def bitmaps_of(ids: DataFrame) -> DataFrame:
    """(bucket, bits) of ids (id) from 0 on, built before the shuffle."""
    placed = ids.select(F.shiftright("id", 15).alias("bucket"), F.col("id").bitwiseAND(F.lit(BITS - 1)).alias("bit"))
    return placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def ids_of_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """(id) of the set bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bucket, bits in zip(batch["bucket"], batch["bits"]):
                yield pd.DataFrame({"id": np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.int64) + bucket * BITS})

    return bitmaps.mapInPandas(run, "id bigint")


def changed_bitmaps(have: DataFrame, ids: DataFrame, gone: bool) -> DataFrame:
    """(bucket, bits, changed): the bitmaps that ids, bitmaps too, are set in or else cleared from, and how many bits that changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for bucket, old, own in batch[["bucket", "old", "own"]].itertuples(index=False):
                before = np.zeros(BITS // 8, np.uint8) if old is None else np.frombuffer(old, np.uint8)
                own = np.frombuffer(own, np.uint8)
                after = before | own if gone else before & ~own
                changed = int(np.bitwise_count(before ^ after).sum())
                if changed:
                    out.append((bucket, after.tobytes(), changed))
            yield pd.DataFrame(out, columns=["bucket", "bits", "changed"])

    both = ids.withColumnRenamed("bits", "own").join(have.withColumnRenamed("bits", "old"), "bucket", "left")
    return both.mapInPandas(run, "bucket bigint, bits binary, changed bigint")


def _marked(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows with _set: whether the id's bit is set. The side of the join is left to the optimiser."""
    at = F.col("id").bitwiseAND(F.lit(BITS - 1))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    side = bitmaps.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    return rows.join(side, F.shiftright("id", 15) == F.col("_bucket"), "left").withColumn("_set", F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def not_in_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return _marked(rows, bitmaps).where(~F.col("_set")).drop("_set")


def in_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return _marked(rows, bitmaps).where("_set").drop("_set")


def allow_count(allow: DataFrame, capacity: int) -> int:
    """How many different ids in 0..capacity-1 the set has, inserted or not, deleted or not."""
    sums = allow_to_bitmap(allow, capacity).agg(F.sum(F.bitmap_count("bits")).alias("n")).first()
    return int(sums["n"] or 0)


def is_deleted(rows: DataFrame, tombstones: DataFrame, out: str = "deleted") -> DataFrame:
    """rows with a flag; ids that no tombstone names aren't deleted, whether inserted or not."""
    marked = tombstones.select(F.col("id").cast("bigint").alias("id")).distinct().withColumn(out, F.lit(True))
    return rows.join(marked, "id", "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def choose_pool(allow: DataFrame | None, ef: int, capacity: int, config: IndexConfig, has_graph: bool) -> Pool:
    """The access path for a search; counts the allow-set only if a graph makes it matter."""
    count = allow_count(allow, capacity) if allow is not None and has_graph else None
    return plan_pool(count, ef, capacity, has_graph, config.filter_scan_limit)
