"""Bounded samples of texts to learn from, drawn in the order of a hash and bounded before anything is collected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Key = tuple[str | None, int]


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"))


def place(*columns: Column, salt: int) -> Column:
    """A place in 0..1 by a hash, the same in every run."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def within(sizes: Iterable[tuple[Key, int]], most: int) -> list[Key]:
    """Keys in their order as long as their sizes together fit; one too large for what is left is passed over, not the ones after it."""
    out, left = [], most
    for key, size in sizes:
        if size <= left:
            out.append(key)
            left -= size
    return out


def texts_of(docs: DataFrame, keys: list[Key], doc_id: str, text: str, *more: str) -> dict[Key, Row]:
    """(text, more) of the rows with these ids, as text, and text hashes: one for each key, the least of those that differ in other columns."""
    if not keys:
        return {}
    wanted = docs.sparkSession.createDataFrame(keys, "_id string, _hash bigint")
    kept = [F.col(f"`{doc_id}`").cast("string").alias("_id"), text_hash(text).alias("_hash"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(c) for c in more]]
    rows = docs.select(*kept)
    same = rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_hash"] == wanted["_hash"])
    found = rows.join(F.broadcast(wanted), same, "left_semi")  # a bounded list of keys
    # copies of a row are put together before they are collected
    found = found.groupBy("_id", "_hash").agg(F.min(F.struct("text", *more)).alias("row"))
    return {(r["_id"], r["_hash"]): r["row"] for r in found.collect()}
