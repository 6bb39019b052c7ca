"""Exact Hamming search within a radius by multi-index hashing (Norouzi, Punjani and Fleet, CVPR 2012).

A code is cut into bands. Two codes within distance r agree within r // bands in at least one band,
so candidates come from equi-joins on (band, value), the query side widened to all values within
that small radius; distances decide. Joins shuffle by band value; no pair outside a bucket is
compared. The k nearest are complete where the k-th is within the radius.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as C
from ..sources.scratch import materialize
from .search import eligible, search

#: Values that one band of a query may be widened to.
MAX_PROBES = 5000


def band_bits(dim: int, bands: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each band: none crosses a word, none is wider than 32 bits."""
    words = C.word_count(dim)
    each = max(1, -(-bands // words))
    out = []
    for w in range(words):
        bits, at = C.bits_in_word(dim, w), 0
        parts = max(each, -(-bits // 32))
        for i in range(parts):
            size = bits // parts + (i < bits % parts)
            if size:
                out.append((w, at, size))
            at += size
    return out


def _value(words: list[Column], band: tuple[int, int, int]) -> Column:
    word, at, size = band
    return F.shiftrightunsigned(words[word], at).bitwiseAND(F.lit((1 << size) - 1).cast("bigint"))


def _masks(size: int, radius: int) -> list[int]:
    """All differences of up to radius bits; refused where they are too many to join on."""
    if sum(comb(size, r) for r in range(min(radius, size) + 1)) > MAX_PROBES:
        raise ValueError(f"bands of {size} bits need more than {MAX_PROBES} probes for {radius} differing bits: use more bands or a smaller radius")
    return [sum(1 << b for b in chosen) for r in range(min(radius, size) + 1) for chosen in combinations(range(size), r)]


def banded(codes: DataFrame, dim: int, bands: int) -> DataFrame:
    """codes with a row for each band: band, value. Worth storing, bucketed by (band, value), for a corpus that is searched often."""
    words = [F.col(w) for w in C.word_names(dim)]
    cut = [F.struct(F.lit(i).alias("band"), _value(words, b).alias("value")) for i, b in enumerate(band_bits(dim, bands))]
    return codes.select("*", F.inline(F.array(*cut)))


def within(codes: DataFrame, queries: DataFrame, dim: int, radius: int, bands: int = 4, **filters) -> DataFrame:
    """(qid, id, distance) of all pairs within the radius; queries are (qid, embedding)."""
    layout = band_bits(dim, bands)
    near = radius // len(layout)
    names = C.word_names(dim)
    q = C.with_code(queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("embedding").alias("q")), dim, "q", "q_w").drop("q")
    qwords = [F.col(f"q_{n}") for n in names]
    probes = []
    for i, band in enumerate(layout):
        value = _value(qwords, band)
        wide = F.array(*[value.bitwiseXOR(F.lit(m).cast("bigint")) for m in _masks(band[2], near)])
        probes.append(q.select("*", F.lit(i).alias("band"), F.explode(wide).alias("value")))
    probe = probes[0]
    for part in probes[1:]:
        probe = probe.unionByName(part)
    rows = banded(eligible(codes, **filters).select("id", *names), dim, bands)
    found = rows.join(probe, ["band", "value"])
    distance = C.hamming_words([F.col(n) for n in names], qwords)
    # the same pair may meet in several bands
    return found.select("qid", "id", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def search_bands(codes: DataFrame, queries: DataFrame, dim: int, k: int, radius: int, bands: int = 4, **filters) -> DataFrame:
    """(qid, rank, id, distance, complete): the k nearest within the radius; complete where nothing nearer or tied can be missing."""
    by = Window.partitionBy("qid")
    ranked = within(codes, queries, dim, radius, bands, **filters).withColumn("rank", F.row_number().over(by.orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("complete", F.count(F.lit(1)).over(by) == k).select("qid", "rank", "id", "distance", "complete")


def search_bands_exact(codes: DataFrame, queries: DataFrame, dim: int, k: int, radius: int, bands: int = 4, step: int | None = None, **filters) -> DataFrame:
    """(qid, rank, id, distance): the radius grows, for the queries that need it, until all are complete or it spans the code."""
    step = step or len(band_bits(dim, bands))
    left, done = queries, None
    while True:
        # the hits of a round are read three times: a row a query and rank
        found = materialize(search_bands(codes, left, dim, k, radius, bands, **filters), "bands")
        whole = radius >= dim
        part = (found if whole else found.where("complete")).drop("complete")
        done = part if done is None else done.unionByName(part)
        if whole:
            return done
        left = left.join(found.where("complete").select("qid").distinct(), "qid", "left_anti")
        if left.isEmpty():
            return done
        if radius // len(band_bits(dim, bands)) >= 2:  # beyond this, wider probes cost more than a scan
            return done.unionByName(search(codes, left, dim, k, ef_limit=None, **filters))
        radius += step
