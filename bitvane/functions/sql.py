"""The engine's scalar functions and a k-nearest-neighbour table function, by name, for SQL.

    vs_quantize(embedding)            ARRAY<BIGINT>   the sign code
    vs_hamming(code, code)            INT             differing bits
    vs_cosine(a, b)                   DOUBLE          float cosine; 0 where either has no length
    vs_approx_cosine(distance, dim)   DOUBLE          the cosine a distance stands for
    vs_asym_score(query, code)        DOUBLE          asymmetric score of a code
    vs_rotate(embedding)              ARRAY<FLOAT>    by the model given to register()
    knn(query, k, ef)                 table           id, score, rank over the table given to register()
    vs_scores(TABLE(id, embedding))   table           qid, id, distance, score, asym with each query given to register_queries()
    vs_pools(TABLE(id, embedding), ef)  table         qid, id, distance: for each of them, what a partition has of the ef nearest

All but vs_rotate are SQL functions: the optimiser puts their expressions in the place of the call, so
they run in the JVM. knn is too: called laterally for a set of queries, it becomes one join of the
distinct queries with the table's codes, a pool of the ef nearest for each, to which floats are joined, and their k
best cosines. The optimiser can't bound a lateral call's ranking below the shuffle, so each pair's id and distance is
shuffled: knn is for a few queries. vs_scores and vs_pools are for many: table functions over Arrow batches that score
blocks of rows against all queries, with the scores of vs_hamming, vs_cosine and vs_asym_score, rounded as rows are ranked. vs_scores gives
the rows of a block in order of score.
A scalar function of two vectors costs tens of microseconds a pair, as expression and as Python function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.rotation import RotationModel
from . import codes as C

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0.0D, (s, x) -> s + x)"
_BIT = "CASE WHEN x > 0 AND NOT isnan(x) THEN shiftleft(1L, i) ELSE 0L END"

SCALARS = {
    "vs_quantize(v ARRAY<FLOAT>) RETURNS ARRAY<BIGINT>": f"""CASE WHEN size(v) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE
        transform(sequence(0, (size(v) - 1) div 64), w -> aggregate(transform(slice(v, CAST(w * 64 + 1 AS INT), 64), (x, i) -> {_BIT}), 0L, (a, b) -> a | b)) END""",
    "vs_hamming(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT": "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)",
    "vs_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"coalesce(try_divide({_DOT.format(a='a', b='b')}, sqrt({_DOT.format(a='a', b='a')}) * sqrt({_DOT.format(a='b', b='b')})), CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.0D END)",
    "vs_approx_cosine(distance INT, dim INT) RETURNS DOUBLE": "CASE WHEN dim = 0 THEN 1.0D ELSE cos(pi() * distance / dim) END",
    "vs_asym_score(q ARRAY<FLOAT>, code ARRAY<BIGINT>) RETURNS DOUBLE": """aggregate(transform(q, (x, i) ->
        CASE WHEN shiftrightunsigned(code[CAST(i div 64 AS INT)], i % 64) & 1 = 1 THEN CAST(x AS DOUBLE) ELSE -CAST(x AS DOUBLE) END), 0.0D, (s, x) -> s + x)""",
}
#: The table that knn() searches, as a view of the session.
KNN_VIEW = "vs_knn_table"
KNN = f"""CREATE OR REPLACE TEMPORARY FUNCTION knn(q ARRAY<FLOAT>, k INT, ef INT) RETURNS TABLE(id BIGINT, score DOUBLE, rank INT) RETURN
    SELECT id, score, rank FROM (
      SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
        SELECT p.id, round(nanvl(vs_cosine(knn.q, v.embedding), CAST('-infinity' AS DOUBLE)), 6) AS score FROM (
          SELECT id FROM (
            SELECT id, row_number() OVER (ORDER BY vs_hamming(code, vs_quantize(knn.q)), id) AS place FROM {KNN_VIEW})
          WHERE place <= greatest(knn.k, knn.ef)) p
        JOIN {KNN_VIEW} v ON p.id = v.id))
    WHERE rank <= knn.k"""


#: Pairs that vs_scores puts in order of score, so that equal scores are neighbours and a compressed file holds them once.
PAIRS_IN_ORDER = 4_000_000


def register_queries(spark: SparkSession, queries: DataFrame) -> None:
    """Register vs_scores and vs_pools for a query set (qid, embedding) that fits a broadcast; calls that were analysed before keep theirs."""
    found = queries.select("qid", "embedding").collect()  # the stated query set
    dim = len(found[0]["embedding"]) if found else 0
    held = spark.sparkContext.broadcast((np.array([r["qid"] for r in found], np.int64), np.array([r["embedding"] for r in found], np.float64).reshape(len(found), dim)))

    @F.arrow_udtf(returnType="qid bigint, id bigint, distance int, score double, asym double")
    class Scores:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            qids, qs = held.value
            if len(qids):
                for ids, made in S.scored_blocks(qs, rows.column("id").to_numpy(), C.rows_of(rows.column("embedding"), dim), tuple(S.PAIR_SCORES), PAIRS_IN_ORDER):
                    distance, score, asym = made["distance"].ravel(), C.ranked_numpy(made["cosine"].ravel()), made["asymmetric"].ravel()
                    # one sort of whole numbers, score above place, is faster than an argsort
                    order = np.sort((np.rint(np.maximum(score, -2.0) * 1e6).astype(np.int64) << 32) + np.arange(len(score))) & 0xFFFFFFFF
                    for a in range(0, len(order), S.PAIRS_AT_ONCE):
                        at = order[a : a + S.PAIRS_AT_ONCE]
                        yield pa.table({"qid": qids[at // len(ids)], "id": ids[at % len(ids)], "distance": distance[at], "score": score[at], "asym": C.ranked_numpy(asym[at])})

    @F.arrow_udtf(returnType="qid bigint, id bigint, distance int")
    class Pools:
        def __init__(self):
            self.kept = None

        def eval(self, rows: pa.RecordBatch, ef: pa.Array) -> Iterator[pa.Table]:
            qids, qs = held.value
            none = np.iinfo(np.int64).max
            for ids, made in S.scored_blocks(qs, rows.column("id").to_numpy(), C.rows_of(rows.column("embedding"), dim), ("distance",)) if len(qids) else ():
                most = max(0, int(ef[0].as_py()))
                if self.kept is None:
                    self.kept = [np.full((len(qids), most), none, np.int64) for _ in range(2)]
                order = np.argsort(ids, kind="stable")
                n = len(ids)
                keys = made["distance"][:, order].astype(np.int64) * n + np.arange(n)  # by distance, then by id
                keys = np.partition(keys, most - 1, axis=1)[:, :most] if n > most > 0 else keys
                d, i = (np.concatenate(x, axis=1) for x in ((self.kept[0], keys // n), (self.kept[1], ids[order][keys % n])))
                keep = np.lexsort((i, d), axis=1)[:, :most]
                self.kept = [np.take_along_axis(d, keep, 1), np.take_along_axis(i, keep, 1)]
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            if self.kept is not None:
                d, i = self.kept
                real = d < np.iinfo(np.int64).max
                yield pa.table({"qid": np.repeat(held.value[0], real.sum(axis=1)), "id": i[real], "distance": d[real].astype(np.int32)})

    spark.udtf.register("vs_scores", Scores)
    spark.udtf.register("vs_pools", Pools)


def register(spark: SparkSession, rotation: RotationModel | None = None, table: DataFrame | None = None) -> None:
    """Register the functions; knn needs table (id, embedding), vs_rotate a model."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    if rotation is not None:
        g = rotation.matrix.T.astype(np.float64)
        dim = rotation.dim

        @F.pandas_udf("array<float>")
        def vs_rotate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                yield pd.Series(list((C.stacked(v, dim).astype(np.float64) @ g).astype(np.float32)), dtype=object)

        spark.udf.register("vs_rotate", vs_rotate)
    if table is not None:
        table.selectExpr("id", "embedding", "vs_quantize(embedding) AS code").createOrReplaceTempView(KNN_VIEW)
        spark.sql(KNN)
