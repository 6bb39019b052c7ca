"""Codes and scores: hand patterns, flips, odd values, and numpy against expressions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitvane.functions import codes as C
from bitvane.operators.evaluate import planted


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id bigint, embedding array<float>")


def words(spark, rows, dim):
    got = C.with_code(frame(spark, rows), dim).orderBy("id").collect()
    return [[r[w] & (1 << 64) - 1 for w in C.word_names(dim)] for r in got]


def test_sizes():
    assert [C.padded_bytes(d) for d in (64, 65, 100, 1)] == [8, 16, 16, 8]
    assert [C.word_count(d) for d in (0, 1, 64, 65)] == [0, 1, 1, 2]
    assert [C.bits_in_word(100, w) for w in (0, 1, 2)] == [64, 36, 0]
    assert C.asymmetric_table(np.ones(64)).shape == (8, 256) and C.asymmetric_table(np.ones(65)).size == C.padded_bytes(65) * 256


def test_hand_pattern(spark):
    row = [1, -2, 3, -4, 5, 6, -7, 0]
    assert words(spark, [row], 8) == [[0x35]]
    assert C.pack_numpy(np.array([row], np.float32)).tolist() == [[0x35]]


@pytest.mark.parametrize("dim", [64, 100])
def test_flipped_signs(spark, dim):
    row = [(i + 1) * (1 if i % 2 == 0 else -1) for i in range(dim)]
    a, b = C.pack_numpy(np.array([row, [-x for x in row]], np.float32))
    assert C.hamming_numpy(a[None], a[None])[0, 0] == 0
    assert C.hamming_numpy(a[None], b[None])[0, 0] == dim
    assert words(spark, [row], dim)[0] == a.tolist()


def test_odd_values(spark):
    row = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e-30] + [0.0] * 57 + [1.0]
    assert words(spark, [row], 64) == [[1 << 1 | 1 << 5 | 1 << 63]]
    assert C.pack_numpy(np.array([row], np.float32))[0, 0] == 1 << 1 | 1 << 5 | 1 << 63


@pytest.mark.parametrize("dim", [1, 64, 100, 192])
def test_expressions_equal_numpy(spark, dim):
    x = np.random.default_rng(dim).standard_normal((40, dim)).astype(np.float32)
    x[3] = 0
    codes = C.pack_numpy(x)
    assert words(spark, x, dim) == codes.tolist()
    df = C.with_code(frame(spark, x), dim)
    q = F.array(*[F.lit(float(v)) for v in x[0]])
    names = C.word_names(dim)
    lits = [F.lit(int(w) - (1 << 64) if w >= 1 << 63 else int(w)).cast("bigint") for w in codes[0]]
    got = df.select(
        "id",
        C.hamming_words([F.col(n) for n in names], lits).alias("h"),
        C.cosine(q, F.col("embedding")).alias("c"),
        C.asymmetric(q, F.col("embedding")).alias("a"),
        C.asymmetric_words(q, [F.col(n) for n in names], dim).alias("aw"),
    ).orderBy("id").collect()
    per_bit = ((x > 0) != (x[0] > 0)).sum(axis=1)
    assert [r["h"] for r in got] == per_bit.tolist()
    assert np.allclose([r["c"] for r in got], C.cosine_numpy(x[:1], x)[0], atol=1e-6)
    naive = (np.where(x > 0, 1.0, -1.0) * x[0].astype(float)).sum(axis=1)
    table = C.asymmetric_numpy(C.asymmetric_table(x[0].astype(np.float64)), codes)
    for found in ([r["a"] for r in got], [r["aw"] for r in got], table):
        assert np.allclose(found, naive, atol=1e-3)


def test_zero_vector_has_cosine_zero(spark):
    df = frame(spark, [[0, 0, 0], [1, 2, 3]])
    got = df.select(C.cosine(F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.col("embedding")).alias("c")).collect()
    assert got[0]["c"] == 0.0 and got[1]["c"] > 0.9


def test_nan_scores_rank_last(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, -1.0)], "id int, s double")
    order = [r["id"] for r in df.select("id", C.ranked_score(F.col("s")).alias("s")).orderBy(F.desc("s"), "id").collect()]
    assert order == [2, 3, 1]


def test_approximation_of_controlled_cosines(spark):
    rng = np.random.default_rng(7)
    true = rng.uniform(-1, 1, 1000)
    q = rng.standard_normal((1000, 512))
    x = np.concatenate([planted(q[i], [c], seed=i) for i, c in enumerate(true)])
    a, b = C.pack_numpy(q.astype(np.float32)), C.pack_numpy(x)
    h = np.bitwise_count(a ^ b).sum(axis=1)
    df = spark.createDataFrame(list(zip(map(float, true), map(int, h))), "t double, h int").withColumn("e", C.approx_cosine(F.col("h"), 512))
    from bitvane.operators.evaluate import correlation, mean_absolute_error

    assert mean_absolute_error(df, "t", "e").first()["mae"] < 0.05
    assert correlation(df, "t", "e").first()["pearson"] > 0.98
    assert df.select(C.approx_cosine(F.col("h"), 0).alias("x")).first()["x"] == 1.0
    assert correlation(df.withColumn("k", F.lit(1.0)), "t", "k").first()["pearson"] == 0.0


def test_planted_neighbours(spark):
    rng = np.random.default_rng(3)
    q = rng.standard_normal(512)
    x = np.concatenate([planted(q, rng.uniform(0.7, 0.9, 10), 1), planted(q, rng.uniform(0, 0.3, 190), 2)])
    h = C.hamming_numpy(C.pack_numpy(q[None].astype(np.float32)), C.pack_numpy(x))[0]
    assert len(set(np.argsort(h, kind="stable")[:10]) & set(range(10))) >= 9
