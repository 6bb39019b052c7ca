"""Measures of a search: recall, correlation, error, throughput; and synthetic vectors to measure on."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits, queries and recall@k of found against truth, both (qid, rank, id)."""
    top = lambda df: df.where(F.col("rank") <= k).select("qid", "id")
    hits = top(found).join(top(truth), ["qid", "id"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    n = truth.agg(F.countDistinct("qid").alias("queries"))
    both = hits.crossJoin(n)  # of one row each
    return both.select("hits", "queries", F.when(F.col("queries") > 0, F.col("hits") / (F.col("queries") * k)).otherwise(0.0).alias("recall"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson's r of two columns, 0 where one doesn't vary."""
    # corr() itself divides by zero in ANSI mode
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.agg(F.coalesce(r, F.lit(0.0)).alias("pearson"))


def mean_absolute_error(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def agreement(moments: DataFrame) -> DataFrame:
    """One row, pearson and mae, of blocks' moments (operators.search.pair_moments): Pearson's r, 0 where one side doesn't vary."""
    total = moments.agg(*[F.sum(F.col(c)).alias(c) for c in ("n", "off")], *[F.sum(F.col("n") * F.col(c)).alias(f"n{c}") for c in ("a", "b")])
    mean = total.select("n", "off", F.try_divide("na", "n").alias("ma"), F.try_divide("nb", "n").alias("mb"))
    da, db = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    each = moments.withColumnRenamed("n", "m").drop("off").crossJoin(F.broadcast(mean))  # of one row
    over = lambda within, x: F.sum(F.col(within) + F.col("m") * x)
    found = each.agg(over("aa", da * da).alias("aa"), over("bb", db * db).alias("bb"), over("ab", da * db).alias("ab"), F.max("n").alias("n"), F.max("off").alias("off"), F.max("ma").alias("ma"), F.max("mb").alias("mb"))
    # deviations within rounding of the mean are none
    none = lambda dd, m: F.col(dd) <= F.col("n") * F.col(m) * F.col(m) * F.lit(1e-28)
    r = F.when(none("aa", "ma") | none("bb", "mb"), 0.0).otherwise(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")))
    return found.select(F.coalesce(r, F.lit(0.0)).alias("pearson"), F.try_divide("off", "n").alias("mae"))


def timed(run: Callable[[], DataFrame], queries: int, repeat: int = 1) -> dict[str, float]:
    """Seconds, seconds a query and queries a second of the fastest of some runs."""
    best = float("inf")
    for _ in range(repeat):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return {"seconds": best, "latency": best / max(1, queries), "qps": queries / best}


def sweep(spark: SparkSession, run: Callable[[int], DataFrame], efs: Sequence[int], truth: DataFrame, queries: int, k: int) -> DataFrame:
    """(ef, recall, seconds, qps) for each pool size."""
    rows = []
    for ef in efs:
        took = timed(lambda e=ef: run(e), queries)
        rows.append((ef, float(recall(run(ef), truth, k).first()["recall"]), took["seconds"], took["qps"]))
    return spark.createDataFrame(rows, "ef int, recall double, seconds double, qps double")


def selectivity_sweep(spark: SparkSession, rows: DataFrame, run: Callable[[DataFrame], DataFrame], shares: Sequence[float], queries: int) -> DataFrame:
    """(share, allowed, seconds, qps): run with allow-sets of so large a share of the ids."""
    out = []
    for share in shares:
        allow = rows.select("id").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
        took = timed(lambda a=allow: run(a), queries)
        out.append((share, allow.count(), took["seconds"], took["qps"]))
    return spark.createDataFrame(out, "share double, allowed bigint, seconds double, qps double")


# -- synthetic vectors: the same for the same seed, whatever the partitions -----------------------


def _generated(spark: SparkSession, n: int, make: Callable[[np.ndarray], np.ndarray], partitions: int | None) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            yield pd.DataFrame({"id": ids, "embedding": list(make(ids).astype(np.float32))})

    base = spark.range(n) if partitions is None else spark.range(0, n, 1, partitions)
    return base.mapInPandas(run, "id bigint, embedding array<float>")


def _noise(ids: np.ndarray, dim: int, seed: int) -> np.ndarray:
    return np.stack([np.random.default_rng((seed, int(i))).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))


def iid(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    return _generated(spark, n, lambda ids: _noise(ids, dim, seed), partitions)


def clustered(spark: SparkSession, n: int, dim: int, clusters: int, seed: int = 0, spread: float = 0.5, decay: float = 0.0, partitions: int | None = None) -> DataFrame:
    """Centres plus noise; with decay, coordinates shrink as exp(-decay * i / dim)."""
    centres = np.random.default_rng(seed).standard_normal((clusters, dim))
    scale = np.exp(-decay * np.arange(dim) / dim)
    return _generated(spark, n, lambda ids: (centres[ids % clusters] + spread * _noise(ids, dim, seed + 1)) * scale, partitions)


def planted(query: np.ndarray, cosines: Sequence[float], seed: int = 0) -> np.ndarray:
    """Unit vectors at the given cosines to the query."""
    rng, q = np.random.default_rng(seed), query / np.linalg.norm(query)
    out = []
    for c in cosines:
        other = rng.standard_normal(len(q))
        other -= (other @ q) * q
        out.append(c * q + np.sqrt(max(0.0, 1 - c * c)) * other / np.linalg.norm(other))
    return np.array(out, np.float32)
