"""Recall and throughput on clustered vectors: python examples/throughput.py [n] [dim] [queries] [k] [shards].

The data are synthetic (centres plus noise), as the published measurements' are: 100,000 vectors of
512 dimensions, 1,000 queries, k = 10. Codes and vectors are written once and read from Parquet.
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitvane.operators import evaluate, graph
from bitvane.operators import search as S
from bitvane.plans.planner import IndexConfig


def main(n: int = 100_000, dim: int = 512, queries: int = 1_000, k: int = 10, shard_count: int = 1) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bitvane-throughput-")
    evaluate.clustered(spark, n + queries, dim, 1000, seed=1, partitions=16).write.parquet(f"{folder}/vectors")
    every = spark.read.parquet(f"{folder}/vectors")
    vectors, q = every.where(F.col("id") < n), every.where(F.col("id") >= n).withColumnRenamed("id", "qid")
    S.encode(vectors, dim).write.parquet(f"{folder}/codes")
    codes = spark.read.parquet(f"{folder}/codes")
    codes.count()
    config = IndexConfig(dim, shards=shard_count, max_ef_search=512)
    began = time.perf_counter()
    graph.build_shards(codes, config).write.parquet(f"{folder}/graph")
    print("graph build", round(time.perf_counter() - began, 2), "s", flush=True)
    shards = spark.read.schema(graph.SHARD).parquet(f"{folder}/graph")
    began = time.perf_counter()
    shards.write.format("noop").mode("overwrite").save()
    print("graph load", round(time.perf_counter() - began, 3), "s", flush=True)
    truth = S.cosine_top(vectors, q, k, method="blocks").persist()
    print("exact cosine", evaluate.timed(lambda: S.cosine_top(vectors, q, k, method="blocks"), queries, 2), flush=True)
    for ef in (25, 50, 100):
        runs = {
            "hamming": lambda: S.search(codes, q, dim, k, method="blocks"),
            "asymmetric": lambda e=ef: S.search_reranked(codes, q, dim, k, e, method="blocks"),
            "exact": lambda e=ef: S.search_exact_reranked(codes, vectors, q, dim, k, e, method="blocks"),
            "graph": lambda e=ef: graph.search_shards(shards, q, config, e).where(F.col("rank") <= k),
            "graph, asymmetric": lambda e=ef: S.search_reranked(codes, q, dim, k, e, found=graph.search_shards(shards, q, config, e)),
            "graph, exact": lambda e=ef: S.search_exact_reranked(codes, vectors, q, dim, k, e, found=graph.search_shards(shards, q, config, e)),
        }
        for name, run in runs.items():
            if name == "hamming" and ef > 25:
                continue
            took = evaluate.timed(run, queries, 2)
            print(ef, name, {a: round(b, 4) for a, b in took.items()}, "recall", round(evaluate.recall(run(), truth, k).first()["recall"], 4), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
