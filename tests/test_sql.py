"""The SQL functions: what they give pair by pair, and for a whole query set at once."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow.parquet as pq

from bitvane.functions import sql
from bitvane.operators import search as S
from bitvane.plans import catalog


def test_whole_query_sets(spark, sf_dir):
    """No join of all pairs and no shuffle of them; the rows are those of the scalar functions and of the lateral call."""
    v = catalog._vectors(spark, sf_dir)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scores, hits = catalog.sql_functions(spark, sf_dir), catalog.knn_udtf(spark, sf_dir)
    assert "NestedLoopJoin" not in plan(scores) + plan(hits) and "Cartesian" not in plan(scores) + plan(hits)
    sql.register(spark, table=v)
    catalog._queries(v).createOrReplaceTempView("vs_queries")
    each = spark.sql("SELECT qid, v.id, vs_hamming(vs_quantize(v.embedding), vs_quantize(q.embedding)) AS distance, round(vs_cosine(q.embedding, v.embedding), 6) AS score, round(vs_asym_score(q.embedding, vs_quantize(v.embedding)), 6) AS asym FROM vs_vectors v CROSS JOIN vs_queries q")
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, each.collect()))
    lateral = spark.sql("SELECT q.qid, t.rank, t.id, t.score FROM vs_queries q, LATERAL knn(q.embedding, 10, 100) t")
    assert sorted(map(tuple, hits.select("qid", "rank", "id", "score").collect())) == sorted(map(tuple, lateral.collect()))


def test_no_queries(spark, sf_dir):
    v = catalog._vectors(spark, sf_dir)
    sql.register_queries(spark, catalog._queries(v).where("qid < 0"))
    v.createOrReplaceTempView("vs_vectors")
    assert spark.sql("SELECT * FROM vs_scores(TABLE(SELECT id, embedding FROM vs_vectors))").count() == 0
    assert spark.sql("SELECT * FROM vs_pools(TABLE(SELECT id, embedding FROM vs_vectors), 5)").count() == 0


def test_written_scores_are_small(spark, tmp_path):
    """Where pairs are more than the scores that they can have, a written score takes less than half of its 8 bytes."""
    x = np.random.default_rng(7).normal(0, 0.5, (1000, 8)) + 1.0
    v = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "id bigint, embedding array<float>")
    sql.register_queries(spark, v.withColumnRenamed("id", "qid"))
    v.coalesce(1).createOrReplaceTempView("vs_vectors")
    spark.sql("SELECT * FROM vs_scores(TABLE(SELECT id, embedding FROM vs_vectors))").write.parquet(f"{tmp_path}/scores")
    stored = rows = 0
    for part in glob.glob(f"{tmp_path}/scores/*.parquet"):
        meta = pq.ParquetFile(part).metadata
        columns = [meta.row_group(g).column(c) for g in range(meta.num_row_groups) for c in range(meta.num_columns)]
        stored += sum(c.total_compressed_size for c in columns if c.path_in_schema == "score")
        rows += meta.num_rows
    assert rows == 1000 * 1000 and stored < 4 * rows


def test_scores_by_parts_of_the_queries(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, catalog.sql_functions(spark, sf_dir).collect()))
    batches = S.batches
    monkeypatch.setattr(S, "batches", lambda queries: batches(queries, 1))
    parts = catalog.sql_functions(spark, sf_dir)
    assert parts._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPythonUDTF vs_scores") > 1
    assert sorted(map(tuple, parts.collect())) == whole and whole


def test_scores_without_length_or_number(spark):
    """Vectors of zeros score 0 and those with NaN below all others, in blocks that are put in order too."""
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [-1.0, 0.0])], "id bigint, embedding array<float>")
    sql.register_queries(spark, v.where("id = 0").withColumnRenamed("id", "qid"))
    v.coalesce(1).createOrReplaceTempView("vs_vectors")
    found = spark.sql("SELECT id, distance, score FROM vs_scores(TABLE(SELECT id, embedding FROM vs_vectors))").collect()
    assert sorted(map(tuple, found)) == [(0, 0, 1.0), (1, 1, 0.0), (2, 2, float("-inf")), (3, 1, -1.0)]
