"""The entry module: every retrieval query runs on the smallest data and equals its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from bitvane.functions import sql
from bitvane.operators import evaluate
from bitvane.operators import search as S
from bitvane.operators.rotation import RotationModel
from bitvane.plans import catalog


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["qid", "rank", "id", "score"] and got.count() > 0


def test_names():
    names, twins = set(entry.queries()), set(entry.oracle_sql())
    assert set(catalog.QUERIES) <= names and twins <= names


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(r[c] for c in order) for r in rows) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_recall_bands(spark):
    """Published for this table at a pool of 100: Hamming alone .352, exact re-ranking .842, on ids 0-49."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    q = v.where("id < 50").withColumnRenamed("id", "qid")
    codes, truth = S.encode(v, 64), S.cosine_top(v, q, 10).persist()
    at = lambda df: round(evaluate.recall(df, truth, 10).first()["recall"], 3)
    assert at(S.search(codes, q, 64, 10)) == 0.352
    assert at(S.search_reranked(codes, q, 64, 10, 100)) == 0.45
    assert at(S.search_exact_reranked(codes, v, q, 64, 10, 100)) == 0.842


def test_sql_rotation(spark):
    sql.register(spark, rotation=RotationModel.identity(3))
    got = spark.sql("SELECT vs_rotate(array(float(1), float(2), float(-3))) AS r, vs_approx_cosine(0, 64) AS one, vs_approx_cosine(5, 0) AS none").first()
    assert list(got["r"]) == [1.0, 2.0, -3.0] and got["one"] == 1.0 and got["none"] == 1.0


def test_sweeps(spark):
    v = evaluate.iid(spark, 100, 16, seed=1, partitions=2).persist()
    q = v.where("id < 5").withColumnRenamed("id", "qid")
    codes, truth = S.encode(v, 16), S.cosine_top(v, q, 5)
    got = evaluate.sweep(spark, lambda ef: S.search_exact_reranked(codes, v, q, 16, 5, ef), (5, 100), truth, 5, 5).collect()
    assert got[1]["recall"] == 1.0 >= got[0]["recall"] and got[0]["qps"] > 0
    by = evaluate.selectivity_sweep(spark, v, lambda allow: S.search(codes, q, 16, 5, allow=allow), (0.0, 1.0), 5).collect()
    assert [r["allowed"] for r in by] == [0, 100]
    assert evaluate.iid(spark, 100, 16, seed=1, partitions=5).exceptAll(v).count() == 0
