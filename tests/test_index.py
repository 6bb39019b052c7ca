"""Index lifecycle: what mutations accept, versions, searches after them, a change stream."""

from __future__ import annotations

import numpy as np
import pytest

from bitvane.operators import integrity
from bitvane.operators import search as S
from bitvane.operators.index import LostRace, VectorIndex
from bitvane.plans.planner import IndexConfig, Pool
from bitvane.streaming import changes

DIM = 32


def vectors(spark, x, first=0):
    return spark.createDataFrame([(int(i) + first, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, embedding array<float>")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


def hits(index, spark, x, k=1):
    q = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "qid bigint, embedding array<float>")
    return sorted((r["qid"], r["rank"], r["id"], r["distance"]) for r in index.search(q, k).collect())


@pytest.fixture()
def index(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((60, DIM)).astype(np.float32)
    made = VectorIndex.create(spark, str(tmp_path / "index"), IndexConfig(DIM), 60)
    n, made = made.insert(vectors(spark, x))
    assert n == 60
    return x, made


def test_insert_refuses(spark, index):
    x, made = index
    bad = spark.createDataFrame([(None, [0.0] * DIM), (1, None), (2, [1.0]), (3, [None] * DIM), (99, [1.0] * DIM), (5, [1.0] * DIM)], "id bigint, embedding array<float>")
    n, same = made.insert(bad)
    assert n == 0 and same.manifest.version == made.manifest.version
    reasons = {r["reason"] for r in made.rejects(bad).collect()}
    assert reasons == {"null id", "null embedding", "wrong length", "null element", "id out of range"}


def test_nan_is_kept(spark, tmp_path):
    made = VectorIndex.create(spark, str(tmp_path / "nan"), IndexConfig(2), 2)
    n, made = made.insert(spark.createDataFrame([(0, [float("nan"), 1.0]), (1, [1.0, 1.0])], "id bigint, embedding array<float>"))
    assert n == 2 and [r["w0"] for r in made.codes().orderBy("id").collect()] == [2, 3]


def test_remove_restore(spark, index):
    x, made = index
    n, gone = made.remove(ids(spark, 7, 8, 7, 1000))
    assert n == 2
    assert gone.remove(ids(spark, 7))[0] == 0
    assert [h[2] for h in hits(gone, spark, x[7:8])] != [7]
    assert gone.counts().first().asDict() == {"size": 60, "deleted_count": 2, "live_size": 58, "capacity": 60, "dim": DIM, "max_ef": 256}
    n, back = gone.restore(ids(spark, 7, 9))
    assert n == 1 and hits(back, spark, x[7:8]) == [(0, 1, 7, 0)]
    assert hits(made, spark, x[7:8]) == [(0, 1, 7, 0)]  # the old version is still there
    assert VectorIndex.open(spark, made.path, gone.manifest.version).tombstones().count() == 2


def test_reinsert_takes_deleted_ids_only(spark, index):
    x, made = index
    _, gone = made.remove(ids(spark, 3))
    n, new = gone.reinsert(vectors(spark, -x[3:6], first=3))
    assert n == 1
    assert hits(new, spark, -x[3:4]) == [(0, 1, 3, 0)]
    assert hits(new, spark, x[4:5]) == [(0, 1, 4, 0)]
    assert new.counts().first()["size"] == 60 and new.tombstones().count() == 0
    assert hits(new.compact(), spark, -x[3:4]) == [(0, 1, 3, 0)]


def test_churn(spark, index):
    x, made = index
    for step in range(3):
        y = np.random.default_rng(step).standard_normal((5, DIM)).astype(np.float32)
        _, made = made.remove(ids(spark, *range(5)))
        n, made = made.reinsert(vectors(spark, y))
        assert n == 5 and hits(made, spark, y) == [(i, 1, i, 0) for i in range(5)]


def test_grow(spark, index):
    x, made = index
    assert made.grow(59)[0] is False and made.grow(60)[0] is True
    ok, big = made.grow(120)
    y = np.random.default_rng(9).standard_normal((60, DIM)).astype(np.float32)
    n, big = big.insert(vectors(spark, y, first=60))
    assert ok and n == 60
    assert hits(big, spark, np.concatenate((x[:2], y[:2]))) == [(0, 1, 0, 0), (1, 1, 1, 0), (2, 1, 60, 0), (3, 1, 61, 0)]
    again = VectorIndex.open(spark, made.path)
    assert again.manifest == big.manifest


def test_two_writers_of_a_version(spark, index):
    _, made = index
    made.remove(ids(spark, 1))
    with pytest.raises(LostRace, match="exists"):
        made.remove(ids(spark, 2))


def test_vacuum_keeps_what_the_last_versions_name(spark, index):
    x, made = index
    _, a = made.remove(ids(spark, 1))
    with pytest.raises(LostRace):
        made.remove(ids(spark, 2))  # its table stays behind
    _, b = a.remove(ids(spark, 3))
    assert b.vacuum(keep=2) == 1 and hits(a, spark, x[5:6]) == [(0, 1, 5, 0)]
    assert b.vacuum() == 0  # both deletions' bitmaps are still read
    assert b.compact().vacuum() == 3  # the segment and two tables of bitmaps
    assert VectorIndex.open(spark, made.path).counts().first()["deleted_count"] == 2


def test_graph_of_an_index(spark, tmp_path):
    x = np.random.default_rng(6).standard_normal((600, 64)).astype(np.float32)
    made = VectorIndex.create(spark, str(tmp_path / "g"), IndexConfig(64, shards=2, ef_construction=80, filter_scan_limit=50), 700)
    with pytest.raises(ValueError):
        made.search(vectors(spark, x[:1]).withColumnRenamed("id", "qid"), 1, method="graph")
    n, made = made.insert(vectors(spark, x[:500]))
    made = made.build_graph()
    q = vectors(spark, x[:25]).withColumnRenamed("id", "qid").unionByName(vectors(spark, x[500:525], first=500).withColumnRenamed("id", "qid"))
    found = lambda at, **more: {(r["qid"], r["id"]) for r in at.search(q, 5, ef=60, **more).collect()}
    near = lambda a, b: len(a & b) >= 0.9 * len(b) > 0
    _, made = made.insert(vectors(spark, x[500:], first=500))
    assert [int(t.split("-")[2]) for t in made.manifest.graphs] == [500, 100] and made.nodes().count() == 600
    assert near(found(made), found(made, method="scan"))
    _, gone = made.remove(ids(spark, *range(0, 50)))
    assert not {i for _, i in found(gone)} & set(range(50)) and near(found(gone), found(gone, method="scan"))
    _, again = gone.reinsert(vectors(spark, -x[:5]))
    walked = again.search(vectors(spark, -x[:5]).withColumnRenamed("id", "qid"), 1, ef=60, method="graph")
    assert sorted((r["qid"], r["id"], r["distance"]) for r in walked.collect()) == [(i, i, 0) for i in range(5)]
    allow = spark.range(100, 600)
    assert again.pool(q, 60, allow)[0] is Pool.GRAPH and again.pool(q, 60, spark.range(40))[0] is Pool.SCAN
    assert near(found(again, allow=allow), found(again, allow=allow, method="scan")) and min(i for _, i in found(again, allow=allow)) >= 100
    packed = again.compact()
    assert len(packed.manifest.graphs) == 1 and near(found(packed, method="graph"), found(again, method="graph"))
    for name in ("search_reranked", "search_exact_reranked"):
        walk, scan = ({(r["qid"], r["id"]) for r in getattr(packed, name)(q, 5, 60, method=m).collect()} for m in ("graph", "scan"))
        assert near(walk, scan)
    assert VectorIndex.open(spark, packed.path).manifest == packed.manifest


def test_change_stream(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((10, DIM)).astype(np.float32)
    path, feed = str(tmp_path / "i"), str(tmp_path / "feed")
    VectorIndex.create(spark, path, IndexConfig(DIM), 10)
    rows = [("insert", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("remove", 2, None)]
    spark.createDataFrame(rows, changes.CHANGE).write.parquet(feed + "/a")
    changes.follow(spark.readStream.schema(changes.CHANGE).parquet(feed + "/*"), path, str(tmp_path / "c")).awaitTermination()
    got = VectorIndex.open(spark, path)
    assert got.counts().first()["live_size"] == 9
    assert got.manifest.version == 2 and got.manifest.applied == 0  # one version for the whole batch
    # the same batch again changes nothing
    changes.writer(path)(spark.createDataFrame(rows, changes.CHANGE), 0)
    assert VectorIndex.open(spark, path).manifest == got.manifest


def test_plans_of_walks(spark, tmp_path):
    """Shards go from the file to the walk without an exchange; only what the walks found is dealt, by query."""
    x = np.random.default_rng(7).standard_normal((50, 64)).astype(np.float32)
    made = VectorIndex.create(spark, str(tmp_path / "p"), IndexConfig(64, shards=2), 50)
    made = made.insert(vectors(spark, x))[1].build_graph()
    q = vectors(spark, x[:3]).withColumnRenamed("id", "qid")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    walked = plan(made.pool(q, 10, method="graph")[1])
    exchanges = [line for line in walked.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(qid" in line for line in exchanges) and "MapInPandas" in walked
    allowed = plan(made.pool(q, 10, spark.range(20), method="scan")[1])
    assert "LeftSemi" in allowed and "embedding" not in [line for line in allowed.splitlines() if "FileScan" in line and "w0" in line][0].split("ReadSchema")[1]
    deleted = plan(made.remove(ids(spark, 1))[1].pool(q, 10, method="scan")[1])
    assert "LeftAnti" not in deleted and "bits#" in deleted  # a bit is tested, no list of ids is joined


def _bytes(path) -> int:
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_small_changes_write_little_and_answers_stay(spark, tmp_path):
    """One in a hundred rows inserted, and as many replaced: each writes a tier of its own size, and walks find what scans find."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 64))
    x = (centres[rng.integers(0, 40, 4100)] + 0.6 * rng.standard_normal((4100, 64))).astype(np.float32)
    made = VectorIndex.create(spark, str(tmp_path / "t"), IndexConfig(64, shards=2, ef_construction=80), 5000)
    made = made.insert(vectors(spark, x[:4000]))[1].build_graph()
    tier = lambda name: _bytes(tmp_path / "t" / name)
    q = vectors(spark, x[3990:4040], first=3990).withColumnRenamed("id", "qid")
    found = lambda at, **more: {(r["qid"], r["id"]) for r in at.search(q, 5, ef=60, **more).collect()}
    near = lambda at: len(found(at, method="graph") & found(at, method="scan")) >= 0.95 * len(found(at, method="scan"))
    _, more = made.insert(vectors(spark, x[4000:4040], first=4000))
    assert len(more.manifest.graphs) == 2 and tier(more.manifest.graphs[1]) < 0.03 * tier(more.manifest.graphs[0]) and near(more)
    _, gone = more.remove(spark.range(0, 40))
    n, again = gone.reinsert(vectors(spark, x[4040:4080]))
    # the two tiers of forty are one now; the large one was not touched
    assert n == 40 and again.manifest.graphs[0] == made.manifest.graphs[0] and len(again.manifest.graphs) == 2 and tier(again.manifest.graphs[1]) < 0.05 * tier(again.manifest.graphs[0])
    assert near(again) and again.nodes().count() == 4040 == again.nodes().select("id").distinct().count()
    self_hit = again.search(vectors(spark, x[4040:4080]).withColumnRenamed("id", "qid"), 1, ef=60, method="graph").where("distance = 0 AND qid = id").count()
    assert self_hit == 40
    assert integrity.violations(again.nodes(), again.edges(), again.codes(), again.config, again.tombstones(), 5000).count() == 0
    packed = again.compact()
    assert near(packed) and len(packed.manifest.graphs) == 1


def test_deletions_write_the_bitmaps_that_change(spark, tmp_path):
    made = VectorIndex.create(spark, str(tmp_path / "d"), IndexConfig(DIM), 200_000)
    x = np.random.default_rng(2).standard_normal((4, DIM)).astype(np.float32)
    for first in (0, 40_000, 199_996):
        made = made.insert(vectors(spark, x, first=first))[1]
    n, one = made.remove(ids(spark, 1, 2, 40_001, 77, None))
    assert n == 3 and one.deletions().count() == 2
    n, two = one.remove(ids(spark, 2, 199_999))
    latest = spark.read.parquet(f"{two.path}/{two.manifest.deletions[-1]}")
    assert n == 1 and latest.count() == 1 and sorted(r["id"] for r in two.tombstones().collect()) == [1, 2, 40_001, 199_999]
    n, three = two.restore(ids(spark, 2, 3, 40_001))
    assert n == 2 and sorted(r["id"] for r in three.tombstones().collect()) == [1, 199_999]
    assert {i for _, _, i, _ in hits(three, spark, x, 12)} == {0, 2, 3, 40_000, 40_001, 40_002, 40_003, 199_996, 199_997, 199_998}
    at = three
    for i in range(20):  # many small deletions are put together
        at = (at.remove if i % 2 == 0 else at.restore)(ids(spark, 0))[1]
    assert len(at.manifest.deletions) <= 17 and sorted(r["id"] for r in at.tombstones().collect()) == [1, 199_999]


def test_predicates_in_the_index(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((800, 64)).astype(np.float32)
    rows = lambda a, b: spark.createDataFrame([(i, [float(v) for v in x[i]], i % 4 if i % 10 else None, f"s{i % 3}") for i in range(a, b)], "id bigint, embedding array<float>, label int, source string")
    made = VectorIndex.create(spark, str(tmp_path / "a"), IndexConfig(64, shards=2, ef_construction=80), 900, "label int, source string")
    made = made.insert(rows(0, 600))[1].build_graph()
    made = made.insert(rows(600, 700))[1].insert(rows(700, 800))[1]
    _, made = made.remove(ids(spark, 5, 9))
    n, made = made.reinsert(spark.createDataFrame([(5, [float(-v) for v in x[5]], 3)], "id bigint, embedding array<float>, label int"))
    assert n == 1 and len(made.manifest.graphs) == 3
    q = vectors(spark, x[:30]).withColumnRenamed("id", "qid")
    wanted = lambda a: (a["label"] == 1) & (a["source"] != "s2")
    for at in (made, made.compact()):
        scan, walk = ({(r["qid"], r["id"]) for r in at.search(q, 5, ef=80, method=m, predicate=wanted).collect()} for m in ("scan", "graph"))
        assert all(i % 4 == 1 and i % 3 != 2 and i % 10 and i != 5 for _, i in scan | walk) and len(scan & walk) >= 0.9 * len(scan) == 0.9 * 150
        truth = S.search(at.live().where("label = 1 AND source <> 's2'").select("id", "w0"), q, 64, 5)
        assert scan == {(r["qid"], r["id"]) for r in truth.collect()}
    with pytest.raises(ValueError, match="attributes"):
        VectorIndex.create(spark, str(tmp_path / "b"), IndexConfig(64), 10).search(q, 1, predicate=wanted)


def _rows_scanned(df) -> tuple[int, str]:
    """(rows that the scan of floats gave, its line in the plan), after the query has run."""
    df._jdf.collectToPython()  # this frame's own plan is run, so that it has the figures
    open_ = [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kind, text = node.getClass().getSimpleName(), node.toString()
        if kind == "FileSourceScanExec" and "embedding" in text.split("ReadSchema")[1]:
            return node.metrics().apply("numOutputRows").value(), text
        if kind == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            open_.append(node.plan())
        else:
            open_ += [node.children().apply(i) for i in range(node.children().length())]
    raise AssertionError("no scan of floats")


def test_floats_are_read_by_id(spark, tmp_path):
    """Ids are pushed into the scan, whose pages are in their order: what is read follows what is asked."""
    made = VectorIndex.create(spark, str(tmp_path / "f"), IndexConfig(DIM), 60_000)
    rows = spark.range(60_000).selectExpr("id", "transform(sequence(1, 32), i -> cast(sin(id * i) AS FLOAT)) AS embedding")
    made = made.insert(rows)[1].compact()
    few, line = _rows_scanned(made.vector(ids(spark, 100, 130, 45_000)))
    assert few < 10_000 and "PushedFilters" in line and "GreaterThanOrEqual(id,45000)" in line
    every, _ = _rows_scanned(made.vector(spark.range(0, 60_000, 7)))
    assert every > 50_000
    assert [r["id"] for r in made.vector(ids(spark, 7, 7, 59_999, 70_000)).orderBy("id").collect()] == [7, 59_999]
    q = made.vector(ids(spark, 3, 4)).withColumnRenamed("id", "qid")
    got = made.search_exact_reranked(q, 2, 20)
    assert {(r["qid"], r["id"]) for r in got.where("rank = 1").collect()} == {(3, 3), (4, 4)}
