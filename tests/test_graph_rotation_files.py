"""The graph, the rotation and the files: recall, invariants, round trips and damaged input."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitvane.functions import codes as C
from bitvane.operators import evaluate, graph, integrity
from bitvane.operators import search as S
from bitvane.operators.rotation import RotationEstimator, RotationModel, polar_factor, quantization_error, random_orthogonal, residual, spectral_norm
from bitvane.plans.planner import EngineError, GraphStatus, IndexConfig, RotationStatus, StorageStatus
from bitvane.sources import datasources, formats


def frame(spark, x, name="id"):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, embedding array<float>")


# -- graph ---------------------------------------------------------------------------------------


def test_levels_fall_by_m():
    found = graph.levels(np.arange(100_000), 16, 42)
    assert abs((found >= 1).mean() - 1 / 16) < 0.005 and found.max() <= 31 and (found == graph.levels(np.arange(100_000), 16, 42)).all()


def recall_of(g, ids, codes, q, ef, admitted=None, walk=True):
    hit = 0
    for c in q:
        d = C.hamming_numpy(c[None], codes)[0]
        order = np.lexsort((ids, d))
        want = ids[order[admitted[order]] if admitted is not None else order][:10].tolist()
        got = g.search(c, ef, admitted, walk)
        assert got == sorted(got)
        hit += len(set(want) & {i for _, i in got[:10]})
    return hit / (10 * len(q))


@pytest.mark.parametrize("n,ef,least", [(200, 200, 0.95), (2000, 100, 0.90)])
def test_recall(n, ef, least):
    """The published gate: 512 dimensions, iid, ef_construction 200, 50 queries."""
    x = np.random.default_rng(n).standard_normal((n, 512)).astype(np.float32)
    codes = C.pack_numpy(x)
    g = graph.ShardGraph(np.arange(n), codes, IndexConfig(512, ef_construction=200)).build()
    q = C.pack_numpy(np.random.default_rng(1).standard_normal((50, 512)).astype(np.float32))
    assert recall_of(g, np.arange(n), codes, q, ef) >= least


def test_links_are_of_two_m_on_the_lowest_layer_and_lead_both_ways():
    x = np.random.default_rng(3).standard_normal((1500, 128)).astype(np.float32)
    config = IndexConfig(128, m=8, ef_construction=60)
    g = graph.ShardGraph(np.arange(1500) * 7, C.pack_numpy(x), config).build()
    for layer, (nodes, links) in enumerate(zip(g.nodes, g.links)):
        assert links.shape == (len(nodes), graph.capacity_of(layer, 8)) and (g.level[nodes] >= layer).all()
        for row, near in zip(nodes, links):
            near = near[near >= 0]
            assert len(set(near.tolist())) == len(near) and row not in near and (g.level[near] >= layer).all()
    assert (g.links[0] >= 0).sum(axis=1).max() == 16 and (g.links[0] >= 0).sum(axis=1).mean() > 12
    again = graph.ShardGraph(np.arange(1500) * 7, C.pack_numpy(x), config).build()
    assert again.edge_rows() == g.edge_rows()
    row = g.to_row(4)
    back = graph.ShardGraph.from_row(row, config)
    assert back.edge_rows() == g.edge_rows() and back.to_row(4) == row


def test_choosing_prefers_spread():
    codes = np.array([[0b0000], [0b0001], [0b0011], [0b1000], [0b1100]], np.uint64)
    g = graph.ShardGraph(np.arange(5), codes, IndexConfig(64))
    keys = np.sort(g.keys(codes[:1], np.arange(1, 5)))[None]
    # 1 and 3 are nearest; 2 is nearer to 1 than to the base, 4 to 3: they come after, nearest first
    assert g.choose(keys, 2).tolist() == [[1, 3]] and g.choose(keys, 3).tolist() == [[1, 3, 2]] and g.choose(keys, 6).tolist() == [[1, 3, 2, 4, -1, -1]]


def test_nodes_are_linked_into_a_graph_that_is_built(monkeypatch):
    """By beams, not by a scan: the bound above which candidates are walked for is lowered."""
    monkeypatch.setattr(graph, "SCANNED", 600)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 128))
    x = (centres[rng.integers(0, 40, 3000)] + 0.7 * rng.standard_normal((3000, 128))).astype(np.float32)
    ids, codes, config = rng.permutation(3000) * 3, C.pack_numpy(x), IndexConfig(128, ef_construction=100)
    g = graph.ShardGraph(ids[:2000], codes[:2000], config).build().add(ids[2000:], codes[2000:])
    assert len(g.nodes[0]) == 3000
    same = g.by_id()
    assert same.ids.tolist() == sorted(ids.tolist()) and sorted(same.edge_rows()) == sorted(g.edge_rows())
    q = C.pack_numpy((centres[rng.integers(0, 40, 40)] + 0.7 * rng.standard_normal((40, 128))).astype(np.float32))
    assert recall_of(g, ids, codes, q, 100) >= 0.9
    assert recall_of(g, ids, codes, codes[2000:2040], 100) >= 0.9
    half = ids % 2 == 0
    assert recall_of(g, ids, codes, q, 100, half) >= 0.9
    few = np.zeros(3000, bool)
    few[::300] = True
    assert recall_of(g, ids, codes, q, 100, few, walk=False) == 1.0  # so few are scanned


def test_a_walk_measures_few_nodes(monkeypatch):
    """In a layer that is linked by groups, of which a walk meets a small share; what it meets grows with the beam, not with the nodes."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((300, 128))
    draw = lambda n: C.pack_numpy((centres[rng.integers(0, 300, n)] + 0.6 * rng.standard_normal((n, 128))).astype(np.float32))
    measured, plain = [0], graph.bits_of
    counted = lambda words: (measured.__setitem__(0, measured[0] + words[..., 0].size), plain(words))[1]
    q, shares = draw(50), []
    for n in (10_000, 30_000):
        codes = draw(n)
        g = graph.ShardGraph(np.arange(n), codes, IndexConfig(128)).build()
        assert recall_of(g, np.arange(n), codes, q, 50) >= 0.95
        monkeypatch.setattr(graph, "bits_of", counted)
        measured[0] = 0
        g.beams(q, g.starts(q, 0), 50, 0)
        monkeypatch.setattr(graph, "bits_of", plain)
        shares.append(measured[0] / len(q))
    assert shares[0] < 0.45 * 10_000 and shares[1] < 1.4 * shares[0]


def test_tiers_of_one_shard_are_searched_and_merged(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 64)).astype(np.float32)
    codes = C.pack_numpy(x)
    config = IndexConfig(64, ef_construction=60)
    old, new = graph.ShardGraph(np.arange(700), codes[:700], config).build(), graph.ShardGraph(np.arange(690, 900), codes[690:], config).build()
    rows = [{**old.to_row(0), "stale": list(range(690, 700))}, {**new.to_row(0), "stale": None}]
    tiers = spark.createDataFrame([tuple(r[c] for c in (*[k.split()[0] for k in graph.SHARD.split(", ")], "stale")) for r in rows], graph.SHARD + ", stale array<bigint>")
    q = frame(spark, x[680:710], "qid")
    found = graph.search_shards(tiers, q, config, 40, walk=True).where("rank = 1")
    assert {(r["qid"], r["distance"]) for r in found.collect()} == {(i, 0) for i in range(30)}
    merged = graph.merge_tiers(tiers, config)
    assert merged.select("n").collect()[0]["n"] == 900 and graph.nodes_of(merged).select("id").distinct().count() == 900 == graph.nodes_of(tiers).count()


def test_odd_graphs():
    config = IndexConfig(64)
    empty = graph.ShardGraph(np.zeros(0, np.int64), np.zeros((0, 1), np.uint64), config).build()
    assert empty.entry == -1 and empty.search(np.zeros(1, np.uint64), 5) == [] and empty.edge_rows() == []
    assert graph.ShardGraph.from_row(empty.to_row(0), config).edge_rows() == []
    same = graph.ShardGraph(np.arange(700), np.zeros((700, 1), np.uint64), config).build()  # one code, over and over
    assert [i for _, i in same.search(np.zeros(1, np.uint64), 5)] == [0, 1, 2, 3, 4] or len(same.search(np.zeros(1, np.uint64), 5)) == 5
    assert same.search(np.zeros(1, np.uint64), 5, np.zeros(700, bool)) == []


def test_graph_tables(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((400, 64)).astype(np.float32)
    v, q = frame(spark, x), frame(spark, x[:20], "qid")
    codes = S.encode(v, 64).persist()
    config = IndexConfig(64, shards=3, ef_construction=60)
    nodes, edges = (df.persist() for df in graph.build_graph(codes, config))
    assert integrity.violations(nodes, edges, codes, config, capacity=400).count() == 0
    again = graph.build_graph(codes, config)[1]
    assert again.exceptAll(edges).count() == 0
    shards = graph.pack_shards(codes, nodes, edges, config).persist()
    found = graph.search_shards(shards, q, config, 60, walk=True)
    truth = S.search(codes, q, 64, 10)
    assert evaluate.recall(found, truth, 10).first()["recall"] >= 0.9
    allow = v.where("id % 2 = 0").select("id")
    assert graph.search_shards(shards, q, config, 60, allow, walk=True).where("id % 2 = 1").count() == 0
    assert graph.search_shards(shards, q, config, 60, tombstones=v.where("id = 5").select("id"), walk=True).where("id = 5").count() == 0
    assert graph.memory_bytes(nodes, edges, config).first()["bytes"] > 400 * 32 * 4
    assert graph.entry_point(nodes).count() == 3
    # broken tables are told
    broken = edges.limit(1).withColumn("dst", F.col("src")).unionByName(edges.limit(1).withColumn("dst", F.lit(9999).cast("bigint")))
    rules = {r["rule"] for r in integrity.violations(nodes, broken, codes, config).collect()}
    assert {"link to itself", "link to no node"} <= rules
    rules = {r["rule"] for r in integrity.violations(nodes.where("id > 0"), edges, codes, config, spark.createDataFrame([(777,)], "id bigint"), 399).collect()}
    assert {"code without node", "tombstone without node", "id out of range"} <= rules
    assert graph.unlink(edges, v.where("id = 3").select("id")).where("dst = 3").count() == 0
    assert graph.neighbours(edges, 0, 0).count() > 0


def test_single_node_and_empty(spark):
    config = IndexConfig(64)
    v = frame(spark, np.ones((1, 64)))
    codes = S.encode(v, 64)
    nodes, edges = graph.build_graph(codes, config)
    got = graph.search_shards(graph.pack_shards(codes, nodes, edges, config), v.withColumnRenamed("id", "qid"), config, 5, walk=True).collect()
    assert [(r["id"], r["distance"]) for r in got] == [(0, 0)]
    nodes, edges = graph.build_graph(codes.where("id < 0"), config)
    assert nodes.count() == 0 == edges.count()


# -- rotation --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    return evaluate.clustered(spark, 1500, 64, 50, seed=3, decay=4.0).persist()


def test_kernels():
    w = random_orthogonal(32, 1)
    assert residual(w) < 1e-9 and (w == random_orthogonal(32, 1)).all()
    m = np.random.default_rng(0).standard_normal((32, 32))
    assert residual(polar_factor(m)) < 1e-9 and abs(spectral_norm(w) - 1) < 1e-9
    assert residual(np.full((2, 2), np.nan)) == 1e30
    with pytest.raises(EngineError) as e:
        polar_factor(np.zeros((3, 3)))
    assert e.value.status is RotationStatus.NOT_CONVERGED


def test_training(spark, skewed):
    model = RotationEstimator(iterations=8).fit(skewed, 64)
    assert residual(model.matrix) < 1e-3 and model.error_after < 0.95 * model.error_before
    assert list(model.objective) == sorted(model.objective, reverse=True)
    again = RotationEstimator(iterations=8).fit(skewed.repartition(7), 64)
    assert np.array_equal(model.matrix, again.matrix)
    turned = model.rotate(skewed).persist()
    assert abs(turned.agg(quantization_error(F.col("rotated")).alias("e")).first()["e"] - model.error_after) < 1e-4
    two = turned.limit(50).select("embedding", "rotated").collect()
    a, r = np.array([x["embedding"] for x in two]), np.array([x["rotated"] for x in two])
    assert np.abs(C.cosine_numpy(a, a) - C.cosine_numpy(r, r)).max() < 1e-4
    codes = model.rotate_quantize(skewed).select("id", "w0").orderBy("id").collect()
    want = C.pack_numpy(np.array([x["rotated"] for x in turned.orderBy("id").collect()], np.float32)).view(np.int64)[:, 0]
    assert [x["w0"] for x in codes] == want.tolist()


def test_rotation_helps_retrieval(spark):
    data = evaluate.clustered(spark, 1500, 128, 40, seed=5, decay=4.0).persist()
    q = evaluate.clustered(spark, 1500, 128, 40, seed=5, decay=4.0).where("id < 25").select(F.col("id").alias("qid"), "embedding")
    truth = S.cosine_top(data, q, 10).persist()
    raw = S.search(S.encode(data, 128), q, 128, 10)
    model = RotationEstimator(iterations=10).fit(data, 128)
    turned = S.search(model.rotate_quantize(data).select("id", "w0", "w1"), model.rotate(q).select("qid", F.col("rotated").alias("embedding")), 128, 10)
    a, b = (evaluate.recall(r, truth, 10).first()["recall"] for r in (raw, turned))
    assert b > a + 0.05


def test_training_on_a_sample(spark, skewed):
    whole, part = RotationEstimator(iterations=8).fit(skewed, 64), RotationEstimator(iterations=8, sample_rows=600).fit(skewed, 64)
    assert residual(part.matrix) < 1e-3 and not np.array_equal(part.matrix, whole.matrix)
    error = part.rotate(skewed).agg(quantization_error(F.col("rotated")).alias("e")).first()["e"]
    assert error < 0.97 * whole.error_before
    assert np.array_equal(RotationEstimator(iterations=8, sample_rows=600).fit(skewed.repartition(5), 64).matrix, part.matrix)
    assert RotationEstimator(iterations=8, sample_rows=20).fit_or_identity(skewed, 64)[1] is RotationStatus.BAD_INPUT


def test_bad_input(spark, skewed):
    few = skewed.limit(10)
    for df, dim, iterations in ((few, 64, 5), (skewed, 32, 5), (skewed, 64, 0)):
        model, status = RotationEstimator(iterations).fit_or_identity(df, dim)
        assert status is RotationStatus.BAD_INPUT and np.array_equal(model.matrix, np.eye(dim))
    flat = skewed.select("id", F.transform("embedding", lambda x, i: F.when(i < 3, x).otherwise(F.lit(0).cast("float"))).alias("embedding"))
    assert RotationEstimator(3).fit_or_identity(flat, 64)[1] is RotationStatus.NOT_CONVERGED


def test_model_round_trip(spark, tmp_path):
    model = RotationModel(random_orthogonal(16, 2).astype(np.float32), 0.5, 0.4, 1e-8)
    model.save(spark, str(tmp_path / "m"))
    back = RotationModel.load(spark, str(tmp_path / "m"), 16)
    assert np.array_equal(back.matrix, model.matrix) and back.error_after == 0.4
    with pytest.raises(EngineError):
        RotationModel.load(spark, str(tmp_path / "m"), 17)


# -- files -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,dim", [(50, 100), (0, 100), (20, 64)])
def test_codes_round_trip(spark, tmp_path, n, dim):
    datasources.register(spark)
    x = np.random.default_rng(n).standard_normal((n, dim)).astype(np.float32)
    path = str(tmp_path / "codes")
    codes = S.encode(frame(spark, x), dim)
    datasources.write_codes(codes, path, dim, 3)
    raw = open(path, "rb").read()
    assert raw[:64] == struct.pack("<4sIQQ40x", b"EVEC", 1, dim, n) and raw[64:] == C.pack_numpy(x).tobytes()
    back = spark.read.format("signcodes").option("recordsPerPartition", 7).load(path)
    assert back.count() == n
    got = datasources.binary_to_codes(back, dim).exceptAll(codes)
    assert got.count() == 0
    assert spark.read.format("signcodes").load(f"file://{path}").count() == n  # as a URI too
    assert [x.name for x in tmp_path.iterdir()] == ["codes"]  # no drafts stay


def test_files_are_replaced_whole(spark, tmp_path):
    datasources.register(spark)
    path = f"file:{tmp_path}/rotation"
    for seed in (1, 2):
        g = random_orthogonal(8, seed).astype(np.float32)
        datasources.write_rotation(path, g)
        back = spark.read.format("rotation").load(path).orderBy("row").collect()
        assert np.array_equal(np.array([r["coeffs"] for r in back], np.float32), g)
    assert [x.name for x in tmp_path.iterdir()] == ["rotation"]


def status_of(f):
    try:
        f()
    except EngineError as e:
        return e.status
    return None


def test_codes_header_checks():
    good = formats.codes_header(64, 2)
    size = 64 + 16
    check = lambda raw, n=size: status_of(lambda: formats.read_codes_header(raw, n))
    assert check(good) is None
    assert check(b"XXXX" + good[4:]) is StorageStatus.BAD_MAGIC
    assert check(good[:4] + b"\x02" + good[5:]) is StorageStatus.BAD_VERSION
    assert check(good, size - 1) is StorageStatus.CORRUPT_SIZE and check(good, size + 1) is StorageStatus.CORRUPT_SIZE
    assert check(good[:10], 10) is StorageStatus.CORRUPT_SIZE and check(b"", 0) is StorageStatus.IO_ERROR
    huge = lambda dim, count: struct.pack("<4sIQQ40x", b"EVEC", 1, dim, count)
    assert check(huge(64, 1 << 61)) is StorageStatus.IO_ERROR and check(huge(1 << 62, 1 << 60)) is StorageStatus.IO_ERROR
    assert check(huge((1 << 64) - 1, 1)) is StorageStatus.CORRUPT_SIZE and check(huge(0, 1 << 62)) is StorageStatus.CORRUPT_SIZE
    assert status_of(lambda: formats.codes_header(0, 1)) is StorageStatus.CORRUPT_SIZE
    assert status_of(lambda: formats.codes_header(64, 1 << 62)) is StorageStatus.IO_ERROR
    assert status_of(lambda: datasources.CodesReader({"path": "/nowhere/x"}).header()) is StorageStatus.IO_ERROR


def small_graph():
    x = np.random.default_rng(8).standard_normal((30, 64)).astype(np.float32)
    g = graph.ShardGraph(np.arange(30), C.pack_numpy(x), IndexConfig(64, m=4, ef_construction=20)).build()
    links = {}
    for src, layer, _, dst in g.edge_rows():
        links.setdefault((src, layer), []).append(dst)
    entry = min(range(30), key=lambda i: (-g.level[i], i))
    return formats.GraphFile(64, 40, 4, entry, {i: int(x) for i, x in enumerate(g.level)}, links, {3, 5})


def test_graph_file_round_trip_and_versions():
    g = small_graph()
    raw = formats.graph_bytes(g)
    back = formats.read_graph(raw, dim=64, capacity=40, m=4)
    assert back.levels == g.levels and back.tombstones == {3, 5} and back.entry == g.entry
    assert {k: v for k, v in back.links.items() if v} == g.links
    old = raw[:4] + struct.pack("<I", 1) + raw[8:-8]
    assert formats.read_graph(old).tombstones == set()
    assert status_of(lambda: formats.read_graph(raw, m=5)) is GraphStatus.MISMATCH
    assert status_of(lambda: formats.read_graph(raw + b"\0")) is GraphStatus.CORRUPT
    assert status_of(lambda: formats.read_graph(raw[:-1])) is GraphStatus.IO_ERROR
    assert status_of(lambda: formats.read_graph(b"EVHX" + raw[4:])) is GraphStatus.BAD_MAGIC
    assert status_of(lambda: formats.read_graph(raw[:4] + b"\x09" + raw[5:])) is GraphStatus.BAD_VERSION


def test_rotation_file():
    g = random_orthogonal(8, 1).astype(np.float32)
    raw = formats.rotation_bytes(g)
    assert np.array_equal(formats.read_rotation(raw, 8), g)
    assert status_of(lambda: formats.read_rotation(raw, 9)) is RotationStatus.INCOMPATIBLE
    assert status_of(lambda: formats.read_rotation(raw[:-1])) is RotationStatus.CORRUPT
    assert status_of(lambda: formats.read_rotation(formats.rotation_bytes(g * 2))) is RotationStatus.CORRUPT
    assert status_of(lambda: formats.read_rotation(raw[:8])) is RotationStatus.IO_ERROR


@pytest.mark.parametrize("kind", ["codes", "graph", "rotation"])
def test_mutants_are_refused_or_valid(kind):
    rng = random.Random(42)
    raw = {"codes": lambda: formats.codes_header(64, 4) + bytes(range(32)), "graph": lambda: formats.graph_bytes(small_graph()), "rotation": lambda: formats.rotation_bytes(random_orthogonal(8, 1))}[kind]()
    read = {"codes": lambda r: formats.read_codes_header(r[:64], len(r)), "graph": formats.read_graph, "rotation": formats.read_rotation}[kind]
    for _ in range(600):
        m = bytearray(raw)
        for _ in range(rng.randint(1, 4)):
            what = rng.randrange(4)
            if what == 0 and m:
                m[rng.randrange(len(m))] ^= 1 << rng.randrange(8)
            elif what == 1 and m:
                del m[rng.randrange(len(m)) :]
            elif what == 2:
                m += bytes(rng.randrange(256) for _ in range(rng.randint(1, 9)))
            elif m:
                m[rng.randrange(min(64, len(m)))] = rng.choice((0, 255, 127))
        try:
            found = read(bytes(m))
        except EngineError:
            continue
        if kind == "graph":
            assert all(found.levels[t] >= layer for (_, layer), near in found.links.items() for t in near)
        elif kind == "rotation":
            assert residual(found) < 1e-2
        else:
            assert found.total_bytes == len(m)


def test_graph_search_on_the_whole_table_recalls_the_exact_scan(spark, sf_dir):
    from bitvane.plans import catalog

    got, want = ({(r["qid"], r["id"]) for r in catalog.QUERIES[name](spark, sf_dir).collect()} for name in ("graph_search", "hamming_topk_batch"))
    assert want and len(got & want) >= 0.9 * len(want)


def test_walks_are_checked():
    """A walk on a graph whose links lead nowhere finds little; checked, its first hits are the exact ones."""
    rng = np.random.default_rng(3)
    codes = C.pack_numpy(rng.standard_normal((600, 64)))
    g = graph.ShardGraph(np.arange(600), codes, IndexConfig(64)).build()
    g.links[0] = np.full_like(g.links[0], -1)
    exact = g.nearest(codes[:20], np.arange(600), 30)
    found = g.pools(codes[:20], 30, None, True)
    assert (found[:, :10] != exact[:, :10]).any()
    assert (g.checked(codes[:20], found, 10)[:, :10] == exact[:, :10]).all()
    odd = np.arange(600) % 2 == 1
    assert (g.checked(codes[:20], g.pools(codes[:20], 30, odd, True), 10, odd)[:, :10] == g.nearest(codes[:20], np.flatnonzero(odd), 10)).all()


def test_shards_grow_with_rows(spark, tmp_path, monkeypatch):
    """Of small shards: faults are found where they were planted, and each shard is a file of its own that reads back."""
    import duckdb

    from bitvane.plans import catalog

    assert graph.shards_for(1) == 1 and graph.shards_for(20_000) == 3 and graph.shards_for(20_000, 8) == 8
    monkeypatch.setattr(graph, "SHARD_NODES", 60)
    sf = str(tmp_path / "sf")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{sf}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    for name in ("integrity_violations", "graph_file", "graph_entry"):
        got, want = catalog.QUERIES[name](spark, sf), con.sql(catalog.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
