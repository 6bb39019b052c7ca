"""Written tables: where they lie and when they go."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from bitvane.sources import scratch


def folders(spark):
    root = f"{scratch.shared_folder(spark).removeprefix('file://')}/bitvane"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_a_scope_removes_what_is_written_in_it_but_for_what_is_kept(spark):
    before = folders(spark)
    with scratch.scope(spark):
        a = scratch.materialize(spark.range(3), "inner")
        with scratch.scope(spark):
            deep = scratch.materialize(a, "deep")
            b = scratch.kept(deep.selectExpr("id + 1 AS id"), "kept")
        assert {f.split("-")[0] for f in folders(spark) - before} == {"inner", "kept"}
        c = scratch.kept(b.where("id > 1"), "last")
    assert {f.split("-")[0] for f in folders(spark) - before} == {"last"}
    assert sorted(r["id"] for r in c.collect()) == [2, 3]


def test_a_scope_ends_when_its_body_fails(spark):
    before = folders(spark)
    with pytest.raises(ValueError), scratch.scope(spark):
        scratch.materialize(spark.range(1), "lost")
        raise ValueError
    assert folders(spark) == before and scratch._scopes == []


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    for master in ("yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_folder(session(master))
    for master in ("local", "local[*]", "local[8]"):
        assert os.path.isdir(scratch.shared_folder(session(master)))
