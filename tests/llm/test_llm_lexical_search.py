"""Ranked search against a plain scorer and SQL; the bisection against a random order; visits that stop early."""

from __future__ import annotations

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from bitvane.llm import lexical_search as L
from bitvane.llm import registry

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, shard int, n bigint, terms string"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def brute(docs, items, k):
    bags = [(d, collections.Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    many, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * many // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms_of(text)) if t in b)
            if s > 0:
                found.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def answer(spark, docs, items, k=5, **more):
    index = L.build(spark.createDataFrame([(*r, 0, 0, "t") for r in docs], SCHEMA), **more)
    found = L.search(index, spark.createDataFrame(items, "item_id bigint, text string"), k)
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str), index


def topics(seed, n, groups=8):
    r = random.Random(seed)
    own = [[f"t{g}w{i}" for i in range(60)] for g in range(groups)]
    text = lambda g: " ".join(r.choice(own[g]) if r.random() < 0.8 else f"common{r.randrange(40)}" for _ in range(r.randrange(5, 60)))
    return [(i, text(r.randrange(groups))) for i in range(n)], [(q, text(q % groups)) for q in range(10)]


def test_search_equals_brute_force_and_stops_early(spark, monkeypatch):
    docs, items = topics(1, 600)
    docs += [(1000 + i, docs[i][1]) for i in range(50)]  # ties
    read = []
    scored = L._scored

    def watched(index, held, visits, floors, k):
        read.append(sum(len(r["queries"]) for r in visits.collect()))
        return scored(index, held, visits, floors, k)

    monkeypatch.setattr(L, "_scored", watched)
    got, index = answer(spark, docs, items, 5, shard_docs=16)
    assert got == brute(docs, items, 5)
    assert index.shards > 30 and sum(read) < 0.7 * index.shards * len(items)


def test_odd_input(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Word WORD été"), (None, "word"), (5, "word"), (5, "word"), (2**53 + 1, "word one"), (2**53 + 3, "word one"), (-1, "word one"), (6, "ÉTÉ"), (7, "a_b c-d 1x"), (8, "many words " * 50_000)]
    items = [(1, "word"), (2, None), (3, "absent"), (None, "one ÉTÉ a b"), (4, "many words WORDS"), (4, "x 1x")]
    got, _ = answer(spark, docs, items, 3)
    assert got == brute(docs, items, 3)
    none, _ = answer(spark, [], items)
    assert none == [] and answer(spark, docs, [])[0] == []


def test_bisection_puts_topics_apart():
    docs, _ = topics(3, 512)
    number: dict[str, int] = {}
    lists = [np.unique([number.setdefault(t, len(number)) for t in set(terms_of(x))]) for _, x in docs]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    terms = np.concatenate(lists).astype(np.uint64)
    tree = L.fit(terms, offsets)
    assert tree.depth == 4
    leaves = tree.leaves(terms, offsets)
    assert np.bincount(leaves, minlength=16).max() < 3 * 512 / 16

    def different(groups):
        """Different terms of the groups' documents: fewer where similar documents stand together."""
        return sum(len(np.unique(np.concatenate([lists[i] for i in np.flatnonzero(groups == g)]))) for g in np.unique(groups))

    assert different(leaves) < 0.75 * different(np.random.default_rng(0).permutation(leaves))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{sf}/{name}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({registry.ORACLE_SQL['op13_lexical_search']})").fetchall()
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in registry.QUERIES["op13_lexical_search"](spark, f"/root/testdata/{sf}").collect()]
    assert sorted(got) == sorted(want)
