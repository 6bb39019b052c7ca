"""The prefix trie against a walk over dictionaries, in blocks of every size, and against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from bitvane.llm import prefix_trie, registry

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, path string, part int"


def brute(rows: list[tuple]) -> set[tuple]:
    own: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids: dict[tuple, int] = {}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(ids) - 1) * (len(node[-1][1]) if node else 0)
    out = set()
    for node, ids in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c in ids if len(made[c]) == len(node))).encode()).hexdigest()
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), kids.get(node, 0), leaves[node], saved[node], ends))
    return out


def answer(df) -> list[tuple]:
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()]


def made_up(seed: int, convs: int, words: int, long: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), convs):
        for t in range(r.choice((0, 1, 2, 3, long))):
            rows.append((c, t if r.random() > 0.02 else None, r.choice(("user", None)), r.choice(["a", "bb", "ünï", None, ""][:words])))
    return rows


@pytest.mark.parametrize("case,block_turns", [((1, 300, 2, 4), 1), ((1, 300, 2, 4), 7), ((2, 300, 5, 9), 40), ((3, 60, 1, 30), 3), ((3, 60, 1, 30), 100_000)])
def test_trie_equals_brute_force(spark, case, block_turns):
    rows = made_up(*case)
    df = spark.createDataFrame([(*r, 0, "p", 1) for r in rows], SCHEMA)
    got = answer(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)), block_turns))
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_many_copies_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(8)] + [(900 + c, 0, "user", "turn 0") for c in range(50)]
    df = spark.createDataFrame([(*r, 0, "p", 1) for r in rows], SCHEMA)
    got = answer(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)), 100))
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_odd_conversations(spark):
    rows = [(1, 0, None, None), (1, 0, "", ""), (1, None, "user", "first"), (None, 0, "user", "nobody's"), (5, 3, "user", "x" * 100_000), (5, 3, "user", "x" * 100_000), (2**60, 1, "user", "late"), (-7, 1, "a", "b"), (100, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 0, "p", 1) for r in rows], SCHEMA)
    assert set(answer(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df)), 2))) == brute(rows)
    none = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(df.where("conv_id IS NULL"))))
    assert none.count() == 0


def test_query_equals_sql_and_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL['op11_prefix_trie']})").fetchall()
    got = answer(registry.QUERIES["op11_prefix_trie"](spark, sf_dir))
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and set(got) == brute(rows) and len(got) == len(set(got))
