"""The n-gram Jaccard join against all pairs, on made-up groups, hot tokens, odd input, and SQL."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import numpy as np

from bitvane.llm import jaccard_join as J
from bitvane.llm import registry

SCHEMA = "doc_id bigint, text string, n bigint, key string, rep bigint"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return set() if not w else {tuple(w)} if len(w) < 3 else set(zip(w, w[1:], w[2:]))


def brute(rows: list[tuple]) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 0.8 < len(sets[i]) / max(1, len(sets[j])) < 1.2:
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    groups: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups.setdefault(top(i), []).append(d)
    return sorted(((d, len(s), min(groups.get(top(i), []), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def answer(spark, rows, **more) -> list[tuple]:
    df = spark.createDataFrame([(*r, 0, "k", 1) for r in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.linked_components(df, **more).collect()), key=str)


def groups_of_copies(seed: int) -> list[tuple]:
    """Chains of small edits, one large group about the threshold, a passage that many share, short texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], []
    for _ in range(12):
        base = [word() for _ in range(r.choice((8, 40, 150)))]
        for _ in range(r.choice((2, 5, 9))):
            base = base[:]
            for _ in range(r.choice((0, 1, 1, 3))):
                base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
    hot = [word() for _ in range(120)]
    for _ in range(70):
        own = hot[:]
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(r.randrange(40))] + passage) for _ in range(40)]
    texts += [" ".join(word() for _ in range(r.randrange(4))) for _ in range(20)]
    texts += r.choices(texts, k=20)
    r.shuffle(texts)
    return list(enumerate(texts))


def test_join_equals_brute_force(spark):
    rows = groups_of_copies(1)
    assert answer(spark, rows, block_rows=16) == brute(rows)


def test_odd_texts(spark):
    long = "a very long text that goes on and on without end " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long + "b"), (None, "null id here"), (None, None), (7, "Same Text"), (7, "same text"), (8, "SAME TEXT"), (9, "same  text"), (10, "x"), (11, "été ÉTÉ x"), (12, "ÉTÉ ÉTÉ x"), (2**53 + 1, "one two three four"), (2**53 + 3, "one two three four"), (-1, "one two three four five")]
    assert answer(spark, rows) == brute(rows)
    df = spark.createDataFrame([], SCHEMA)
    assert J.linked_components(df).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({registry.ORACLE_SQL['op12_jaccard_join']})").fetchall()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op12_jaccard_join"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len({c for _, _, c in want}) < len(want)


def test_longer_prefixes_are_chosen_where_they_pay():
    t = J.Threshold(90, 100)
    rare = np.concatenate((np.ones(90, np.uint32), np.full(10, 3, np.uint32)))
    assert J.choose(rare, 100, t) == (1, 11)
    common = np.full(100, 5000, np.uint32)
    matches, length = J.choose(common, 100, t)
    assert matches > 1 and length == 10 + matches
