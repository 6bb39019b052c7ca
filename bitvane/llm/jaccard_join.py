"""Exact self-join of documents by the Jaccard similarity of their three-word shingles, with adaptive multi-match prefixes.

Sets in one order of all tokens that overlap in at least o tokens share at least l of the first
n - o + l of each (AdaptJoin, Wang, Li and Feng, SIGMOD 2012; l = 1 is the usual prefix filter). A longer
prefix is dearer to read and, as it demands more matches, gives fewer candidates.

1. Equal sets form a group with one representative, combined before the shuffle.
2. Which texts can have a partner at all? In the order of their hashes, a prefix with l of a tenth of
   the set: fewer than that many tokens that any other prefix has, and there is none. Most texts end here.
3. The others are read again, and their tokens put in order of how many of them have each, rarest first.
   Tokens that no other has come first, and a set with too many of these ends here too. For each set l is
   chosen, 1, 2, 4, ..., by estimated cost: the postings of its prefix, and the candidates,
   no more than the postings over l, times the cost of verifying one.
4. Sets that share a token of their shortest prefixes (l = 1) meet in that token's bucket. A pair is
   verified if it shares as many tokens of its prefixes as the smaller l of both. First each bucket's members
   are taken with its least member only, and links go into connected components; then pairs of different
   components, in blocks of bounded size. So no bucket is capped and no pair of a group of
   copies is emitted: every pair of a bucket is verified, shown to be below the threshold, or in one
   component already.

Counts of tokens are exchanged in blocks: a block of texts sends each of its different tokens once, as
numbers in a range, to the range's task, and gets the counts back. So a token that a third of all
texts have costs one number a block, and tokens are never rows.

Defined results: only A-Z are lower-cased; words are runs of other bytes than space and 0x09-0x0D;
shingles are compared by 64 bits of their hash; a text of fewer than three words has one shingle; null,
empty and blank texts have none and are linked with nothing, each its own component; a component's id
is its least doc_id, null if all are null; repeated rows and ids are documents like others; a very long text
is hashed whole by one task. No rows, no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bloom
from ._spark import kept, map_frames, materialize, scope, table, text_or_empty
from ._words import Block, blocks, give_back, mix, shingles
from .near_dedup import MAX_FILTER_BYTES, _residual, _residual_links, components, widened

U = np.uint64
WIDTH = 3
#: What it costs to verify a candidate, in postings read.
VERIFY = 32
#: Different tokens of blocks that one task counts, on average.
RANGE_TOKENS = 1_000_000
_IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
BLOCK = "block bigint, part int, tokens binary, counts binary, reps binary, sizes binary, at binary"


class Threshold:
    """A similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, n: np.ndarray) -> np.ndarray:
        """Least overlap of a set of n with any set it is linked with."""
        return -(-n * self.num // self.den)

    def matches(self, n: np.ndarray) -> np.ndarray:
        """l of the first filter: a tenth of the set. It never falls as n grows."""
        return np.minimum(self.need(n), np.maximum(1, -(-n // 10)))

    def links(self, both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (n + m - both)


def set_list(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles, ascending."""
    hashes, offsets = shingles(block, width)
    of = np.repeat(np.arange(block.n), np.diff(offsets))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(of[new], np.arange(block.n + 1))


def set_keys(hashes: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Hex of 128 bits over each set; '' for an empty one."""
    halves = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ U(salt)), dtype=U)))
        halves.append((sums[offsets[1:]] - sums[offsets[:-1]]).tolist())
    return [f"{a:016x}{b:016x}" if n else "" for a, b, n in zip(*halves, np.diff(offsets))]


def _sketched(docs: DataFrame, t: Threshold) -> DataFrame:
    """(doc_id, key, n, prefix): the least hashes of each set, as many as the first filter needs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, block in blocks(batch["text"].tolist(), _IN_WORD, True):
                hashes, offsets = set_list(block)
                n = np.diff(offsets)
                ends = offsets[:-1] + n - t.need(n) + t.matches(n)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "key": set_keys(hashes, offsets), "n": n, "prefix": [hashes[x:y].tobytes() for x, y in zip(offsets, ends)]})

    return map_frames(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, n bigint, prefix binary")


def _sets_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, _, block in blocks(batch["text"].tolist(), _IN_WORD, True):
                hashes, offsets = set_list(block)
                yield pd.DataFrame({"key": set_keys(hashes, offsets), "set": [hashes[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]})

    return docs.select("text").mapInPandas(run, "key string, set binary")


def _counted(rows: DataFrame, tokens: str, total: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """(blocks: reps, sizes, at, written; counts: block, part, counts) of rows (rep, n, the tokens as 64-bit hashes, ascending).

    at: for each token of each row its place among the block's different tokens, in order; counts: how many rows have
    each of those, range after range of tokens.
    """
    bits = max(0, (-(-total // RANGE_TOKENS) - 1).bit_length())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for nth, batch in enumerate(batches):
            block = TaskContext.get().partitionId() << 32 | nth
            lists = [np.frombuffer(x, U) for x in batch[tokens]]
            every = np.concatenate(lists) if lists else np.zeros(0, U)
            different, at, count = np.unique(every, return_inverse=True, return_counts=True)
            edges = np.searchsorted(different, np.arange(1, 1 << bits, dtype=U) << U(64 - bits)) if bits else np.zeros(0, np.int64)
            out = [(block, p, x.tobytes(), c.astype(np.uint32).tobytes(), None, None, None) for p, (x, c) in enumerate(zip(np.split(different, edges), np.split(count, edges))) if len(x)]
            sizes = np.array([len(x) for x in lists], np.int64)
            out.append((block, -1, None, None, np.stack([batch["rep"].to_numpy(np.int64), batch["n"].to_numpy(np.int64)]).tobytes(), sizes.tobytes(), at.astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["block", "part", "tokens", "counts", "reps", "sizes", "at"])
        give_back()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, U) for x in group["tokens"]]
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]])).astype(np.uint32)
        parts = np.split(sums[at], np.cumsum([len(x) for x in lists])[:-1])
        return pd.DataFrame({"block": group["block"], "part": group["part"], "counts": [x.tobytes() for x in parts]})

    cuts = materialize(rows.select("rep", "n", tokens).mapInPandas(cut, BLOCK), f"op12-{tag}")
    counts = cuts.where("part >= 0").select("block", "part", "tokens", "counts").groupBy("part").applyInPandas(count, "block bigint, part int, counts binary")
    return cuts.where("part < 0").select("block", "reps", "sizes", "at"), counts


class _Held:
    """A block with its counts: for each row rep, n and the slice of its tokens' counts."""

    def __init__(self, heads: pd.DataFrame, counts: pd.DataFrame):
        head = heads.iloc[0]
        self.reps, self.n = np.frombuffer(head["reps"], np.int64).reshape(2, -1)
        sizes = np.frombuffer(head["sizes"], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        of = np.concatenate([np.frombuffer(x, np.uint32) for x in counts.sort_values("part")["counts"]]) if len(counts) else np.zeros(0, np.uint32)
        self.counts = of[np.frombuffer(head["at"], np.uint32)]


def _possible(heads: DataFrame, counts: DataFrame, t: Threshold) -> DataFrame:
    """(rep) of the rows whose prefix has enough tokens that another's has too."""

    def run(head: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        b = _Held(head, back)
        sums = np.concatenate(([0], np.cumsum(b.counts > 1)))
        shared = sums[b.offsets[1:]] - sums[b.offsets[:-1]]
        # a partner may be smaller and have a smaller l
        return pd.DataFrame({"rep": b.reps[shared >= t.matches(t.need(b.n))]})

    return heads.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(run, "rep bigint")


def choose(counts: np.ndarray, n: int, t: Threshold) -> tuple[int, int]:
    """(l, length) of the multi-match prefix of least estimated cost of a set whose tokens have these counts, ascending."""
    need = int(t.need(np.int64(n)))
    others = np.concatenate(([0], np.cumsum(counts.astype(np.int64) - 1)))
    best = None
    matches = 1
    while matches <= need:
        length = n - need + matches
        cost = others[length] * (1 + VERIFY / matches)
        if best is None or cost < best[0]:
            best = (cost, matches, length)
        matches *= 2
    return best[1:]


def _prefixes(heads: DataFrame, counts: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(rep, n, matches, alone, first, prefix, set) of the sets that can have a partner.

    alone: how many tokens no other set has; first: the tokens of the shortest prefix that another has; prefix: those of the chosen one.
    """

    def run(head: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        b = _Held(head, back)
        out = [(int(rep), b.counts[x:y].tobytes()) for rep, x, y in zip(b.reps, b.offsets, b.offsets[1:])]
        return pd.DataFrame(out, columns=["rep", "counts"])

    back = heads.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(run, "rep bigint, counts binary")

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rep, n, raw, counted in batch[["rep", "n", "set", "counts"]].itertuples(index=False):
                tokens, count = np.frombuffer(raw, U), np.frombuffer(counted, np.uint32)
                by = np.lexsort((tokens, count))
                tokens, count = tokens[by], count[by]
                alone, need = int(np.searchsorted(count, 1, side="right")), int(t.need(np.int64(n)))
                if n - alone < need:
                    continue
                matches, length = choose(count, n, t)
                out.append((rep, n, matches, alone, tokens[alone : n - need + 1].view(np.int64), np.sort(tokens[alone:length]).tobytes(), raw))
            yield pd.DataFrame(out, columns=["rep", "n", "matches", "alone", "first", "prefix", "set"])

    return sets.join(back, "rep").mapInPandas(order, "rep bigint, n bigint, matches int, alone int, first array<bigint>, prefix binary, set binary")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """pairs (a, b) with similarity, null where too few tokens of the prefixes match, and linked."""

    @F.pandas_udf("struct<similarity double, linked boolean>")
    def verify(l_a: pd.Series, p_a: pd.Series, s_a: pd.Series, l_b: pd.Series, p_b: pd.Series, s_b: pd.Series) -> pd.DataFrame:
        out = []
        for l1, p1, x, l2, p2, y in zip(l_a, p_a, s_a, l_b, p_b, s_b):
            if _overlap(np.frombuffer(p1, U), np.frombuffer(p2, U)) < min(l1, l2):
                out.append((None, False))
                continue
            n, m = len(x) // 8, len(y) // 8
            both = _overlap(np.frombuffer(x, U), np.frombuffer(y, U))
            out.append((both / (n + m - both), bool(t.links(both, n, m))))
        return pd.DataFrame(out, columns=["similarity", "linked"]).astype({"similarity": "float64", "linked": "bool"})

    side = lambda name: sets.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("matches", "prefix", "set")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", verify("matches_a", "prefix_a", "set_a", "matches_b", "prefix_b", "set_b").alias("v")).select("a", "b", F.when(~F.isnan("v.similarity"), F.col("v.similarity")).alias("similarity"), "v.linked")


def matched_links(left: pd.DataFrame, right: pd.DataFrame, t: Threshold) -> list[tuple[int, int]]:
    """Links that join the components (class) of left rows to those of right rows."""
    out: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return out
    prefixes = [np.frombuffer(x, U) for x in right["prefix"]]
    widths = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
    every, at = np.unique(np.concatenate(prefixes), return_inverse=True)
    ends = np.cumsum(widths)
    classes, reps, n, matches, alone, far = (right[c].to_numpy() for c in ("class", "rep", "size", "matches", "alone", "far"))
    sets = right["set"].tolist()
    merged: dict[int, int] = {}

    def top(c: int) -> int:
        while c in merged:
            c = merged[c]
        return c

    for rep, cls, m, l_, own_alone, d, prefix, raw in left[["rep", "class", "size", "matches", "alone", "far", "prefix", "set"]].itertuples(index=False):
        # sizes, tokens that no other set has, and the distances from a common third leave little to compare
        most = np.minimum(m - own_alone, n - alone)
        open_ = (classes != cls) & t.links(most, n, np.int64(m)) & ~(np.abs(far - d) > 1 - t.num / t.den + 1e-9)
        if not open_.any():
            continue
        own = np.frombuffer(prefix, U)
        place = np.minimum(np.searchsorted(every, own), len(every) - 1)
        mark = np.zeros(len(every), np.int64)
        mark[place[every[place] == own]] = 1
        sums = np.concatenate(([0], np.cumsum(mark[at])))
        open_ &= sums[ends] - sums[ends - widths] >= np.minimum(matches, l_)
        whole = np.frombuffer(raw, U)
        for k in np.flatnonzero(open_):
            x, y = top(int(cls)), top(int(classes[k]))
            if x != y and t.links(_overlap(whole, np.frombuffer(sets[k], U)), m, n[k]):
                merged[max(x, y)] = min(x, y)
                out.append((int(rep), int(reps[k])))
    return out


def _components(docs: DataFrame, members: DataFrame, t: Threshold, block_rows: int) -> DataFrame:
    """(key, component_id) of the sets that are linked with others."""
    groups = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"))
    groups = materialize(groups.withColumn("rep", F.monotonically_increasing_id()), "op12-groups")
    total = groups.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0)) / 8).first()[0]
    possible = materialize(_possible(*_counted(groups, "prefix", int(total), "prefixes"), t), "op12-possible")
    groups_ = groups.select("rep", "key", "doc_id")
    looked_at = materialize(groups_.join(possible, "rep"), "op12-candidates")

    blocks_ = _bloom.block_count(looked_at.count(), 16, MAX_FILTER_BYTES)
    flagged, maybe = _bloom.flag(docs, F.xxhash64("doc_id"), _bloom.build(looked_at, F.xxhash64("doc_id"), blocks_), blocks_)
    texts = _sets_of(flagged.where(F.col(maybe)).select("text")).groupBy("key").agg(F.any_value("set").alias("set"))
    sets = materialize(texts.join(looked_at.select("key", "rep"), "key").select("rep", (F.length("set") / 8).cast("bigint").alias("n"), "set"), "op12-sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ordered = materialize(_prefixes(*_counted(sets, "set", int(total), "sets"), sets, t), "op12-ordered")

    signed = ordered.select("rep", F.explode("first").alias("bucket"))
    shared = materialize(signed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("many"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum")).where("many > 1"), "op12-shared")
    # of buckets with the same members one is enough
    shared = materialize(shared.groupBy("pivot", "many", "sum").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot"), "op12-different")
    bucketed = materialize(signed.join(shared, "bucket"), "op12-buckets")
    pairs = bucketed.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    compared = materialize(_verified(pairs, ordered, t), "op12-compared")
    comp = components(compared.where("linked"))
    left = materialize(_residual(bucketed, compared, comp), "op12-residual")
    carried = ordered.select("rep", F.col("n").alias("size"), "matches", "alone", "prefix", "set")
    more = materialize(_residual_links(left, carried, t, block_rows, matched_links).distinct(), "op12-links")
    comp = widened(comp, more)
    named = comp.join(groups_.select("rep", "doc_id"), "rep").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return comp.join(named, "class").join(groups_.select("rep", "key"), "rep").select("key", "component_id")


def linked_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 90, den: int = 100, block_rows: int = 512) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id, by links of similarity num / den and more."""
    t = Threshold(num, den)
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    with scope(df.sparkSession):
        members = kept(_sketched(docs, t), "op12-members")
        linked = kept(_components(docs, members, t, block_rows), "op12-components")
    rows = members.select("doc_id", F.col("n").alias("n_shingles"), "key")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    copies = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    ids = copies.join(linked, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id"))
    return rows.where("n_shingles > 0").join(ids, "key").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


QUERIES = {"op12_jaccard_join": op12_jaccard_join}
ORACLE_SQL = {
    "op12_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT nth, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END) AS s
  FROM words),
sizes AS (SELECT w.nth, w.doc_id, count(s) AS n FROM words w LEFT JOIN shingled USING (nth) GROUP BY w.nth, w.doc_id),
pairs AS (SELECT a.nth AS a, b.nth AS b, count(*) AS both_have FROM shingled a JOIN shingled b ON a.s = b.s AND a.nth < b.nth GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.nth = a JOIN sizes y ON y.nth = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT nth, nth AS other FROM words UNION SELECT r.nth, l.b FROM reached r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, least_id AS component_id
FROM sizes s JOIN (SELECT r.nth, min(o.doc_id) AS least_id FROM reached r JOIN words o ON o.nth = r.other GROUP BY r.nth) c ON c.nth = s.nth
""",
}
