"""Ranked lexical search over documents reordered by recursive graph bisection, in shards that are visited by their bounds.

Documents and their terms are a graph. Bisection (Dhulipala et al., KDD 2016) splits documents in halves and
swaps them between the halves as long as that lowers the cost of writing each half's postings as
gaps; halves are split in turn. It is fitted on a bounded sample, and every document is led down the tree: to the
half in which its terms cost less, measured against the sample's median. The leaves' order is the order
of the documents, and consecutive pieces of it are the shards: similar documents stand together, so a
shard has many of the documents that score high for a query, or none.

An index is a table of documents by shard: their length, and their terms, by 64 bits of a hash, with
frequencies. For a query each shard has a bound: the sum over the query's terms of the weight times the greatest
factor of any document there. A query visits its shards with the highest bounds first, in rounds that widen, and
stops when no shard is left whose bound reaches its k-th best score. A bound that equals it is visited, as ties go to the
lesser doc_id. So the result is exact, whatever the order of the documents.

Scores are integers. They are summed as doubles by matrix products where every sum is below 2**53, which is
exact, and as integers otherwise.

Defined results: terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null texts have
none; documents without terms are found by no query and count nowhere; queries without terms find none; rows that
repeat, documents or queries, are each their own; a null doc_id goes before all others of its score; a very long text is
read whole, by one task. No documents, no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._sample import place, text_hash, texts_of, within
from ._spark import kept, map_frames, materialize, scope, table, text_or_empty
from ._words import Block, blocks, give_back

U = np.uint64
#: The sample that the bisection is fitted on, and the documents of it that a leaf has at least.
SAMPLE_DOCS, SAMPLE_CHARS, LEAF_DOCS = 4096, 16_000_000, 32
#: Most documents of a shard, about; queries that are answered at once.
SHARD_DOCS, MOST_QUERIES = 2048, 1024
#: Shards that a query visits in the first rounds; then all that are left open.
ROUNDS = (4, 32)
ITERATIONS = 12
_EXACT = 1 << 53


def counts(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, frequencies, offsets): each text's distinct terms, ascending, by their hashes."""
    words = block.words()
    of = np.repeat(np.arange(block.n), block.counts)
    order = np.lexsort((words, of))
    of, words = of[order], words[order]
    new = np.ones(len(words), bool)
    new[1:] = (of[1:] != of[:-1]) | (words[1:] != words[:-1])
    first = np.flatnonzero(new)
    return words[first], np.diff(np.append(first, len(words))), np.searchsorted(of[first], np.arange(block.n + 1))


# -- the bisection -----------------------------------------------------------------------------


@dataclass
class Tree:
    """vocabulary, ascending; for each inner node, in the order of a heap, what each term speaks for the left half, and the threshold."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    depth: int

    def leaves(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The leaf of each document; one without known terms goes left."""
        n = len(offsets) - 1
        node, of = np.zeros(n, np.int64), np.repeat(np.arange(n), np.diff(offsets))
        if not self.depth or not len(self.vocabulary):
            return node
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == terms
        at, of = at[known], of[known]
        many = np.maximum(np.bincount(of, minlength=n), 1)
        for _ in range(self.depth):
            score = np.bincount(of, self.weights[node[of], at], n) / many
            node = 2 * node + 1 + (score < self.thresholds[node])
        return node - ((1 << self.depth) - 1)


def _cost(degree: np.ndarray, n: int) -> np.ndarray:
    """Bits of a term's gaps among n documents of which degree have it."""
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisected(terms: np.ndarray, offsets: np.ndarray, width: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(whether each document is in the left half, what each term speaks for it) of documents as term numbers below width."""
    n, of = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = np.arange(n) < (n + 1) // 2
    for _ in range(iterations):
        n_left = int(left.sum())
        in_left = np.bincount(terms[left[of]], minlength=width).astype(np.float64)
        in_right = np.bincount(terms[~left[of]], minlength=width).astype(np.float64)
        here = _cost(in_left, n_left) + _cost(in_right, n - n_left)
        to_right = here - _cost(np.maximum(in_left - 1, 0), n_left) - _cost(in_right + 1, n - n_left)
        to_left = here - _cost(in_left + 1, n_left) - _cost(np.maximum(in_right - 1, 0), n - n_left)
        gain = np.bincount(of, np.where(left[of], to_right[terms], to_left[terms]), n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = gain[a[:m]] + gain[b[:m]] > 1e-9
        m = int(np.argmin(swap)) if not swap.all() else m
        if not m:
            break
        left[a[:m]], left[b[:m]] = False, True
    n_left = int(left.sum())
    in_left, in_right = (np.bincount(terms[x[of]], minlength=width).astype(np.float64) for x in (left, ~left))
    more = lambda d, size: _cost(d + 1, size) - _cost(d, size)
    return left, (more(in_right, n - n_left) - more(in_left, n_left)).astype(np.float32)


def fit(terms: np.ndarray, offsets: np.ndarray, leaf_docs: int = LEAF_DOCS) -> Tree:
    """The tree of some documents' distinct terms."""
    n = len(offsets) - 1
    depth = max(0, (n // leaf_docs).bit_length() - 1)
    vocabulary, at, many = np.unique(terms, return_inverse=True, return_counts=True)
    vocabulary, keep = vocabulary[many > 1], (many > 1)[at]
    number = np.cumsum(many > 1) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))[keep]
    numbers = number[at[keep]]
    offsets = np.searchsorted(of, np.arange(n + 1))
    tree = Tree(vocabulary, np.zeros(((1 << depth) - 1, len(vocabulary)), np.float32), np.zeros((1 << depth) - 1), depth)
    held = {0: np.arange(n)}
    for node in range((1 << depth) - 1):
        docs = held.pop(node)
        sizes = offsets[docs + 1] - offsets[docs]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        own = numbers[np.repeat(offsets[docs] - ends[:-1], sizes) + np.arange(ends[-1])]
        left, weights = bisected(own, ends, len(vocabulary))
        rows = np.repeat(np.arange(len(docs)), sizes)
        score = np.bincount(rows, weights[own], len(docs)) / np.maximum(sizes, 1)
        tree.weights[node], tree.thresholds[node] = weights, np.median(score) if len(docs) else 0
        held[2 * node + 1], held[2 * node + 2] = docs[left], docs[~left]
    return tree


def sample_tree(docs: DataFrame, most: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Tree:
    """fit() on a sample of docs (doc_id, text) by a hash: at most so many documents and characters, bounded before they are collected."""
    drawn = docs.select(F.col("doc_id").cast("string").alias("id"), text_hash("text").alias("hash"), F.length("text").alias("size"))
    drawn = drawn.where("size > 0").orderBy(place(F.col("id"), F.col("hash"), salt=13), "id", "hash").limit(most).collect()
    keys = within((((r["id"], r["hash"]), r["size"]) for r in drawn), chars)
    found = texts_of(docs, keys, "doc_id", "text")
    texts = [found[k]["text"] for k in dict.fromkeys(keys) if k in found]
    parts = [counts(block) for _, _, block in blocks(texts, ascii_only=True)]
    terms = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
    sizes = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.zeros(0, np.int64)
    return fit(terms, np.concatenate(([0], np.cumsum(sizes))))


# -- the index ---------------------------------------------------------------------------------


@dataclass
class Index:
    """docs: shard, doc_id, n, terms, tfs, written; documents and total: how many have terms, and how many terms they have."""

    docs: DataFrame
    documents: int
    total: int
    shards: int

    def norm(self, n: np.ndarray) -> np.ndarray:
        """m of documents of so many terms; in Python's integers where 64 bits might not do."""
        if self.documents * int(n.max(initial=0)) * 50 < 1 << 63:
            return 50 + 50 * n.astype(np.int64) * self.documents // max(1, self.total)
        return np.array([50 + 50 * int(x) * self.documents // self.total for x in n], np.int64)


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """The index of df's documents. Besides the sample texts are read twice: to count the leaves' documents, and
    to write terms and frequencies by shard; writing them before they are dealt to shards would cost the input's size on disk."""
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    tree = df.sparkSession.sparkContext.broadcast(sample_tree(docs))  # of a bounded sample

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = 1 << tree.value.depth
        many, total = np.zeros(leaves, np.int64), np.zeros(leaves, np.int64)
        for batch in batches:
            for _, _, block in blocks(batch["text"].tolist(), ascii_only=True):
                terms, _, offsets = counts(block)
                leaf = tree.value.leaves(terms, offsets)
                many += np.bincount(leaf[block.counts > 0], minlength=leaves)
                np.add.at(total, leaf, block.counts)
        at = np.flatnonzero(many)
        yield pd.DataFrame({"leaf": at, "docs": many[at], "total": total[at]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, block in blocks(batch["text"].tolist(), ascii_only=True):
                terms, tfs, offsets = counts(block)
                leaf, has = tree.value.leaves(terms, offsets), np.flatnonzero(block.counts)
                slices = [slice(offsets[i], offsets[i + 1]) for i in has]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].array[has], "n": block.counts[has], "leaf": leaf[has],
                    "terms": [terms[s].tobytes() for s in slices], "tfs": [tfs[s].astype(np.uint32).tobytes() for s in slices],
                })

    found = docs.select("text").mapInPandas(sums, "leaf int, docs bigint, total bigint").groupBy("leaf").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))
    leaves = sorted(found.collect())  # of a bounded tree
    pieces, first = [], 0
    for leaf, many, _ in leaves:
        pieces.append((leaf, first, -(-many // shard_docs)))
        first += pieces[-1][2]
    cuts = df.sparkSession.createDataFrame(pieces, "leaf int, first int, pieces int")
    counted = map_frames(docs, run, "doc_id bigint, n bigint, leaf int, terms binary, tfs binary")
    placed = counted.join(F.broadcast(cuts), "leaf")  # a row a leaf
    placed = placed.withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("doc_id", F.length("terms"), F.crc32("terms")), F.col("pieces"))).cast("int"))
    ordered = placed.select("shard", "doc_id", "n", "terms", "tfs").repartition("shard").sortWithinPartitions("shard")
    return Index(materialize(ordered, "op13-index"), sum(r["docs"] for r in leaves), sum(r["total"] for r in leaves), first)


class Queries:
    """Some queries: for each the distinct terms; terms, all of them, ascending."""

    def __init__(self, lists: list[np.ndarray]):
        self.lists = lists
        self.terms = np.unique(np.concatenate(lists)) if lists else np.zeros(0, U)
        self.at = [np.searchsorted(self.terms, x) for x in lists]
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, having: dict[int, int], documents: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * having.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)

    def matrix(self) -> np.ndarray:
        """terms x queries, the weights where a query has the term; doubles if sums of them times a million are exact."""
        exact = max((int(self.weights[a].sum()) for a in self.at), default=0) * 1_000_000 < _EXACT
        out = np.zeros((len(self.terms), len(self.at)), np.float64 if exact else np.int64)
        for q, a in enumerate(self.at):
            out[a, q] = self.weights[a]
        return out

    def factors(self, index: Index, batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, rows after, terms, factors) for runs of a batch's documents: the postings of asked terms, rows counted from the first."""
        lists = [np.frombuffer(x, U) for x in batch["terms"]]
        norm = index.norm(batch["n"].to_numpy(np.int64))
        at = 0
        while at < len(lists):
            end, size = at, 0
            while end < len(lists) and end - at < 512 and (end == at or size + len(lists[end]) < 2_000_000):
                size += len(lists[end])
                end += 1
            terms = np.concatenate(lists[at:end])
            tfs = np.concatenate([np.frombuffer(x, np.uint32) for x in batch["tfs"].iloc[at:end]]).astype(np.int64)
            rows = np.repeat(np.arange(end - at), [len(x) for x in lists[at:end]])
            place_ = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
            known = self.terms[place_] == terms if len(self.terms) else np.zeros(len(terms), bool)
            rows, place_, tfs = rows[known], place_[known], tfs[known]
            yield at, end, rows, place_, 1_000_000_000 * tfs // (1000 * tfs + 20 * norm[at:end][rows])
            at = end


def _shard_stats(index: Index, held) -> DataFrame:
    """(shard, best, having), written: the greatest factor of each asked term in the shard, and how many documents have it."""
    facts = Index(None, index.documents, index.total, index.shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, own = held.value, None
        best = having = None
        for batch in batches:
            shards = batch["shard"].to_numpy()
            for at, end, rows, terms, factor in queries.factors(facts, batch):
                for shard in np.unique(shards[at:end]):
                    if own is not None and shard != own:
                        yield pd.DataFrame({"shard": [own], "best": [best.tobytes()], "having": [having.tobytes()]})
                        own = None
                    if own is None:
                        own, best, having = shard, np.zeros(len(queries.terms), np.int32), np.zeros(len(queries.terms), np.int64)
                    mine = shards[at:end][rows] == shard
                    np.maximum.at(best, terms[mine], factor[mine].astype(np.int32))
                    having += np.bincount(terms[mine], minlength=len(having))
        if own is not None:
            yield pd.DataFrame({"shard": [own], "best": [best.tobytes()], "having": [having.tobytes()]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        best = np.max([np.frombuffer(x, np.int32) for x in group["best"]], axis=0)
        having = np.sum([np.frombuffer(x, np.int64) for x in group["having"]], axis=0)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "best": [best.tobytes()], "having": [having.tobytes()]})

    schema = "shard int, best binary, having binary"
    return materialize(index.docs.select("shard", "n", "terms", "tfs").mapInPandas(run, schema).groupBy("shard").applyInPandas(joined, schema), "op13-shards")


def _having(stats: DataFrame) -> dict[int, int]:
    """Documents of each asked term, by its number: a row a term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for raw in batch["having"]:
                total = np.frombuffer(raw, np.int64) + (0 if total is None else total)
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"term": at, "having": total[at]})

    rows = stats.select("having").mapInPandas(run, "term bigint, having bigint").groupBy("term").agg(F.sum("having").alias("having"))
    return {r["term"]: r["having"] for r in rows.collect()}


def _bounds(stats: DataFrame, held) -> DataFrame:
    """(query, shard, bound): no document of the shard scores more for the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = held.value.matrix()
        for batch in batches:
            best = np.stack([np.frombuffer(x, np.int32) for x in batch["best"]]).astype(matrix.dtype) if len(batch) else np.zeros((0, len(matrix)))
            bound = (best @ matrix).astype(np.int64)
            row, query = np.nonzero(bound)
            yield pd.DataFrame({"query": query, "shard": batch["shard"].to_numpy()[row], "bound": bound[row, query]})

    return materialize(stats.select("shard", "best").mapInPandas(run, "query int, shard int, bound bigint"), "op13-bounds")


def _scored(index: Index, held, visits: DataFrame, floors: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): of each task's documents in the visited shards (shard, queries), a query's k best that score its floor and more."""
    facts = Index(None, index.documents, index.total, index.shards)

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), len(floors)), bool)
            for i, x in enumerate(batch["queries"]):
                out[i, np.asarray(x, np.int64)] = True
            yield pd.DataFrame({"shard": batch["shard"], "asks": [np.packbits(x).tobytes() for x in out]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = held.value
        matrix, count = queries.matrix(), len(floors)
        best: list[list] = [[] for _ in range(count)]
        floor = floors.copy()
        held_rows = 0

        def trim() -> None:
            nonlocal held_rows
            held_rows = 0
            for q, rows in enumerate(best):
                rows.sort()
                del rows[k:]
                if len(rows) == k:
                    floor[q] = max(floor[q], -rows[-1][0])
                held_rows += len(rows)

        for batch in batches:
            asks = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in batch["asks"]]), axis=1)[:, :count].astype(bool)
            ids, unknown = batch["doc_id"].fillna(0).to_numpy(np.int64), batch["doc_id"].isna().to_numpy()
            for at, end, rows, terms, factor in queries.factors(facts, batch):
                table_ = np.zeros((end - at, len(queries.terms)), matrix.dtype)
                table_[rows, terms] = factor
                score = (table_ @ matrix).astype(np.int64)
                row, query = np.nonzero((score >= floor) & (score > 0) & asks[at:end])
                for r, q, s in zip((row + at).tolist(), query.tolist(), score[row, query].tolist()):
                    best[q].append((-s, not unknown[r], int(ids[r])))
                held_rows += len(row)
                if held_rows > 4 * k * count + 10_000:
                    trim()
        trim()
        out = [(q, i if known else None, -s) for q, rows in enumerate(best) for s, known, i in rows]
        yield pd.DataFrame({"query": [r[0] for r in out], "doc_id": pd.array([r[1] for r in out], dtype="Int64"), "score": [r[2] for r in out]})
        give_back()

    asked = materialize(visits.mapInPandas(masks, "shard int, asks binary"), "op13-visits")
    # the sides of this join are left to the optimiser, which knows the written table's size
    return map_frames(index.docs.join(asked, "shard").select("doc_id", "n", "terms", "tfs", "asks"), run, "query int, doc_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answered(index: Index, lists: list[np.ndarray], k: int) -> DataFrame:
    """(query, rank, doc_id, score), written, of queries as terms."""
    sc = index.docs.sparkSession.sparkContext
    queries = Queries(lists)
    with scope(index.docs.sparkSession):
        stats = _shard_stats(index, sc.broadcast(queries))
        queries.weigh(_having(stats), index.documents)
        held = sc.broadcast(queries)  # a bounded part of the queries
        bounds = _bounds(stats, held)
        nth = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
        found, floors, before = None, np.ones(len(lists), np.int64), 0
        for most in (*ROUNDS, None):
            limits = index.docs.sparkSession.createDataFrame([(q, int(f)) for q, f in enumerate(floors)], "query int, floor bigint")
            open_ = bounds.join(F.broadcast(limits), "query").where("bound >= floor")  # a row a query of a bounded part
            if most is not None:  # the least of those is found below the exchange
                ranked = bounds.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= most)
                now = ranked.where(F.col("nth") > before).join(F.broadcast(limits), "query").where("bound >= floor")
            else:
                first = bounds.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= before).select("query", "shard")
                now = open_.join(first, ["query", "shard"], "left_anti")
            visits = materialize(now.groupBy("shard").agg(F.collect_list("query").alias("queries")), "op13-round")  # at most a part's queries
            before = most
            if visits.isEmpty():
                break
            new = _scored(index, held, visits, floors, k)
            found = materialize(_best(new if found is None else found.select("query", "doc_id", "score").unionByName(new), k), "op13-best")
            last = found.where(F.col("rank") == k).select("query", "score").collect()  # a row a query
            for r in last:
                floors[r["query"]] = max(floors[r["query"]], r["score"])
        if found is None:
            return index.docs.sparkSession.createDataFrame([], "query int, rank int, doc_id bigint, score bigint")
        return kept(found.select("query", "rank", "doc_id", "score"), "op13-answers")


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each row of items, written. Items are answered in parts of MOST_QUERIES."""
    spark = index.docs.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, block in blocks(batch["text"].tolist(), ascii_only=True):
                terms, _, offsets = counts(block)
                yield pd.DataFrame({"nth": batch["nth"].iloc[a:b], "item": batch["item"].iloc[a:b], "terms": [terms[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]})

    kind = items.schema[item_id].dataType.simpleString()
    asked = items.select(F.col(f"`{item_id}`").alias("item"), text_or_empty(text).alias("text")).withColumn("nth", F.monotonically_increasing_id())
    asked = kept(map_frames(asked, run, f"nth bigint, item {kind}, terms binary").where(F.length("terms") > 0), "op13-items")
    parts = max(1, -(-asked.count() * 5 // (MOST_QUERIES * 4)))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for i in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("nth"), F.lit(parts)) == i).orderBy("nth").collect()  # a bounded part of the items
        if rows:
            named = spark.createDataFrame([(q, r["nth"]) for q, r in enumerate(rows)], "query int, nth bigint")
            found = _answered(index, [np.frombuffer(bytes(r["terms"]), U) for r in rows], k)
            found = found.join(F.broadcast(named), "query").join(F.broadcast(asked.select("nth", F.col("item").alias("item_id"))), "nth")  # a row a query of the part
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE_SQL = {
    "op13_lexical_search": r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
