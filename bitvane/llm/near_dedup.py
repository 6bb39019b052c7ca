"""MinHash near-duplicate detection with DartMinHash signatures (Christiani, arXiv:2005.11547).

A text is the weighted set of its five-word shingles, weighted by how often each occurs. Hashed
darts are thrown into the region of each element: the weight axis in intervals that double, the
rank axis in slabs that hold one dart on average. Darts that land under the element's weight are
dealt to the signature's coordinates, and each coordinate keeps the dart of least rank. The work
is a few hashes an element and hardly grows with the signature.

The stages, all exact after the candidates:

1. Texts with the same words form a group with one representative, combined before the shuffle;
   so copies cost nothing further.
2. Signatures are cut into bands; the representatives with equal values in a band are a bucket.
3. Pivot round: each bucket's members are compared with its least member only. Links go into
   connected components.
4. Residual round: the pairs of a bucket that are in different components still, and that the
   pivot's distances do not rule out (1 - similarity obeys the triangle inequality), are compared
   in blocks of bounded size. So every pair that shares a bucket is linked, shown to be below the
   threshold, or in one component already, and no bucket is capped.

Nothing that grows with the documents is collected: components are found by rounds of joins, with
their lineage cut by written tables. Texts are never shuffled: a Bloom filter of the ids that
need a second look picks the rows that are read again.

Defined results: null text counts as empty; texts without words are copies of each other; a text
of fewer than five words has one shingle, of all of them; a very long text is hashed whole, by one
task, in memory of some forty times its size; repeated rows and ids belong to the class of their words;
the class id is the least doc_id of the class (null only if all are), and one row of it is kept, of
ties the first text by its key. No rows, no rows. Other columns pass with near_dedup() and play no
part in near_classes(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bloom
from ._spark import fresh, kept, map_frames, materialize, scope, table, text_or_empty
from ._words import Block, blocks, mix, shingles

U = np.uint64
#: Cumulative chances of 0, 1, 2, ... darts in an area that holds one on average.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16)))))
MAX_FILTER_BYTES = 256 << 20


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element's place, identity, rank) of the darts under each element's weight and below its height.

    An element's darts depend on the element alone; a greater weight or height only adds darts.
    Interval v of the weight axis is [2**v - 1, 2**(v+1) - 1); its slab s of the rank axis is
    [s / 2**v, (s+1) / 2**v), an area of one, so with Poisson(1) darts.
    """
    found = []
    for v in range(int(np.log2(weights.max(initial=0) + 1)) + 1):
        low = float(2**v - 1)
        own = np.flatnonzero(weights > low)
        slabs = np.ceil(heights[own] * 2**v).astype(np.int64)
        own = np.repeat(own, slabs)
        slab = np.arange(len(own)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        seed = mix(elements[own] + slab.astype(U) * U(0xE7037ED1A0B428DB) + U((v + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        n = np.searchsorted(_POISSON, _unit(seed), side="right")
        of = np.repeat(np.arange(len(own)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(seed[of] ^ (nth.astype(U) + U(1)) * U(0x8EBC6AF09C88C6E3))
        rank = (slab[of] + _unit(mix(dart + U(0x3C79AC492BA7B653)))) / 2**v
        under = (rank < heights[own[of]]) & (low + _unit(mix(dart + U(0x589965CC75374CC3))) * 2**v < weights[own[of]])
        found.append((own[of][under], dart[under], rank[under]))
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(sets: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets x size signatures, which sets have one). Row i of the input is an element of set sets[i].

    Two signatures agree at a coordinate with the weighted Jaccard similarity as probability. A
    set that leaves a coordinate without darts is thrown at again with twice the height.
    """
    out, rank_of = np.zeros((n_sets, size), U), np.full((n_sets, size), np.inf)
    total = np.bincount(sets, weights, n_sets)
    has = total > 0
    height = np.where(has, (size * np.log(size) + 3 * size) / np.maximum(total, 1e-300), 0)
    open_ = has.copy()
    while open_.any():
        rows = np.flatnonzero(open_[sets])
        at, ids, ranks = darts(elements[rows], weights[rows], height[sets[rows]])
        place = sets[rows][at] * size + (mix(ids + U(0x1D8E4E27C47D124F)) % U(size)).astype(np.int64)
        order = np.argsort(ranks, kind="stable")[::-1]  # the least rank is written last
        out.ravel()[place[order]], rank_of.ravel()[place[order]] = ids[order], ranks[order]
        open_ &= ~np.isfinite(rank_of).all(axis=1)
        height[open_] *= 2
    return out, has


def weighted_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, element, weight) of the distinct hashes between each two offsets, weight their count."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return of[first], hashes[first], np.diff(np.append(first, len(hashes))).astype(np.float64)


def band_values(sigs: np.ndarray, bands: int) -> np.ndarray:
    """sets x bands: a hash of each band's rows and its number."""
    parts = sigs.reshape(len(sigs), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sigs), bands)).copy()
    for j in range(parts.shape[2]):
        h = mix(h * U(0x2545F4914F6CDD1D) + parts[:, :, j])
    return h.view(np.int64)


def word_keys(block: Block) -> list[str]:
    """Hex of 128 bits over each text's words in order; '' for a text without words."""
    pos = (np.arange(len(block.starts)) - np.repeat(block.first, block.counts)).astype(U)
    both, last = [], block.first + block.counts
    for salt in (21, 22):
        h = mix(block.words(salt) + mix(pos * U(2) + U(salt)))
        s = np.concatenate((np.zeros(1, U), np.cumsum(h, dtype=U)))
        both.append((s[last] - s[block.first]).tolist())
    return [f"{a:016x}{b:016x}" if n else "" for a, b, n in zip(*both, block.counts)]


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, bands) of docs (doc_id, text); bands is null for texts without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, block in blocks(batch["text"].tolist()):
                sets, elements, weights = weighted_sets(*shingles(block, width))
                sigs, has = signatures(sets, elements, weights, block.n, bands * rows)
                values = band_values(sigs, bands)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "key": word_keys(block), "bands": [v if x else None for v, x in zip(values, has)]})

    return map_frames(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key string, bands array<bigint>")


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """(key, set): each text's shingle hashes, 32 bits each, sorted, with repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, block in blocks(batch["text"].tolist()):
                hashes, offsets = shingles(block, width)
                short = (hashes >> U(32)).astype(np.uint32)
                yield pd.DataFrame({"key": word_keys(block), "set": [np.sort(short[offsets[i] : offsets[i + 1]]).tobytes() for i in range(block.n)]})

    return docs.select("text").mapInPandas(run, "key string, set binary")


def numbered(raw: bytes) -> np.ndarray:
    """A sorted multiset as a sorted set: the k-th repeat of a value is an element of its own."""
    a = np.frombuffer(raw, np.uint32)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    nth = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return a.astype(U) << U(32) | nth.astype(U)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 if one is empty."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def components(links: DataFrame) -> DataFrame:
    """(rep, class) of all reps in links (a, b): the least rep that a path reaches.

    Each round a node takes the least label among its neighbours, then that label's own label, so
    labels travel twice as far each time and the rounds grow with the logarithm of the longest path.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = materialize(both, "op9-edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
    labels = materialize(labels, "op9-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("a").alias("low"), F.col("label").alias("up"))
        new = materialize(low.join(up, "low").select("a", "label", F.least("low", "up").alias("next")), "op9-labels")
        if new.where("next <> label").isEmpty():
            return new.select(F.col("a").alias("rep"), F.col("next").alias("class"))
        labels = new.select("a", F.col("next").alias("label"))


def widened(comp: DataFrame, more: DataFrame) -> DataFrame:
    """Components (rep, class) after further links (a, b), a written table."""
    if more.isEmpty():
        return comp
    own = comp.select(F.col("rep").alias("a"), F.col("class").alias("class_a"))
    other = comp.select(F.col("rep").alias("b"), F.col("class").alias("class_b"))
    joined = more.join(own, "a", "left").join(other, "b", "left")
    joined = components(joined.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")))
    joined = joined.select(F.col("rep").alias("class"), F.col("class").alias("wider"))
    every = comp.unionByName(more.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(comp, "rep", "left_anti").select("rep", F.col("rep").alias("class")))
    return every.join(joined, "class", "left").select("rep", F.coalesce("wider", "class").alias("class"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity."""

    @F.pandas_udf("double")
    def sim(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(numbered(x), numbered(y)) for x, y in zip(a, b)], dtype="float64")

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", sim("set_a", "set_b").alias("similarity"))


def _residual(bucketed: DataFrame, compared: DataFrame, comp: DataFrame) -> DataFrame:
    """(bucket, rep, class, main, far, n, out) of the buckets that hold several components.

    main: whether the component has the most members in the bucket; far: the distance from the
    pivot, which is left out as it has been compared with all; n: members, out: those not of main.
    """
    known = compared.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (1 - F.col("similarity")).alias("far"))
    rows = bucketed.where("rep <> pivot").join(known, ["pivot", "rep"]).join(comp, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    rows = materialize(rows, "op9-distances")
    each = rows.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("own"))
    buckets = each.groupBy("bucket").agg(F.max_by("class", F.struct("own", "class")).alias("most"), F.sum("own").alias("n"), F.max("own").alias("top"))
    # written too: the join is then of plain exchanges, and a hot bucket can be split over tasks
    buckets = materialize(buckets.where("n > top").select("bucket", "most", "n", (F.col("n") - F.col("top")).alias("out")), "op9-open")
    return rows.join(buckets, "bucket").select("bucket", "rep", "class", (F.col("class") == F.col("most")).alias("main"), "far", "n", "out")


def _residual_links(members: DataFrame, sets: DataFrame, threshold: float, block_rows: int, compare: Callable | None = None) -> DataFrame:
    """Links (a, b) that join components of one bucket, among members as _residual() gives them; compare is block_links(), or another such.

    A bucket is cut into runs of block_rows members on average, and its members outside the main
    component likewise; each pair of such runs is compared in one task. A bucket of one run goes to its
    task once.
    """
    spread = F.xxhash64("rep", F.lit(17))
    runs, outs = (F.ceil(F.col(c) / block_rows).cast("int") for c in ("n", "out"))
    single = (runs == 1) & (outs == 1)
    last = lambda count: F.sequence(F.lit(0), count - 1)
    rights = members.select("*", F.lit(False).alias("left"), (single & ~F.col("main")).alias("both"), F.pmod(spread, runs).cast("int").alias("j"), F.explode(last(outs)).alias("i"))
    lefts = members.where(~F.col("main") & ~single).select("*", F.lit(True).alias("left"), F.lit(False).alias("both"), F.explode(last(runs)).alias("j"), F.pmod(spread, outs).cast("int").alias("i"))
    tasks = lefts.unionByName(rights).join(sets, "rep").select("bucket", "i", "j", "left", "both", "rep", "class", "far", *[c for c in sets.columns if c != "rep"])
    compare = compare or block_links

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left"] | group["both"]], group[~group["left"]]
        return pd.DataFrame(compare(left, right, threshold), columns=["a", "b"], dtype="int64")

    return tasks.groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint")


def block_links(left: pd.DataFrame, right: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Links that join the components (class) of left rows to those of right rows; columns rep, class, far, set."""
    out: list[tuple[int, int]] = []
    if not len(left) or not len(right):
        return out
    sets = [numbered(s) for s in right["set"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    classes, far, reps = right["class"].to_numpy(), right["far"].to_numpy(), right["rep"].to_numpy()
    merged: dict[int, int] = {}

    def top(c: int) -> int:
        while c in merged:
            c = merged[c]
        return c

    for rep, cls, raw, d in left[["rep", "class", "set", "far"]].itertuples(index=False):
        own = numbered(raw)
        open_ = (classes != cls) & (np.abs(far - d) <= 1 - threshold + 1e-9)
        if not len(own) or not len(every) or not open_.any():
            continue
        place = np.minimum(np.searchsorted(every, own), len(every) - 1)
        mark = np.zeros(len(every), np.int64)
        mark[place[every[place] == own]] = 1
        sums = np.concatenate(([0], np.cumsum(mark[at])))
        both = sums[ends] - sums[ends - sizes]
        for k in np.flatnonzero(open_ & (both >= threshold * (len(own) + sizes - both))):
            x, y = top(int(cls)), top(int(classes[k]))
            if x != y:  # one link joins two components
                merged[max(x, y)] = min(x, y)
                out.append((int(rep), int(reps[k])))
    return out


def _grouped(docs: DataFrame, threshold: float, width: int, bands: int, rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, key; groups: key, class_id, kept_key, class_size, links) of docs (doc_id, text).

    Only the two tables that these read stay; the others go as soon as those are written.
    """
    with scope(docs.sparkSession):
        members = kept(_sketched(docs.select("doc_id", text_or_empty().alias("text")), width, bands, rows), "op9-members")
        placed = kept(_placed(docs, members, threshold, width, block_rows), "op9-placed")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    whole = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min_by("key", order).alias("kept_key"), F.sum("copies").alias("class_size"))
    return members.select("doc_id", "key"), placed.join(whole, "class").select("key", "class_id", "kept_key", "class_size", "links")


def _placed(docs: DataFrame, members: DataFrame, threshold: float, width: int, block_rows: int) -> DataFrame:
    """(key, doc_id, copies, class, links): each different text's least id, number of rows, class, and links that were found."""
    groups = members.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    # numbered as they are written, so the numbers are unique and stay
    groups = materialize(groups.withColumn("rep", F.monotonically_increasing_id()), "op9-groups")
    signed = groups.select("rep", F.explode("bands").alias("bucket"))
    shared = signed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialize(shared, "op9-shared")
    # few buckets are shared: a filter of them keeps the others' rows out of the shuffle. The result is written, so
    # that both sides of later joins are plain exchanges and a hot bucket can be split over tasks
    blocks_ = _bloom.block_count(shared.count(), 16, MAX_FILTER_BYTES)
    flagged, maybe = _bloom.flag(signed, F.col("bucket"), _bloom.build(shared, F.col("bucket"), blocks_), blocks_)
    bucketed = materialize(flagged.where(F.col(maybe)).select("rep", "bucket").join(shared, "bucket"), "op9-buckets")

    looked_at = materialize(groups.join(bucketed.select("rep").distinct(), "rep").select("rep", "key", "doc_id"), "op9-candidates")
    blocks_ = _bloom.block_count(looked_at.count(), 16, MAX_FILTER_BYTES)
    bloom = _bloom.build(looked_at, F.xxhash64("doc_id"), blocks_)
    again, maybe = _bloom.flag(docs, F.xxhash64("doc_id"), bloom, blocks_)
    texts = _shingled(again.where(F.col(maybe)).select(text_or_empty().alias("text")), width)
    # one set a text leaves a task, and the join uses the exchange by key
    sets = texts.groupBy("key").agg(F.any_value("set").alias("set")).join(looked_at.select("key", "rep"), "key").select("rep", "set")
    sets = materialize(sets, "op9-sets")

    pairs = bucketed.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    compared = materialize(_compared(pairs, sets), "op9-compared")
    comp = components(compared.where(F.col("similarity") >= threshold))
    left = materialize(_residual(bucketed, compared, comp), "op9-residual")
    open_ = left.select("rep").distinct()
    blocks_ = _bloom.block_count(open_.count(), 16, MAX_FILTER_BYTES)
    some, maybe = _bloom.flag(sets, F.xxhash64("rep"), _bloom.build(open_, F.xxhash64("rep"), blocks_), blocks_)
    more = materialize(_residual_links(left, some.where(F.col(maybe)).select("rep", "set"), threshold, block_rows).distinct(), "op9-links")
    comp = widened(comp, more)
    found = compared.where(F.col("similarity") >= threshold).select("a", "b").unionByName(more)
    links = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    out = groups.join(comp.join(links, "rep", "left"), "rep", "left")
    return out.select("key", "doc_id", "copies", F.coalesce("class", "rep").alias("class"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def near_classes(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5, block_rows: int = 512
) -> DataFrame:
    """One row a document: doc_id, class_id, class_size, links.

    links counts the other texts that the row's text was compared with and found to be at the threshold or
    above. Such links connect every class; within it, not all pairs are compared. Copies of a text have no links
    among each other.

    With 20 bands of 5 rows a pair of similarity 0.8 shares a bucket with probability 0.9996.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    members, groups = _grouped(docs, threshold, width, bands, rows, block_rows)
    return members.join(groups, "key").select("doc_id", "class_id", "class_size", "links")


def near_dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, bands: int = 20, rows: int = 5, block_rows: int = 512
) -> DataFrame:
    """The rows of df, all columns, with one document of each class: that of the least doc_id.

    Rows of classes of one document pass straight; the others are read again and decided by their words.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    members, groups = _grouped(docs, threshold, width, bands, rows, block_rows)
    shared = groups.where("class_size > 1")
    ids = materialize(members.join(shared.select("key"), "key").select("doc_id").distinct(), "op9-doubtful")
    blocks_ = _bloom.block_count(ids.count(), 16, MAX_FILTER_BYTES)
    h = F.xxhash64(F.col(f"`{doc_id}`"))
    flagged, maybe = _bloom.flag(df, h, _bloom.build(ids, F.xxhash64("doc_id"), blocks_), blocks_)
    columns = [F.col(f"`{c}`") for c in df.columns]
    (key,) = fresh(flagged, "key")

    @F.pandas_udf("string")
    def key_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([k for _, _, block in blocks(texts.tolist()) for k in word_keys(block)], dtype=object)

    rows_ = flagged.where(F.col(maybe)).withColumn(key, key_of(text_or_empty(text)))
    # one whole row for each text and task leaves the partial aggregate; of a class the kept text's rows pass
    order = F.struct(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"))
    one = rows_.groupBy(F.col(key).alias("key")).agg(F.min_by(F.struct(*columns), order).alias("row"))
    stay = one.join(shared.select("key", "kept_key"), "key", "left").where(F.col("kept_key").isNull() | (F.col("kept_key") == F.col("key")))
    return flagged.where(~F.col(maybe)).select(*columns).unionByName(stay.select("row.*"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLE_SQL: dict[str, str] = {}
