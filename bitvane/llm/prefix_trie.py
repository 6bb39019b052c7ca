"""The trie of conversation prefixes, from the Cartesian tree over the sorted conversations' LCP array.

A conversation is a sequence of turns. Conversations are sorted by their turns' digests, so that equal
prefixes stand together, and cut into blocks. L[i] is how many turns conversation i shares with the one
before it. A node of the compact trie at depth L[i] is the interval between the nearest smaller values
on both sides of i (Berkman, Schieber and Vishkin, all nearest smaller values in parallel): inside a
block they are found with a stack; beyond it the blocks' minima tell which block has the
nearest smaller value, and that block's staircase of suffix or prefix minima tells where. Elements with
equal L and equal neighbours are one node. A node between its parent's depth and its own stands for a
chain of trie nodes with the same members, which are expanded at the end.

What a node holds is summed over its interval: what lies within a block is summed there, and an
interval over several blocks adds the end of its first block, whole blocks by prefix sums and
a table of minima, the start of its last, and the other such nodes inside it by a running sum over
their places. So no subtree is walked and no group is gathered: a task holds a block, the driver a row
of numbers a block, and a node of many members nothing but its interval. Only the hash of a list of ids
is computed in one task, as it must be, from a text of up to a block at a time.

Defined results: a null role or text is empty; turns of one conversation are in order of turn, nulls first,
ties by role and text; rows without a conversation's id belong to none and play no part; repeated rows are
turns like others; no rows, no nodes. A conversation travels as 24 bytes a turn in one row. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import kept, materialize, scope, table

#: Turns in a block of sorted conversations, on average.
BLOCK_TURNS = 100_000
KEY = 16  # bytes of a turn's digest
_FAR = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: kind 0: a node; 1: an entry for a node that may reach beyond the block; 2: a step of a staircase; 3: the block's sums.
FOUND = (
    "kind int, part int, depth int, above int, conv_id bigint, n_convs bigint, n_children bigint, leaves bigint, below bigint, sums array<bigint>, ends string, parent bigint,"
    "to_part int, to_depth int, to_side int, left_open boolean, right_open boolean, at bigint, side int, upto bigint, size int, least bigint"
)


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of key, the hex digest of role and text, and n, the text's code points.

    Turns are numbered by a sort over all rows, so no conversation's texts are gathered.
    """
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), text_.alias("text")).where("conv_id IS NOT NULL")
    placed = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    placed = placed.select("conv_id", F.monotonically_increasing_id().alias("place"), key.alias("key"), F.length("text").cast("bigint").alias("n"))
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "n"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """turns with each conversation's first h turns taken from the first one of its group of ids, h = crc32(id) % (most + 1)."""
    turns = materialize(turns, "op11-turns")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    both = turns.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """How many digests two paths share from the start."""
    n = min(len(a), len(b)) // KEY
    differ = np.flatnonzero((np.frombuffer(a, "V16", n) != np.frombuffer(b, "V16", n)) if n else [])
    return int(differ[0]) if len(differ) else n


class _Open:
    """A node that is being read: depth, first member's place (None: in an earlier block), and what it has so far."""

    __slots__ = ("depth", "first", "at", "last", "branches", "ends", "least", "leaves", "below", "low", "index", "waiting")

    def __init__(self, depth: int, first: int | None, at: int, low: int):
        self.depth, self.first, self.at, self.last, self.low = depth, first, at, at, low
        self.branches, self.ends, self.least, self.leaves, self.below = 0, [], _FAR, 0, 0
        self.index = None  # its row, once it is complete
        self.waiting: list[int] = []  # rows whose parent it is


def block_nodes(part: int, after: int, ids: np.ndarray, paths: list[bytes], lens: list[np.ndarray], first_shared: int, next_shared: int) -> list[dict]:
    """A block's rows as FOUND has them. first_shared: turns shared with the block before (-1: none), next_shared: with that after it."""
    m = len(ids)
    size = np.array([len(p) // KEY for p in paths])
    shared = np.array([first_shared] + [_shared(paths[i - 1], paths[i]) for i in range(1, m)])
    sums = lambda i, low, high: np.concatenate(([0, 0], np.cumsum(lens[i])))[low + 1 : high + 2].tolist()  # noqa: E731  code points of turns up to low..high
    rows: list[dict] = []
    leaf_at, below_at = np.zeros(m, np.int64), np.zeros(m, np.int64)
    starts: list[tuple[int, int]] = [(0, first_shared)]  # the staircase of prefix minima
    bottom = _Open(first_shared, None, 0, -1)
    stack = [bottom]

    def single(i: int, left: int, right: int) -> None:
        """The turns that conversation i shares with no other."""
        above = max(left, right)
        if size[i] <= above:
            return
        ends = hashlib.sha256(str(ids[i]).encode()).hexdigest()
        rows.append({"kind": 0, "depth": size[i], "above": above, "conv_id": ids[i], "n_convs": 1, "n_children": 0, "leaves": 1, "below": 0, "ends": ends})
        leaf_at[i] += 1
        if i == m - 1 and right > left:
            rows[-1] |= {"to_part": after, "to_depth": right, "to_side": 0}
        elif above >= 0:
            stack[-1].waiting.append(len(rows) - 1)
            stack[-1].leaves += 1

    def take_in(node: _Open, i: int) -> None:
        """Element i, of the node's depth: conversation i is the start of another branch, or ends here."""
        if size[i] > node.depth:
            node.branches += 1
        else:
            node.ends.append(str(ids[i]))
        node.last, node.least = i, min(node.least, int(ids[i]))

    def entry(node: _Open, low: int, right_open: bool) -> None:
        rows.append({"kind": 1, "depth": node.depth, "above": low, "n_children": node.branches, "sums": sums(node.at, low, node.depth), "ends": ",".join(node.ends), "left_open": node.first is None, "right_open": right_open, "at": node.at})
        for k in node.waiting:
            rows[k] |= {"to_part": part, "to_depth": node.depth, "to_side": int(right_open)}

    take_in(bottom, 0)
    for i in range(1, m):
        w = int(shared[i])
        if w <= stack[-1].depth:
            single(i - 1, int(shared[i - 1]), w)
        popped = None
        while stack and stack[-1].depth > w:
            node = stack.pop()
            if popped is not None:
                node.least = min(node.least, popped.least)
                node.leaves, node.below = node.leaves + popped.leaves, node.below + popped.below
                if popped.index is not None:
                    node.waiting.append(popped.index)
            low = max(w, stack[-1].depth if stack else -1)
            if node.first is None:
                entry(node, low, False)
                starts.append((i, w))
            else:
                n = i - node.first
                branches = node.branches + int(size[node.first] > node.depth)
                ends = ([str(ids[node.first])] if size[node.first] == node.depth else []) + node.ends
                chain = sums(node.at, low, node.depth)
                node.index = len(rows)
                if not branches:
                    leaf_at[node.first] += 1
                    node.leaves += 1
                rows.append({"kind": 0, "depth": node.depth, "above": low, "conv_id": node.least, "n_convs": n, "n_children": branches, "leaves": node.leaves, "below": node.below, "sums": chain, "ends": hashlib.sha256(",".join(ends).encode()).hexdigest()})
                for k in node.waiting:
                    rows[k]["parent"] = node.least
                own = (n - 1) * (chain[-1] - chain[0])
                below_at[node.first] += own
                node.below += own
            popped = node
        if not stack or stack[-1].depth < w:
            inner = popped is not None and popped.first is not None
            new = _Open(w, popped.first if inner else None if popped is not None else i - 1, i, stack[-1].depth if stack else -1)
            if popped is None:
                new.least = int(ids[i - 1])
            stack.append(new)
        top = stack[-1]
        if popped is not None:
            top.least, top.leaves, top.below = min(top.least, popped.least), top.leaves + popped.leaves, top.below + popped.below
            if popped.index is not None:
                top.waiting.append(popped.index)
        if popped is None and w > shared[i - 1]:
            single(i - 1, int(shared[i - 1]), w)
        take_in(top, i)
    single(m - 1, int(shared[m - 1]), next_shared)
    for k, node in enumerate(stack):
        if node.depth >= 0:
            entry(node, stack[k - 1].depth if k else -1, True)
    # the staircases, with the sums of what lies behind or before each step
    leaves, below = (np.concatenate(([0], np.cumsum(x))) for x in (leaf_at, below_at))
    behind = np.minimum.accumulate(ids[::-1])[::-1]
    before = np.concatenate(([_FAR], np.minimum.accumulate(ids)))
    for k, node in enumerate(stack):
        at = node.last
        rows.append({"kind": 2, "side": 0, "depth": node.depth, "upto": stack[k + 1].depth if k + 1 < len(stack) else _FAR, "at": at, "size": size[at], "conv_id": ids[at], "leaves": leaves[m] - leaves[at], "below": below[m] - below[at], "least": behind[at]})
    for k, (at, depth) in enumerate(starts):
        rows.append({"kind": 2, "side": 1, "depth": depth, "upto": starts[k - 1][1] if k else _FAR, "at": at, "leaves": leaves[at], "below": below[at], "least": before[at]})
    rows.append({"kind": 3, "depth": int(shared.min()), "n_convs": m, "leaves": leaves[m], "below": below[m], "least": behind[0]})
    return [{"part": part} | r for r in rows]


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = {}
    for name, kind in (c.strip().split() for c in FOUND.split(",")):
        values = [r.get(name) for r in rows]
        out[name] = pd.Series(values, dtype="object") if kind in ("array<bigint>", "string") else pd.array(values, dtype={"int": "Int32", "bigint": "Int64", "boolean": "boolean"}[kind])
    return pd.DataFrame(out)


class _Blocks:
    """A row of numbers a block, in order: what lies between two blocks, and the nearest with a smaller minimum."""

    def __init__(self, rows: list):
        self.parts = np.array([r["part"] for r in rows], np.int64)
        self.start = np.concatenate(([0], np.cumsum([r["n_convs"] for r in rows])))
        self.leaves, self.below = (np.concatenate(([0], np.cumsum([r[c] for r in rows]))) for c in ("leaves", "below"))
        self.lows = np.array([r["depth"] for r in rows], np.int64)
        self.least = [np.array([r["least"] for r in rows], np.int64)]  # by runs of 1, 2, 4, ... blocks
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            a, half = self.least[-1], 1 << len(self.least) - 1
            self.least.append(np.minimum(a[:-half], a[half:]))
        self.left, self.right = self._smaller(range(len(rows))), self._smaller(range(len(rows) - 1, -1, -1))

    def _smaller(self, order) -> np.ndarray:
        out, stack = np.full(len(self.lows), -1), []
        for b in order:
            while stack and self.lows[stack[-1]] >= self.lows[b]:
                stack.pop()
            out[b] = stack[-1] if stack else -1
            stack.append(b)
        return out

    def nearest(self, b: int, depth: int, to_right: bool) -> int:
        """The nearest block on that side with an element below depth; one after the last, -1 before the first."""
        b, jump = b + (1 if to_right else -1), self.right if to_right else self.left
        while 0 <= b < len(self.lows) and self.lows[b] >= depth:
            b = int(jump[b])
            if b < 0 and to_right:
                return len(self.lows)
        return b

    def between(self, a: int, b: int) -> tuple[int, int, int]:
        """Leaves, tokens and least id of the blocks after a and before b."""
        if b - a < 2:
            return 0, 0, _FAR
        k = (b - a - 1).bit_length() - 1
        return int(self.leaves[b] - self.leaves[a + 1]), int(self.below[b] - self.below[a + 1]), int(min(self.least[k][a + 1], self.least[k][b - (1 << k)]))


def _running(rows: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """rows with each value's sum over all rows up to it, written: sums within ranges of the order, and over the ranges before."""
    placed = materialize(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range")), "op11-ranges")
    totals = placed.groupBy("range").agg(*[F.sum(v).alias(v) for v in values]).collect()  # a row a task
    ahead, so_far = [], [0] * len(values)
    for r in sorted(totals, key=lambda r: r["range"]):
        ahead.append((r["range"], *so_far))
        so_far = [a + r[v] for a, v in zip(so_far, values)]
    names = [f"{v}_ahead" for v in values]
    before = rows.sparkSession.createDataFrame(ahead or [(0, *so_far)], ", ".join(["range int", *[f"{n} bigint" for n in names]]))
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({v: F.sum(v).over(upto) for v in values}).join(F.broadcast(before), "range")  # a row a task
    return summed.select(*rows.columns[: len(rows.columns) - len(values)], *[(F.col(v) + F.col(n)).alias(v) for v, n in zip(values, names)])


def _resolved(found: DataFrame, blocks: _Blocks) -> DataFrame:
    """Nodes over several blocks: left, right (first member, and one after the last), depth, above, conv_id, n_convs, n_children, leaves, below,
    sums, ends, and where the parent is: to_part, to_depth, to_side; entries, the references to it."""
    spark = found.sparkSession
    held = spark.sparkContext.broadcast(blocks)

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = held.value
        for batch in batches:
            own = np.searchsorted(b.parts, batch["part"].to_numpy())
            depth = batch["depth"].to_numpy()
            out = batch.copy()
            out["block"] = own
            out["from"] = [b.nearest(int(k), int(d), False) if o else k for k, d, o in zip(own, depth, batch["left_open"])]
            out["to"] = [b.nearest(int(k), int(d), True) if o else k for k, d, o in zip(own, depth, batch["right_open"])]
            out["at"] = b.start[own] + batch["at"].to_numpy()
            yield out

    entries = found.where("kind = 1").select("part", "depth", "above", "n_children", "sums", "ends", "left_open", "right_open", "at")
    entries = entries.mapInPandas(aim, "part int, depth int, above int, n_children bigint, sums array<bigint>, ends string, left_open boolean, right_open boolean, at bigint, block int, from int, to int")
    entries = materialize(entries.withColumn("entry", F.monotonically_increasing_id()), "op11-entries")

    index = spark.createDataFrame([(int(p), i, int(s)) for i, (p, s) in enumerate(zip(blocks.parts, blocks.start))], "part int, block int, start bigint")
    steps = found.where("kind = 2").join(F.broadcast(index), "part")  # a row a block
    end = spark.createDataFrame([(len(blocks.parts), -1, _FAR, int(blocks.start[-1]), 0, 0, _FAR)], "block int, depth int, upto bigint, at bigint, leaves bigint, below bigint, least bigint")
    lefts = steps.where("side = 0").select(F.col("block").alias("from"), F.col("depth").alias("l_depth"), F.col("upto").alias("l_upto"), (F.col("at") + F.col("start")).alias("left"), F.col("size").alias("l_size"), F.col("conv_id").alias("l_conv"), *[F.col(c).alias(f"l_{c}") for c in ("leaves", "below", "least")])
    rights = steps.where("side = 1").select("block", "depth", "upto", (F.col("at") + F.col("start")).alias("at"), "leaves", "below", "least").unionByName(end)
    rights = rights.select(F.col("block").alias("to"), F.col("depth").alias("r_depth"), F.col("upto").alias("r_upto"), F.col("at").alias("right"), *[F.col(c).alias(f"r_{c}") for c in ("leaves", "below", "least")])
    placed = entries.join(lefts, "from").where("depth > l_depth AND depth <= l_upto").join(rights, "to").where("depth > r_depth AND depth <= r_upto")
    placed = materialize(placed.withColumn("ends", F.when((F.col("ends") == ""), F.lit(None)).otherwise(F.col("ends"))), "op11-placed")

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = held.value
        for batch in batches:
            rows = [b.between(int(x), int(y)) for x, y in zip(batch["from"], batch["to"])]
            out = batch.copy()
            for k, name in enumerate(("leaves", "below")):
                out[name] = [r[k] for r in rows] + batch[f"l_{name}"] + batch[f"r_{name}"]
            out["conv_id"] = np.minimum(np.minimum([r[2] for r in rows] if rows else [], batch["l_least"]), batch["r_least"]).astype("int64")
            yield out[["left", "right", "depth", "to_part", "to_depth", "to_side", "l_size", "l_conv", "l_depth", "r_depth", "conv_id", "leaves", "below", "n_children", "at", "sums", "lift"]]

    # entries of one node, in several blocks, have the same neighbours
    part_of = spark.createDataFrame([(i, int(p)) for i, p in enumerate(blocks.parts)] + [(len(blocks.parts), -1)], "b int, p int")
    by_left = F.col("l_depth") >= F.col("r_depth")
    one = placed.groupBy("left", "right").agg(
        F.sum("n_children").alias("n_children"), F.min("at").alias("at"), F.max_by(F.struct(F.col("sums"), F.col("above")), "above").alias("chain"),
        *[F.any_value(c).alias(c) for c in ("depth", "from", "to", "l_size", "l_conv", "l_depth", "r_depth", "l_leaves", "l_below", "l_least", "r_leaves", "r_below", "r_least")],
    )
    one = one.join(F.broadcast(part_of), F.when(by_left, F.col("from")).otherwise(F.col("to")) == F.col("b")).select(
        "*", F.col("p").alias("to_part"), F.greatest("l_depth", "r_depth").alias("to_depth"), by_left.cast("int").alias("to_side"), F.col("chain.sums").alias("sums"), F.col("chain.above").alias("lift")
    ).drop("b", "p", "chain")
    schema = "left bigint, right bigint, depth int, to_part int, to_depth int, to_side int, l_size int, l_conv bigint, l_depth int, r_depth int, conv_id bigint, leaves bigint, below bigint, n_children bigint, at bigint, sums array<bigint>, lift int"
    nodes = one.mapInPandas(inside, schema).withColumn("above", F.greatest("l_depth", "r_depth"))
    nodes = nodes.withColumn("sums", F.expr("slice(sums, above - lift + 1, size(sums))")).withColumn("n_convs", F.col("right") - F.col("left"))
    nodes = nodes.withColumn("n_children", F.col("n_children") + (F.col("l_size") > F.col("depth")).cast("bigint"))
    own = (F.col("n_convs") - 1) * (F.element_at("sums", -1) - F.element_at("sums", 1))
    nodes = materialize(nodes.withColumns({"own": own, "leaf": (F.col("n_children") == 0).cast("bigint")}), "op11-wide")

    # other wide nodes inside: those whose element lies after the first member and before the end
    zero = F.lit(0).cast("bigint")
    events = nodes.select(F.col("at").alias("place"), F.lit(0).alias("query"), F.lit(-1).cast("bigint").alias("left"), F.lit(-1).cast("bigint").alias("right"), "own", "leaf")
    for query, place in ((1, F.col("left")), (2, F.col("right") - 1)):
        events = events.unionByName(nodes.select(place.alias("place"), F.lit(query).alias("query"), "left", "right", zero.alias("own"), zero.alias("leaf")))
    asked = _running(events, ["place", "query", "left", "right"], ["own", "leaf"]).where("query > 0")
    sign = F.when(F.col("query") == 2, F.lit(1)).otherwise(F.lit(-1))
    inner = asked.groupBy("left", "right").agg(F.sum(F.col("own") * sign).alias("inner_own"), F.sum(F.col("leaf") * sign).alias("inner_leaves"))
    nodes = nodes.join(inner, ["left", "right"]).withColumns({"below": F.col("below") + F.col("inner_own") - F.col("own"), "leaves": F.col("leaves") + F.col("inner_leaves")})

    # the ids that end at a node: its first member, if that does, and those of its entries, block after block
    parts = placed.where("ends IS NOT NULL").select("left", "right", F.col("block").alias("nth"), "ends")
    first = nodes.where("l_size = depth").select("left", "right", F.lit(-1).alias("nth"), F.col("l_conv").cast("string").alias("ends"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, None
        for batch in batches:
            out = []
            for left, right, _, ends in batch.itertuples(index=False):
                if (left, right) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (left, right), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
            yield pd.DataFrame(out, columns=["left", "right", "ends"])
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["left", "right", "ends"])

    ends = parts.unionByName(first).repartition("left", "right").sortWithinPartitions("left", "right", "nth").mapInPandas(hashed, "left bigint, right bigint, ends string")
    nodes = nodes.join(ends, ["left", "right"], "left").withColumn("ends", F.coalesce("ends", F.lit(_NO_ENDS)))
    refs = placed.select("left", "right", F.explode(F.array_compact(F.array(*[F.when(F.col(o), F.struct(F.col("part"), F.col("depth"), F.lit(s).alias("side"))) for s, o in ((0, "left_open"), (1, "right_open"))]))).alias("ref"))
    return nodes.select("left", "right", "depth", "above", "conv_id", "n_convs", "n_children", "leaves", "below", "sums", "ends", "to_part", "to_depth", "to_side"), refs


def trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of conversations (conv_id, turns: array of key, n): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Returned rows come from written tables.
    """
    spark = turns.sparkSession
    with scope(spark):
        paths = turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path"), F.transform("turns", lambda t: t["n"]).alias("lens"))
        paths = materialize(paths, "op11-paths")
        count = paths.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lens")).alias("turns")).first()
        wanted = max(1, -(-(count["turns"] or 0) // block_turns), -(-count["n"] // block_turns))
        blocks = materialize(paths.repartitionByRange(wanted, "path", "conv_id").select(F.spark_partition_id().alias("part"), "*"), "op11-blocks")
        edges = materialize(blocks.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")), "op11-edges")
        parts = sorted(r["part"] for r in edges.select("part").collect())  # a number a block

        @F.pandas_udf("int")
        def shared(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([-1 if x is None else _shared(x, y) for x, y in zip(a, b)], dtype="int32")

        order = spark.createDataFrame(list(zip(parts, [-1, *parts])), "part int, earlier int")
        seams = edges.join(order, "part").join(edges.select(F.col("part").alias("earlier"), F.col("last").alias("of")), "earlier", "left").select("part", shared("of", "first").alias("shared"))
        seam = {r["part"]: r["shared"] for r in seams.collect()}  # a number a block
        after = dict(zip(parts, parts[1:]))
        held = spark.sparkContext.broadcast((seam, after))

        def run(block: pd.DataFrame) -> pd.DataFrame:
            seam, after = held.value
            part = int(block["part"].iloc[0])
            block = block.sort_values(["path", "conv_id"], kind="stable")
            following = after.get(part, -1)
            return _frame(block_nodes(part, following, block["conv_id"].to_numpy(np.int64), block["path"].tolist(), block["lens"].tolist(), seam[part], seam.get(following, -1)))

        found = kept(blocks.groupBy("part").applyInPandas(run, FOUND), "op11-found")
        rows = sorted(found.where("kind = 3").select("part", "depth", "n_convs", "leaves", "below", "least").collect(), key=lambda r: r["part"])  # a row a block
        wide, refs = _resolved(found, _Blocks(rows))
        wide = kept(wide, "op11-nodes")
        named = kept(refs.join(wide.select("left", "right", F.col("conv_id").alias("named")), ["left", "right"]).select(F.col("ref.part").alias("to_part"), F.col("ref.depth").alias("to_depth"), F.col("ref.side").alias("to_side"), "named"), "op11-named")
    local = found.where("kind = 0")
    columns = ["depth", "above", "conv_id", "n_convs", "n_children", "leaves", "below", "sums", "ends"]
    outer = local.where("to_part IS NOT NULL").select(*columns, "to_part", "to_depth", "to_side").unionByName(wide.select(*columns, "to_part", "to_depth", "to_side"))
    outer = outer.join(named, ["to_part", "to_depth", "to_side"], "left").select(*columns, F.col("named").alias("parent"))
    return _expanded(local.where("to_part IS NULL").select(*columns, "parent").unionByName(outer))


def _expanded(nodes: DataFrame) -> DataFrame:
    """A row for each depth above a node's parent's."""
    chain = nodes.select("*", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))).alias("d"))
    bottom, top = F.col("d") == F.col("depth"), F.col("d") == F.col("above") + 1
    read = F.coalesce(F.element_at("sums", -1) - F.element_at("sums", F.col("d") - F.col("above")), F.lit(0))
    number: dict[str, Column] = {
        "conv_id": F.col("conv_id"), "depth": F.col("d").cast("bigint"), "parent_conv_id": F.when(F.col("d") > 0, F.when(top, F.col("parent")).otherwise(F.col("conv_id"))),
        "n_convs": F.col("n_convs"), "n_children": F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("bigint"), "n_leaves": F.col("leaves"),
        "saved_tokens": F.col("below") + (F.col("n_convs") - 1) * read, "ends_sha256": F.when(bottom, F.col("ends")).otherwise(F.lit(_NO_ENDS)),
    }
    return chain.select(*[c.alias(n) for n, c in number.items()])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
crc_table AS (
  SELECT list(c ORDER BY i) AS entries
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS t(i))),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, entries[xor(c, b) % 256 + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
parts AS (
  SELECT i.conv_id, 0 AS part, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.base AND place <= h
  UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND place > h),
keyed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, md5(length(role) || ':' || role || text) AS key, length(text) AS n FROM parts),
paths AS (
  SELECT conv_id, depth, n, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM paths GROUP BY depth, path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sizes AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ended AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM paths JOIN sizes USING (conv_id, depth) GROUP BY path),
above AS (
  SELECT left(path, (32 * up)::BIGINT) AS path, sum((n_convs - 1) * n) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM (SELECT nodes.*, n_children, unnest(range(depth + 1)) AS up FROM nodes LEFT JOIN kids USING (path)) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
  coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN above USING (path) LEFT JOIN kids USING (path) LEFT JOIN ended USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))
""",
}
