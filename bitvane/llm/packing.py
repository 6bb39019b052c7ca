"""Packing documents into sequences by minimum bin slack.

A document is its token ids and an end id. Whole windows are cut from its front; what remains,
under one window, is an item. Items matter by length only, so the multiset of remaining lengths,
a table of at most window - 1 counts, is all that the planner sees, whatever the corpus.

The planner fills one window after another. It puts in the longest remaining item, and a
subset-sum dynamic program over bitsets (bit s: a sum of s can be made, counts split in powers of
two) finds the multiset of remaining lengths that fills the window closest to capacity; walking
back gives the counts used. The pattern is repeated as often as the counts allow, which uses up a
length each time. If the best multiset leaves slack, an item that is left is cut to fill it, and
its other part, shorter, is an item of a new class. What is left at the end, less than a window,
is cut into sequences whose lengths are powers of two, which take no padding.

The plan, a bounded table of patterns, is carried out by rank: an item's rank among those of its
length, by task and then by place in the task's input, decides pattern and place. A task counts its
documents of each length as it tokenizes them, and adds those of the tasks before it, so documents
aren't shuffled to be ranked, and a length that a third of all documents share is no one task's.

Defined results: null text is empty, which is the end id alone; a special token's string in a text
is that token, as the tokenizers library has it; a very long text is tokenized as a whole by one
task and cut into whole windows and one item; rows that repeat, and null ids, are packed each; ties
of length go by place. No rows, no pieces. Extra columns, of whatever name, play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import map_frames, materialize, table, text_or_empty
from ._tokens import TokenizerFile, WordTokenizer
from ._words import give_back

#: A piece of the plan: items of class cls and ranks lo..hi-1. kind "fill": item lo + r is placed in
#: sequence first + r // each at offset + (r % each) * the class's length. kind "cut": the first
#: `length` ids of item lo + r go to sequence first + r at offset; the rest is item r of class rest.


@dataclass(frozen=True)
class Use:
    cls: int
    lo: int
    hi: int
    first: int
    each: int
    offset: int
    length: int
    rest: int = -1


@dataclass
class Plan:
    """uses by class; class c below the window is the items of c ids, those above are rests."""

    uses: dict[int, list[Use]]
    lengths: dict[int, int]
    sequences: int


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is closest to room without exceeding it.

    Longer lengths enter first, so of equal sums the one with the longest items is found.
    """
    steps: list[tuple[int, int, int]] = []  # (length, how many at once, sums before)
    reach, mask = 1, (1 << room + 1) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            chunk *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def make_plan(counts: dict[int, int], window: int) -> Plan:
    """Plan for so many items of each length 1..window - 1."""
    live: dict[int, list[list[int]]] = {x: [[x, 0, n]] for x, n in counts.items() if n}  # length: runs of (class, next rank, end)
    totals = {x: n for x, n in counts.items() if n}
    lengths = {x: x for x in totals}
    uses: dict[int, list[Use]] = {}
    sequences, next_class = 0, window

    def take(length: int, n: int) -> list[tuple[int, int, int]]:
        """(class, from, to) of n items of the length."""
        out = []
        while n:
            run = live[length][0]
            m = min(n, run[2] - run[1])
            out.append((run[0], run[1], run[1] + m))
            run[1] += m
            n -= m
            if run[1] == run[2]:
                live[length].pop(0)
            totals[length] -= m
        if not totals[length]:
            del totals[length], live[length]
        return out

    def use(length: int, each: int, times: int, first: int, offset: int) -> None:
        """Place each * times items, each in every one of times sequences."""
        at = 0  # of each * times
        for cls, lo, hi in take(length, each * times):
            while lo < hi:
                slot = at % each
                if slot or hi - lo < each:  # part of one sequence
                    m = min(each - slot, hi - lo)
                    uses.setdefault(cls, []).append(Use(cls, lo, lo + m, first + at // each, m, offset + slot * length, length))
                else:
                    m = (hi - lo) // each * each
                    uses.setdefault(cls, []).append(Use(cls, lo, lo + m, first + at // each, each, offset, length))
                lo += m
                at += m

    def cut(length: int, part: int, times: int, first: int, offset: int) -> None:
        """Cut the first `part` ids off times items, one for each sequence."""
        nonlocal next_class
        at = 0
        for cls, lo, hi in take(length, times):
            uses.setdefault(cls, []).append(Use(cls, lo, hi, first + at, 1, offset, part, next_class))
            lengths[next_class] = length - part
            live.setdefault(length - part, []).append([next_class, 0, hi - lo])
            totals[length - part] = totals.get(length - part, 0) + hi - lo
            next_class += 1
            at += hi - lo

    while totals:
        if sum(x * n for x, n in totals.items()) < window:
            break
        longest = max(totals)
        rest = dict(totals)
        rest[longest] -= 1
        used = best_fill(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = window - sum(x * n for x, n in used.items())
        times = min(totals[x] // n for x, n in used.items())
        filler = 0
        if slack:
            # all that is left is longer than the slack, else it would have been put in
            free = {x: totals[x] - used.get(x, 0) for x in totals}
            filler = min(x for x, n in free.items() if n > 0 and x > slack)
            mine = {**used, filler: used.get(filler, 0) + 1}
            times = min(totals[x] // n for x, n in mine.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            use(x, n, times, sequences, offset)
            offset += x * n
        if slack:
            cut(filler, slack, times, sequences, offset)
        sequences += times
    # less than a window is left: sequences of powers of two, largest first
    left = sum(x * n for x, n in totals.items())
    while left:
        room, offset = 1 << left.bit_length() - 1, 0
        left -= room
        while room:
            fits = [x for x in totals if x <= room]
            if fits:
                x = max(fits)
                use(x, 1, 1, sequences, offset)
                offset, room = offset + x, room - x
            else:
                cut(min(totals), room, 1, sequences, offset)
                room = 0
        sequences += 1
    return Plan(uses, lengths, sequences)


class Placement:
    """Looks up where the plan puts an item."""

    def __init__(self, plan: Plan):
        self.of = {}
        for cls, found in plan.uses.items():
            found = sorted(found, key=lambda u: u.lo)
            self.of[cls] = (np.array([u.lo for u in found]), found)
        self.lengths = plan.lengths

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start within the item, length, sequence, offset) of the item's pieces, in order."""
        out, cls, start = [], length, 0
        while cls >= 0:
            los, found = self.of[cls]
            u = found[int(np.searchsorted(los, rank, side="right")) - 1]
            r = rank - u.lo
            if u.rest < 0:
                out.append((start, u.length, u.first + r // u.each, u.offset + r % u.each * u.length))
                return out
            out.append((start, u.length, u.first + r, u.offset))
            start, cls, rank = start + u.length, u.rest, r
        raise AssertionError("the plan has no place for an item")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _held(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit, as the first byte tells."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _let_go(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


def _tokenized(docs: DataFrame, file: TokenizerFile, end_id: int, window: int) -> DataFrame:
    """(doc_id, doc_tokens, whole: the crc32 of each whole window, rest: the ids that remain, left: how many,
    part: the task, rank: the documents of that task before it with as many left, before: the whole windows
    of that task before it). The input's rows are counted as they come, so ranking needs no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, part = WordTokenizer.of(held.value), TaskContext.get().partitionId()
        seen, windows = [0] * window, 0
        for batch in batches:
            n, whole, rest, lefts, ranks, before = [], [], [], [], [], []
            for ids in tokenizer.ids(batch["text"].tolist()):
                ids = np.append(ids, np.uint32(end_id))
                left = len(ids) % window
                full = len(ids) - left
                n.append(len(ids))
                whole.append([_crc(ids[i : i + window]) for i in range(0, full, window)])
                rest.append(_held(ids[full:]))
                lefts.append(left)
                ranks.append(seen[left])
                before.append(windows)
                seen[left] += 1
                windows += full // window
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "doc_tokens": n, "whole": whole, "rest": rest, "left": lefts, "part": part, "rank": ranks, "before": before})
        tokenizer.forget()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(docs, run, f"doc_id {kind}, doc_tokens bigint, whole array<bigint>, rest binary, left int, part int, rank bigint, before bigint")


def pack(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path is a file of the driver's. Documents are read once and their ids written; what is
    shuffled are counts by task and length, and, where those are too many to broadcast, the ids once.
    """
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    tokens = materialize(_tokenized(docs, TokenizerFile.read(tokenizer_path), end_id, window), "op2-tokens")  # from here on ranks stay
    counted = materialize(tokens.groupBy("left", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("whole")).alias("wholes")), "op2-counts")
    totals = {r["left"]: r["n"] for r in counted.groupBy("left").agg(F.sum("n").alias("n")).collect()}  # at most window rows
    plan = make_plan({x: n for x, n in totals.items() if x}, window)

    # an item's rank: after the items of its length in earlier tasks
    earlier = Window.partitionBy("left").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("left", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranks_before"))
    starts = first.join(_running(counted.groupBy("part").agg(F.sum("wholes").alias("wholes"))), "part")
    placed = tokens.join(starts, ["part", "left"]).select(
        *("doc_id", "doc_tokens", "whole", "rest", "left"),
        (F.col("rank") + F.col("ranks_before")).alias("rank"),
        (F.col("before") + F.col("parts_before") + plan.sequences).alias("whole_from"),
    )
    held = df.sparkSession.sparkContext.broadcast(plan)  # patterns over at most window lengths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Placement(held.value)
        for batch in batches:
            rows: list[tuple] = []
            for k, (n, whole, rest, left, rank, at) in enumerate(batch[["doc_tokens", "whole", "rest", "left", "rank", "whole_from"]].itertuples(index=False)):
                for i, crc in enumerate(whole):
                    rows.append((k, i * window, window, int(crc), at + i, 0))
                if left:
                    ids = _let_go(rest)
                    for start, length, sequence, offset in places.pieces(int(left), int(rank)):
                        rows.append((k, n - left + start, length, _crc(ids[start : start + length]), sequence, offset))
            out = pd.DataFrame(rows, columns=["k", "start", "length", "ids_crc32", "sequence_id", "offset"], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].array[out["k"].to_numpy()] if len(out) else batch["doc_id"].array[:0])
            out.insert(4, "doc_tokens", batch["doc_tokens"].to_numpy()[out["k"].to_numpy()] if len(out) else np.zeros(0, np.int64))
            yield out.drop(columns="k")[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_frames(placed, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _running(by_part: DataFrame, block: int = 1000) -> DataFrame:
    """(part, parts_before): the sum of wholes over all earlier tasks, by blocks of tasks and then over the blocks."""
    blocked = by_part.withColumn("block", (F.col("part") / block).cast("int"))
    sums = blocked.groupBy("block").agg(F.sum("wholes").alias("sum"))
    # one row for each thousand tasks
    earlier = sums.select("block", F.coalesce(F.sum("sum").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("blocks_before"))
    within = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.withColumn("own", F.coalesce(F.sum("wholes").over(within), F.lit(0))).join(earlier, "block").select("part", (F.col("own") + F.col("blocks_before")).alias("parts_before"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
ORACLE_SQL: dict[str, str] = {}
