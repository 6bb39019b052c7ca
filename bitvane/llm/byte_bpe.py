"""Byte-level BPE, encoded by a monoid tree reduction.

The monoid is the encodings of byte strings under "encode the concatenation". An encoding is a
leaf where the string is a token or short; a longer string is halved, its halves are encoded by
themselves and joined. A join re-encodes a window around the boundary, made of the last tokens of
the left half and the first of the right, and grows the window until the tokens outside it
provably stay: until each token pair at the window's edges encodes to itself. A sequence all of
whose neighbouring pairs encode to themselves is the encoding of the whole, so the join is exact,
and windows stay small. Decoding halves the ids likewise, maps short runs of them to bytes and
concatenates up that tree.

A text is split by the tokenizer's pattern; each match is encoded by itself, which makes joins at
matches trivial (there, concatenation is the product). Distinct matches are remembered, in two
generations of bounded size.

Defined results: null text counts as empty, which has no ids; lone surrogates cannot occur in a
column; a very long text, or a match without end, is encoded as a whole in one task, its match by
halves; repeated rows are encoded alike; of equal ranks of pairs the leftmost is merged first; ids
that are not in the vocabulary raise KeyError in decode(). No rows, no rows. Columns that clash with
the output are replaced by it; others pass.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_frames, table, text_or_empty

#: Bytes up to which a string is encoded by merging alone.
LEAF = 12
#: Tokens up to which ids are decoded by mapping alone.
DECODED_LEAF = 512
_NONE = 1 << 40


def read_ranks(lines: Sequence[bytes]) -> dict[bytes, int]:
    """Lines of base64 of a token's bytes, a space, and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most_words: int = 250_000):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.most_words = most_words
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    # -- the leaves --------------------------------------------------------------------------

    def merged(self, raw: bytes) -> list[int]:
        """The encoding of a leaf or window: merge the pair of least rank, leftmost first, while there is one."""
        if len(raw) > 4 * LEAF:
            return self._merged_by_heap(raw)
        get = self.ranks.get
        ends = list(range(1, len(raw) + 1))  # where each part ends; it starts where the one before ends
        pairs = [get(raw[i : i + 2], _NONE) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            at = pairs.index(best)
            del ends[at], pairs[at]
            start, stop = ends[at - 1] if at else 0, ends[at]
            if at < len(pairs):
                pairs[at] = get(raw[start : ends[at + 1]], _NONE)
            if at:
                pairs[at - 1] = get(raw[ends[at - 2] if at > 1 else 0 : stop], _NONE)
        ranks, out, start = self.ranks, [], 0
        for stop in ends:
            out.append(ranks[raw[start:stop]])
            start = stop
        return out

    def _merged_by_heap(self, raw: bytes) -> list[int]:
        """The same for a window that had to grow long: in a run of one letter every token may move."""
        ranks, n = self.ranks, len(raw)
        end = list(range(1, n + 1))  # of the part that starts at i; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the parts has changed meanwhile
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    # -- the product -------------------------------------------------------------------------

    def keeps(self, a: int, b: int) -> bool:
        """Whether the pair of tokens is the encoding of its own bytes."""
        got = self.stable.get((a, b))
        if got is None:
            if len(self.stable) > 300_000:
                self.stable.clear()
            got = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of what left and right encode."""
        if not left or not right:
            return left + right
        if self.keeps(left[-1], right[0]):
            return left + right
        i = j = 1  # tokens of each side in the window
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            raw = b"".join([self.bytes_of[t] for t in left[len(left) - i :] + right[:j]])
            window = self.merged(raw)
            left_holds = i == len(left) or self.keeps(left[-i - 1], window[0])
            right_holds = j == len(right) or self.keeps(window[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            if not left_holds:
                i = 2 * i
            if not right_holds:
                j = 2 * j

    def _halves(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.merged(raw)
        mid = len(raw) // 2
        return self.join(self._halves(raw[:mid]), self._halves(raw[mid:]))

    def encode_bytes(self, raw: bytes) -> list[int]:
        """One match of the pattern."""
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self._halves(raw)

    # -- texts -------------------------------------------------------------------------------

    def _learn(self, word: str) -> tuple[int, ...]:
        got = self.old.get(word)
        if got is None:
            got = tuple(self.encode_bytes(word.encode("utf-8")))
        if len(word) <= 64:
            self.young[word] = got
            if len(self.young) > self.most_words:
                self.old, self.young = self.young, {}
        return got

    def encode(self, text: str) -> list[int]:
        """The product of the encodings of the pattern's matches."""
        out: list[int] = []
        extend, learn = out.extend, self._learn
        for word in self.split.findall(text):
            got = self.young.get(word)
            extend(got if got is not None else learn(word))
        return out

    def decode(self, ids: Sequence[int]) -> bytes:
        """Concatenate up the tree: a leaf is the bytes of some tokens, a node its two halves' bytes."""
        if len(ids) <= DECODED_LEAF:
            of = self.bytes_of
            return b"".join([of[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@dataclass(frozen=True)
class Vocabulary:
    """Ranks and pattern, with a digest that tells them from any others."""

    ranks: dict[bytes, int]
    pattern: str
    key: str

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        found = hashlib.sha256(pattern.encode() + b"\0")
        for token, rank in sorted(ranks.items()):
            found.update(b"%d %d " % (rank, len(token)) + token)
        return cls(ranks, pattern, found.hexdigest())


class Coder:
    """A ByteBpe for each process and vocabulary, made from a broadcast one."""

    made: dict[str, ByteBpe] = {}

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> ByteBpe:
        if vocabulary.key not in cls.made:
            cls.made[vocabulary.key] = ByteBpe(vocabulary.ranks, vocabulary.pattern)
        return cls.made[vocabulary.key]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file beside the driver."""
    with open(path, "rb") as f:
        return read_ranks(f.readlines())


def encoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text, array<int>."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.of(ranks, pattern))  # one vocabulary

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder.of(held.value)
        for texts in batches:
            yield pd.Series([np.array(coder.encode(t or ""), np.int32) for t in texts], dtype=object)

    return df.withColumn(out, encode(F.col(f"`{text}`")))


def decoded(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """df with the bytes that each array of ids stands for; null ids count as none."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.of(ranks, pattern))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder.of(held.value)
        for arrays in batches:
            yield pd.Series([coder.decode([] if a is None else a.tolist()) for a in arrays], dtype=object)

    return df.withColumn(out, decode(F.col(f"`{ids}`")))


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay in the task."""
    held = df.sparkSession.sparkContext.broadcast(Vocabulary.of(ranks, pattern))
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(held.value)
        numbers = [str(i) for i in range(max(coder.bytes_of, default=0) + 1)]
        for batch in batches:
            rows = []
            for t in batch["text"].tolist():
                ids = coder.encode(t)
                said = " ".join([numbers[i] for i in ids]).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            made = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            made.insert(0, "doc_id", batch["doc_id"].array)
            yield made

    return map_frames(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
