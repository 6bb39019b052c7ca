"""Word hashing over whole batches of texts in numpy.

A word is a maximal run of ASCII letters and digits or non-ASCII bytes of the lower-cased text's
UTF-8. Hashes are polynomials over the bytes, modulo 2**64, taken from prefix sums and mixed, so
any word, prefix or n-gram costs a subtraction and a product. They depend on the text alone: the
same on every machine and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK_BYTES + 4096)
        got = np.full(size, base, dtype=U)
        got[0] = 1
        got = np.cumprod(got, dtype=U)
        if size > 8 * BLOCK_BYTES:  # of an extremely long text: not worth keeping
            return got[:n]
        _powers[base] = got
    return got[:n]


class Block:
    """Some texts' bytes, with their words' places and prefix sums for hashing.

    in_word: for each byte whether words are of it; ascii_only: lower-case A-Z alone.
    """

    def __init__(self, texts: Sequence[str | None], in_word: np.ndarray = _WORD, ascii_only: bool = False):
        # each text ends in a line feed, which belongs to no word
        if ascii_only:
            parts = [(t or "").encode("utf-8", "replace").lower() + b"\n" for t in texts]
        else:
            parts = [(t or "").lower().encode("utf-8", "replace") + b"\n" for t in texts]
        self.n = len(parts)
        self.sizes = np.fromiter(map(len, parts), np.int64, self.n)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.ends_of_texts = np.cumsum(self.sizes)
        word = in_word[self.bytes]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]  # a text's last byte is never in a word, so they pair up
        size = len(self.bytes)
        self.inverse = powers(_INVERSE, size + 1)
        self.sums = np.zeros(size + 1, U)
        np.cumsum((self.bytes.astype(U) + U(1)) * powers(_BASE, size), dtype=U, out=self.sums[1:])
        #: of each text, the number of its words, and its first word's index
        self.first = np.searchsorted(self.starts, np.concatenate(([0], self.ends_of_texts))[:-1])
        self.counts = np.diff(np.append(self.first, len(self.starts)))

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + U(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1))

    def words(self, salt: int = 0) -> np.ndarray:
        return self.hash(self.starts, self.ends, salt)

    def prefixes(self, n: int, salt: int) -> np.ndarray:
        return self.hash(self.starts, np.minimum(self.starts + n, self.ends), salt)


def blocks(texts: Sequence[str | None], in_word: np.ndarray = _WORD, ascii_only: bool = False) -> Iterator[tuple[int, int, Block]]:
    """(from, to, Block) for runs of texts of about BLOCK_BYTES."""
    at = size = 0
    for i, t in enumerate(texts):
        length = len(t or "")
        if size and size + length > BLOCK_BYTES:
            yield at, i, Block(texts[at:i], in_word, ascii_only)
            at, size = i, 0
        size += length
    if at < len(texts):
        yield at, len(texts), Block(texts[at:], in_word, ascii_only)
    give_back()


def give_back() -> None:
    """Return freed memory: a worker that waits for its next task shares the executor's limit with others."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def shingles(block: Block, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): text i's shingles of so many words are hashes[offsets[i]:offsets[i+1]].

    In the order of the text, with repeats. A text of fewer words, but at least one, has one
    shingle of all its words; one without words has none.
    """
    words, counts = block.words(), block.counts
    out = np.maximum(counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(out)))
    at = np.repeat(block.first - offsets[:-1], out) + np.arange(offsets[-1])
    left = np.repeat(np.minimum(counts, width), out)
    h = np.zeros(len(at), U)
    for j in range(width):
        has = left > j
        h = h * U(0xD6E8FEB86659FD93) + np.where(has, words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else U(0), U(j + 1))
    return mix(h), offsets
