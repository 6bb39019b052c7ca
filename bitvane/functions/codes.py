"""Sign codes and the scores over them, as Column expressions and as Arrow functions.

A code holds one bit a dimension: 1 where the component is above zero. Bits are packed into 64-bit
words, least significant first; the last word's spare bits are 0. In DataFrames a code is either
scalar columns w0..wN-1 (BIGINT), which keep Hamming distances inside whole-stage codegen, or one
ARRAY<BIGINT>. NaN components have bit 0: a plain `x > 0` would be true for them in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


# -- sizes ------------------------------------------------------------------------------------


def word_count(dim: int) -> int:
    return -(-dim // WORD)


def padded_bytes(dim: int) -> int:
    """Bytes of a code: whole words."""
    return word_count(dim) * 8


def bits_in_word(dim: int, word: int) -> int:
    """How many of the word's bits are dimensions."""
    return max(0, min(WORD, dim - word * WORD))


def word_names(dim: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{i}" for i in range(word_count(dim))]


# -- packing ----------------------------------------------------------------------------------


def _bit(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x)


def pack_word(vector: Column, word: int) -> Column:
    """One 64-bit word of the vector's code."""
    bits = F.transform(F.slice(vector, word * WORD + 1, WORD), lambda x, i: F.when(_bit(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def with_code(df: DataFrame, dim: int, vector: str = "embedding", prefix: str = "w") -> DataFrame:
    """df with the code's words as columns, packed by expressions alone."""
    return df.withColumns({name: pack_word(F.col(vector), i) for i, name in enumerate(word_names(dim, prefix))})


def code_array(vector: Column, dim: int) -> Column:
    return F.array(*[pack_word(vector, i) for i in range(word_count(dim))])


def pack_numpy(vectors: np.ndarray) -> np.ndarray:
    """rows x words (uint64) of a rows x dim matrix."""
    rows, dim = vectors.shape
    with np.errstate(invalid="ignore"):
        bits = vectors > 0  # false for NaN
    packed = np.packbits(bits, axis=1, bitorder="little") if dim else np.zeros((rows, 0), np.uint8)
    out = np.zeros((rows, padded_bytes(dim)), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def stacked(column: pd.Series, dim: int, kind=np.float32) -> np.ndarray:
    """rows x dim of a column of arrays."""
    return np.stack(column.to_numpy()).astype(kind, copy=False) if len(column) else np.zeros((0, dim), kind)


# -- scores -----------------------------------------------------------------------------------


def hamming_words(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Differing bits of two codes given word by word; INT."""
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total.cast("int")


def approx_cosine(distance: Column, dim: int) -> Column:
    """The cosine that a Hamming distance stands for: cos(pi * distance / dim); 1 for no dimensions."""
    return F.cos(F.lit(float(np.pi)) * distance / F.lit(float(dim))) if dim else F.lit(1.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two float vectors in double; 0 where either has no length."""
    return cosine_by_norms(a, b, norm(a), norm(b))


def cosine_by_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """The same with the lengths given: worth it where a row meets many others.

    Written so that each argument is evaluated once: higher-order functions are not shared between
    the branches of a CASE.
    """
    return F.coalesce(F.try_divide(_dot(a, b), norm_a * norm_b), F.lit(0.0))


def asymmetric(query: Column, vector: Column) -> Column:
    """The query's components summed with the signs of the vector's bits; 0 counts as negative."""
    signed = F.zip_with(query, vector, lambda q, x: F.when(_bit(x), q.cast("double")).otherwise(-q.cast("double")))
    return F.aggregate(signed, F.lit(0.0), lambda s, x: s + x)


def asymmetric_words(query: Column, words: Sequence[Column], dim: int) -> Column:
    """asymmetric() of a packed code: 2 * the components under set bits, less all components."""
    total = F.aggregate(query, F.lit(0.0), lambda s, x: s + x.cast("double"))
    under = F.lit(0.0)
    for i, word in enumerate(words):
        part = F.transform(F.slice(query, i * WORD + 1, bits_in_word(dim, i)), _under(word))
        under = under + F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return under * 2 - total


def _under(word: Column):
    """Of a component and its place in the word: the component where its bit is set, else 0."""
    return lambda q, j: F.when(F.call_function("shiftrightunsigned", word, j).bitwiseAND(F.lit(1).cast("bigint")) == 1, q.cast("double")).otherwise(F.lit(0.0))


def ranked_score(score: Column, digits: int = 6) -> Column:
    """A score as rows are ranked by: rounded, with NaN below all others."""
    return F.round(F.nanvl(score, F.lit(float("-inf"))), digits)


# -- the same in numpy, for workers ------------------------------------------------------------


def hamming_numpy(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left rows x right rows distances of codes as pack_numpy() gives them."""
    out = np.zeros((len(left), len(right)), np.int32)
    a, b = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    step = max(1, (1 << 18) // max(1, len(right)))  # what is counted at once stays near the processor
    for at in range(0, len(left), step):
        part = out[at : at + step]
        for w in range(len(a)):
            part += np.bitwise_count(a[w, at : at + step, None] ^ b[w])
    return out


def cosine_numpy(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    a, b = left.astype(np.float64), right.astype(np.float64)
    both = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    with np.errstate(invalid="ignore"):
        return np.where(both == 0, 0.0, (a @ b.T) / np.where(both == 0, 1.0, both))


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; those without one stay zero."""
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        return np.where(size == 0, 0.0, x / np.where(size == 0, 1.0, size))


def rows_of(column: pa.ListArray, dim: int) -> np.ndarray:
    """rows x dim doubles of an Arrow column of vectors of that length; those that are null are zero, null elements NaN."""
    given = column if not column.null_count else column.fill_null([0.0] * dim)
    return given.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def ranked_numpy(score: np.ndarray, digits: int = 6) -> np.ndarray:
    """ranked_score() of an array: halves are rounded away from 0."""
    scale = 10.0**digits
    with np.errstate(invalid="ignore"):
        out = np.copysign(np.floor(np.abs(score) * scale + 0.5), score) / scale + 0.0
    return np.where(np.isnan(score), -np.inf, out)


def asymmetric_table(query: np.ndarray) -> np.ndarray:
    """bytes x 256: what each value of each byte of a code adds to the query's score."""
    dim = len(query)
    padded = np.zeros(padded_bytes(dim) * 8)
    padded[:dim] = query
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1.0
    return padded.reshape(-1, 8) @ signs.T


def asymmetric_numpy(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Scores of packed codes by a query's table."""
    raw = np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), -1)
    return table[np.arange(raw.shape[1]), raw].sum(axis=1)
