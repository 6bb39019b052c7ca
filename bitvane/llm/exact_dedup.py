"""Exact deduplication by two Bloom passes, in DataFrame functions alone.

Pass one enters the hash of every text in a one-probe Bloom filter of 2**44 bits and finds the cells
that are hit again. So large a filter is sparse: it is held as the numbers of its cells, merged in
each task before they are dealt, 8 bytes a text and no text. Pass two probes a dense Bloom filter of
the repeated cells, whose size goes with the repeats and not with the table, and which is
broadcast. A row that misses it has no copy and passes straight through. Only the rest, copies and a
few false alarms, are shuffled, as (digest, id, count) and combined before the shuffle, so a hot text
costs each task one row.

Texts are equal when identical after lower-casing A-Z. The filter's hash is of the text in full
lower case, which equal texts share too, so it never misses a copy; the digest decides.

Defined results: null text counts as empty, so null and empty texts are copies of each other; a null
id is never kept in preference to another id; rows that repeat both text and id form part of the
group, and one of them stays; a tie of ids is of such rows, which differ in other columns at most;
very long texts are hashed whole; no rows, no rows. Other columns pass with exact_dedup() and play no
part in verdicts(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _bloom
from ._spark import materialize, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lowered."""
    return F.sha2(F.translate(text_or_empty(text), UPPER, LOWER).cast("binary"), 256)


def flag_candidates(
    df: DataFrame, text: str = "text", bits_per_row: int = 16, probes: int = 3, max_filter_bytes: int = 256 << 20
) -> tuple[DataFrame, str]:
    """df with a boolean column, whose name is returned too: whether the row may have a copy.

    Every row with a copy is flagged. The filter has bits_per_row bits for each text that repeats;
    beyond max_filter_bytes it stops growing, which flags more rows without copies and changes no result.
    """
    h = F.xxhash64(F.lower(text_or_empty(text)))
    again = materialize(_bloom.repeated(df, h), "op5-repeated")
    return _bloom.flag_repeats(df, h, again, bits_per_row, probes, max_filter_bytes)


def verdicts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **filter_options) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged, flag = flag_candidates(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), **filter_options)
    narrow = materialize(flagged.select("doc_id", digest().alias("text_sha256"), F.col(flag).alias("maybe")), "op5")
    straight = narrow.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    each = narrow.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # written, so that both sides of the join are plain exchanges and a hot text's ids can be split over tasks
    groups = materialize(each.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")), "op5-groups")
    decided = each.join(groups, "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"),
        "text_sha256",
    )
    decided = decided.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )
    return straight.unionByName(decided)


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **filter_options) -> DataFrame:
    """The rows of df, all columns, without copies: of equal texts the largest doc_id stays."""
    flagged, flag = flag_candidates(df, text, **filter_options)
    columns = [F.col(f"`{c}`") for c in df.columns]
    # one whole row a text and task leaves the partial aggregate, so a hot text shuffles next to nothing
    order = F.struct(F.col(f"`{doc_id}`").isNotNull(), F.col(f"`{doc_id}`"))
    kept = flagged.where(F.col(flag)).groupBy(digest(text).alias("sha")).agg(F.max_by(F.struct(*columns), order).alias("row"))
    return flagged.where(~F.col(flag)).select(*columns).unionByName(kept.select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {"op5_exact_dedup": ORACLE}
