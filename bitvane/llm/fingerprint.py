"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k least of a text's distinct hashed shingles of five words, and all of them where
there are fewer. The sketch of a union is the k least of the sketches' hashes together, so parts
of a text, or of a corpus, are sketched apart and merged. From sketches alone come the
resemblance (the share of common hashes among the union's k least), the containment and the
number of distinct shingles ((k - 1) / the k-th least, as a share of the hash range).

As text, a fingerprint is the URL-safe base64 of the hashes in ascending order, 8 bytes each,
big-endian, without padding.

Defined results: null text counts as empty; a text without words has the empty fingerprint, which
is like another empty one to 1 and like any other to 0; a text of fewer than five words has one
shingle, of all of them; equal texts have equal fingerprints; a very long text is sketched whole, by
one task, in memory of some forty times its size. In edited_pairs() ids are integers, or cast to them;
rows are ordered by id, then by a hash of the text, then by the text, null ids first, so that rows which
repeat follow one another; the last row's successor is the first, and a single row is its own. No
rows, no rows. Other columns play no part there, whatever their names; in fingerprints() they pass,
and one of the output's name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_frames, or_none, table, text_or_empty
from ._words import blocks, shingles

K = 128
#: Runs of documents at most: the list of where they end is the driver's. A run is streamed, whatever its size.
MAX_RUNS = 100_000


def sketches(texts: Sequence[str | None], k: int = K, width: int = 5) -> list[np.ndarray]:
    """The bottom-k sketch of each text, ascending."""
    out = []
    for _, _, block in blocks(texts):
        hashes, offsets = shingles(block, width)
        for i in range(block.n):
            out.append(bottom(hashes[offsets[i] : offsets[i + 1]], k))
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct hashes."""
    if len(hashes) > 4 * k:
        # repeats could crowd the least ones out, so look further until enough are distinct
        take = 2 * k
        while take < len(hashes):
            got = np.unique(np.partition(hashes, take)[:take])
            if len(got) >= k:
                return got[:k]
            take *= 4
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).sum() / len(a))
    return min(1.0, r * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k))


def to_text(sketch: np.ndarray) -> str:
    return base64.urlsafe_b64encode(sketch.astype(">u8").tobytes()).decode().rstrip("=")


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)), ">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", k: int = K, out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each text."""

    @F.pandas_udf("string")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([to_text(s) for s in sketches(texts.tolist(), k)], dtype=object)

    return df.withColumn(out, sketch(F.col(f"`{text}`")))


def merged(df: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K, out: str = "fingerprint") -> DataFrame:
    """One fingerprint for each key: of all its parts together.

    Each task first merges what it holds of a key, so a key of any share of the rows sends one
    sketch a task.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[*(key if isinstance(key, tuple) else (key,)), _merge_texts(part[fingerprint], k)] for key, part in batch.groupby(keys, dropna=False, sort=False)]
            yield pd.DataFrame(rows, columns=[*keys, out])

    def final(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*part[keys].iloc[0], _merge_texts(part[out], k)]], columns=[*keys, out])

    schema = f"{kinds}, `{out}` string"
    held = df.select(*[F.col(f"`{c}`") for c in keys], F.col(f"`{fingerprint}`")).mapInPandas(partial, schema)
    # two steps: a hot key's partial sketches meet in up to 64 groups before they meet in one
    salted = held.groupBy(*keys, F.pmod(F.xxhash64(out), F.lit(64))).applyInPandas(lambda key, part: final(part), schema)
    return salted.groupBy(*keys).applyInPandas(final, schema)


def _merge_texts(parts: Sequence[str], k: int) -> str:
    got = np.zeros(0, np.uint64)
    for p in parts:
        got = merge(got, from_text(p), k)
    return to_text(got)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def edited(text: str, after: str) -> str:
    """The text with its last quarter, in code points, replaced by as many from the start of the next."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def edited_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, run_rows: int = 1000) -> DataFrame:
    """A row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt to runs of consecutive ids (integers), by quantiles of the id; many rows without an id,
    or with the same one, to several by the hash of the text. The first row of each run is also sent, marked,
    to the end of the run before it, so that a task meets every row's successor. Runs are read row
    after row and never held as a whole.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = docs.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("known")).first()
    wanted = min(max(1, -(-n["known"] // run_rows)), MAX_RUNS)
    cuts = [i / wanted for i in range(1, wanted)]
    found = docs.select(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(max(10_000, 4 * wanted)))).first()[0] if cuts else None
    # an id that is several quantiles has so many runs' rows: it is split by the hash of the text, as the null ids are
    ends, split = np.unique(np.array(found or [], np.int64), return_counts=True)
    unknown = min(max(1, -(-(n["all"] - n["known"]) // run_rows)), MAX_RUNS)
    base = unknown + np.concatenate(([0], np.cumsum(split)))

    @F.pandas_udf("int")
    def run_of(ids: pd.Series, has_id: pd.Series, hashes: pd.Series) -> pd.Series:
        """The first runs have the null ids; then come ids up to ends[0], and so on."""
        known, values = has_id.to_numpy(bool), ids.to_numpy(np.int64)  # no nulls here: they would make floats of the ids
        part = (hashes.to_numpy(np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        at = np.searchsorted(ends, values)
        own = np.zeros(len(at), np.int64)
        if len(ends):
            inside = np.minimum(at, len(ends) - 1)
            own = np.where(ends[inside] == values, np.minimum((part * split[inside]).astype(np.int64), split[inside] - 1), 0)
        return pd.Series(np.where(known, base[at] + own, np.minimum((part * unknown).astype(np.int64), unknown - 1)), dtype="int32")

    placed = docs.withColumn("run", run_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "hash"))
    order = F.struct("doc_id", "hash", "text")  # nulls first
    firsts = {r["run"]: r["first"] for r in placed.groupBy("run").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect()}  # a row a run
    runs = sorted(firsts)
    before = {run: runs[i - 1] for i, run in enumerate(runs)}
    # each run's first row is read again and sent to the end of the run before it
    heads = docs.sparkSession.createDataFrame([(run, before[run], *firsts[run]) for run in runs], "run int, to int, id bigint, h bigint")
    same = placed["run"].eqNullSafe(heads["run"]) & placed["doc_id"].eqNullSafe(heads["id"]) & (placed["hash"] == heads["h"])
    ahead = placed.join(F.broadcast(heads), same).groupBy("to").agg(F.min(order).alias("row"))  # of rows that repeat, one
    placed = placed.select("run", F.lit(False).alias("ahead"), "doc_id", "hash", "text").unionByName(ahead.select(F.col("to").alias("run"), F.lit(True).alias("ahead"), "row.doc_id", "row.hash", "row.text"))
    dealt = placed.repartition("run").sortWithinPartitions("run", "ahead", "doc_id", "hash", "text").drop("hash")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None  # (run, ahead, id, text, sketch) of the row before
        for batch in batches:
            ids, texts = or_none(batch["doc_id"]), batch["text"].tolist()
            rows = list(zip(batch["run"].tolist(), batch["ahead"].tolist(), ids, texts, sketches(texts, k)))
            if last is not None:
                rows.insert(0, last)
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            changed = [edited(a[3], b[3]) for a, b in pairs]
            out = []
            for (a, b), new, sketch in zip(pairs, changed, sketches(changed, k)):
                out.append((a[2], len(a[3]), _sha(new), to_text(a[4]), to_text(sketch), resemblance(a[4], sketch, k), resemblance(a[4], b[4], k)))
            if out:
                made = pd.DataFrame([row[1:] for row in out], columns=["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                made.insert(0, "doc_id", pd.array([row[0] for row in out], dtype="Int64"))
                yield made
            if rows:
                last = rows[-1]

    return map_frames(dealt, walk, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op6_fingerprint": op6_fingerprint}
ORACLE_SQL: dict[str, str] = {}
